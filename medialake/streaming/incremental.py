"""New files only: a file stream with a checkpoint takes each inventory file once, and keeps facet counts up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.facets import facets


def facet_updates(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str) -> None:
    """Take every inventory file (Parquet) of the folder that no earlier call took, and append its facet counts to out by batch.

    Counts of a batch are written under its number, so a batch that is repeated after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        facets(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(folder)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def facet_totals(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("facet", "value").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.sum("duration").alias("duration"))
