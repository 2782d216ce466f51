"""What several operators share: tables in the shared folder, connected components, splits by id, queries streamed past an index."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..components import connected_components
from ..tables import discard, in_batches, staged

__all__ = ["connected_components", "discard", "in_batches", "split_of", "staged", "streamed", "table"]


def split_of(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.col(doc_id).cast("string")) % folds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streamed(held: DataFrame, asked: DataFrame, key: str, run: Callable, schema: str) -> DataFrame:
    """Brings the rows of held and of asked that share a key into one task, those of held first, and maps them in Arrow batches.

    run gets an iterator of (key, 0 for held or 1 for asked, batch of that side's other columns) and yields batches of schema. A task
    has one batch at a time, so the asked rows of a key are never gathered; what run keeps of the held rows is its own affair.
    """
    mine, theirs = ([c for c in df.columns if c != key] for df in (held, asked))
    kinds = {"held": held.select(F.struct(*mine)).schema[0].dataType, "asked": asked.select(F.struct(*theirs)).schema[0].dataType}
    none = lambda side: F.lit(None).cast(kinds[side]).alias(side)
    both = held.select(key, F.lit(0).alias("_side"), F.struct(*mine).alias("held"), none("asked")).unionByName(
        asked.select(key, F.lit(1).alias("_side"), none("held"), F.struct(*theirs).alias("asked"))
    )

    def pieces(batches):
        for batch in batches:
            keys, sides = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            start = 0
            for stop in range(1, len(keys) + 1):
                if stop == len(keys) or (keys[stop], sides[stop]) != (keys[start], sides[start]):
                    part = batch.column(2 + sides[start]).slice(start, stop - start)
                    yield keys[start], sides[start], pa.RecordBatch.from_arrays(part.flatten(), [f.name for f in part.type])
                    start = stop

    n = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(n, key).sortWithinPartitions(key, "_side").mapInArrow(lambda batches: run(pieces(batches)), schema)
