"""Rankings and pass/fail over groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def all_pass(df: DataFrame, group: str, category: str, value: str, limits: DataFrame) -> DataFrame:
    """(group, passed, failed): whether every row reaches its category's limit (limits: category, limit); unknown categories pass."""
    joined = df.join(F.broadcast(limits), category, "left")  # a row a category
    ok = F.col("limit").isNull() | (F.col(value) >= F.col("limit"))
    return joined.groupBy(group).agg(F.every(ok).alias("passed"), F.count_if(~ok).alias("failed"))


def display_order(df: DataFrame, by: list[str]) -> DataFrame:
    """df with place: its position in the order of `by` (case folded), within the first of them."""
    from pyspark.sql import Window as W

    return df.withColumn("place", F.row_number().over(W.partitionBy(by[0]).orderBy(*[F.lower(c) for c in by[1:]], *by[1:])))
