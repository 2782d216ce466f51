"""Positions in an order over all rows, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import staged


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with name, the 1-based position of each row in the order of the columns.

    Ranges of the order are sorted and numbered each by itself and written once, so that all that reads them sees the same ranges;
    the rows before a range are a sum over one row a range.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = staged(parts.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id() % (1 << 33)}), "numbered")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return parts.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def _within(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """df with name, the 0-based position of each row in its group: its place among all rows less that of the group's first."""
    placed = numbered(df, [*by, *order], "_place")
    firsts = placed.groupBy(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)]).agg(F.min("_place").alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)]
    return placed.join(firsts, same).withColumn(name, F.col("_place") - F.col("_first")).drop("_place", "_first", *[f"_{i}" for i in range(len(by))])


def allotted(wants: DataFrame, key: str, by: list[str], used: DataFrame, held: DataFrame, first: int) -> DataFrame:
    """wants with number: null for the row of a group (columns by) that takes the plain name, else the number that makes it another.

    In key order the first row takes the plain name, unless held (by) has it; the others take first, first + 1, ... without the
    numbers that used (by, number) gives away. A used number lies behind as many free ones as its value less first less its rank; sorted
    among the wishes by that, each wish stands at its own number. So groups are nowhere gathered: a name that a third of all rows want
    is numbered by ranges of its rows. Nulls in by are equal to each other; equal keys are told apart at will.
    """
    ranked = _within(wants, by, [key], "_rank")
    plain = held.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)]).distinct().withColumn("_held", F.lit(1))
    ranked = ranked.join(plain, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)], "left").drop(*[f"_{i}" for i in range(len(by))])
    ranked = staged(ranked.withColumn("_behind", F.col("_rank") - 1 + F.coalesce("_held", F.lit(0))).drop("_rank", "_held"), "allotted")
    taken = _within(used.where(F.col("number") >= first).select(*by, F.col("number").cast("long")).distinct(), by, ["number"], "_rank")
    taken = taken.select(*by, (F.col("number") - first - F.col("_rank")).alias("_behind"), F.lit(0).alias("_kind"))
    rows = ranked.where("_behind >= 0").withColumn("_kind", F.lit(1)).unionByName(taken, allowMissingColumns=True)
    asked = _within(rows, by, ["_behind", "_kind"], "_at").where("_kind = 1").withColumn("number", F.col("_at") + first)
    alone = ranked.where("_behind < 0").withColumn("number", F.lit(None).cast("long"))
    return alone.drop("_behind").unionByName(asked.drop("_behind", "_kind", "_at"))
