"""Exact order statistics of groups of any size, without a task that holds a group's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import discard, staged

#: Different values that one task may order; what a sketch's ranks are off by at most is 1 / ACCURACY of the rows it saw.
FEW = 10_000
ACCURACY = 10_000
GRID = 1_000


def order_statistics(df: DataFrame, value: str, by: list[str], ranks: dict[str, Column]) -> DataFrame:
    """(by, a column a name): the values of the given 0-based ranks, expressions of each group's count n, among its values in order.

    A rank is sought between two bounds. A mergeable sketch of what lies between them names two values around the rank, wherever
    they fall; the rows
    below, at and between these are counted, and either one of the two is the value or the search goes on strictly between them,
    among a 300th of the rows or so. Where FEW rows or less are between the bounds their values are counted and ordered. Ties cost nothing, as
    rows equal to a bound are only counted. Nulls have no rank; NaN is the largest value.
    """
    if not ranks:
        return df.select(*by).distinct()
    group = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")  # so that null is a group as others are
    data = df.where(F.col(value).isNotNull()).select(group.alias("_g"), F.col(value).cast("double").alias("_v"))
    groups = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("_g", group)
    sought = groups.select("_g", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), k.cast("long").alias("k")) for name, k in ranks.items()])).alias("s"), F.col("n").alias("inside"))
    sought = sought.select("_g", "s.*", "inside", F.lit(0).cast("long").alias("below"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    open_, found, used = staged(sought, "rank-open"), [], []
    used.append(open_)
    between = (F.col("lo").isNull() | (F.col("_v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("_v") < F.col("hi")))
    keys = ["_g", "name"]
    while (many := open_.where(F.col("inside") > FEW)).limit(1).count():
        # Groups with more than FEW rows left, so few that each task can have all: rows are neither shuffled nor sorted for them.
        rows = data.join(F.broadcast(many), "_g").where(between)
        # Values at 1001 even ranks; those around the rank sought, with one to spare on either side for what the sketch is off by.
        grid = rows.groupBy(*keys, "k", "below", "inside").agg(F.percentile_approx("_v", [i / GRID for i in range(GRID + 1)], ACCURACY).alias("grid"))
        share = (F.col("k") - F.col("below")) / F.col("inside") * GRID
        around = lambda i: F.get("grid", F.greatest(F.lit(0), F.least(F.lit(GRID), i)).cast("int"))
        marks = grid.select(*keys, around(F.floor(share) - 1).alias("a"), around(F.ceil(share) + 1).alias("b"))
        counted = rows.join(F.broadcast(marks), keys).groupBy(*keys, "k", "inside", "below", "lo", "hi", "a", "b").agg(
            F.count_if(F.col("_v") < F.col("a")).alias("n_below"), F.count_if(F.col("_v") == F.col("a")).alias("n_a"),
            F.count_if((F.col("_v") > F.col("a")) & (F.col("_v") < F.col("b"))).alias("n_between"), F.count_if((F.col("_v") == F.col("b")) & (F.col("b") > F.col("a"))).alias("n_b"),
        )
        at = F.col("k") - F.col("below")
        to_a, to_between = F.col("n_below") + F.col("n_a"), F.col("n_below") + F.col("n_a") + F.col("n_between")
        to_b = to_between + F.col("n_b")
        place = F.when(at < F.col("n_below"), "before").when(at < to_a, "a").when(at < to_between, "between").when(at < to_b, "b").otherwise("behind")
        settled = staged(counted.withColumn("place", place), "rank-counted")
        used.append(settled)
        found.append(settled.where("place in ('a', 'b')").select(*keys, F.when(F.col("place") == "a", F.col("a")).otherwise(F.col("b")).alias("value")))
        pick = lambda before, within, behind: F.when(F.col("place") == "before", before).when(F.col("place") == "between", within).otherwise(behind)
        further = settled.where("place not in ('a', 'b')").select(
            *keys, "k", pick(F.col("n_below"), F.col("n_between"), F.col("inside") - to_b).alias("inside"), (F.col("below") + pick(F.lit(0), to_a, to_b)).alias("below"),
            pick(F.col("lo"), F.col("a"), F.col("b")).alias("lo"), pick(F.col("a"), F.col("b"), F.col("hi")).alias("hi"),
        )
        open_ = staged(open_.where(F.col("inside") <= FEW).unionByName(further.select(*open_.columns)), "rank-open")
        used.append(open_)
    # What rounds have narrowed is as few; groups that were small from the start may be any number.
    narrowed = F.col("lo").isNotNull() | F.col("hi").isNotNull()
    last = data.join(F.broadcast(open_.where(narrowed)), "_g").where(between).unionByName(data.join(open_.where(~narrowed), "_g"))
    values = last.groupBy(*keys, "k", "below", "_v").agg(F.count(F.lit(1)).alias("n"))
    ranked = values.withColumn("upto", F.col("below") + F.sum("n").over(W.partitionBy(*keys).orderBy("_v")))
    every = ranked.where((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("n") <= F.col("k"))).select(*keys, F.col("_v").alias("value"))
    for more in found:
        every = every.unionByName(more)
    out = staged(groups.join(every, "_g").groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in ranks]), "rank-found")
    discard(*used)
    return out


def medians(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, median): the mean of the two middle values of each group, which are one if their number is odd."""
    middle = order_statistics(df, value, by, {"_low": F.floor((F.col("n") - 1) / 2), "_high": F.floor(F.col("n") / 2)})
    return middle.select(*by, ((F.col("_low") + F.col("_high")) / 2).alias("median"))
