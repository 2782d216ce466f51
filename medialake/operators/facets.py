"""Faceted statistics of an inventory.

Units have role, genre, style, gender, reverb, vocal_type, compression, music_key, sdr, bytes and duration. A pair is one unit
but two stems. All facets come from one pass: each unit is expanded to its (facet, value) entries, and one aggregation with
map-side combination counts them, whatever the number of facets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.signal import fade_window
from .selection import medians

INSTRUMENT_SIDE = ("genre", "style")
VOCAL_SIDE = ("gender", "reverb", "vocal_type")
SHARED = ("compression", "music_key")


def bucket(df: DataFrame, name: str) -> DataFrame:
    """(name, n, bytes, duration) per non-empty value of a column."""
    return df.where((F.col(name).isNotNull()) & (F.col(name) != "")).groupBy(F.col(name).alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.sum("duration").alias("duration")
    )


def stems(units: DataFrame) -> DataFrame:
    """One row a stem: a pair gives an instrumental and a vocal side, each half of its bytes and duration counted once."""
    side = F.when(F.col("role") == "pair", F.array(F.lit("instrumental"), F.lit("vocal"))).otherwise(F.array("role"))
    return units.withColumn("side", F.explode(side))


def facets(units: DataFrame) -> DataFrame:
    """(facet, value, n, bytes, duration): instrument-side facets of instrumentals and pairs, vocal-side facets of vocals and pairs,
    shared facets once a stem."""
    role = F.col("role")
    entries = [F.when(role.isin("instrumental", "pair"), F.struct(F.lit(f).alias("facet"), F.col(f).alias("value"), F.lit(1).alias("weight"))) for f in INSTRUMENT_SIDE]
    entries += [F.when(role.isin("vocal", "pair"), F.struct(F.lit(f).alias("facet"), F.col(f).alias("value"), F.lit(1).alias("weight"))) for f in VOCAL_SIDE]
    twice = F.when(role == "pair", 2).otherwise(1)
    entries += [F.struct(F.lit(f).alias("facet"), F.col(f).alias("value"), twice.alias("weight")) for f in SHARED]
    rows = units.select("bytes", "duration", F.explode(F.array(*entries)).alias("e")).where("e.value is not null and e.value <> ''")
    return rows.groupBy("e.facet", "e.value").agg(F.sum("e.weight").alias("n"), F.sum("bytes").alias("bytes"), F.sum("duration").alias("duration"))


def role_counts(units: DataFrame) -> DataFrame:
    """One row: units by role, and the total in which a pair counts for both its stems."""
    count = lambda r: F.count_if(F.col("role") == r)
    return units.agg(
        count("instrumental").alias("instrumental"), count("vocal").alias("vocal"), count("sample").alias("samples"), count("pair").alias("pairs"),
        (F.count(F.lit(1)) + count("pair")).alias("total_files"),
    )


def top_with_other(counts: DataFrame, total: DataFrame, k: int) -> DataFrame:
    """The k most frequent names and a row "other" for the rest of the total, never below 0; total has one row, total_files."""
    top = counts.orderBy(F.desc("n"), "name").limit(k).select("name", "n")
    tagged = counts.agg(F.sum("n").alias("tagged"))
    other = total.crossJoin(tagged).select(F.lit("other").alias("name"), F.greatest(F.col("total_files") - F.coalesce("tagged", F.lit(0)), F.lit(0)).alias("n"))  # one row each
    return top.unionByName(other)


def continuous(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, n, total, mean, median) of each group; the median by selection, so that no task holds a group's values."""
    sums = df.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    middle = medians(df.select(*by, value), value, by)
    same = F.lit(True)
    for c in by:
        same = same & sums[c].eqNullSafe(middle[c])
    return sums.join(middle, same, "left").select(*[sums[c] for c in by], "n", "total", "mean", "median")


def with_share(counts: DataFrame, within: list[str]) -> DataFrame:
    """counts with share, percent of the sum within a group; and relative, the ratio to the group's peak."""
    w = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
    return counts.withColumn("share", F.round(100 * F.col("n") / F.sum("n").over(w), 4)).withColumn("relative", F.round(F.col("n") / F.max("n").over(w), 6))


def histogram(df: DataFrame, value: str, width: int = 5) -> DataFrame:
    """(bin, n) of width-wide bins from the least to the largest value, empty ones too; the top edge has its own bin, and
    values that are not finite are left out."""
    finite = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))
    n = finite.groupBy((F.floor(F.col(value) / width) * width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = n.agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).where("lo is not null").select(F.explode(F.sequence("lo", "hi", F.lit(width).cast("long"))).alias("bin"))
    return bins.join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def kpis(units: DataFrame) -> DataFrame:
    return units.agg(F.count(F.lit(1)).alias("units"), F.sum("bytes").alias("bytes"), F.sum("duration").alias("duration"), F.countDistinct("role").alias("roles"))


def mode_largest(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value, n): the most common value of each group; among equals the largest."""
    counts = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(by).agg(F.max_by(value, F.struct("n", value)).alias(value), F.max("n").alias("n"))


def outcome_counts(df: DataFrame, outcome: str, order: tuple[str, ...]) -> DataFrame:
    """(outcome, n, ord) of every outcome of the given order, zero where there is none."""
    n = df.groupBy(F.col(outcome).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.createDataFrame([(o, i) for i, o in enumerate(order)], "outcome string, ord int")
    return every.join(n, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"), "ord")


def energy_shares(df: DataFrame, group: list[str], source: str, value: str) -> DataFrame:
    """(group, source, rms, share): root mean square of the values and its share of the group's sum."""
    rms = df.groupBy(*group, source).agg(F.sqrt(F.avg(F.col(value) * F.col(value)) + F.lit(1e-12)).alias("rms"))
    return rms.withColumn("share", F.round(F.col("rms") / (F.sum("rms").over(W.partitionBy(*group)) + 1e-12), 6)).withColumn("rms", F.round("rms", 6))


def weighted_mean_vector(df: DataFrame, group: str, vector: str, weight: Column | None) -> DataFrame:
    """(group, idx, mean): element-wise mean of the vectors of a group, by weight if given; all weights zero give zeros."""
    w = F.lit(1.0) if weight is None else weight
    parts = df.select(group, w.alias("w"), F.posexplode(vector).alias("idx", "p"))
    total = F.sum("w")
    return parts.groupBy(group, "idx").agg(F.when(total > 0, F.sum(F.col("p") * F.col("w")) / total).otherwise(F.lit(0.0)).alias("mean"))


def mix_down(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, idx, total): element-wise sum of a group's vectors, cut to the shortest."""
    shortest = df.groupBy(group).agg(F.min(F.size(vector)).alias("shortest"))
    parts = df.join(shortest, group).select(group, F.posexplode(F.slice(vector, F.lit(1), F.col("shortest"))).alias("idx", "x"))
    return parts.groupBy(group, "idx").agg(F.sum("x").alias("total"))


def overlap_add(parts: DataFrame, key: str, start: str, vector: str, size: int, overlap: int) -> DataFrame:
    """(key, idx, y): segments laid over each other at their starts, weighted by a fading window and divided by the summed weight.
    A segment shorter than size has the window's beginning; where only zero weights lie, y is 0."""
    each = parts.select(key, start, F.posexplode(vector).alias("at", "x")).withColumn("w", fade_window(F.col("at"), size, overlap))
    sums = each.groupBy(key, (F.col(start) + F.col("at")).cast("int").alias("idx")).agg(F.sum(F.col("x") * F.col("w")).alias("x"), F.sum("w").alias("w"))
    return sums.select(key, "idx", (F.col("x") / F.greatest("w", F.lit(1e-8))).alias("y"))


def phase_seconds(log: DataFrame, phase: str, seconds: str) -> DataFrame:
    """(phase, seconds, steps): the time of each phase of a run's log."""
    return log.groupBy(F.col(phase).alias("phase")).agg(F.sum(seconds).alias("seconds"), F.count(F.lit(1)).alias("steps"))


def run_summary(log: DataFrame, run: str, item: str, seconds: str) -> DataFrame:
    """(run, items, elapsed, seconds_per_item, items_per_minute) of each run of a log."""
    out = log.groupBy(F.col(run).alias("run")).agg(F.countDistinct(item).alias("items"), F.sum(seconds).alias("elapsed"))
    per_minute = F.when(F.col("elapsed") > 0, 60.0 * F.col("items") / F.col("elapsed")).otherwise(0.0)
    return out.withColumns({"seconds_per_item": F.col("elapsed") / F.col("items"), "items_per_minute": per_minute})
