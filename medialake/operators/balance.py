"""Balanced subsets: stratified undersampling of an inventory with a seeded, repeatable choice.

A stratum is the list of feature values that apply to a unit's role. Every stratum gives as many units as the smallest one
that counts; which ones is decided by the order of md5(seed|id), so the choice does not depend on partitioning. Stratum sizes are
counted with map-side combination; the smallest size is one row. The place of a unit within its stratum is its rank in a slice
of the draw plus the sizes of the slices before, so no task sorts a whole stratum, however large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The features in their order, and the side that each belongs to.
FEATURES = ("roles", "genre", "style", "gender", "reverb", "vocal_type", "sdr", "compression", "key")
VOCAL_SIDE = ("gender", "reverb", "vocal_type")
INSTRUMENT_SIDE = ("genre", "style")
UNTAGGED = "_untagged"


def normalize_features(features) -> tuple[str, ...]:
    """Known features in their fixed order; roles always first."""
    return ("roles", *(f for f in FEATURES[1:] if f in set(features or ())))


def sdr_bin(sdr: Column) -> Column:
    low = (F.floor(sdr / 5) * 5).cast("long")
    return F.when(sdr.isNull() | F.isnan(sdr), UNTAGGED).otherwise(F.concat(low.cast("string"), F.lit("-"), (low + 5).cast("string")))


def feature_value(feature: str) -> Column:
    if feature == "roles":
        return F.col("role")
    if feature == "sdr":
        return sdr_bin(F.col("sdr"))
    return F.coalesce(F.nullif(F.trim(F.col("music_key" if feature == "key" else feature)), F.lit("")), F.lit(UNTAGGED))


def stratum(features: tuple[str, ...]) -> Column:
    """The values of the features that apply to the unit's role: its length varies."""
    role = F.col("role")
    parts = []
    for f in features:
        value = feature_value(f)
        if f in VOCAL_SIDE:
            value = F.when(role.isin("vocal", "pair"), value)
        if f in INSTRUMENT_SIDE:
            value = F.when(role != "vocal", value)
        parts.append(value)
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), "|")


def strata(units: DataFrame, features) -> DataFrame:
    """(stratum, n, vocal_side, only_vocal) of every stratum."""
    feats = normalize_features(features)
    return units.groupBy(stratum(feats).alias("stratum")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("role").isin("vocal", "pair")).alias("vocal_side"), F.every(F.col("role") == "vocal").alias("only_vocal")
    )


def target_size(counts: DataFrame, features) -> DataFrame:
    """One row, target: the size of the smallest stratum that counts."""
    feats = normalize_features(features)
    if any(f in VOCAL_SIDE for f in feats):
        counts = counts.where("vocal_side")
    elif any(f in INSTRUMENT_SIDE for f in feats):
        counts = counts.where("not only_vocal")
    return counts.agg(F.coalesce(F.min("n"), F.lit(0)).alias("target"))


def multiplier(units: DataFrame, features) -> DataFrame:
    """One row, g: how many vocal-side value combinations there are; 1 unless only vocal-side features are on."""
    feats = normalize_features(features)
    vocal = [f for f in feats if f in VOCAL_SIDE]
    if not vocal or any(f in INSTRUMENT_SIDE for f in feats):
        return units.sparkSession.range(1).select(F.lit(1).cast("long").alias("g"))
    combos = units.where("role in ('vocal', 'pair')").agg(F.countDistinct(*[feature_value(f) for f in vocal]).alias("g"))
    return combos.select(F.greatest("g", F.lit(1)).cast("long").alias("g"))


def draw_order(seed: int, key: str = "id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def select_balanced(units: DataFrame, features, seed: int = 42) -> DataFrame:
    """units with stratum and target, those chosen only.

    With instrument-side features alone, loose vocals are drawn to the number of chosen instrumentals instead.
    """
    feats = normalize_features(features)
    fill = any(f in INSTRUMENT_SIDE for f in feats) and not any(f in VOCAL_SIDE for f in feats)
    counts = strata(units, features)
    goal = target_size(counts, features).crossJoin(multiplier(units, features))  # one row each
    takes = counts.crossJoin(F.broadcast(goal)).select(
        "stratum", "target", F.when(F.col("vocal_side"), F.col("target")).otherwise(F.col("target") * F.col("g")).alias("take"), "only_vocal"
    )
    if fill:
        takes = takes.where("not only_vocal")
    keyed = units.withColumn("stratum", stratum(feats)).withColumn("draw", draw_order(seed))
    chosen = drawn(keyed, ["stratum"]).join(takes.drop("only_vocal"), "stratum").where(F.col("place") <= F.col("take")).drop("draw", "place", "take")
    if not fill:
        return chosen
    need = chosen.agg(F.count_if(F.col("role") == "instrumental").alias("need"), F.coalesce(F.max("target"), F.lit(0)).alias("target"))
    return chosen.unionByName(vocal_fill(units, need, seed).withColumn("stratum", F.lit("vocal")).select(chosen.columns))


def drawn(units: DataFrame, by: list[str]) -> DataFrame:
    """units (with draw) with place, the 1-based position in draw order among the units that are equal in `by`."""
    sliced = units.withColumn("slice", F.substring("draw", 1, 2))  # 256 slices of about the same size
    within = sliced.withColumn("at", F.row_number().over(W.partitionBy(*by, "slice").orderBy("draw", "id")))
    sizes = sliced.groupBy(*by, "slice").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(W.partitionBy(*by).orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    before = sizes.select(*by, "slice", F.coalesce(earlier, F.lit(0)).alias("before"))
    return within.join(before, [*by, "slice"]).withColumn("place", F.col("at") + F.col("before")).drop("slice", "at", "before")


def vocal_fill(units: DataFrame, need: DataFrame, seed: int) -> DataFrame:
    """Loose vocals in draw order up to `need` (one row)."""
    vocals = units.where("role = 'vocal'").withColumn("draw", draw_order(seed))
    return drawn(vocals, ["role"]).crossJoin(F.broadcast(need)).where("place <= need").drop("draw", "place", "need").select(*units.columns, *[c for c in need.columns if c != "need"])


def destinations(chosen: DataFrame, dest: str) -> DataFrame:
    """(id, role, target_path): where each chosen unit would go; nothing is moved."""
    root = F.when(F.col("role") == "pair", "pairs_BALANCED").when(F.col("role") == "sample", "samples_BALANCED").otherwise(F.concat("role", F.lit("_BALANCED")))
    return chosen.select("id", "role", F.concat_ws("/", F.lit(dest), root, F.col("style"), F.col("id").cast("string")).alias("target_path"))
