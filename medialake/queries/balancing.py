"""Balanced subsets (BAL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import balance as B
from .fixtures import UNITS, units


def bal01_feature_values(spark, sf):
    return units(spark, sf).select("id", *[B.feature_value(f).alias(f) for f in B.FEATURES])


def bal03_strata(spark, sf):
    return B.strata(units(spark, sf), ("genre", "gender"))


def bal04_target(spark, sf):
    u = units(spark, sf)
    out = [B.target_size(B.strata(u, f), f).select(F.lit("+".join(f)).alias("features"), "target") for f in (("gender",), ("genre",), ("compression",))]
    return out[0].unionByName(out[1]).unionByName(out[2])


def bal05_multiplier(spark, sf):
    return B.multiplier(units(spark, sf), ("gender", "reverb"))


def bal06_seeded_take(spark, sf):
    return B.select_balanced(units(spark, sf), ("gender",)).select("id", "role", "stratum", "target")


def bal07_vocal_fill(spark, sf):
    return B.select_balanced(units(spark, sf), ("genre",)).select("id", "role", "target")


def bal08_destinations(spark, sf):
    return B.destinations(B.select_balanced(units(spark, sf), ("genre", "gender")), "out")


def bal09_categories(spark, sf):
    chosen = B.select_balanced(units(spark, sf), ("compression",))
    return chosen.agg(F.count(F.lit(1)).alias("total"), F.max("target").alias("target")).withColumn("categories", F.expr("total div target"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("bal")}

_TAG = lambda c: f"coalesce(nullif(trim({c}), ''), '_untagged')"
_STRATA = f"""WITH u AS ({UNITS}), s AS (SELECT *, concat_ws('|', role, CASE WHEN role <> 'vocal' THEN {_TAG('genre')} END,
  CASE WHEN role IN ('vocal', 'pair') THEN {_TAG('gender')} END) AS gg, concat_ws('|', role, CASE WHEN role <> 'vocal' THEN {_TAG('genre')} END) AS ge,
  concat_ws('|', role, CASE WHEN role IN ('vocal', 'pair') THEN {_TAG('gender')} END) AS gn, concat_ws('|', role, {_TAG('compression')}) AS co,
  md5('42|' || id) AS draw FROM u)"""


def _chosen(key: str, keep: str = "true", g: str = "1") -> str:
    return f"""{_STRATA}, n AS (SELECT {key} AS stratum, count(*) AS n, bool_or(role IN ('vocal', 'pair')) AS side, bool_and(role = 'vocal') AS loose FROM s GROUP BY 1),
      t AS (SELECT min(n) AS target FROM n WHERE {keep}), r AS (SELECT s.*, {key} AS stratum, row_number() OVER (PARTITION BY {key} ORDER BY draw, id) AS k FROM s),
      c AS (SELECT r.*, target FROM r JOIN n USING (stratum), t WHERE k <= CASE WHEN side THEN target ELSE target * {g} END)"""


SQL = {
    "bal01_feature_values": f"""SELECT id, role AS roles, {_TAG('genre')} AS genre, {_TAG('style')} AS style, {_TAG('gender')} AS gender, {_TAG('reverb')} AS reverb,
      {_TAG('vocal_type')} AS vocal_type,
      CASE WHEN sdr IS NULL THEN '_untagged' ELSE concat(CAST(floor(sdr / 5) * 5 AS BIGINT), '-', CAST(floor(sdr / 5) * 5 + 5 AS BIGINT)) END AS sdr,
      {_TAG('compression')} AS compression, {_TAG('music_key')} AS key FROM ({UNITS})""",
    "bal03_strata": _STRATA + " SELECT gg AS stratum, count(*) AS n, bool_or(role IN ('vocal', 'pair')) AS vocal_side, bool_and(role = 'vocal') AS only_vocal FROM s GROUP BY 1",
    "bal04_target": _STRATA + """ SELECT 'gender' AS features, min(n) AS target FROM (SELECT count(*) AS n, bool_or(role IN ('vocal', 'pair')) AS v FROM s GROUP BY gn) WHERE v
      UNION ALL SELECT 'genre', min(n) FROM (SELECT count(*) AS n, bool_and(role = 'vocal') AS v FROM s GROUP BY ge) WHERE NOT v
      UNION ALL SELECT 'compression', min(n) FROM (SELECT count(*) AS n FROM s GROUP BY co)""",
    "bal05_multiplier": _STRATA + f" SELECT greatest(count(DISTINCT {_TAG('gender')} || '|' || {_TAG('reverb')}), 1) AS g FROM s WHERE role IN ('vocal', 'pair')",
    "bal06_seeded_take": _chosen("gn", "side", f"(SELECT count(DISTINCT {_TAG('gender')}) FROM s WHERE role IN ('vocal', 'pair'))") + " SELECT id, role, stratum, target FROM c",
    "bal07_vocal_fill": _chosen("ge", "NOT loose") + """ SELECT id, role, target FROM c WHERE role <> 'vocal' UNION ALL
      SELECT id, role, (SELECT target FROM t) FROM (SELECT *, row_number() OVER (ORDER BY draw, id) AS k FROM s WHERE role = 'vocal')
      WHERE k <= (SELECT count(*) FROM c WHERE role = 'instrumental')""",
    "bal08_destinations": _chosen("gg", "side") + """ SELECT id, role, concat_ws('/', 'out', CASE role WHEN 'pair' THEN 'pairs_BALANCED' WHEN 'sample' THEN 'samples_BALANCED'
      ELSE role || '_BALANCED' END, style, id) AS target_path FROM c""",
    "bal09_categories": _chosen("co") + " SELECT count(*) AS total, max(target) AS target, count(*) // max(target) AS categories FROM c",
}
