"""Faceted aggregation (AGG)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facets as A
from ..operators.selection import medians, order_statistics
from .fixtures import FILES, UNITS, files, load, units


def agg01_bucket(spark, sf):
    return A.bucket(units(spark, sf), "genre")


def agg02_facets(spark, sf):
    return A.facets(units(spark, sf))


def agg03_pair_expansion(spark, sf):
    return A.stems(units(spark, sf)).groupBy("side").agg(F.count(F.lit(1)).alias("stems"), F.sum("bytes").alias("bytes"), F.count("sdr").alias("with_sdr"))


def agg04_role_counts(spark, sf):
    return A.role_counts(units(spark, sf))


def agg05_style_by_genre(spark, sf):
    return units(spark, sf).groupBy("genre", "style").agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("duration"))


def agg06_top_styles(spark, sf):
    u = units(spark, sf)
    tagged = A.bucket(u.where("role in ('instrumental', 'pair')"), "style")
    return A.top_with_other(tagged, A.role_counts(u).select("total_files"), 20)


def agg07_continuous(spark, sf):
    return A.continuous(units(spark, sf), "duration", ["role"])


def agg07_order_statistics(spark, sf):
    """Median, least, greatest and the value at nine tenths of the ranks of prices, in groups of a third of all rows."""
    li = load(spark, sf, "lineitem")
    ends = order_statistics(li, "l_extendedprice", ["l_returnflag"], {"least": F.lit(0), "p90": F.floor(F.col("n") * 9 / 10), "most": F.col("n") - 1})
    return medians(li, "l_extendedprice", ["l_returnflag"]).join(ends, "l_returnflag")


def agg08_share_of_facet(spark, sf):
    return A.with_share(A.facets(units(spark, sf)).select("facet", "value", "n"), ["facet"]).drop("relative")


def agg09_relative_to_peak(spark, sf):
    return A.with_share(A.bucket(units(spark, sf), "style").select("name", "n"), []).drop("share")


def agg10_style_share_in_genre(spark, sf):
    return A.with_share(agg05_style_by_genre(spark, sf).select("genre", "style", "n"), ["genre"]).drop("relative")


def agg11_histogram(spark, sf):
    return A.histogram(units(spark, sf), "sdr")


def agg12_kpis(spark, sf):
    return A.kpis(units(spark, sf))


def agg13_mode_largest(spark, sf):
    return A.mode_largest(load(spark, sf, "part"), "p_brand", "p_size")


_OUTCOMES = ("ok", "minor", "suspect", "failed", "missing")


def agg14_outcomes(spark, sf):
    u = units(spark, sf).withColumn("outcome", F.expr("CASE id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'minor' WHEN 2 THEN 'suspect' ELSE 'ok' END"))
    return A.outcome_counts(u, "outcome", _OUTCOMES)


def agg15_phase_seconds(spark, sf):
    return A.phase_seconds(load(spark, sf, "events"), "event_type", "value").withColumn("seconds", F.round("seconds", 2))


def agg16_run_summary(spark, sf):
    out = A.run_summary(load(spark, sf, "events"), "user_id", "event_id", "value")
    return out.select("run", "items", *[F.round(c, 4).alias(c) for c in ("elapsed", "seconds_per_item", "items_per_minute")])


def agg17_energy_shares(spark, sf):
    return A.energy_shares(load(spark, sf, "events"), ["user_id"], "event_type", "value")


def _vectors(spark, sf):
    v = load(spark, sf, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 11).cast("array<double>").alias("p"))
    return v.withColumn("rms", F.expr("CASE WHEN vec_id % 5 = 0 THEN 0.0 ELSE vec_id % 7 / 8.0 END"))


def agg18_weighted_mean(spark, sf):
    return A.weighted_mean_vector(_vectors(spark, sf), "label", "p", F.col("rms")).withColumn("mean", F.round("mean", 5))


def agg19_plain_mean(spark, sf):
    return A.weighted_mean_vector(_vectors(spark, sf), "label", "p", None).withColumn("mean", F.round("mean", 5))


def agg20_mix_down(spark, sf):
    v = _vectors(spark, sf).withColumn("p", F.slice("p", F.lit(1), (F.lit(6) + F.col("vec_id") % 4).cast("int")))
    return A.mix_down(v, "label", "p").withColumn("total", F.round("total", 5))


def agg21_process_hints(spark, sf):
    f = files(spark, sf).groupBy("folder", "category").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("stem").contains("nstrumental")).alias("keyword"))
    return f.agg(F.count_if(F.col("n") == 2).alias("two_files"), F.count_if(F.col("keyword")).alias("with_keyword"), F.count_if(~F.col("keyword") & (F.col("n") >= 10)).alias("large_unmatched"))


def agg22_layout(spark, sf):
    f = files(spark, sf)
    folders = f.groupBy("folder").agg(F.countDistinct("category").alias("k")).agg(F.count_if(F.col("k") == 5).alias("folders"))
    sets = f.groupBy("stem").agg(F.countDistinct("category").alias("k")).agg(F.count_if(F.col("k") == 5).alias("sets"))
    both = folders.crossJoin(sets)  # a row each
    return both.withColumn("layout", F.when((F.col("folders") == 0) & (F.col("sets") == 0), "none").when(F.col("folders") >= F.col("sets"), "folders").otherwise("sets"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("agg")}

_FACETS = f"""WITH u AS ({UNITS}), e AS (
  SELECT 'genre' AS facet, genre AS value, 1 AS w, bytes, duration FROM u WHERE role IN ('instrumental', 'pair')
  UNION ALL SELECT 'style', style, 1, bytes, duration FROM u WHERE role IN ('instrumental', 'pair')
  UNION ALL SELECT 'gender', gender, 1, bytes, duration FROM u WHERE role IN ('vocal', 'pair')
  UNION ALL SELECT 'reverb', reverb, 1, bytes, duration FROM u WHERE role IN ('vocal', 'pair')
  UNION ALL SELECT 'vocal_type', vocal_type, 1, bytes, duration FROM u WHERE role IN ('vocal', 'pair')
  UNION ALL SELECT 'compression', compression, CASE role WHEN 'pair' THEN 2 ELSE 1 END, bytes, duration FROM u
  UNION ALL SELECT 'music_key', music_key, CASE role WHEN 'pair' THEN 2 ELSE 1 END, bytes, duration FROM u
), f AS (SELECT facet, value, CAST(sum(w) AS BIGINT) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, sum(duration) AS duration FROM e WHERE value IS NOT NULL GROUP BY 1, 2)"""
_VECTORS = "SELECT vec_id, label, CAST(embedding[1:11] AS DOUBLE[]) AS p, CASE WHEN vec_id % 5 = 0 THEN 0.0 ELSE vec_id % 7 / 8.0 END AS rms FROM embeddings"
SQL = {
    "agg01_bucket": f"SELECT genre AS name, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, sum(duration) AS duration FROM ({UNITS}) WHERE genre <> '' GROUP BY 1",
    "agg02_facets": _FACETS + " SELECT * FROM f",
    "agg03_pair_expansion": f"""WITH s AS (SELECT CASE WHEN role = 'pair' THEN 'instrumental' ELSE role END AS side, bytes, sdr FROM ({UNITS})
      UNION ALL SELECT 'vocal', bytes, sdr FROM ({UNITS}) WHERE role = 'pair')
      SELECT side, count(*) AS stems, CAST(sum(bytes) AS BIGINT) AS bytes, count(sdr) AS with_sdr FROM s GROUP BY 1""",
    "agg04_role_counts": f"""SELECT count(*) FILTER (role = 'instrumental') AS instrumental, count(*) FILTER (role = 'vocal') AS vocal, count(*) FILTER (role = 'sample') AS samples,
      count(*) FILTER (role = 'pair') AS pairs, count(*) + count(*) FILTER (role = 'pair') AS total_files FROM ({UNITS})""",
    "agg05_style_by_genre": f"SELECT genre, style, count(*) AS n, sum(duration) AS duration FROM ({UNITS}) GROUP BY 1, 2",
    "agg06_top_styles": f"""WITH u AS ({UNITS}), c AS (SELECT style AS name, count(*) AS n FROM u WHERE role IN ('instrumental', 'pair') AND style <> '' GROUP BY 1)
      (SELECT name, n FROM c ORDER BY n DESC, name LIMIT 20) UNION ALL
      SELECT 'other', greatest((SELECT count(*) + count(*) FILTER (role = 'pair') FROM u) - (SELECT CAST(sum(n) AS BIGINT) FROM c), 0)""",
    "agg07_order_statistics": """WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
      SELECT l_returnflag, median(v) AS median, min(v) AS least, max(CASE WHEN k = n * 9 // 10 THEN v END) AS p90, max(v) AS most FROM r GROUP BY 1""",
    "agg07_continuous": f"SELECT role, count(duration) AS n, sum(duration) AS total, avg(duration) AS mean, median(duration) AS median FROM ({UNITS}) GROUP BY 1",
    "agg08_share_of_facet": _FACETS + " SELECT facet, value, n, round(100.0 * n / sum(n) OVER (PARTITION BY facet), 4) AS share FROM f",
    "agg09_relative_to_peak": f"SELECT style AS name, count(*) AS n, round(count(*) * 1.0 / max(count(*)) OVER (), 6) AS relative FROM ({UNITS}) GROUP BY 1",
    "agg10_style_share_in_genre": f"SELECT genre, style, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY genre), 4) AS share FROM ({UNITS}) GROUP BY 1, 2",
    "agg11_histogram": f"""WITH b AS (SELECT CAST(floor(sdr / 5) * 5 AS BIGINT) AS bin, count(*) AS n FROM ({UNITS}) WHERE sdr IS NOT NULL GROUP BY 1)
      SELECT r.bin, coalesce(b.n, 0) AS n FROM (SELECT unnest(range((SELECT min(bin) FROM b), (SELECT max(bin) FROM b) + 1, 5)) AS bin) r LEFT JOIN b USING (bin)""",
    "agg12_kpis": f"SELECT count(*) AS units, CAST(sum(bytes) AS BIGINT) AS bytes, sum(duration) AS duration, count(DISTINCT role) AS roles FROM ({UNITS})",
    "agg13_mode_largest": """SELECT p_brand, p_size, n FROM (SELECT p_brand, p_size, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_size DESC) AS k
      FROM part GROUP BY 1, 2) WHERE k = 1""",
    "agg14_outcomes": f"""SELECT o.outcome, count(u.id) AS n, o.ord FROM (VALUES ('ok', 0), ('minor', 1), ('suspect', 2), ('failed', 3), ('missing', 4)) o(outcome, ord)
      LEFT JOIN (SELECT id, CASE id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'minor' WHEN 2 THEN 'suspect' ELSE 'ok' END AS outcome FROM ({UNITS})) u USING (outcome) GROUP BY 1, 3""",
    "agg15_phase_seconds": "SELECT event_type AS phase, round(sum(value), 2) AS seconds, count(*) AS steps FROM events GROUP BY 1",
    "agg16_run_summary": """SELECT user_id AS run, count(DISTINCT event_id) AS items, round(sum(value), 4) AS elapsed, round(sum(value) / count(DISTINCT event_id), 4) AS seconds_per_item,
      round(CASE WHEN sum(value) > 0 THEN 60.0 * count(DISTINCT event_id) / sum(value) ELSE 0 END, 4) AS items_per_minute FROM events GROUP BY 1""",
    "agg17_energy_shares": """WITH r AS (SELECT user_id, event_type, sqrt(avg(value * value) + 1e-12) AS rms FROM events GROUP BY 1, 2)
      SELECT user_id, event_type, round(rms, 6) AS rms, round(rms / (sum(rms) OVER (PARTITION BY user_id) + 1e-12), 6) AS share FROM r""",
    "agg18_weighted_mean": f"""WITH v AS ({_VECTORS}), x AS (SELECT label, rms, unnest(p) AS p, unnest(range(0, 11)) AS idx FROM v)
      SELECT label, CAST(idx AS INT) AS idx, round(CASE WHEN sum(rms) > 0 THEN sum(p * rms) / sum(rms) ELSE 0 END, 5) AS mean FROM x GROUP BY 1, 2""",
    "agg19_plain_mean": f"WITH v AS ({_VECTORS}), x AS (SELECT label, unnest(p) AS p, unnest(range(0, 11)) AS idx FROM v) SELECT label, CAST(idx AS INT) AS idx, round(avg(p), 5) AS mean FROM x GROUP BY 1, 2",
    "agg20_mix_down": f"""WITH v AS (SELECT label, p[1:6 + vec_id % 4] AS p FROM ({_VECTORS})), m AS (SELECT label, min(len(p)) AS k FROM v GROUP BY 1),
      x AS (SELECT label, unnest(p[1:k]) AS x, unnest(range(0, k)) AS idx FROM v JOIN m USING (label)) SELECT label, CAST(idx AS INT) AS idx, round(sum(x), 5) AS total FROM x GROUP BY 1, 2""",
    "agg21_process_hints": f"""WITH f AS (SELECT folder, category, count(*) AS n, bool_or(contains(stem, 'nstrumental')) AS k FROM ({FILES}) GROUP BY 1, 2)
      SELECT count(*) FILTER (n = 2) AS two_files, count(*) FILTER (k) AS with_keyword, count(*) FILTER (NOT k AND n >= 10) AS large_unmatched FROM f""",
    "agg22_layout": f"""WITH a AS (SELECT count(*) FILTER (k = 5) AS folders FROM (SELECT folder, count(DISTINCT category) AS k FROM ({FILES}) GROUP BY 1)),
      b AS (SELECT count(*) FILTER (k = 5) AS sets FROM (SELECT stem, count(DISTINCT category) AS k FROM ({FILES}) GROUP BY 1))
      SELECT folders, sets, CASE WHEN folders = 0 AND sets = 0 THEN 'none' WHEN folders >= sets THEN 'folders' ELSE 'sets' END AS layout FROM a, b""",
}
