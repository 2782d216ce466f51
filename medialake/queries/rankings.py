"""Score vectors, decisions and rankings (TOP)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import ranking as R
from .fixtures import load

_LABELS = ("Kick", "Snare", "Hat", "Bass", "Lead", "Pad", "Vocal", "Speech", "Strings", "Keys", "Noise")


def _vectors(spark, sf, k=11):
    v = load(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, k), lambda x: F.round(x.cast("double") * 4, 3)).alias("v"))
    return v.withColumn("p", F.expr("CASE WHEN vec_id % 17 = 0 THEN transform(v, x -> 0.0D) ELSE transform(v, x -> abs(x)) END"))


def _labels():
    return F.array(*map(F.lit, _LABELS))


def _energies(spark, sf):
    e = load(spark, sf, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 2).alias("e"))
    return e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "e"))).alias("energies"))  # at most one entry a source


def top01_classify(spark, sf):
    d = S.category_decision(F.col("energies"), ("view", "click", "other"), {"view": "view", "click": "click"}, "other", 0.5, 0.2)
    return _energies(spark, sf).select("user_id", d.alias("d")).select("user_id", "d.action", "d.category", F.round("d.share", 5).alias("share"), F.round("d.margin", 5).alias("margin"), "d.reason")


def top02_decision(spark, sf):
    t = S.top_k(F.col("p"), _labels(), 5, 0.0)
    rows = _vectors(spark, sf).select("vec_id", t.alias("t")).withColumn("category", F.when(F.col("t.label").isin("Noise", ""), "").otherwise("x"))
    return rows.select("vec_id", S.decision(F.col("t.label"), F.col("category"), F.col("t.score"), F.col("t.second"), 0.8, 0.1).alias("action"))


def top03_top_k(spark, sf):
    t = S.top_k(F.col("p"), _labels(), 5, 0.5)
    return _vectors(spark, sf).select("vec_id", t.alias("t")).select("vec_id", "t.label", "t.score", "t.second", F.array_join("t.top", ",").alias("top"), F.array_join("t.above", ",").alias("above"), "t.silent")


def top04_pair_confidence(spark, sf):
    return _vectors(spark, sf).select("vec_id", F.round(S.pair_confidence(F.col("p")), 6).alias("raw"), F.round(S.pair_confidence(F.transform("p", lambda x: x + 0.0004), 2), 6).alias("rounded"))


def top05_renormalised(spark, sf):
    return _vectors(spark, sf, 5).select("vec_id", F.posexplode(S.renormalised(F.col("p")))).select("vec_id", F.col("pos").alias("idx"), F.round("col", 6).alias("share"))


def top06_demotion(spark, sf):
    r = S.ranked(F.col("p"), _labels())
    return _vectors(spark, sf).select("vec_id", S.demoted(r, gap=0.3)["label"].alias("label"))


def top07_focus(spark, sf):
    """The shares of the first five labels, the best with demotion, and the top ten of all labels cut to the focus."""
    focus = F.slice(_labels(), 1, 5)
    r = S.ranked(S.renormalised(F.slice("p", 1, 5)), focus)
    top = F.filter(F.slice(S.ranked(F.col("p"), _labels()), 1, 6), lambda x: F.array_contains(focus, x["label"]))
    return _vectors(spark, sf).select("vec_id", r[0]["label"].alias("label"), F.round(r[0]["score"], 5).alias("share"), F.array_join(F.transform(top, lambda x: x["label"]), ",").alias("top"))


def top08_key_of_logits(spark, sf):
    return _vectors(spark, sf, 24).select("vec_id", S.key_of_logits(F.col("v")).alias("k")).select("vec_id", "k.key", F.round("k.probability", 6).alias("probability"))


def top09_argmax(spark, sf):
    wet, dry = F.col("v")[0], F.col("v")[1]
    return _vectors(spark, sf).select("vec_id", F.when(wet >= dry, "wet").otherwise("dry").alias("reverb"))


def top09_gender(spark, sf):
    """The mean of a track's patches, then the larger class; the first among equals."""
    patches = _vectors(spark, sf).select((F.floor(F.col("vec_id") / 5)).alias("track"), F.col("p")[0].alias("f"), F.col("p")[1].alias("m"))
    means = patches.groupBy("track").agg(F.avg("f").alias("f"), F.avg("m").alias("m"), F.count(F.lit(1)).alias("n_patches"))
    return means.select("track", F.when(F.round("f", 9) >= F.round("m", 9), "female").otherwise("male").alias("gender"), F.round(F.greatest("f", "m"), 5).alias("confidence"), "n_patches")


def top10_all_pass(spark, sf):
    limits = spark.createDataFrame([("click", 2.0), ("view", 1.0), ("error", 0.5)], "event_type string, limit double")
    return R.all_pass(load(spark, sf, "events"), "user_id", "event_type", "value", limits)


def top11_display_order(spark, sf):
    return R.display_order(load(spark, sf, "part").select(F.col("p_brand").alias("folder"), F.expr("concat(CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END, '_', p_partkey)").alias("name")), ["folder", "name"])


def top12_limit(spark, sf):
    """The first 100 paths: --limit is this operator's feature."""
    return load(spark, sf, "part").select(F.expr("concat(p_brand, '/', p_name, '_', p_partkey)").alias("path")).orderBy("path").limit(100)


QUERIES = {k: v for k, v in globals().items() if k.startswith("top")}


def _vec(k: int = 11) -> str:
    return f"""SELECT vec_id, i, round(CAST(embedding[i] AS DOUBLE) * 4, 3) AS v, CASE WHEN vec_id % 17 = 0 THEN 0.0 ELSE abs(round(CAST(embedding[i] AS DOUBLE) * 4, 3)) END AS p,
      {list(_LABELS)}[i] AS label FROM embeddings, (SELECT unnest(range(1, {k + 1})) AS i)"""


_RANKED = f"WITH x AS ({_vec()}), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS k FROM x)"
_BEST = "max(label) FILTER (k = 1) AS l1, max(label) FILTER (k = 2) AS l2, max(p) FILTER (k = 1) AS p1, max(p) FILTER (k = 2) AS p2"
SQL = {
    "top01_classify": """WITH e AS (SELECT user_id, event_type, round(sum(value), 2) AS e FROM events GROUP BY 1, 2),
      s AS (SELECT user_id, c, coalesce(sum(e) FILTER (CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'other' END = c), 0) / (sum(e) + 1e-12) AS share, o
        FROM e, (VALUES ('view', 0), ('click', 1), ('other', 2)) t(c, o) GROUP BY 1, 2, 4),
      r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY share DESC, o) AS k FROM s),
      d AS (SELECT user_id, max(c) FILTER (k = 1) AS category, max(share) FILTER (k = 1) AS share, max(share) FILTER (k = 1) - max(share) FILTER (k = 2) AS margin FROM r GROUP BY 1),
      q AS (SELECT *, CASE WHEN share < 0.5 AND margin < 0.2 THEN 'both' WHEN share < 0.5 THEN 'confidence' WHEN margin < 0.2 THEN 'margin' END AS reason FROM d)
      SELECT user_id, CASE WHEN reason IS NOT NULL THEN 'skip' ELSE category END AS action, category, round(share, 5) AS share, round(margin, 5) AS margin, reason FROM q""",
    "top02_decision": _RANKED + f""", b AS (SELECT vec_id, {_BEST} FROM r GROUP BY 1) SELECT vec_id, CASE WHEN p1 <= 0 THEN 'skip_silence' WHEN l1 = 'Noise' THEN 'skip_unmap'
      WHEN p1 < 0.8 AND p1 - p2 < 0.1 THEN 'skip_both' WHEN p1 < 0.8 THEN 'skip_confidence' WHEN p1 - p2 < 0.1 THEN 'skip_margin' ELSE 'apply' END AS action FROM b""",
    "top03_top_k": _RANKED + f""", b AS (SELECT vec_id, {_BEST}, string_agg(label, ',' ORDER BY k) FILTER (k = 1 OR (k <= 5 AND p >= 0.5)) AS t,
      string_agg(label, ',' ORDER BY k) FILTER (p >= 0.5) AS a FROM r GROUP BY 1) SELECT vec_id, CASE WHEN p1 <= 0 THEN '' ELSE l1 END AS label, p1 AS score, p2 AS second,
      CASE WHEN p1 <= 0 THEN '' ELSE t END AS top, coalesce(a, '') AS above, p1 <= 0 AS silent FROM b""",
    "top04_pair_confidence": _RANKED + f""", b AS (SELECT vec_id, {_BEST} FROM r GROUP BY 1) SELECT vec_id, CASE WHEN p1 + p2 > 0 THEN round(p1 / (p1 + p2), 6) ELSE 0 END AS raw,
      CASE WHEN p1 + p2 > 0 THEN round(round(p1 + 0.0004, 2) / (round(p1 + 0.0004, 2) + round(p2 + 0.0004, 2)), 6) ELSE 0 END AS rounded FROM b""",
    "top05_renormalised": f"WITH x AS ({_vec(5)}) SELECT vec_id, CAST(i - 1 AS INT) AS idx, round(greatest(p, 1e-12) / sum(greatest(p, 1e-12)) OVER (PARTITION BY vec_id), 6) AS share FROM x",
    "top06_demotion": _RANKED + f", b AS (SELECT vec_id, {_BEST} FROM r GROUP BY 1) SELECT vec_id, CASE WHEN l1 = 'Speech' AND p1 - p2 <= 0.3 THEN l2 ELSE l1 END AS label FROM b",
    "top07_focus": _RANKED + """, f AS (SELECT vec_id, label, greatest(p, 1e-12) / sum(greatest(p, 1e-12)) OVER (PARTITION BY vec_id) AS s, i FROM x WHERE i <= 5),
      g AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, i) AS k FROM f), t AS (SELECT vec_id, string_agg(label, ',' ORDER BY k) AS top FROM r WHERE k <= 6 AND i <= 5 GROUP BY 1)
      SELECT vec_id, label, round(s, 5) AS share, coalesce(top, '') AS top FROM g LEFT JOIN t USING (vec_id) WHERE k = 1""",
    "top08_key_of_logits": f"""WITH x AS (SELECT vec_id, i, v FROM ({_vec(24)})), e AS (SELECT *, exp(v - max(v) OVER (PARTITION BY vec_id)) AS e FROM x),
      p AS (SELECT vec_id, i, e / sum(e) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS k FROM e)
      SELECT vec_id, {list(S.WHEEL)}[i] AS key, round(p, 6) AS probability FROM p WHERE k = 1""",
    "top09_argmax": f"WITH x AS ({_vec()}) SELECT vec_id, CASE WHEN max(v) FILTER (i = 1) >= max(v) FILTER (i = 2) THEN 'wet' ELSE 'dry' END AS reverb FROM x GROUP BY 1",
    "top09_gender": f"""WITH x AS ({_vec()}), m AS (SELECT vec_id // 5 AS track, avg(p) FILTER (i = 1) AS f,
      avg(p) FILTER (i = 2) AS m, count(DISTINCT vec_id) AS n_patches FROM x GROUP BY 1)
      SELECT track, CASE WHEN round(f, 9) >= round(m, 9) THEN 'female' ELSE 'male' END AS gender, round(greatest(f, m), 5) AS confidence, n_patches FROM m""",
    "top10_all_pass": """WITH e AS (SELECT user_id, value >= CASE event_type WHEN 'click' THEN 2.0 WHEN 'view' THEN 1.0 WHEN 'error' THEN 0.5 ELSE -1e9 END AS ok FROM events)
      SELECT user_id, bool_and(ok) AS passed, count(*) FILTER (NOT ok) AS failed FROM e GROUP BY 1""",
    "top11_display_order": """WITH n AS (SELECT p_brand AS folder, concat(CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END, '_', p_partkey) AS name FROM part)
      SELECT folder, name, CAST(row_number() OVER (PARTITION BY folder ORDER BY lower(name), name) AS INT) AS place FROM n""",
    "top12_limit": "SELECT concat(p_brand, '/', p_name, '_', p_partkey) AS path FROM part ORDER BY 1 LIMIT 100",
}
