"""Joins and matching (JON)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import classify_role
from ..operators import linkage as J
from .fixtures import FILES, files, load


def _tracks(spark, sf):
    t = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lower("p_brand").alias("artist"), F.lower("p_name").alias("title"))
    return t.where("id % 2 = 0"), t.where("id % 2 = 1")


def jon01_block_keys(spark, sf):
    left, _ = _tracks(spark, sf)
    return left.select("id", F.explode(J.block_keys(True)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def jon02_candidates(spark, sf):
    left, right = _tracks(spark, sf)
    return J.candidates(left, right, 1.0)


def jon02_fuzzy_candidates(spark, sf):
    names = lambda df: df.groupBy("artist", "title").agg(F.min("id").alias("id"))
    left, right = _tracks(spark, sf)
    return J.candidates(names(left), names(right), 0.8)


def jon03_similarity(spark, sf):
    left, right = _tracks(spark, sf)
    names = left.select(F.col("title").alias("a")).distinct().join(right.select(F.col("title").alias("b")).distinct(), F.substring("a", 1, 1) == F.substring("b", 1, 1))
    return J.with_similarity(names, "a", "b", "score")


def jon04_greedy(spark, sf):
    """Greedy assignment by given scores: events of a user and of another kind, scored by closeness of value."""
    e = load(spark, sf, "events").where("event_type in ('click', 'view')").select("user_id", "event_type", "event_id", "value")
    a = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("ref"), F.col("value").alias("va"))
    b = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("partner"), F.col("value").alias("vb"))
    # The score bounds the distance by 1, so equal or neighbouring bands meet; they are a little wider, for rounding.
    band = lambda v: F.floor(F.col(v) / 1.000001)
    a, b = a.withColumn("band", F.explode(F.array(band("va") - 1, band("va"), band("va") + 1))), b.withColumn("band", band("vb"))
    scored = a.join(b, ["user_id", "band"]).select("ref", "partner", (1 / (1 + F.abs(F.col("va") - F.col("vb")))).alias("score")).where("score >= 0.5")
    return J.assign_greedily(scored)


def jon05_find_pairs(spark, sf):
    matched, left, right = J.find_pairs(*_tracks(spark, sf), 1.0)
    none = F.lit(None).cast("long")
    return matched.select("ref", "partner").unionByName(left.select(F.col("id").alias("ref"), none.alias("partner"))).unionByName(right.select(none.alias("ref"), F.col("id").alias("partner")))


def jon06_folder_similarity(spark, sf):
    left, right = _tracks(spark, sf)
    ending = lambda c: F.substring(c, -3, 3)  # noqa: E731  of a name that ends with a title, so the two meet by it
    names = left.select(F.concat_ws(" ", "artist", "title").alias("a")).distinct().withColumn("ending", ending("a"))
    titles = right.select(F.concat_ws(" ", "artist", "title", F.lit("x")).alias("b"), F.col("title")).distinct().withColumn("ending", ending("title"))
    return J.folder_similarity(names.join(titles, "ending").where(F.col("a").endswith(F.col("title"))).select("a", "b"), "a", "b", "score")


def jon07_best_match(spark, sf):
    left, _ = _tracks(spark, sf)
    names = left.select(F.concat(F.col("title"), F.lit(" live")).alias("name"))
    folders = load(spark, sf, "part").groupBy(F.lower("p_name").alias("folder")).agg(F.min("p_partkey").alias("ord"))
    return J.best_match(names, folders)


def jon08_winners(spark, sf):
    li = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("folder"), F.expr("l_orderkey * 10 + l_linenumber").alias("src"), F.col("l_extendedprice").alias("score"))
    return J.winners(li.groupBy("folder", "src").agg(F.max("score").alias("score")), "folder", "score", "src")


def jon09_complete_sets(spark, sf):
    return J.complete_sets(load(spark, sf, "lineitem"), "l_orderkey", "l_returnflag", ("A", "N", "R"))


_CATEGORIES = ("acapella", "instrumental", "vocals")


def jon10_category_files(spark, sf):
    return J.category_files(files(spark, sf), "folder", "stem", _CATEGORIES)


def jon11_two_files(spark, sf):
    f = files(spark, sf).withColumn("dir", F.expr("concat(folder, '/', category, '/', id % 97)"))
    return J.two_file_roles(f, "dir", F.col("stem").contains("capella"))


def jon12_roles_by_folder(spark, sf):
    f = files(spark, sf).withColumn("role", classify_role(F.col("stem")))
    first = lambda r: F.min(F.when(F.col("role") == r, F.col("stem"))).alias(r)
    return f.groupBy("folder").agg(first("original"), first("acapella"), first("instrumental"))


_MAPPING = {"ECONOMY": "drums", "SMALL": "bass", "MEDIUM": "vocals"}


def jon13_label_lookup(spark, sf):
    dim = spark.createDataFrame(list(_MAPPING.items()), "category string, stem_class string")
    joined = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("category")).join(F.broadcast(dim), "category", "left")
    return joined.select("id", F.coalesce("stem_class", F.lit("other")).alias("stem_class"))


def jon14_cache_lookup(spark, sf):
    orders = load(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("model"), F.col("o_totalprice").alias("value"))
    items = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr("CASE WHEN l_linenumber % 2 = 0 THEN '1-URGENT' ELSE '2-HIGH' END").alias("model"))
    hit = items.join(orders, (items.l_orderkey == orders.o_orderkey) & (items.model == orders.model), "left")
    return hit.groupBy("l_linenumber").agg(F.count("o_orderkey").alias("hits"), F.count_if(F.col("o_orderkey").isNull()).alias("misses"))


def jon15_target_paths(spark, sf):
    f = files(spark, sf).withColumn("role", classify_role(F.col("stem")))
    both = f.where("role = 'instrumental'").select("folder", F.lit("genre").alias("target")).unionByName(f.where("role = 'acapella'").select("folder", F.lit("vocal").alias("target")))
    return both.distinct()


QUERIES = {k: v for k, v in globals().items() if k.startswith("jon")}

_T = "SELECT p_partkey AS id, lower(p_brand) AS artist, lower(p_name) AS title FROM part"
_ROLE = """CASE WHEN contains(stem, '(Original Song)') THEN 'original' WHEN contains(stem, '(Acapella)') OR contains(stem, '(lead vocals)') THEN 'acapella'
  WHEN contains(lower(stem), 'instrumental') THEN 'instrumental' END"""
_KEYS = """SELECT id, 'x:' || artist || chr(9) || title AS key FROM {t} UNION ALL SELECT id, 't:' || title FROM {t} UNION ALL SELECT id, 'a:' || artist FROM {t}
  UNION ALL SELECT id, 'h:' || substr(title, 1, 3) FROM {t} UNION ALL SELECT id, 'p:' || substr(title, 1, 6) FROM {t}"""
SQL = {
    "jon01_block_keys": f"WITH t AS (SELECT * FROM ({_T}) WHERE id % 2 = 0), k AS ({_KEYS.format(t='t')}) SELECT key, count(*) AS n, min(id) AS first_id FROM k GROUP BY 1",
    "jon02_candidates": f"WITH t AS ({_T}) SELECT a.id AS ref, b.id AS partner FROM t a JOIN t b USING (artist, title) WHERE a.id % 2 = 0 AND b.id % 2 = 1",
    "jon02_fuzzy_candidates": f"""WITH t AS ({_T}), l AS (SELECT artist, title, min(id) AS id FROM t WHERE id % 2 = 0 GROUP BY 1, 2), r AS (SELECT artist, title, min(id) AS id FROM t WHERE id % 2 = 1 GROUP BY 1, 2),
      a AS ({_KEYS.format(t='l')}), b AS ({_KEYS.format(t='r')}) SELECT DISTINCT a.id AS ref, b.id AS partner FROM a JOIN b USING (key)""",
    "jon05_find_pairs": f"""WITH t AS ({_T}), n AS (SELECT *, id % 2 AS side, row_number() OVER (PARTITION BY id % 2, artist, title ORDER BY id) AS k FROM t)
      SELECT a.id AS ref, b.id AS partner FROM (SELECT * FROM n WHERE side = 0) a FULL JOIN (SELECT * FROM n WHERE side = 1) b USING (artist, title, k)""",
    "jon08_winners": """WITH s AS (SELECT l_partkey AS folder, l_orderkey * 10 + l_linenumber AS src, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2)
      SELECT folder, src, score, CASE WHEN row_number() OVER (PARTITION BY folder ORDER BY score DESC, src) = 1 THEN 'winner' ELSE 'rejected' END AS outcome FROM s""",
    "jon09_complete_sets": "SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3",
    "jon10_category_files": f"""WITH f AS ({FILES}), h AS (SELECT folder, c AS category, stem, CASE WHEN lower(stem) = c THEN 0 WHEN suffix(lower(stem), c) THEN 1 WHEN contains(lower(stem), '(' || c || ')') THEN 2 ELSE 3 END AS rank
      FROM f, (SELECT unnest({list(_CATEGORIES)}) AS c) WHERE contains(lower(stem), c))
      SELECT folder, category, stem FROM (SELECT *, row_number() OVER (PARTITION BY folder, category ORDER BY rank, length(stem), stem) AS k FROM h) WHERE k = 1""",
    "jon11_two_files": f"""WITH f AS (SELECT *, concat(folder, '/', category, '/', id % 97) AS dir, contains(stem, 'capella')::INT AS kw FROM ({FILES})),
      g AS (SELECT *, count(*) OVER (PARTITION BY dir) AS n, sum(kw) OVER (PARTITION BY dir) AS kws, row_number() OVER (PARTITION BY dir ORDER BY bytes DESC, id) AS k FROM f)
      SELECT dir AS folder, max(CASE WHEN kws = 1 THEN CASE WHEN kw = 0 THEN id END ELSE CASE WHEN k = 1 THEN id END END) AS instrumental,
      max(CASE WHEN kws = 1 THEN CASE WHEN kw = 1 THEN id END ELSE CASE WHEN k = 2 THEN id END END) AS vocal FROM g WHERE n = 2 GROUP BY 1""",
    "jon12_roles_by_folder": f"""WITH f AS (SELECT folder, stem, {_ROLE} AS role FROM ({FILES})) SELECT folder, min(stem) FILTER (role = 'original') AS original,
      min(stem) FILTER (role = 'acapella') AS acapella, min(stem) FILTER (role = 'instrumental') AS instrumental FROM f GROUP BY 1""",
    "jon13_label_lookup": "SELECT p_partkey AS id, CASE p_type WHEN 'ECONOMY' THEN 'drums' WHEN 'SMALL' THEN 'bass' WHEN 'MEDIUM' THEN 'vocals' ELSE 'other' END AS stem_class FROM part",
    "jon14_cache_lookup": """SELECT l_linenumber, count(o_orderkey) AS hits, count(*) FILTER (o_orderkey IS NULL) AS misses FROM lineitem LEFT JOIN orders
      ON l_orderkey = o_orderkey AND o_orderpriority = CASE WHEN l_linenumber % 2 = 0 THEN '1-URGENT' ELSE '2-HIGH' END GROUP BY 1""",
    "jon15_target_paths": f"""WITH f AS (SELECT folder, {_ROLE} AS role FROM ({FILES})) SELECT DISTINCT folder, 'genre' AS target FROM f WHERE role = 'instrumental'
      UNION SELECT DISTINCT folder, 'vocal' FROM f WHERE role = 'acapella'""",
}
