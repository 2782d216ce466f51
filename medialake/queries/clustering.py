"""Near-duplicates, components and leader groups (CLU)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters as C
from ..operators.near_stems import near_links, near_pairs
from .fixtures import load

_LIMIT = 1.3


def _stems(spark, sf):
    return load(spark, sf, "embeddings").select("vec_id", F.concat_ws("-", "label", (F.col("vec_id") % 10)).alias("song"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def clu01_residual_edges(spark, sf):
    return C.residual_edges(_stems(spark, sf), "song", "vec_id", "v", _LIMIT)


def clu02_components(spark, sf):
    """Components of parts, linked by the orders that have both as least and largest part. Without SQL: a recursive query makes a row
    for each two parts of a component. Tests hold it against a union-find."""
    li = load(spark, sf, "lineitem")
    edges = li.groupBy("l_orderkey").agg(F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b")).where("a <> b").select("a", "b")
    return C.components(edges)


def clu03_keep_one(spark, sf):
    stems = _stems(spark, sf)
    return C.keep_one(stems, C.residual_links(stems, "song", "vec_id", "v", _LIMIT), "vec_id", "v").select("vec_id", "component", "kept")


def _songs(spark, sf):
    """The vectors of a label as stems of one song, each with a copy of a little more level, every third with an equal one too."""
    e = load(spark, sf, "embeddings").select(F.col("label").cast("string").alias("song"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    louder = e.withColumns({"id": F.col("id") * 4 + 1, "v": F.transform("v", lambda x, i: x * (1 + F.when(i % 2 == 0, 0.04).otherwise(0.01)))})
    return e.withColumn("id", F.col("id") * 4).unionByName(louder).unionByName(e.where("id % 3 = 0").withColumn("id", F.col("id") * 4 + 2))


def clu01_near_stems(spark, sf):
    return near_pairs(_songs(spark, sf))


def clu03_near_components(spark, sf):
    """The component of every stem that has a near or an equal one."""
    return C.components(near_links(_songs(spark, sf)))


def _tracks(spark, sf):
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lower("p_brand").alias("artist"), F.lower("p_name").alias("title"))


def clu04_leader_groups(spark, sf):
    return C.leader_groups(_tracks(spark, sf), 0.95)


def clu05_group_names(spark, sf):
    t = _tracks(spark, sf)
    exact = t.join(t.groupBy("artist", "title").agg(F.min("id").alias("leader")), ["artist", "title"]).select("id", "leader")
    return C.group_names(exact, t, F.concat_ws(" - ", "artist", "title"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("clu")}

_EDGES = f"""s AS (SELECT vec_id, label || '-' || vec_id % 10 AS song, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.song = b.song AND a.vec_id < b.vec_id
  WHERE sqrt(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) ** 2)) / len(a.v))
    / greatest(sqrt(list_sum(list_transform(a.v, lambda x: x * x)) / len(a.v)), sqrt(list_sum(list_transform(b.v, lambda x: x * x)) / len(b.v)), 1e-12) < {_LIMIT})"""
_REACH = "u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(node, c) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.node)"
_NEAR = """v AS (SELECT CAST(label AS VARCHAR) AS song, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT song, vec_id * 4 AS id, v FROM v
    UNION ALL SELECT song, vec_id * 4 + 1, list_transform(v, lambda x, i: x * (1 + CASE WHEN i % 2 = 1 THEN 0.04 ELSE 0.01 END)) FROM v UNION ALL SELECT song, vec_id * 4 + 2, v FROM v WHERE vec_id % 3 = 0),
  e AS (SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.song = b.song AND a.id < b.id
    WHERE sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) ** 2))) / greatest(sqrt(list_dot_product(a.v, a.v)), sqrt(list_dot_product(b.v, b.v))) < 0.05)"""
SQL = {
    "clu01_near_stems": f"WITH {_NEAR} SELECT a, b FROM e",
    "clu03_near_components": f"WITH RECURSIVE {_NEAR}, {_REACH} SELECT node, min(c) AS component FROM r GROUP BY 1",
    "clu01_residual_edges": f"WITH {_EDGES} SELECT a, b FROM e",
    "clu03_keep_one": f"""WITH RECURSIVE {_EDGES}, {_REACH}, m AS (SELECT node, min(c) AS c FROM r GROUP BY 1),
      p AS (SELECT vec_id, coalesce(m.c, vec_id) AS component, list_max(list_transform(v, lambda x: abs(x))) AS peak FROM s LEFT JOIN m ON node = vec_id)
      SELECT vec_id, component, row_number() OVER (PARTITION BY component ORDER BY peak, vec_id) = 1 AS kept FROM p""",
    "clu05_group_names": """SELECT min(p_partkey) AS leader, concat(lower(p_brand), ' - ', lower(p_name), CASE WHEN count(*) > 2 THEN ' [' || count(*) || ']' ELSE '' END) AS name, count(*) AS size
      FROM part GROUP BY lower(p_brand), lower(p_name)""",
}
