"""Incremental filters (FLT) and integrity decisions (INT)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facets as A
from ..operators import integrity as I
from .fixtures import UNITS, files, load, units


def flt03_unprocessed(spark, sf):
    return I.unprocessed(load(spark, sf, "documents").select("doc_id", "source"), load(spark, sf, "labels"), ["doc_id"])


def flt03_songs_not_tagged(spark, sf):
    return I.songs_not_all_tagged(load(spark, sf, "lineitem"), "l_orderkey", F.col("l_discount") > 0)


def flt04_no_output_yet(spark, sf):
    items = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("song_"), (F.col("o_orderkey") % 500).cast("string")).alias("name"))
    done = load(spark, sf, "customer").where("c_custkey < 400").select(F.expr("concat('song_', c_custkey, ' [', c_mktsegment, ']')").alias("out"))
    return I.unprocessed(items, done.select(F.regexp_replace("out", r" \[.*$", "").alias("name")), ["name"])


def flt05_cache_misses(spark, sf):
    items = load(spark, sf, "part").select(F.col("p_partkey").alias("path"), (F.col("p_size") % 3).alias("mtime"), F.lit("m2").alias("model"))
    cache = load(spark, sf, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("path"), F.expr("CASE WHEN p_size > 25 THEN 0 ELSE p_size % 3 END").alias("mtime"), F.expr("CASE WHEN p_size % 10 = 0 THEN 'm1' ELSE 'm2' END").alias("model"))
    return I.unprocessed(items, cache, ["path", "mtime", "model"])


def flt07_prescan(spark, sf):
    f = files(spark, sf)
    return I.prescan(f, F.when(F.col("id") % 13 != 0, F.col("bytes") * (F.col("id") % 7)), F.col("size") % 5).select("id", "reason")


def flt08_incomplete(spark, sf):
    o = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("written"), F.sum("l_quantity").alias("seconds"))
    missing, verdict = I.missing_categories(("A", "N", "R"), F.col("written"), F.col("seconds"), 60.0)
    return o.select("l_orderkey", F.array_join(F.array_sort(missing), ",").alias("missing"), verdict.alias("verdict"))


def flt09_changed_only(spark, sf):
    return A.bucket(units(spark, sf), "gender").where("n > 0").select("name", "n")


def flt10_optimal(spark, sf):
    f = files(spark, sf).withColumns({"rate": F.expr("CASE size % 3 WHEN 0 THEN 44100 WHEN 1 THEN 48000 ELSE 96000 END"), "subtype": F.expr("CASE size % 4 WHEN 0 THEN 'PCM_16' WHEN 1 THEN 'PCM_24' ELSE 'FLOAT' END"), "channels": F.col("size") % 2 + 1})
    return f.where("ext = '.flac' and rate = 44100 and subtype in ('PCM_16', 'PCM_24') and channels = 2").select("id")


_DEEP = "CASE id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'minor' WHEN 2 THEN 'failed' END"


def _checks(spark, sf):
    return units(spark, sf).select("id", (F.col("gender") == "female").alias("fast"), F.expr(_DEEP).alias("deep"))


def int01_merge_status(spark, sf):
    return _checks(spark, sf).select("id", *[I.merge_status(m, F.col("fast"), F.col("deep")).alias(m) for m in ("fast", "deep", "both")])


def int05_slack(spark, sf):
    return units(spark, sf).select("id", I.within_slack(F.col("duration"), F.floor("duration") + 0.75).alias("within"))


def int03_mp3_walk(spark, sf):
    """Frames of byte strings made of each part's number of silent frames, some cut short."""
    frame = "concat('FFFB9000', repeat('00', 413))"
    data = F.unhex(F.expr(f"substr(repeat({frame}, p_size % 5), 1, 834 * (p_size % 5) - CASE WHEN p_size % 2 = 0 THEN 20 ELSE 0 END)"))
    return load(spark, sf, "part").select("p_partkey", I.mp3_walk(data).alias("w")).select("p_partkey", "w.frames", "w.problem")


def int02_fast_check(spark, sf):
    f = files(spark, sf).withColumns({"problem": F.expr("CASE WHEN size % 3 = 0 THEN 'LOST SYNC' END"), "bits": F.expr("CASE size % 4 WHEN 0 THEN 32 WHEN 1 THEN 24 WHEN 2 THEN 16 END")})
    ok, detail = I.fast_check(F.col("ext"), F.col("problem"), F.col("bits"))
    return f.select("id", ok.alias("ok"), detail.alias("detail"))


def int04_frame_audit(spark, sf):
    """Byte strings of each part's number of silent frames; the first states a count that is right, one less, or absent."""
    head = "concat('FFFB9000', repeat('00', 32), CASE WHEN p_size % 3 = 0 THEN repeat('00', 12) ELSE concat('496E666F', '00000001', lpad(hex(p_size % 5 + p_size % 2), 8, '0')) END, repeat('00', 369))"
    data = F.unhex(F.expr(f"concat({head}, repeat(concat('FFFB9000', repeat('00', 413)), p_size % 5))"))
    walked = load(spark, sf, "part").select("p_partkey", I.mp3_walk(data).alias("w"))
    return walked.select("p_partkey", F.col("w.stated").alias("expected"), (F.col("w.frames") - 1).alias("counted"), I.frame_audit(F.col("w.stated"), F.col("w.frames") - 1).alias("verdict"))


def int06_sniff(spark, sf):
    head = F.unhex(F.expr("CASE id % 5 WHEN 0 THEN '524946460000000057415645' WHEN 1 THEN '664C614300000022' WHEN 2 THEN '4944330400' WHEN 3 THEN 'FFFB9000' ELSE '00FF' END"))
    f = files(spark, sf).select("id", I.sniffed(head).alias("found"), F.regexp_replace("ext", r"^\.", "").alias("named"))
    return f.withColumn("note", F.when(F.col("found").isin("wav", "flac") & (F.col("found") != F.col("named")), "wrong extension"))


def int07_fix_outcomes(spark, sf):
    both = I.merge_status("both", F.col("fast"), F.col("deep"))
    out = _checks(spark, sf).withColumn("outcome", I.outcome_after_fix(both, F.col("id") % 3 == 0, F.col("id") % 2 == 0))
    return A.outcome_counts(out, "outcome", ("fixed", "leave", "quarantine"))


def int08_compression_counts(spark, sf):
    u = units(spark, sf).withColumn("state", F.expr("CASE WHEN id % 4 = 0 AND compression IS NOT NULL THEN 'skipped' WHEN compression IS NULL THEN 'new' ELSE 'done' END"))
    return u.groupBy(F.coalesce("compression", F.lit("unknown")).alias("compression")).agg(F.count_if(F.col("state") == "skipped").alias("skipped"), F.count(F.lit(1)).alias("total"))


QUERIES = {k: v for k, v in globals().items() if k.startswith(("flt", "int"))}

_C = f"SELECT id, gender = 'female' AS fast, {_DEEP} AS deep FROM ({UNITS})"
_BOTH = """CASE WHEN fast = false AND coalesce(deep, 'failed') = 'ok' THEN 'suspect' WHEN fast = false AND coalesce(deep, 'failed') = 'minor' THEN 'minor'
  WHEN fast = false THEN 'failed' ELSE coalesce(deep, 'failed') END"""
_F = "SELECT p_partkey AS id, p_size AS size, CAST(p_retailprice * 100 AS BIGINT) AS bytes, CASE p_partkey % 5 WHEN 0 THEN 'mp3' WHEN 1 THEN 'wav' WHEN 2 THEN 'flac' WHEN 3 THEN 'aiff' ELSE 'txt' END AS ext FROM part"
SQL = {
    "flt03_unprocessed": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "flt03_songs_not_tagged": "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING NOT bool_and(l_discount > 0)",
    "flt04_no_output_yet": "SELECT 'song_' || o_orderkey % 500 AS name, o_orderkey AS id FROM orders WHERE o_orderkey % 500 NOT IN (SELECT c_custkey FROM customer WHERE c_custkey < 400)",
    "flt05_cache_misses": "SELECT p_partkey AS path, p_size % 3 AS mtime, 'm2' AS model FROM part WHERE NOT (p_partkey % 2 = 0 AND p_size % 10 <> 0 AND CASE WHEN p_size > 25 THEN 0 ELSE p_size % 3 END = p_size % 3)",
    "flt07_prescan": f"SELECT id, CASE WHEN id % 13 = 0 THEN 'unreadable' WHEN bytes * (id % 7) = 0 THEN 'empty' WHEN size % 5 = 0 THEN 'no_frames' END AS reason FROM ({_F})",
    "flt08_incomplete": """WITH o AS (SELECT l_orderkey, sum(l_quantity) < 60 AS short, concat_ws(',', CASE WHEN count(*) FILTER (l_returnflag = 'A') = 0 THEN 'A' END, CASE WHEN count(*) FILTER (l_returnflag = 'N') = 0 THEN 'N' END,
      CASE WHEN count(*) FILTER (l_returnflag = 'R') = 0 THEN 'R' END) AS missing FROM lineitem GROUP BY 1)
      SELECT l_orderkey, missing, CASE WHEN short AND missing <> '' THEN 'both' WHEN short THEN 'short' WHEN missing <> '' THEN 'incomplete' END AS verdict FROM o""",
    "flt09_changed_only": f"SELECT gender AS name, count(*) AS n FROM ({UNITS}) WHERE gender <> '' GROUP BY 1",
    "flt10_optimal": f"SELECT id FROM ({_F}) WHERE ext = 'flac' AND size % 3 = 0 AND size % 4 IN (0, 1) AND size % 2 = 1",
    "int01_merge_status": f"SELECT id, CASE WHEN fast = false THEN 'suspect' ELSE 'ok' END AS fast, coalesce(deep, 'failed') AS deep, {_BOTH} AS both FROM (SELECT id, fast, deep FROM ({_C}))",
    "int05_slack": f"SELECT id, abs(duration - (floor(duration) + 0.75)) <= 0.5 AS within FROM ({UNITS})",
    "int03_mp3_walk": """SELECT p_partkey, CAST(CASE WHEN p_size % 2 = 0 THEN greatest(p_size % 5 - 1, 0) ELSE p_size % 5 END AS INT) AS frames,
      CASE WHEN p_size % 5 = 0 THEN 'NO FRAMES' WHEN p_size % 2 = 0 THEN 'TRUNCATED' ELSE '' END AS problem FROM part""",
    "int02_fast_check": f"""SELECT id, NOT (ext = 'mp3' AND size % 3 = 0 OR ext = 'flac' AND size % 4 = 0) AS ok,
      CASE WHEN ext NOT IN ('mp3', 'flac') THEN 'n/a' WHEN ext = 'mp3' AND size % 3 = 0 THEN 'LOST SYNC' WHEN ext = 'flac' AND size % 4 = 0 THEN 'FLAC bit depth 32 unsupported (max 24)' ELSE '' END AS detail FROM ({_F})""",
    "int04_frame_audit": """SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_size % 5 + p_size % 2 END AS expected, p_size % 5 AS counted,
      CASE WHEN p_size % 3 = 0 THEN 'no count stated' WHEN p_size % 2 = 0 THEN 'ok' ELSE 'one frame short' END AS verdict FROM part""",
    "int06_sniff": f"""WITH x AS (SELECT id, CASE id % 5 WHEN 0 THEN 'wav' WHEN 1 THEN 'flac' WHEN 2 THEN 'id3' WHEN 3 THEN 'mp3' ELSE 'unknown' END AS found, ext AS named FROM ({_F}))
      SELECT *, CASE WHEN found IN ('wav', 'flac') AND found <> named THEN 'wrong extension' END AS note FROM x""",
    "int07_fix_outcomes": f"""WITH s AS (SELECT id, {_BOTH} AS s FROM ({_C})), o AS (SELECT CASE WHEN s = 'ok' THEN 'leave' WHEN id % 3 = 0 AND id % 2 = 0 THEN 'fixed' WHEN s = 'failed' THEN 'quarantine' ELSE 'leave' END AS outcome FROM s)
      SELECT t.outcome, count(o.outcome) AS n, ord FROM (VALUES ('fixed', 0), ('leave', 1), ('quarantine', 2)) t(outcome, ord) LEFT JOIN o USING (outcome) GROUP BY 1, 3""",
    "int08_compression_counts": f"SELECT coalesce(compression, 'unknown') AS compression, count(*) FILTER (id % 4 = 0 AND compression IS NOT NULL) AS skipped, count(*) AS total FROM ({UNITS}) GROUP BY 1",
}
