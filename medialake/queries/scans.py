"""Scans and what follows from paths (SRC)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import filename_tags
from ..sources import listing as L
from .fixtures import FILES, files, load

_PATH = "concat(lower(category), '/', folder, '/', stem, ext)"


def _paths(spark, sf):
    return files(spark, sf).withColumn("path", F.expr(_PATH))


def src01_list_files(spark, sf):
    found = L.list_files(spark, sf)
    return found.select(F.regexp_extract("path", "([^/]+\\.parquet)", 1).alias("name"), "length").groupBy("name").agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files"))


def src02_scan_variants(spark, sf):
    one = [L.of_kind(_paths(spark, sf), k).select(F.lit(k).alias("kind"), "id") for k in sorted(L.FORMATS)]
    every = one[0]
    for df in one[1:]:
        every = every.unionByName(df)
    return every.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


def src03_rename_source(spark, sf):
    return L.rename_source(_paths(spark, sf).select("id", "path")).drop("path")


def src04_pair_folders(spark, sf):
    return L.pair_folders(files(spark, sf).withColumn("folder", F.expr("concat(folder, CASE WHEN size % 2 = 0 THEN concat('/', lower(category)) ELSE '' END)")))


def src05_song_groups(spark, sf):
    paths = _paths(spark, sf)
    return L.song_groups(paths, "subfolders").withColumn("mode", F.lit("subfolders")).unionByName(L.song_groups(paths, "recursive").withColumn("mode", F.lit("recursive")))


def src06_union_roots(spark, sf):
    paths = files(spark, sf)
    low = paths.select("id", F.expr("concat(folder, '/', lower(category), ext)").alias("path"))
    high = paths.select("id", F.expr("concat(folder, '/', category, ext)").alias("path")).where("id % 2 = 1")
    return L.union_roots([high.groupBy("path").agg(F.min("id").alias("id")), low.groupBy("path").agg(F.min("id").alias("id"))])


def src07_distinct_paths(spark, sf):
    paths = files(spark, sf).select("id", F.expr("concat(folder, '/', CASE WHEN id % 2 = 0 THEN category ELSE lower(category) END, ext)").alias("path"))
    return L.union_roots([paths], fold_case=False).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def src08_listed_paths(spark, sf):
    lines = files(spark, sf).select("id", F.expr("CASE size % 4 WHEN 0 THEN concat('\"', stem, ext, '\"') WHEN 1 THEN concat('  ', stem, ext) WHEN 2 THEN '' ELSE concat(stem, ext) END").alias("value"))
    return L.listed_paths(lines).select("id", "path")


_TAGS = """map('TCON', CASE WHEN ext = '.mp3' THEN folder ELSE '' END, 'genre', category, 'GENRE', CASE WHEN size % 2 = 0 THEN lower(folder) ELSE ' ' END,
  'TXXX:genre', CASE WHEN size % 3 = 0 THEN 'own' END)"""


def src09_tag_value(spark, sf):
    return files(spark, sf).select("id", L.tag_value(F.expr(_TAGS), F.col("ext"), "genre").alias("genre"))


def src11_tag_fields(spark, sf):
    tags = F.expr("map('TXXX:GENDER', CASE WHEN size % 2 = 0 THEN ' female ' END, 'gender', CASE WHEN size % 3 = 0 THEN 'male' ELSE '' END, 'COMM', stem)")
    return files(spark, sf).select("id", *[L.tag_value(tags, F.col("ext"), c).alias(c) for c in ("gender", "comment")])


def src13_sizes(spark, sf):
    """Bytes and probed seconds of each file; unreadable lengths count 0."""
    frames = F.expr("CASE WHEN size % 9 = 0 THEN NULL ELSE bytes END")
    return files(spark, sf).select("id", "bytes", F.round(F.coalesce(L.probed_duration(frames, F.lit(44_100)), F.lit(0.0)), 4).alias("seconds"))


def src10_key_tag(spark, sf):
    tags = F.expr("map('INITIALKEY', CASE WHEN size % 3 = 0 THEN 'Am' ELSE ' ' END, 'KEY', CASE WHEN size % 2 = 0 THEN 'C' ELSE '' END)")
    return files(spark, sf).select("id", L.first_tag(tags, ("INITIALKEY", "KEY")).alias("music_key"))


def src12_artist_title(spark, sf):
    tags = F.expr("map('ARTIST', CASE WHEN size % 3 = 0 THEN folder ELSE '' END, 'TPE1', CASE WHEN size % 3 = 1 THEN lower(folder) ELSE '' END)")
    artist, _ = filename_tags(F.col("stem"))
    return files(spark, sf).select("id", F.coalesce(L.first_tag(tags, ("ARTIST", "TPE1")), artist).alias("artist"))


def src14_probe(spark, sf):
    frames, rate = F.col("l_orderkey") * 100_000, F.when(F.col("l_linenumber") > 1, F.lit(44_100)).otherwise(0)
    return load(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(L.probed_duration(frames, rate)), 2).alias("seconds"))


def src16_label_index(spark, sf):
    return L.label_index(load(spark, sf, "part").select("p_name").distinct(), "p_name")


def src17_cache_entries(spark, sf):
    events = load(spark, sf, "events").withColumn("json", F.expr("CASE WHEN event_id % 10 = 0 THEN '{broken' ELSE props END"))
    return L.cache_entries(events, "k int").where("entry.k is not null").groupBy("event_type").agg(F.count(F.lit(1)).alias("entries"), F.sum("entry.k").alias("total"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("src")}

_KINDS = " UNION ALL ".join(f"SELECT '{k}' AS kind, unnest({list(v)}) AS e" for k, v in sorted(L.FORMATS.items()))
_ROLES = "regexp_matches(stem, '(?i)instrumental') AND NOT contains(stem, '(Original Song)') AS i, regexp_matches(stem, '(?i)acapella|lead vocals') AS v"
SQL = {
    "src02_scan_variants": f"WITH k AS ({_KINDS}) SELECT kind, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM ({FILES}) f JOIN k ON '.' || k.e = f.ext GROUP BY kind",
    "src03_rename_source": rf"""SELECT id, 2 AS depth, folder AS parent, stem, replace(ext, '.', '') AS extension, regexp_extract(stem, '(?i)\b(\d{{2,3}})\s*bpm\b', 1) AS bpm,
      regexp_extract(stem, '(?i)\b([A-G](?:#m|b)?(?:m|min|maj|major|minor)?)\b', 1) AS music_key FROM ({FILES})""",
    "src04_pair_folders": f"""WITH f AS (SELECT *, concat(folder, CASE WHEN size % 2 = 0 THEN concat('/', lower(category)) ELSE '' END) AS dir FROM ({FILES})),
      r AS (SELECT dir, bool_or(i) AND bool_or(v) AS ok FROM (SELECT dir, {_ROLES} FROM f) GROUP BY dir), m AS (SELECT dir FROM r WHERE ok)
      SELECT dir AS folder FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE prefix(m.dir, o.dir || '/'))""",
    "src05_song_groups": f"""WITH f AS (SELECT *, {_PATH} AS path FROM ({FILES}))
      SELECT lower(category) AS song, count(*) AS n_files, min(path) AS first_file, 'subfolders' AS mode FROM f GROUP BY lower(category)
      UNION ALL SELECT lower(category) || '/' || folder, count(*), min(path), 'recursive' FROM f GROUP BY lower(category) || '/' || folder""",
    "src06_union_roots": f"""WITH p AS (SELECT 0 AS root, id, concat(folder, '/', category, ext) AS path FROM ({FILES}) WHERE id % 2 = 1
      UNION ALL SELECT 1, id, concat(folder, '/', lower(category), ext) FROM ({FILES})), g AS (SELECT root, path, min(id) AS id FROM p GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY lower(path) ORDER BY root, path) AS k FROM g) SELECT path, id, root FROM r WHERE k = 1""",
    "src07_distinct_paths": f"SELECT DISTINCT concat(folder, '/', CASE WHEN id % 2 = 0 THEN category ELSE lower(category) END, ext) AS path, CAST(1 AS BIGINT) AS n FROM ({FILES})",
    "src08_listed_paths": f"SELECT id, trim(stem) || ext AS path FROM ({FILES}) WHERE size % 4 <> 2 AND ext <> '.txt'",
    "src09_tag_value": f"""SELECT id, CASE WHEN ext = '.mp3' THEN folder WHEN ext IN ('.wav', '.aiff') THEN CASE WHEN size % 3 = 0 THEN 'own' ELSE '' END
      WHEN size % 2 = 0 THEN lower(folder) ELSE category END AS genre FROM ({FILES})""",
    "src11_tag_fields": f"""SELECT id, CASE WHEN ext IN ('.mp3', '.wav', '.aiff') THEN CASE WHEN size % 2 = 0 THEN 'female' ELSE '' END WHEN size % 3 = 0 THEN 'male' ELSE '' END AS gender,
      CASE WHEN ext IN ('.mp3', '.wav', '.aiff') THEN stem ELSE '' END AS comment FROM ({FILES})""",
    "src13_sizes": f"SELECT id, bytes, round(CASE WHEN size % 9 = 0 THEN 0 ELSE bytes / 44100.0 END, 4) AS seconds FROM ({FILES})",
    "src10_key_tag": f"SELECT id, CASE WHEN size % 3 = 0 THEN 'Am' WHEN size % 2 = 0 THEN 'C' END AS music_key FROM ({FILES})",
    "src12_artist_title": f"SELECT id, CASE WHEN size % 3 = 1 THEN lower(folder) ELSE folder END AS artist FROM ({FILES})",
    "src14_probe": """SELECT l_returnflag, round(sum(CASE WHEN l_linenumber > 1 AND l_orderkey * 100000 <= 345600000 THEN l_orderkey * 100000 / 44100.0 ELSE 0 END), 2) AS seconds
      FROM lineitem GROUP BY 1""",
    "src16_label_index": "SELECT p_name, CAST(row_number() OVER (ORDER BY p_name) - 1 AS INT) AS idx FROM (SELECT DISTINCT p_name FROM part)",
    "src17_cache_entries": """SELECT event_type, count(*) AS entries, CAST(sum(CAST(props->>'$.k' AS INT)) AS BIGINT) AS total FROM events
      WHERE event_id % 10 <> 0 AND props->>'$.k' IS NOT NULL GROUP BY 1""",
}
