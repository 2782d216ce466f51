"""Tables behind the sinks (SNK)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import balance as B
from ..operators.integrity import merge_status
from ..sources import sinks as K
from ..sources.containers import with_tags
from ..tables import shared_folder
from .containers import ID3_FORMS, TAGGED, VORBIS_FORMS, tagged_files
from .fixtures import FILES, UNITS, files, load, units


def snk01_balanced_rows(spark, sf):
    return K.balanced_rows(units(spark, sf))


def snk02_result_rows(spark, sf):
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_size")
    return K.result_rows([p.where("id % 2 = 0").select("id", "p_name"), p.where("id % 2 = 1").select("id", "p_size")])


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def snk03_report_csv(spark, sf):
    """The report as it reads back from the written CSV."""
    report = files(spark, sf).select("id", "stem", "bytes", F.expr("CASE WHEN size % 2 = 0 THEN 'converted' ELSE 'skipped, kept' END").alias("action"))
    K.write_csv(report, path := _folder(spark, "report"))
    return spark.read.schema(report.schema).option("header", True).csv(path)


def snk04_json_lines(spark, sf):
    """Result or error objects, one a line, as they read back."""
    rows = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.expr("CASE WHEN p_size % 5 <> 0 THEN p_name END").alias("label"), F.expr("CASE WHEN p_size % 5 = 0 THEN 'silent' END").alias("error"))
    K.write_json_lines(rows, path := _folder(spark, "results"))
    return spark.read.schema(rows.schema).json(path)


def snk05_song_list(spark, sf):
    """Lines of the list of folders, as they read back."""
    K.write_list(files(spark, sf).select("folder").distinct(), "folder", path := _folder(spark, "songs"))
    return spark.read.text(path)


def snk06_overview(spark, sf):
    """Found, chosen and target counts of a balanced selection, one row a role."""
    every, chosen = units(spark, sf), B.select_balanced(units(spark, sf), ("genre",))
    found, taken = every.groupBy("role").agg(F.count(F.lit(1)).alias("found")), chosen.groupBy("role").agg(F.count(F.lit(1)).alias("chosen"), F.max("target").alias("target"))
    return found.join(taken, "role", "left").select("role", "found", F.coalesce("chosen", F.lit(0)).alias("chosen"), F.coalesce("target", F.lit(0)).alias("target"))


def snk07_manifest(spark, sf):
    """A manifest that is written again: readers see the last version whole."""
    rows = files(spark, sf).select("id", "stem", "bytes")
    K.write_manifest(rows.where("id % 2 = 0"), path := _folder(spark, "manifest"))
    K.write_manifest(rows, path)
    return K.read_manifest(spark, path)


def snk08_copy_plan(spark, sf):
    items = files(spark, sf).select(F.col("stem").alias("src"), F.concat("category", F.lit("/"), F.col("id").cast("string")).alias("dst"))
    return K.copy_plan(items, items.where(F.col("dst").endswith("7")))


def snk09_two_phase(spark, sf):
    return K.two_phase_plan(load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("source"), F.upper("p_name").alias("final")))


def snk10_prefix_moves(spark, sf):
    return K.prefix_moves(files(spark, sf), F.regexp_replace("stem", r"^\[DL\] - ", ""))


def snk11_tag_updates(spark, sf):
    return K.tag_updates(units(spark, sf), "COMPRESSION", F.expr("CASE WHEN id % 3 = 0 THEN 'odd' ELSE compression END"))


def snk12_vorbis_tags(spark, sf):
    """Tags of several containers under one name keep all values; names take the allowed characters."""
    tags = F.expr("""map('tpe1', array(p_brand), 'x~y', array(p_type, ' '), 'TIT2', array(CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END), 'TDRC', array('1999'), 'TYER', array(concat('', p_size)),
      'ключ', array('x'), 'TXXX:mood=é', array('calm'), '----:com.apple.iTunes:initialkey', array('Am'), 'UFID:me', array('id'))""")
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.explode(K.vorbis_tags(tags)).alias("name", "values")).select("id", "name", F.posexplode("values").alias("nth", "value"))


def snk12_copied_tags(spark, sf):
    """What a copy to FLAC gets of the tags that each part's file holds in its own container."""
    copied = with_tags(tagged_files(spark, sf)).select("id", F.explode(K.vorbis_tags(F.col("tags"))).alias("name", "values"))
    return copied.select("id", "name", F.array_join("values", " / ").alias("value"))


def snk14_quarantine(spark, sf):
    u = units(spark, sf)
    return K.quarantine_plan(u, merge_status("both", F.col("gender") == "female", F.expr("CASE id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'minor' WHEN 2 THEN 'failed' END")), "quarantine")


QUERIES = {k: v for k, v in globals().items() if k.startswith("snk")}

SQL = {
    "snk03_report_csv": f"SELECT id, stem, bytes, CASE WHEN size % 2 = 0 THEN 'converted' ELSE 'skipped, kept' END AS action FROM ({FILES})",
    "snk04_json_lines": "SELECT p_partkey AS id, CASE WHEN p_size % 5 <> 0 THEN p_name END AS label, CASE WHEN p_size % 5 = 0 THEN 'silent' END AS error FROM part",
    "snk05_song_list": f"SELECT DISTINCT folder AS value FROM ({FILES})",
    "snk07_manifest": f"SELECT id, stem, bytes FROM ({FILES})",
    "snk01_balanced_rows": f"""SELECT role, id, coalesce(genre, '') AS genre, coalesce(style, '') AS style, coalesce(gender, '') AS gender, coalesce(reverb, '') AS reverb, coalesce(vocal_type, '') AS vocal_type,
      coalesce(music_key, '') AS music_key, coalesce(compression, '') AS compression, CASE WHEN sdr IS NULL THEN '' ELSE printf('%.3f', CAST(sdr AS DOUBLE)) END AS sdr, bytes,
      printf('%.3f', CAST(duration AS DOUBLE)) AS duration FROM ({UNITS})""",
    "snk02_result_rows": "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS p_name, CASE WHEN p_partkey % 2 = 1 THEN p_size END AS p_size FROM part",
    "snk08_copy_plan": f"SELECT stem AS src, category || '/' || id AS dst, CASE WHEN suffix(CAST(id AS VARCHAR), '7') THEN 'skip' ELSE 'copy' END AS op FROM ({FILES})",
    "snk09_two_phase": "SELECT p_partkey AS id, 1 AS step, p_name AS src, '.renaming-' || p_partkey AS dst FROM part UNION ALL SELECT p_partkey, 2, '.renaming-' || p_partkey, upper(p_name) FROM part",
    "snk10_prefix_moves": f"SELECT id, folder FROM ({FILES})",
    "snk11_tag_updates": f"SELECT id, 'COMPRESSION' AS field, compression AS value FROM ({UNITS}) WHERE id % 3 <> 0 AND compression IS NOT NULL",
    "snk12_vorbis_tags": """SELECT p_partkey AS id, name, nth, value FROM part, LATERAL (VALUES ('ARTIST', 0, p_brand), ('X_Y', 0, p_type), ('TITLE', 0, CASE WHEN p_size % 2 = 0 THEN p_name END),
      ('DATE', 0, '1999'), ('DATE', 1, CAST(p_size AS VARCHAR)), ('MOOD', 0, 'calm'), ('INITIALKEY', 0, 'Am'), ('UFID:me', 0, 'id')) t(name, nth, value) WHERE value IS NOT NULL""",
    "snk12_copied_tags": f"""WITH f AS ({TAGGED}) SELECT id, name, value FROM f, LATERAL (VALUES
      ('TITLE', CASE WHEN form = 'id3v1' THEN 'a title' WHEN form NOT IN ('cut', 'looping', 'empty') THEN stem END),
      ('ARTIST', CASE WHEN form IN ('id3v2.3 latin', 'wav id3') THEN folder || ' é / second' WHEN {ID3_FORMS} OR {VORBIS_FORMS} THEN folder || ' Жé😀ÿ / second'
        WHEN form IN ('wav info', 'mp4') THEN folder || ' Жé😀ÿ' WHEN form = 'id3v1' THEN 'an artist' END),
      ('GENRE', CASE WHEN form NOT IN ('cut', 'looping', 'empty', 'id3v1') THEN category END), ('COMMENT', CASE WHEN {ID3_FORMS} THEN 'a note' END),
      ('MOOD', CASE WHEN form NOT IN ('cut', 'looping', 'empty', 'id3v1', 'wav info') THEN concat('mood ', size) END),
      (CASE k WHEN 'Am' THEN 'INITIALKEY' ELSE 'KEY' END, CASE WHEN {ID3_FORMS} OR {VORBIS_FORMS} OR form = 'mp4' THEN k END),
      ('DATE', CASE WHEN form = 'id3v1' THEN '1999' END), ('TRACKNUMBER', CASE WHEN form = 'mp4' THEN '3/9' END)) t(name, value) WHERE value IS NOT NULL""",
    "snk14_quarantine": f"""SELECT id, 'quarantine' AS op, 'quarantine/' || id AS dst FROM ({UNITS}) WHERE CASE WHEN gender = 'male' THEN id % 4 IN (2, 3) ELSE id % 4 IN (2, 3) END""",
}
