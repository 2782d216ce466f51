"""Projections over file names, tags and keys (PRJ)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from .fixtures import FILES, UNITS, files, load, units

_SLASHED = "concat(p_type, CASE WHEN p_size % 2 = 0 THEN ' / ' WHEN p_size % 3 = 0 THEN '' ELSE '/' END, p_name)"


def prj01_split_slash(spark, sf):
    first, second = N.split_slash(F.expr(_SLASHED))
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), first.alias("first"), second.alias("second"))


def prj02_normalize_tags(spark, sf):
    p = load(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.expr("concat(p_brand, '/', p_name)").alias("genre_tag"),
        F.expr("CASE p_size % 4 WHEN 0 THEN ' Female ' WHEN 1 THEN 'male/wet' WHEN 2 THEN 'robot' ELSE '' END").alias("gender_tag"),
        F.expr("CASE p_size % 3 WHEN 0 THEN '12.5 dB' WHEN 1 THEN 'n/a' ELSE cast(p_size AS string) END").alias("sdr_tag"),
    )
    genre, style = N.split_slash(F.col("genre_tag"))
    gender, reverb = N.split_slash(F.col("gender_tag"))
    return p.select("id", genre.alias("genre"), style.alias("style"), N.one_of(gender, N.GENDERS).alias("gender"), N.one_of(reverb, N.REVERBS).alias("reverb"), N.parse_sdr(F.col("sdr_tag")).alias("sdr"))


_RAW_KEY = "CASE p_partkey % 8 WHEN 0 THEN 'Db/C#' WHEN 1 THEN 'c#' WHEN 2 THEN 'Am' WHEN 3 THEN ' bbm / a#m ' WHEN 4 THEN 'H' WHEN 5 THEN 'G#m' WHEN 6 THEN '' ELSE 'eb' END"


def prj03_normalize_key(spark, sf):
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), N.normalize_key(F.expr(_RAW_KEY)).alias("short_key"))


def prj04_key_display(spark, sf):
    display = N.key_display(N.normalize_key(F.expr(_RAW_KEY)))
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), display.alias("display"), N.key_chart_label(display).alias("label"))


def prj05_treated_as_vocal(spark, sf):
    return files(spark, sf).select("id", N.treated_as_vocal(F.col("stem")).alias("as_vocal"))


def prj06_ignore_rules(spark, sf):
    return files(spark, sf).select("id", N.ignore(F.col("stem"), keywords=("bpm",)).alias("name"))


def prj07_normalize_tag(spark, sf):
    return files(spark, sf).select("id", N.normalize_tag(F.regexp_replace("stem", "small", "R&B")).alias("tag"))


def prj08_filename_tags(spark, sf):
    artist, title = N.filename_tags(F.col("stem"))
    return files(spark, sf).select("id", artist.alias("artist"), title.alias("title"))


def prj09_tempo_and_key(spark, sf):
    return files(spark, sf).select("id", N.tempo(F.col("stem")).alias("bpm"), N.key_in_name(F.col("stem")).alias("music_key"))


def prj10_strip_suffixes(spark, sf):
    return files(spark, sf).select("id", N.strip_role_suffix(N.strip_bracket_tags(F.col("stem"))).alias("name"))


def prj11_classify_role(spark, sf):
    return files(spark, sf).select("id", N.classify_role(F.col("stem")).alias("role"))


def prj12_only_stems(spark, sf):
    return files(spark, sf).select("id", N.vocals_only(F.col("stem")).alias("vocals_only"), N.instrumental_only(F.col("stem")).alias("instrumental_only"))


_CATEGORISED = "CASE p_size % 3 WHEN 0 THEN concat(lower(p_type), '_', p_name) WHEN 1 THEN concat(p_name, '-', p_type) ELSE p_name END"


def prj13_song_key(spark, sf):
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), N.song_key(F.expr(_CATEGORISED), F.col("p_type")).alias("song"))


def prj14_folder_names(spark, sf):
    name = F.expr("concat(p_brand, ': ', p_name, CASE WHEN p_size % 2 = 0 THEN '_BALANCED' ELSE '. ' END)")
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), N.slug(name).alias("slug"), N.safe_folder(name).alias("folder"), N.balanced_root(name).alias("root"))


def prj15_formats(spark, sf):
    return units(spark, sf).select(
        "id", N.clock(F.col("duration")).alias("clock"), N.hours_clock(F.col("duration") * 8).alias("hours"), N.sized(F.col("bytes") * 1_000_000).alias("size")
    )


def prj16_strictness(spark, sf):
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.round(N.strictness_threshold(F.col("p_size") * 3 - 20), 6).alias("threshold"))


_VERDICT = "CASE p_size % 5 WHEN 0 THEN 'AUTHENTIC' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'SUSPICIOUS' WHEN 3 THEN 'FAKE_CERTAIN' ELSE 'UNKNOWN' END"


def prj17_compression(spark, sf):
    return files(spark, sf).select("id", N.compression_of(F.expr(_VERDICT.replace("p_size", "size")), F.col("ext")).alias("compression"))


_KBPS = "CASE size % 4 WHEN 0 THEN 320 WHEN 1 THEN 245 WHEN 2 THEN 128 END"


def prj18_lossy_suffix(spark, sf):
    stem = F.expr("CASE WHEN size % 7 = 0 THEN concat(stem, '_mp3-vbr') ELSE stem END")
    return files(spark, sf).select("id", N.lossy_suffix(stem, F.expr(_KBPS)).alias("name"))


def prj19_genre_label(spark, sf):
    genre, style = N.genre_label(F.expr("CASE WHEN p_size % 4 = 0 THEN p_type ELSE concat(p_type, '---', p_name) END"))
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), genre.alias("genre"), style.alias("style"))


def prj20_combined_tag(spark, sf):
    return units(spark, sf).select("id", N.combined_tag(F.col("gender"), F.col("reverb")).alias("tag"))


_MODES = {"2 stems": "2", "4 stems": "4", "2 (old)": "2"}


def prj21_stem_mode(spark, sf):
    raw = F.expr("CASE p_size % 4 WHEN 0 THEN '2 stems' WHEN 1 THEN '4 stems' WHEN 2 THEN '2 (old)' ELSE 'other' END")
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), N.stem_mode(raw, _MODES, "6").alias("mode"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("prj")}

_ROLE_TAIL = r"(\s*\(([^)]*\b)?(original song|original|acapella|vocals?|lead|bgv|instrumental|inst|karaoke)( [^)]*)?\))+\s*$"
_BARE = rf"trim(regexp_replace(trim(regexp_replace(stem, '(\s*\[[^\]]+\])+\s*$', '')), '(?i){_ROLE_TAIL}', ''))"
_CORE = rf"trim(regexp_replace(trim(regexp_replace(regexp_replace(stem, '^\s*\[[^\]]*\]\s*-\s*', ''), '(\s*\[[^\]]+\])+\s*$', '')), '(?i){_ROLE_TAIL}', ''))"
_KEY_SQL = f"""CASE lower(regexp_replace(trim({_RAW_KEY}), '\\s*/\\s*', ' / ')) WHEN 'db / c#' THEN 'Db' WHEN 'c#' THEN 'Db' WHEN 'am' THEN 'Am'
  WHEN 'bbm / a#m' THEN 'Bbm' WHEN 'g#m' THEN 'Abm' WHEN 'eb' THEN 'Eb' END"""
_CORED = "WITH f AS ({files}), c AS (SELECT f.*, lower(trim(regexp_replace(stem, '(\\s*\\[[^\\]]+\\])+\\s*$', ''))) AS core FROM f)".replace("{files}", FILES)
SQL = {
    "prj01_split_slash": f"""SELECT p_partkey AS id, trim(split_part({_SLASHED}, '/', 1)) AS first,
      CASE WHEN strpos({_SLASHED}, '/') > 0 THEN trim(substr({_SLASHED}, strpos({_SLASHED}, '/') + 1)) ELSE '' END AS second FROM part""",
    "prj02_normalize_tags": """SELECT p_partkey AS id, trim(p_brand) AS genre, trim(p_name) AS style,
      CASE p_size % 4 WHEN 0 THEN 'female' WHEN 1 THEN 'male' END AS gender, CASE p_size % 4 WHEN 1 THEN 'wet' END AS reverb,
      CASE p_size % 3 WHEN 0 THEN 12.5 WHEN 2 THEN CAST(p_size AS DOUBLE) END AS sdr FROM part""",
    "prj03_normalize_key": f"SELECT p_partkey AS id, {_KEY_SQL} AS short_key FROM part",
    "prj04_key_display": f"""WITH k AS (SELECT p_partkey AS id, {_KEY_SQL} AS s FROM part), d AS (
      SELECT id, CASE s WHEN 'Db' THEN 'Db / C#' WHEN 'Bbm' THEN 'Bbm / A#m' WHEN 'Abm' THEN 'Abm / G#m' WHEN 'Eb' THEN 'Eb / D#' ELSE s END AS display FROM k)
      SELECT id, display, replace(display, ' / ', chr(10)) AS label FROM d""",
    "prj05_treated_as_vocal": f"SELECT id, regexp_matches(stem, '(?i)vocal|acapella|vox|vocoder') AS as_vocal FROM ({FILES})",
    "prj06_ignore_rules": rf"""SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(stem, '\([^)]*\)', '', 'g'), '\[[^\]]*\]', '', 'g'),
      '(?i)bpm', '', 'g'), '\s+', ' ', 'g')) AS name FROM ({FILES})""",
    "prj07_normalize_tag": rf"""SELECT id, trim(regexp_replace(replace(lower(trim(regexp_replace(regexp_replace(regexp_replace(replace(stem, 'small', 'R&B'),
      '\([^)]*\)', '', 'g'), '\[[^\]]*\]', '', 'g'), '\s+', ' ', 'g'))), '&', ' and '), '[^a-z0-9_]+', ' ', 'g')) AS tag FROM ({FILES})""",
    "prj08_filename_tags": rf"""WITH c AS (SELECT id, {_CORE} AS core FROM ({FILES}))
      SELECT id, CASE WHEN strpos(core, ' - ') > 0 THEN trim(substr(core, 1, strpos(core, ' - ') - 1)) ELSE '' END AS artist,
      CASE WHEN strpos(core, ' - ') > 0 THEN trim(substr(core, strpos(core, ' - ') + 3)) ELSE core END AS title FROM c""",
    "prj09_tempo_and_key": rf"""SELECT id, regexp_extract(stem, '(?i)\b(\d{{2,3}})\s*bpm\b', 1) AS bpm,
      regexp_extract(stem, '(?i)\b([A-G](?:#m|b)?(?:m|min|maj|major|minor)?)\b', 1) AS music_key FROM ({FILES})""",
    "prj10_strip_suffixes": f"SELECT id, {_BARE} AS name FROM ({FILES})",
    "prj11_classify_role": _CORED + """
      SELECT id, CASE WHEN contains(lower(stem), '(original song)') THEN 'original' WHEN core LIKE '%(acapella)' OR core LIKE '%(lead vocals)' THEN 'acapella'
        WHEN core LIKE '%(instrumental)' OR core LIKE '%instrumental%' THEN 'instrumental' END AS role FROM c""",
    "prj12_only_stems": f"""SELECT id, regexp_matches(lower(stem), 'acapella|vocals') AND NOT regexp_matches(lower(stem), 'instrumental') AS vocals_only,
      regexp_matches(lower(stem), 'instrumental') AND NOT regexp_matches(lower(stem), 'acapella|vocals') AS instrumental_only FROM ({FILES})""",
    "prj13_song_key": f"""WITH n AS (SELECT p_partkey AS id, {_CATEGORISED} AS stem, p_type AS cat FROM part), f AS (
      SELECT *, lower(stem) AS low, lower(cat) AS c, length(cat) AS k FROM n)
      SELECT id, lower(trim(CASE WHEN prefix(low, c) AND substr(stem, k + 1, 1) IN ('_', '-', ' ') THEN substr(stem, k + 2)
        WHEN suffix(low, c) AND substr(stem, length(stem) - k, 1) IN ('_', '-', ' ') THEN substr(stem, 1, length(stem) - k - 1) ELSE stem END)) AS song FROM f""",
    "prj14_folder_names": r"""WITH n AS (SELECT p_partkey AS id, concat(p_brand, ': ', p_name, CASE WHEN p_size % 2 = 0 THEN '_BALANCED' ELSE '. ' END) AS name FROM part)
      SELECT id, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS slug, rtrim(trim(replace(name, ':', '')), '. ') AS folder,
      CASE WHEN suffix(name, '_BALANCED') THEN name ELSE name || '_BALANCED' END AS root FROM n""",
    "prj15_formats": f"""WITH u AS (SELECT id, CAST(floor(duration) AS BIGINT) AS s, CAST(floor(duration * 8) AS BIGINT) AS h, bytes * 1000000 AS b FROM ({UNITS}))
      SELECT id, concat(s // 60, ':', lpad(CAST(s % 60 AS VARCHAR), 2, '0')) AS clock,
      CASE WHEN h >= 3600 THEN concat(h // 3600, 'h', lpad(CAST(h % 3600 // 60 AS VARCHAR), 2, '0'), 'm', lpad(CAST(h % 60 AS VARCHAR), 2, '0'), 's')
        ELSE concat(h // 60, 'm', lpad(CAST(h % 60 AS VARCHAR), 2, '0'), 's') END AS hours,
      CASE WHEN b >= 1099511627776 THEN printf('%.2f TB', b / 1099511627776.0) WHEN b >= 1073741824 THEN printf('%.2f GB', b / 1073741824.0)
        WHEN b >= 1048576 THEN printf('%.2f MB', b / 1048576.0) ELSE concat(b, ' B') END AS size FROM u""",
    "prj16_strictness": "SELECT p_partkey AS id, round(0.55 + least(greatest(p_size * 3 - 20, 0), 100) / 100.0 * 0.45, 6) AS threshold FROM part",
    "prj17_compression": f"""SELECT id, CASE WHEN ext = '.mp3' OR {_VERDICT.replace("p_size", "size")} IN ('WARNING', 'SUSPICIOUS', 'FAKE_CERTAIN') THEN 'lossy'
      WHEN size % 5 = 0 THEN 'lossless' END AS compression FROM ({FILES})""",
    "prj18_lossy_suffix": f"""SELECT id, CASE WHEN size % 7 = 0 THEN stem || '_mp3-vbr' WHEN size % 4 = 0 THEN stem || '_mp3-320' WHEN size % 4 = 1 THEN stem || '_mp3-vbr'
      WHEN size % 4 = 2 THEN stem || '_mp3-128' ELSE stem || '_mp3' END AS name FROM ({FILES})""",
    "prj19_genre_label": "SELECT p_partkey AS id, p_type AS genre, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_name END AS style FROM part",
    "prj20_combined_tag": f"SELECT id, concat_ws('/', gender, reverb) AS tag FROM ({UNITS})",
    "prj21_stem_mode": "SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN '2' WHEN 1 THEN '4' WHEN 2 THEN '2' ELSE '6' END AS mode FROM part",
}
