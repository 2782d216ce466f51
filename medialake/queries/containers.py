"""Tags and stream parameters read from bytes (SRC-9 to SRC-14): every part's file is put together by `encoders` and read back."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.mpeg_check import mp3_check
from ..sources import containers as C
from ..sources import listing as L
from ..tables import BATCH_BYTES, spread, staged
from . import encoders as E
from .fixtures import FILES, files

_FORMS, _STREAMS = tuple(E.TAGGED), E.STREAMS
_KEY = "CASE size % 3 WHEN 0 THEN 'Am' WHEN 1 THEN 'C' END"


@F.pandas_udf(T.BinaryType())
def _tagged(form: pd.Series, title: pd.Series, folder: pd.Series, genre: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series([E.tagged(f, t, a + " é", a + " Жé😀ÿ", g, f"mood {s}", k) for f, t, a, g, s, k in zip(form, title, folder, genre, size, key)], dtype=object)


@F.pandas_udf(T.BinaryType())
def _stream(form: pd.Series, title: pd.Series, n: pd.Series, channels: pd.Series) -> pd.Series:
    return pd.Series([E.stream(*row) for row in zip(form, title, n.astype(int), channels.astype(int))], dtype=object)


@F.pandas_udf(T.BinaryType())
def _mpeg(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    return in_parts(E.mpeg(f, int(k)) for form, n in batches for f, k in zip(form, n))


def in_parts(contents: Iterable[bytes]) -> Iterator[pd.Series]:
    """The contents in series of BATCH_BYTES and at most one content more: what a batch of short rows is made into may be long."""
    part, held = [], 0
    for content in contents:
        part.append(content)
        held += len(content)
        if held >= BATCH_BYTES:
            yield pd.Series(part, dtype=object)
            part, held = [], 0
    if part:
        yield pd.Series(part, dtype=object)


def _nth(values) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col("id") % len(values) + 1).cast("int"))


def tagged_files(spark, sf) -> DataFrame:
    """(id, form, ext, content): one of the forms for each part, with title, artist, genre, a tag of one's own and a key."""
    f = spread(files(spark, sf), "id").withColumn("form", _nth(_FORMS))
    return staged(f.select("id", "form", _nth(tuple(E.TAGGED.values())).alias("ext"), _tagged("form", "stem", "folder", "category", "size", F.expr(_KEY)).alias("content")), "tagged-files")


def probed_files(spark, sf) -> DataFrame:
    """(id, content): one of the forms of stream for each part."""
    return staged(spread(files(spark, sf), "id").select("id", _stream(_nth(_STREAMS), "stem", "size", F.col("id") % 2 + 1).alias("content")), "probed-files")


def _tags(spark, sf):
    return C.with_tags(tagged_files(spark, sf)).withColumn("first", C.first_values(F.col("tags")))


def src09_container_tags(spark, sf):
    """Genre, comment and a field of one's own by each container's names, and how many names the file has."""
    tags, ext = F.col("first"), F.col("ext")
    return _tags(spark, sf).select("id", "form", *[L.tag_value(tags, ext, c).alias(c) for c in ("genre", "comment", "mood")], F.size("tags").cast("long").alias("n_names"))


def src10_container_keys(spark, sf):
    return _tags(spark, sf).select("id", L.first_tag(F.col("first"), L.KEY_NAMES).alias("music_key"))


def src12_container_names(spark, sf):
    """Title and all artists."""
    artists = F.coalesce(*[F.try_element_at("tags", F.lit(n)) for n in L.ARTIST_NAMES])
    return _tags(spark, sf).select("id", L.first_tag(F.col("first"), L.TITLE_NAMES).alias("title"), F.array_join(artists, " / ").alias("artists"))


def src13_header_seconds(spark, sf):
    """Bytes and seconds of each file by its headers, 0 where they don't say."""
    return C.with_stream(probed_files(spark, sf)).select("id", F.length("content").alias("bytes"), F.round(F.coalesce("seconds", F.lit(0.0)), 6).alias("seconds"))


def src14_header_probe(spark, sf):
    return C.with_stream(probed_files(spark, sf)).select("id", "container", "rate", "channels", "frames", "subtype")


def int03_mp3_pieces(spark, sf):
    """Each part's MPEG stream of as many frames as its size, walked in pieces of 4 KB: frames, faults with their time, stated frames."""
    made = staged(spread(files(spark, sf), "id").select("id", _mpeg(_nth(E.MPEGS), "size").alias("content")), "mpeg-files")
    return mp3_check(made, "id", piece=4096).withColumn("seconds", F.round("seconds", 6))


QUERIES = {k: v for k, v in globals().items() if k.startswith(("src", "int"))}

_FORM = "CASE id % 16 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_FORMS)) + " END"
ID3_FORMS = "form IN ('id3v2.3 latin', 'id3v2.3 utf-16', 'id3v2.4', 'id3v2.4 unsynchronised', 'id3v2.2', 'wav id3', 'aiff')"
VORBIS_FORMS = "form IN ('flac', 'ogg', 'opus')"
TAGGED = f"SELECT *, {_FORM} AS form, {_KEY} AS k FROM ({FILES})"
_STREAM_FORM = "CASE id % 11 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_STREAMS)) + " END"
_PROBE = f"""WITH f AS (SELECT id, CAST(size AS BIGINT) AS n, id % 2 + 1 AS c, {_STREAM_FORM} AS form, strlen(stem) AS named FROM ({FILES})), s AS (
  SELECT *, CASE form WHEN 'wav 16' THEN 44100 WHEN 'wav 24 extensible' THEN 96000 WHEN 'wav float' THEN 48000 WHEN 'wav 8 cut' THEN 22050 WHEN 'aiff' THEN 44100 WHEN 'aifc' THEN 192000
      WHEN 'flac' THEN 88200 WHEN 'xing' THEN 44100 WHEN 'vbri' THEN 44100 WHEN 'constant' THEN 24000 END AS rate,
    CASE WHEN form IN ('xing', 'vbri') THEN 2 WHEN form = 'constant' THEN 2 WHEN form <> 'nothing' THEN c END AS channels,
    CASE WHEN form LIKE 'wav%' THEN n WHEN form LIKE 'ai%' THEN n * 1000 WHEN form = 'flac' THEN n * 1000000 WHEN form IN ('xing', 'vbri') THEN n * 1152
      WHEN form = 'constant' THEN CAST(floor((n * 100 + 4) * 8 * 24000 / 64000) AS BIGINT) END AS frames FROM f)"""
_MPEG_FORM = "CASE id % 8 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(E.MPEGS)) + " END"
SQL = {
    "int03_mp3_pieces": f"""WITH f AS (SELECT id, CAST(size AS BIGINT) AS n, {_MPEG_FORM} AS form FROM ({FILES})), g AS (SELECT *, CASE form WHEN 'checksum' THEN n // 2 WHEN 'gap' THEN n // 2 + 1 WHEN 'short tag' THEN 0 WHEN 'none' THEN 0 ELSE n END AS frames,
        CASE form WHEN 'checksum' THEN (n // 2 + 1) * 1152 // 44100 WHEN 'gap' THEN (n // 2 + 2) * 1152 // 44100 END AS s FROM f)
      SELECT id, form IN ('whole', 'tails') AS ok, CASE form WHEN 'checksum' THEN 'CRC ERROR @ 0m 0' || s || 's' WHEN 'gap' THEN 'LOST SYNC @ 0m 0' || s || 's' WHEN 'tail' THEN 'LOST SYNC @ END OF FILE'
          WHEN 'short tag' THEN 'BAD ID3v2 TAG' WHEN 'cut' THEN 'TRUNCATED' WHEN 'none' THEN 'UNRECOGNISED FORMAT' ELSE '' END AS problem,
        frames, round(frames * 1152 / 44100.0, 6) AS seconds, CASE WHEN form = 'whole' THEN n - 1 END AS stated FROM g""",
    "src09_container_tags": f"""SELECT id, form, CASE WHEN {ID3_FORMS} OR {VORBIS_FORMS} OR form IN ('mp4') THEN category ELSE '' END AS genre,
      CASE WHEN {ID3_FORMS} THEN 'a note' ELSE '' END AS comment, CASE WHEN {ID3_FORMS} OR {VORBIS_FORMS} OR form = 'mp4' THEN concat('mood ', size) ELSE '' END AS mood,
      CAST(CASE WHEN {ID3_FORMS} THEN CASE WHEN k IS NULL THEN 5 ELSE 6 END WHEN form = 'wav info' THEN 3 WHEN {VORBIS_FORMS} THEN CASE WHEN k IS NULL THEN 4 ELSE 5 END
        WHEN form = 'mp4' THEN CASE WHEN k IS NULL THEN 5 ELSE 6 END WHEN form = 'id3v1' THEN 3 ELSE 0 END AS BIGINT) AS n_names FROM ({TAGGED})""",
    "src10_container_keys": f"SELECT id, CASE WHEN {ID3_FORMS} OR {VORBIS_FORMS} OR form = 'mp4' THEN k END AS music_key FROM ({TAGGED})",
    "src12_container_names": f"""SELECT id, CASE WHEN form = 'id3v1' THEN 'a title' WHEN form NOT IN ('cut', 'looping', 'empty') THEN stem END AS title,
      CASE WHEN form IN ('id3v2.3 latin', 'wav id3') THEN folder || ' é / second' WHEN {ID3_FORMS} OR {VORBIS_FORMS} THEN folder || ' Жé😀ÿ / second'
        WHEN form IN ('wav info', 'mp4') THEN folder || ' Жé😀ÿ' WHEN form = 'id3v1' THEN 'an artist' END AS artists FROM ({TAGGED})""",
    "src13_header_seconds": _PROBE + """ SELECT id, CAST(CASE form WHEN 'wav 16' THEN 44 + n * c * 2 WHEN 'wav 24 extensible' THEN 10 + 31 + named + 12 + 36 + 26 + 48 + 8 + n * c * 3 + n * c * 3 % 2
        WHEN 'wav float' THEN 12 + 24 + 12 + 8 + n * c * 4 WHEN 'wav 8 cut' THEN 12 + 24 + 8 + n * c WHEN 'aiff' THEN 12 + 26 + 16 WHEN 'aifc' THEN 12 + 32 WHEN 'flac' THEN 4 + 38 + 44 + 2
        WHEN 'xing' THEN 10 + 31 + named + 36 + 12 + 373 WHEN 'vbri' THEN 36 + 18 + 363 WHEN 'constant' THEN 4 + n * 100 ELSE 40 END AS BIGINT) AS bytes,
      round(coalesce(frames / CAST(rate AS DOUBLE), 0), 6) AS seconds FROM s""",
    "src14_header_probe": _PROBE + """ SELECT id, CASE WHEN form LIKE 'wav%' THEN 'wav' WHEN form LIKE 'ai%' THEN 'aiff' WHEN form = 'flac' THEN 'flac' WHEN form <> 'nothing' THEN 'mpeg' END AS container, rate, channels, frames,
      CASE form WHEN 'wav 16' THEN 'PCM_16' WHEN 'wav 24 extensible' THEN 'PCM_24' WHEN 'wav float' THEN 'FLOAT' WHEN 'wav 8 cut' THEN 'PCM_U8' WHEN 'aiff' THEN 'PCM_24' WHEN 'aifc' THEN 'FLOAT'
        WHEN 'flac' THEN 'PCM_20' WHEN 'nothing' THEN NULL ELSE 'FLOAT' END AS subtype FROM s""",
}
