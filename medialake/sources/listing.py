"""Scans of file trees and what follows from a path alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import classify_role, key_in_name, tempo
from ..operators.numbering import numbered

BACKUP_FOLDER = "_backup_before_align"

# The file endings that each kind of scan accepts.
FORMATS = {
    "inventory": ("wav", "flac", "mp3", "ogg", "m4a", "aiff", "aif", "opus", "aac", "ape"),
    "matcher": ("wav", "mp3", "flac", "aif", "aiff", "ogg", "m4a", "opus"),
    "key": ("wav", "mp3", "flac", "aif", "aiff", "ogg", "m4a", "opus", "mp4", "aac", "ape"),
    "vocal": ("wav", "flac", "mp3", "ogg", "opus", "m4a", "aac", "aif", "aiff"),
    "renamer": ("wav", "mp3", "flac", "aif", "aiff", "ogg", "m4a", "opus", "wma"),
    "converter": ("wav", "flac", "mp3", "ogg", "m4a", "aiff", "aif", "opus", "aac", "ape", "w64", "caf", "wma"),
}


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def of_kind(files: DataFrame, kind: str, path: str = "path") -> DataFrame:
    return files.where(ending(F.col(path)).isin(*FORMATS[kind]))


def list_files(spark: SparkSession, root: str, recursive: bool = True, kind: str | None = None) -> DataFrame:
    """(path, length, modified): names and sizes only; file contents are never read. Backup folders are skipped."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    found = reader.load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    found = found.where(~F.array_contains(F.split("path", "/"), BACKUP_FOLDER))
    return of_kind(found, kind) if kind else found


def rename_source(files: DataFrame, path: str = "path") -> DataFrame:
    """files with depth, parent, stem, extension, bpm and music_key, all read from the relative path."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return files.withColumns(
        {"depth": F.size(parts) - 1, "parent": F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")), "stem": stem, "extension": ending(F.col(path)), "bpm": tempo(stem), "music_key": key_in_name(stem)}
    )


def pair_folders(files: DataFrame, folder: str = "folder", stem: str = "stem") -> DataFrame:
    """Folders that hold an instrumental and an acapella; a folder below such a folder is not one itself."""
    roles = files.groupBy(F.col(folder).alias("folder")).agg(F.bool_or(classify_role(F.col(stem)) == "instrumental").alias("i"), F.bool_or(classify_role(F.col(stem)) == "acapella").alias("v"))
    matched = roles.where("i and v").select("folder")
    parts = F.split("folder", "/")
    above = matched.select("folder", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("up")).where("up <> folder")
    inside = above.join(matched.select(F.col("folder").alias("up")), "up", "left_semi").select("folder")
    return matched.join(inside, "folder", "left_anti")


def song_groups(files: DataFrame, mode: str, path: str = "path") -> DataFrame:
    """(song, n_files, first_file): files under their first folder (subfolders) or their own folder (recursive)."""
    song = F.substring_index(path, "/", 1) if mode == "subfolders" else F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return files.groupBy(song.alias("song")).agg(F.count(F.lit(1)).alias("n_files"), F.min(path).alias("first_file"))


def union_roots(roots: list[DataFrame], path: str = "path", fold_case: bool = True) -> DataFrame:
    """All roots' files, each path once (in any case, if fold_case): the first root, then the least path, wins."""
    tagged = [df.withColumn("root", F.lit(i)) for i, df in enumerate(roots)]
    every = tagged[0]
    for df in tagged[1:]:
        every = every.unionByName(df)
    name = F.lower(path) if fold_case else F.col(path)
    # min_by aggregates on the map side; a window would sort every copy of a path.
    order = F.struct("root", path)
    return every.groupBy(name.alias("name")).agg(F.min_by(F.struct(*[F.col(c) for c in every.columns]), order).alias("best")).select("best.*")


def listed_paths(lines: DataFrame, kind: str = "inventory", line: str = "value") -> DataFrame:
    """Paths from lines of text: byte order mark, quotes and blanks stripped, unknown endings dropped."""
    clean = F.trim(F.regexp_replace(F.trim(F.regexp_replace(line, "^﻿", "")), "^[\"']+|[\"']+$", ""))
    return of_kind(lines.withColumn("path", clean).where("path <> ''"), kind)


def first_tag(tags: Column, names: tuple[str, ...]) -> Column:
    """The first of the named entries of a tag map that is not empty."""
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(tags, F.lit(n))), F.lit("")) for n in names])


# What containers call genre and comment, and how they name tags of one's own.
ID3_ENDINGS = ("mp3", "wav", "wave", "aif", "aiff")
MP4_ENDINGS = ("m4a", "mp4", "aac")
ID3_FRAMES = {"GENRE": "TCON", "COMMENT": "COMM"}
MP4_ATOMS = {"GENRE": "\xa9gen", "COMMENT": "\xa9cmt"}
ID3_OWN, MP4_OWN = "TXXX:", "----:com.apple.iTunes:"
# Where containers keep the key, the title and the artist, standard names first.
KEY_NAMES = ("TKEY", "INITIALKEY", "KEY", *(MP4_OWN + k for k in ("initialkey", "INITIALKEY", "KEY", "key")), *(ID3_OWN + k for k in ("KEY", "key", "INITIALKEY", "initialkey")))
TITLE_NAMES = ("TIT2", "TITLE", "\xa9nam", "INAM")
ARTIST_NAMES = ("TPE1", "ARTIST", "\xa9ART", "IART")


def tag_value(tags: Column, ext: Column, field: str) -> Column:
    """A field's text in a file's tag map, by its container's names: the standard name first, then the field in upper case, in
    lower case and as it is; empty where there is none."""
    spellings = tuple(dict.fromkeys((field.upper(), field.lower(), field)))
    named = lambda standard, own: first_tag(tags, (*([standard[field.upper()]] if field.upper() in standard else []), *(own + x for x in spellings)))
    ext = F.lower(F.regexp_replace(ext, r"^\.", ""))
    value = F.when(ext.isin(*ID3_ENDINGS), named(ID3_FRAMES, ID3_OWN)).when(ext.isin(*MP4_ENDINGS), named(MP4_ATOMS, MP4_OWN)).otherwise(named({}, ""))
    return F.coalesce(value, F.lit(""))


def probed_duration(frames: Column, rate: Column) -> Column:
    """Seconds of a stream; counts beyond two hours at 48 kHz are not believed."""
    return F.when((rate > 0) & (frames >= 0) & (frames <= 48_000 * 7_200), frames / rate).otherwise(F.lit(0.0))


def label_index(labels: DataFrame, name: str) -> DataFrame:
    """labels with a dense 0-based idx by name, of any number of distinct labels."""
    return numbered(labels, [name], "idx").withColumn("idx", (F.col("idx") - 1).cast("int"))


def cache_entries(raw: DataFrame, schema: str, column: str = "json") -> DataFrame:
    """raw with its JSON parsed; entries that do not parse are dropped, as a broken cache counts as empty."""
    return raw.withColumn("entry", F.from_json(column, schema, {"mode": "PERMISSIVE"})).where("entry is not null")
