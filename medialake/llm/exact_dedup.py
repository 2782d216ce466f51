"""Exact dedup by progressive refinement: length, then a hash of a prefix, then a hash of the whole text.

Built from DataFrame functions alone. Texts are equal when identical after each run of the white space 0x20, 0x09-0x0D
becomes one space. Null text counts as empty. First lengths are counted; only rows of a length that occurs twice have their
prefix hashed, and only rows of a length and prefix that occur twice are hashed in full. The groups of a step go to the scan of
the next by broadcast up to BROADCAST_GROUPS of them, and the hash is taken behind that join. Beyond, a bitmap of the groups'
hashes goes there, FILTER_BITS at most; rows whose bit is set are hashed behind it and then meet the groups themselves in a shuffle, so
that a false bit costs one hash and changes nothing. Only ids and hashes, never texts, are shuffled. Groups are counted with map-side
combination, and the join that hands each member its group reads both sides from tables, so Spark can split a group that
holds a large share of all rows.

Defined cases: rows that repeat a doc_id are decided each by its own text: equal texts share one decision, other texts of that
doc_id another. same_rows counts the rows of that doc_id and text. A null doc_id never stays in place of a known one. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, staged, table

PREFIX_CHARS = 200
BROADCAST_GROUPS = 500_000
#: Bits of the bitmap of groups, 8 a group and at most this many (64 MB); in pieces of 2**15, as bitmap_construct_agg makes them.
FILTER_BITS = 1 << 29
_PIECE = 1 << 15
_ADDED = ("keep_id", "group_size", "kept", "same_rows")
#: Every run of white space but a single space; what it leaves alone is already in normal form.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normal_text(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def maybe_of_groups(normal: DataFrame, groups: DataFrame, on: list[str], count: int) -> DataFrame:
    """The rows of normal whose columns on are in groups, with few others: those that meet a set bit of the bitmap of groups."""
    bits = min(FILTER_BITS, max(_PIECE, 1 << (8 * count).bit_length()))
    place = F.pmod(F.xxhash64(*on), F.lit(bits))
    pieces = groups.select(place.alias("_at")).groupBy(F.expr(f"_at div {_PIECE}").alias("_piece")).agg(F.expr(f"bitmap_construct_agg(_at % {_PIECE})").alias("_bits"))
    placed = normal.withColumn("_at", place).withColumn("_piece", F.expr(f"_at div {_PIECE}"))
    byte = f"cast(conv(hex(substring(_bits, cast(_at % {_PIECE} div 8 as int) + 1, 1)), 16, 10) as int)"
    return placed.join(F.broadcast(pieces), "_piece").where(F.expr(f"shiftright({byte}, cast(_at % 8 as int)) & 1 = 1")).select(*normal.columns)


def _of_groups(normal: DataFrame, groups: DataFrame, on: list[str], name: str, value: Column) -> DataFrame:
    """(doc_id, on, name) of the rows of normal whose columns on are in groups (a written table of distinct rows), with value as name."""
    count = groups.count()
    if count <= BROADCAST_GROUPS:  # 16 bytes each
        return normal.join(F.broadcast(groups), on, "left_semi").select("doc_id", *on, value.alias(name))
    # An inner join: a semi join would be pushed below the hash, and the texts be shuffled with it.
    return maybe_of_groups(normal, groups, on, count).select("doc_id", *on, value.alias(name)).join(groups, on)


def duplicate_members(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """(doc_id, full, keep_id, group_size, same_rows) of every document and text that occurs at least twice."""
    prefix, full = F.xxhash64(F.substring("t", 1, prefix_chars)), F.sha2("t", 256)
    several = lambda df, *by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*by)
    normal = docs.select("doc_id", normal_text(F.col("text")).alias("t"))
    sized = normal.select("doc_id", "t", F.length("t").alias("len"))
    lengths = staged(several(sized, "len"), "dedup-lengths")
    prefixes = staged(several(_of_groups(sized, lengths, ["len"], "prefix", prefix), "len", "prefix"), "dedup-prefixes")
    survivors = _of_groups(sized.withColumn("prefix", prefix), prefixes, ["len", "prefix"], "full", full)
    survivors = survivors.groupBy("doc_id", "full").agg(F.count(F.lit(1)).alias("same_rows"))
    survivors = staged(survivors.withColumn("full", F.unhex("full")), "dedup-survivors")
    groups = survivors.groupBy("full").agg(F.min("doc_id").alias("keep_id"), F.sum("same_rows").alias("group_size")).where("group_size > 1")
    groups = staged(groups, "dedup-groups")
    discard(lengths, prefixes)
    return survivors.join(groups, "full").select("doc_id", F.lower(F.hex("full")).alias("full"), "keep_id", "group_size", "same_rows")


def exact_dedup(docs: DataFrame, prefix_chars: int = PREFIX_CHARS, hashed: str | None = None) -> DataFrame:
    """docs with keep_id, group_size, kept and same_rows added (columns of these names are replaced).

    hashed names a column with the SHA-256 of the normal text, if docs has one; else only rows that may be members are hashed.
    """
    rest = docs.drop(*_ADDED)
    members = duplicate_members(docs, prefix_chars).select(F.col("doc_id").alias("_id"), F.col("full").alias("_full"), *[F.col(c).alias(f"_{c}") for c in ("keep_id", "group_size", "same_rows")])
    own = F.col(hashed) if hashed else F.when(F.col("_full").isNotNull(), F.sha2(normal_text(F.col("text")), 256))
    out = rest.join(members, F.col("doc_id").eqNullSafe(F.col("_id")) & (own == F.col("_full")), "left")
    return out.select(
        *[F.col(c) for c in rest.columns],
        F.when(F.col("_full").isNull(), F.col("doc_id")).otherwise(F.col("_keep_id")).alias("keep_id"),
        F.coalesce("_group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("_full").isNull() | F.col("_keep_id").eqNullSafe(F.col("doc_id"))).alias("kept"),
        F.coalesce("_same_rows", F.lit(1).cast("long")).alias("same_rows"),
    )


def op7_exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(normal_text(F.col("text")), 256).alias("text_sha256"))
    return exact_dedup(docs, hashed="text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
