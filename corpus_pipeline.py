"""A training-corpus pipeline: five stages, each on all that its predecessor kept.

Language identification, exact dedup, near-duplicate removal, benchmark decontamination, tokenisation. Every stage takes
(spark, docs, sf_dir); all but the last return the columns of documents. A stage's decisions are tables of ids that are
joined back to the documents; Spark broadcasts them while they are small and else shuffles both sides by doc_id.

Defined cases: null text and text without a letter goes with the first stage. Of equal texts the smallest doc_id stays (ties:
rows that repeat both doc_id and text leave one row). Rows that repeat a doc_id with other texts are one document from the third
stage on: the third drops it if all of its rows are near copies, the fourth if one of them is contaminated.
Very long texts are read whole; columns beside those of documents are not carried; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.llm.bpe import round_trip
from medialake.llm.common import split_of, staged, table
from medialake.llm.decontaminate import contaminated
from medialake.llm.exact_dedup import exact_dedup, normal_text
from medialake.llm.jaccard_join import ngram_jaccard_components
from medialake.llm.language_id import UNDETERMINED, fit, identify

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no determinable language; learns from two thirds of the labelled rows."""
    docs = docs.select(*COLUMNS)
    known = identify(docs, fit(docs, split_of("doc_id", 3) != 1), COLUMNS)
    return known.where(F.col("lang_pred") != UNDETERMINED).select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one with the smallest id stays, in one row."""
    kept = exact_dedup(docs.select(*COLUMNS)).where("kept")
    again = kept.where("same_rows > 1").withColumn("text_hash", F.sha2(normal_text(F.col("text")), 256)).dropDuplicates(["doc_id", "text_hash"])
    return kept.where("same_rows = 1").select(*COLUMNS).unionByName(again.select(*COLUMNS))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of five-word shingles at a Jaccard similarity of 0.8 connect, the smallest id stays."""
    docs = docs.select(*COLUMNS)
    parts = ngram_jaccard_components(docs, size=5, num=80, den=100)
    dropped = staged(parts.groupBy("doc_id").agg(F.bool_and(F.col("component_id") != F.col("doc_id")).alias("drop")).where("drop").select("doc_id"), "pipeline-near")
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold at least 0.8 of a benchmark item's five-word shingles."""
    docs = docs.select(*COLUMNS)
    found = staged(contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "pipeline-contaminated")
    return docs.join(found, "doc_id", "left_anti").select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document that is left."""
    return round_trip(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("ngram_jaccard", near_stage),
    ("decontamination", decontamination_stage),
    ("bpe", token_stage),
]

#: The last stage is not expressible in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
