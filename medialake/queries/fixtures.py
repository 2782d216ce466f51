"""How the given tables stand for a media library: the same SELECT text serves Spark and the SQL beside each query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Inventory units from documents and labels: the role is dealt by id, the other facets are columns of the tables.
UNIT_COLUMNS = """d.doc_id AS id,
  CASE d.doc_id % 4 WHEN 0 THEN 'instrumental' WHEN 1 THEN 'vocal' WHEN 2 THEN 'sample' ELSE 'pair' END AS role,
  d.lang AS genre, d.source AS style,
  CASE l.toxic WHEN 0 THEN 'female' WHEN 1 THEN 'male' END AS gender,
  CASE WHEN d.n_chars % 3 = 0 THEN 'dry' WHEN d.n_chars % 3 = 1 THEN 'wet' END AS reverb,
  CASE WHEN d.doc_id % 6 < 2 THEN 'singing' WHEN d.doc_id % 6 = 3 THEN 'rap' END AS vocal_type,
  CASE l.quality WHEN 1 THEN 'lossless' WHEN 0 THEN 'lossy' END AS compression,
  CASE WHEN d.doc_id % 5 <> 0 THEN substr('CDEFGAB', CAST(d.doc_id % 7 AS INT) + 1, 1) END AS music_key,
  CASE WHEN d.doc_id % 9 <> 0 THEN 20 + (d.doc_id * 37 % 160) / 4.0 END AS sdr,
  d.n_chars AS bytes, d.n_chars / 16.0 AS duration"""
UNITS = f"SELECT {UNIT_COLUMNS} FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"

#: Audio files from parts, with names that carry roles, tags, tempo and key.
FILE_COLUMNS = """p_partkey AS id, p_brand AS folder, p_type AS category,
  concat(CASE WHEN p_partkey % 7 = 0 THEN '[DL] - ' ELSE '' END, p_brand, ' - ', p_name,
    CASE WHEN p_partkey % 3 = 0 THEN concat(' ', CAST(80 + p_size AS STRING), 'BPM') ELSE '' END,
    CASE WHEN p_partkey % 4 = 1 THEN ' F#m' ELSE '' END,
    CASE p_size % 6 WHEN 0 THEN ' (Acapella)' WHEN 1 THEN ' (Instrumental)' WHEN 2 THEN ' (Original Song)'
      WHEN 3 THEN ' (lead vocals)' WHEN 4 THEN '' ELSE ' instrumental' END,
    CASE WHEN p_partkey % 5 = 0 THEN ' [MP3-320]' ELSE '' END) AS stem,
  CASE p_partkey % 5 WHEN 0 THEN '.mp3' WHEN 1 THEN '.wav' WHEN 2 THEN '.flac' WHEN 3 THEN '.aiff' ELSE '.txt' END AS ext,
  CAST(p_retailprice * 100 AS BIGINT) AS bytes, p_size AS size"""
FILES = f"SELECT {FILE_COLUMNS} FROM part"


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents").alias("d"), load(spark, sf_dir, "labels").alias("l")
    return docs.join(labels, docs.doc_id == labels.doc_id, "left").selectExpr(*_split(UNIT_COLUMNS))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").selectExpr(*_split(FILE_COLUMNS))


def _split(columns: str) -> list[str]:
    """The select list, cut at its top-level commas."""
    out, depth, start, quoted = [], 0, 0, False
    for i, c in enumerate(columns):
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                out.append(columns[start:i].strip())
                start = i + 1
    return [*out, columns[start:].strip()]
