"""Temporal list join: captures of URLs against dated block-list entries, as of each capture's fetch time.

A list is a log of dated statements: an entry (a host, with all hosts below it, or a host with a path prefix) is added or
removed at a time. A window per entry turns the log into validity intervals [valid_from, valid_to). A capture looks up its
host, every parent domain and every directory of its path among the entries' keys, and the as-of condition keeps the
intervals that were open when it was fetched. A capture is blocked when any remains.

DataFrame functions only. The intervals are a written table, so that both sides of the key join are plain shuffles and Spark can
split a host that holds a large share of all captures. A URL contributes a key for each of its domains and directories, but only
of the numbers of labels and directories that some entry has: others, as a bare top-level domain or a deep path, match nothing.

Defined cases: a null or unparsable URL has no key and is not blocked; a null fetch time matches no interval; repeated
statements of the same kind extend one interval; an addition and a removal at the same time leave the entry removed. Rows that
repeat a capture_id each come back, with what was found for any of them. A URL is read whole, however long; without captures
there are no rows, without a list nothing is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged, table


def host_of(url: Column) -> Column:
    """The lower-cased host without user, port and leading www."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.regexp_replace(host, r"^www\.|\.$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def key_depths(keys: DataFrame) -> tuple[int, int, int]:
    """(least and most labels of the listed domains, most directories of the listed paths); zeros where there are none."""
    domain, path = ~F.col("key").contains("/"), F.col("key").contains("/")
    labels = F.when(domain, F.size(F.split("key", r"\.")))
    row = keys.agg(F.min(labels), F.max(labels), F.max(F.when(path, F.size(F.split("key", "/")) - 1))).first()
    return tuple(x or 0 for x in row)


def url_keys(url: Column, depths: tuple[int, int, int]) -> Column:
    """Array of the keys under which an entry can name the URL: its domains, and its host with each directory of its path, as far
    as the depths of the entries go."""
    least, most, deepest = depths
    labels = F.split(host_of(url), r"\.")
    n = F.size(labels)
    first, last = F.greatest(n - most + 1, F.lit(1)), n - least + 1
    domains = F.when(F.lit(most > 0) & (first <= last), F.transform(F.sequence(first, F.greatest(first, last)), lambda i: F.array_join(F.slice(labels, i, n), ".")))
    parts = F.filter(F.split(path_of(url), "/"), lambda p: p != "")
    folders = F.when(
        F.lit(deepest > 0) & (F.size(parts) > 0),
        F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(parts), F.lit(deepest)))), lambda i: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))),
    )
    none = F.array().cast("array<string>")
    return F.when(host_of(url) != "", F.array_distinct(F.concat(F.coalesce(domains, none), F.coalesce(folders, none))))


def validity_intervals(log: DataFrame) -> DataFrame:
    """(key, category, valid_from, valid_to) from a log (key, category, at, listed): listed true adds, false removes."""
    # One statement a key and time; a removal wins over an addition at the same time.
    steps = log.where("key is not null and at is not null").groupBy("key", "category", "at").agg(F.min("listed").alias("listed"))
    order = W.partitionBy("key", "category").orderBy("at")
    turns = steps.withColumn("before", F.lag("listed").over(order)).where("before is null or before <> listed")
    closed = turns.withColumn("valid_to", F.lead("at").over(order))
    return closed.where("listed").select("key", "category", F.col("at").alias("valid_from"), "valid_to")


def blocked_captures(captures: DataFrame, log: DataFrame) -> DataFrame:
    """(capture_id, blocked, n_entries, categories) of captures (capture_id, url, fetched_at)."""
    intervals = staged(validity_intervals(log), "url-intervals")
    keys = captures.select("capture_id", "fetched_at", F.explode(url_keys(F.col("url"), key_depths(intervals))).alias("key"))
    open_then = (F.col("valid_from") <= F.col("fetched_at")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    hits = keys.join(intervals, "key").where(open_then)
    hits = hits.groupBy("capture_id").agg(F.countDistinct("key", "category").alias("n"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("found"))
    return captures.select("capture_id").join(hits, "capture_id", "left").select(
        "capture_id", F.col("n").isNotNull().alias("blocked"), F.coalesce("n", F.lit(0).cast("long")).alias("n_entries"), F.coalesce("found", F.lit("")).alias("categories")
    )


def _captures(pages: DataFrame) -> DataFrame:
    """The given pages carry no fetch time: a year of minutes is dealt by their id."""
    minutes = F.pmod(F.col("page_id") * 7919, F.lit(525_600))
    return pages.select(F.col("page_id").alias("capture_id"), "url", F.timestamp_seconds(F.lit(1_704_067_200) + minutes * 60).alias("fetched_at"))


def _hash(column: str) -> Column:
    return F.conv(F.substring(F.md5(F.col(column)), 1, 8), 16, 10).cast("long")


def _list_log(pages: DataFrame) -> DataFrame:
    """A dated list made from the pages' own hosts and directories, so that it grows with them.

    By a hash of a host: a fifth are listed as spam at some day and, of these, half are removed 60 days later and a part
    listed again; a tenth of the first directories are listed as adult.
    """
    host = host_of(F.col("url"))
    hosts = pages.select(host.alias("key")).where("key <> ''").distinct().withColumn("h", _hash("key")).where("h % 5 = 0")
    folder = F.concat(host, F.lit("/"), F.regexp_extract(path_of(F.col("url")), "^/([^/]+)/", 1))
    folders = pages.select(folder.alias("key")).where("key not like '%/'").distinct().withColumn("h", _hash("key")).where("h % 10 = 3")
    day = lambda days: F.timestamp_seconds(F.lit(1_704_067_200) + days * 86_400)
    first = (F.col("h") / 5).cast("long") % 300
    steps = F.array(
        F.struct(first.alias("day"), F.lit(True).alias("listed")),
        F.when(F.col("h") % 2 == 0, F.struct((first + 60).alias("day"), F.lit(False).alias("listed"))),
        F.when(F.col("h") % 4 == 0, F.struct((first + 90).alias("day"), F.lit(True).alias("listed"))),
    )
    log = hosts.select("key", F.lit("spam").alias("category"), F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("s"))
    log = log.select("key", "category", day(F.col("s.day")).alias("at"), "s.listed")
    return log.unionByName(folders.select("key", F.lit("adult").alias("category"), day(F.col("h") % 200).alias("at"), F.lit(True).alias("listed")))


def op6_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = blocked_captures(_captures(pages), _list_log(pages))
    return out.withColumnRenamed("capture_id", "page_id")


OP6_SQL = r"""
WITH c AS (
  SELECT page_id, make_timestamp((1704067200 + ((page_id * 7919) % 525600) * 60) * 1000000) AS fetched_at,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.|\.$', '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages
), named AS (
  SELECT DISTINCT 'spam' AS category, host AS key FROM c WHERE host <> ''
  UNION SELECT DISTINCT 'adult', host || '/' || regexp_extract(path, '^/([^/]+)/', 1) FROM c WHERE regexp_extract(path, '^/([^/]+)/', 1) <> ''
), hashed AS (
  SELECT category, key, CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) AS h
  FROM named
), log AS (
  SELECT key, category, h // 5 % 300 AS day, true AS listed FROM hashed WHERE category = 'spam' AND h % 5 = 0
  UNION ALL SELECT key, category, h // 5 % 300 + 60, false FROM hashed WHERE category = 'spam' AND h % 5 = 0 AND h % 2 = 0
  UNION ALL SELECT key, category, h // 5 % 300 + 90, true FROM hashed WHERE category = 'spam' AND h % 5 = 0 AND h % 4 = 0
  UNION ALL SELECT key, category, h % 200, true FROM hashed WHERE category = 'adult' AND h % 10 = 3
), i AS (
  SELECT key, category, listed, make_timestamp((1704067200 + CAST(day AS BIGINT) * 86400) * 1000000) AS valid_from,
    lead(make_timestamp((1704067200 + CAST(day AS BIGINT) * 86400) * 1000000)) OVER (PARTITION BY key, category ORDER BY day) AS valid_to
  FROM log
), k AS (
  SELECT page_id, fetched_at, unnest(list_distinct(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda j: array_to_string(string_split(host, '.')[j:], '.')),
    list_transform(range(1, len(list_filter(string_split(path, '/'), lambda p: p <> '')) + 1),
      lambda j: host || '/' || array_to_string(list_filter(string_split(path, '/'), lambda p: p <> '')[:j], '/'))))) AS key
  FROM c WHERE host <> ''
), hits AS (
  SELECT page_id, count(DISTINCT key || ' ' || category) AS n, string_agg(DISTINCT category, ',' ORDER BY category) AS found
  FROM k JOIN i USING (key) WHERE listed AND valid_from <= fetched_at AND (valid_to IS NULL OR fetched_at < valid_to) GROUP BY 1
)
SELECT c.page_id, n IS NOT NULL AS blocked, coalesce(n, 0) AS n_entries, coalesce(found, '') AS categories FROM c LEFT JOIN hits USING (page_id)
"""
