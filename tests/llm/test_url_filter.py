from datetime import datetime as D

from pyspark.sql import functions as F

from medialake.llm.url_filter import blocked_captures, key_depths, op6_url_filter, url_keys, validity_intervals
from medialake.llm import registry

LOG = [
    ("bad.com", "spam", D(2024, 1, 1), True), ("bad.com", "spam", D(2024, 2, 1), True), ("bad.com", "spam", D(2024, 3, 1), False), ("bad.com", "spam", D(2024, 5, 1), True),
    ("ok.org/x", "adult", D(2024, 1, 1), True), ("tie.net", "spam", D(2024, 1, 1), True), ("tie.net", "spam", D(2024, 1, 1), False), (None, "spam", D(2024, 1, 1), True),
]


def test_intervals_and_as_of(spark):
    log = spark.createDataFrame(LOG, "key string, category string, at timestamp, listed boolean")
    got = {(r.key, r.valid_from.month, r.valid_to and r.valid_to.month) for r in validity_intervals(log).collect()}
    assert got == {("bad.com", 1, 3), ("bad.com", 5, None), ("ok.org/x", 1, None)}
    captures = [
        (1, "http://www.a.BAD.com:80/p", D(2024, 1, 1)), (2, "https://bad.com", D(2024, 3, 1)), (3, "https://u:p@bad.com/?q", D(2024, 6, 1)), (4, "http://ok.org/x/y.html", D(2024, 6, 1)),
        (5, "http://ok.org/xx", D(2024, 6, 1)), (6, None, D(2024, 6, 1)), (7, "not a url", D(2024, 6, 1)), (8, "http://bad.com/", None), (9, "http://tie.net", D(2024, 6, 1)), (10, "http://notbad.com", D(2024, 1, 2)),
    ]
    rows = blocked_captures(spark.createDataFrame(captures, "capture_id long, url string, fetched_at timestamp"), log).collect()
    assert {r.capture_id for r in rows if r.blocked} == {1, 3, 4} and len(rows) == 10
    assert blocked_captures(spark.createDataFrame(captures, "capture_id long, url string, fetched_at timestamp"), log.limit(0)).where("blocked").count() == 0


def test_repeated_captures_long_urls_and_no_captures(spark):
    log = spark.createDataFrame(LOG, "key string, category string, at timestamp, listed boolean")
    deep = "http://ok.org/x/" + "/".join(f"d{i}" for i in range(300)) + "/" + "y" * 20_000
    rows = [(1, "http://fine.net", D(2024, 1, 2)), (1, "http://bad.com", D(2024, 1, 2)), (2, deep, D(2024, 1, 2)), (3, deep, D(2023, 1, 2)), (3, deep, D(2023, 1, 2))]
    captures = spark.createDataFrame(rows, "capture_id long, url string, fetched_at timestamp")
    got = sorted((r.capture_id, r.blocked, r.n_entries) for r in blocked_captures(captures, log).collect())
    assert got == [(1, True, 1), (1, True, 1), (2, True, 1), (3, False, 0), (3, False, 0)]
    assert blocked_captures(captures.limit(0), log).count() == 0


def test_keys_of_the_depths_that_the_list_has(spark):
    url = "http://a.b.bad.com/x/y/" + "/".join(f"d{i}" for i in range(2_000)) + "/end"
    df = spark.createDataFrame([(url,)], "url string")
    keys = lambda depths: set(df.select(url_keys(F.col("url"), depths).alias("k")).first().k)
    assert keys((2, 2, 1)) == {"bad.com", "a.b.bad.com/x"} and keys((2, 3, 0)) == {"bad.com", "b.bad.com"}
    assert keys((1, 9, 0)) == {"com", "bad.com", "b.bad.com", "a.b.bad.com"} and keys((5, 6, 2)) == {"a.b.bad.com/x", "a.b.bad.com/x/y"} and keys((0, 0, 0)) == set()
    entries = spark.createDataFrame([("com",), ("a.b.c",), ("h.org/x",), ("h.org/x/y",)], "key string")
    assert key_depths(entries) == (1, 3, 2) and key_depths(entries.limit(0)) == (0, 0, 0)
    # An entry of every depth, against captures of every depth.
    log = spark.createDataFrame([(k, "spam", D(2024, 1, 1), True) for k in ("com", "b.c.net", "h.org/x/y")], "key string, category string, at timestamp, listed boolean")
    urls = ["http://com", "http://q.com/z", "http://net", "http://c.net", "http://b.c.net", "http://a.b.c.net/p", "http://h.org/x", "http://h.org/x/y", "http://h.org/x/y/z", "http://org", "http://w.h.org/x/y"]
    captures = spark.createDataFrame([(i, u, D(2024, 2, 1)) for i, u in enumerate(urls)], "capture_id long, url string, fetched_at timestamp")
    assert {urls[r.capture_id] for r in blocked_captures(captures, log).collect() if r.blocked} == {"http://com", "http://q.com/z", "http://b.c.net", "http://a.b.c.net/p", "http://h.org/x/y", "http://h.org/x/y/z"}


def test_equals_sql(spark, sf, duck):
    got = sorted(tuple(r) for r in op6_url_filter(spark, sf).select("page_id", "blocked", "n_entries", "categories").collect())
    assert got == sorted(duck.execute(f"SELECT page_id, blocked, n_entries, categories FROM ({registry.oracle_sql()['op6_url_filter']})").fetchall())
    assert 0 < sum(r[1] for r in got) < len(got)


def test_no_python_in_the_plan(spark, sf):
    plan = op6_url_filter(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and F.lit(1) is not None
