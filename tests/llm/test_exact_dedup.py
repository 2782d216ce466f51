import hashlib
import re

from pyspark.sql import functions as F

from medialake.llm.exact_dedup import _of_groups, exact_dedup, maybe_of_groups, op7_exact_dedup


def test_edge_rows(edge_docs):
    got = {r.doc_id: r for r in exact_dedup(edge_docs).collect()}
    assert exact_dedup(edge_docs).count() == edge_docs.count()
    assert got[1].kept and got[1].keep_id == 1 and got[1].group_size == 2 and got[2].keep_id == 1 and not got[2].kept
    assert got[3].keep_id == 3 and got[3].group_size == 1
    assert got[4].kept and got[4].group_size == 2 and got[5].keep_id == 5
    assert got[6].kept and not got[7].kept and got[7].keep_id == 6
    assert not got[11].kept and got[12].kept
    assert got[4].key == "x"


def test_empty_table(no_docs):
    assert exact_dedup(no_docs).count() == 0


def test_same_length_and_prefix_need_the_full_text(spark):
    a, b = "x" * 300 + "a", "x" * 300 + "b"
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id) for r in exact_dedup(docs).collect()} == {(1, 1), (2, 2), (3, 1)}


def test_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    norm = {r.doc_id: re.sub("[\x20\x09-\x0d]+", " ", r.text or "") for r in docs}
    first: dict = {}
    for i in sorted(norm):
        first.setdefault(norm[i], i)
    for r in op7_exact_dedup(spark, sf).collect():
        assert r.keep_id == first[norm[r.doc_id]] and r.kept == (r.keep_id == r.doc_id)
        assert r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()


def test_rows_that_repeat_an_id_are_decided_by_their_texts(spark):
    docs = spark.createDataFrame([(1, "same"), (2, "same"), (2, "unique text"), (3, "same"), (3, "same"), (None, "same"), (None, "alone")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text, r.keep_id, r.group_size, r.kept, r.same_rows) for r in exact_dedup(docs).collect())
    assert got == [(0, "alone", None, 1, True, 1), (0, "same", 1, 5, False, 1), (1, "same", 1, 5, True, 1), (2, "same", 1, 5, False, 1),
                   (2, "unique text", 2, 1, True, 1), (3, "same", 1, 5, False, 2), (3, "same", 1, 5, False, 2)]


def test_shuffled_groups_give_the_same_decisions(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    few = {tuple(r) for r in exact_dedup(docs).drop("text").collect()}
    monkeypatch.setattr("medialake.llm.exact_dedup.BROADCAST_GROUPS", 0)
    assert few == {tuple(r) for r in exact_dedup(docs).drop("text").collect()}


def test_beyond_the_broadcast_only_survivors_are_hashed(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    sized = docs.selectExpr("doc_id", "text as t", "length(text) as len")
    lengths = sized.groupBy("len").count().where("count > 1").select("len")
    want = sized.join(lengths, "len", "left_semi").count()
    assert want < sized.count()
    for count in (lengths.count(), 1_000_000):
        through = maybe_of_groups(sized, lengths, ["len"], count)
        assert through.join(lengths, "len", "left_semi").count() == want
        assert through.count() <= want + 0.05 * (sized.count() - want) + (3 if count < 1_000_000 else 0)
    # A bitmap too small for its groups lets more rows through and loses none.
    monkeypatch.setattr("medialake.llm.exact_dedup.FILTER_BITS", 1 << 15)
    assert maybe_of_groups(sized, lengths, ["len"], 10**9).join(lengths, "len", "left_semi").count() == want


def test_texts_are_not_shuffled_beyond_the_broadcast(spark, sf, monkeypatch):
    monkeypatch.setattr("medialake.llm.exact_dedup.BROADCAST_GROUPS", 0)
    sized = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text as t", "length(text) as len")
    groups = sized.groupBy("len").count().where("count > 1").select("len")
    plan = _of_groups(sized, groups, ["len"], "full", F.sha2("t", 256))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    hashed = min(i for i, x in enumerate(plan) if "sha2" in x)
    joins = [i for i, x in enumerate(plan) if "Join Inner" in x]
    assert len(joins) == 2 and joins[0] < hashed < joins[1]  # above the bitmap's join, below the shuffled one


def test_no_python_in_the_plan(spark, sf):
    plan = op7_exact_dedup(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
