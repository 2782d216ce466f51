import hashlib
import json
import re

import corpus_pipeline
from medialake.llm import bpe

from .test_jaccard_join import brute


def test_stages_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    codec = bpe.Codec(json.loads(bpe.read_vocabulary()))
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {i: t for i, t in texts.items() if t and re.search(r"[^\W\d_]", t)}  # every table language is learned
    first = {}
    for i in sorted(kept):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", kept[i]), i)
    kept = {i: kept[i] for i in first.values()}
    parts = brute(sorted(kept.items()), 5, 80, 100)
    kept = {i: t for i, t in kept.items() if parts[i][1] == i}
    grams = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(len(w) - 4)}
    items = [grams(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {i: t for i, t in kept.items() if not any(len(g & grams(t)) >= 0.8 * len(g) - 1e-9 for g in items)}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(kept)
    for r in rows:
        ids = codec.encode(kept[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(kept[r.doc_id].encode()).hexdigest()


def test_stages_keep_the_columns_and_bear_edges(spark, sf, edge_docs):
    docs = edge_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS, name
    ids = [r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()]
    assert set(ids) <= {4, 5, 6, 8, 10, 12} and len(ids) == len(set(ids))  # the repeated row of 4 is left once
    empty = edge_docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_text_in_a_language_that_was_not_learned_stays(spark, sf):
    rows = [(1, "Съешь ещё этих мягких французских булок", None, "s", 1), (2, "12 34 !", "en", "s", 1), (3, None, "en", "s", 1)]
    known = [(10 + i, f"the plain english words number {i}", "en", "s", 1) for i in range(30)]
    docs = spark.createDataFrame(rows + known, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, sf).collect()}
    assert 1 in kept and not kept & {2, 3}
