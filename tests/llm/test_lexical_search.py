import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from medialake.llm import lexical_search as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k=50):
    """The stated score of every document for every item."""
    counts = [(d, Counter(terms_of(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, query in wanted.items():
        scored = []
        for d, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in query if t in c)
            if s > 0:
                scored.append((-s, math.inf if d is None else d))
        out += [(item, r + 1, None if d == math.inf else d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def test_whole_table_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert rows(L.op13_lexical_search(spark, sf)) == brute(docs, items)


@pytest.mark.parametrize("k", [1, 5, 50])
def test_many_blocks_and_small_shards_equal_brute_force(spark, k):
    rng = random.Random(k)
    common = [f"c{i}" for i in range(20)]
    rare = [f"r{i}" for i in range(400)]
    docs = [(i * 7 % 3001, " ".join(rng.choices(common, k=rng.randint(0, 12)) + rng.choices(rare, k=rng.randint(0, 4)))) for i in range(3000)]
    docs += [(5000 + i, "c1 c2 r7 r7") for i in range(300)]  # copies share a score: the smaller ids win
    items = [(i, " ".join(rng.sample(common, rng.randint(0, 6)) + rng.sample(rare, rng.randint(0, 5)))) for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = L.build_index(frame, shard_bytes=20_000)
    assert index.select("shard").distinct().count() > 3
    assert rows(L.search(index, spark.createDataFrame(items, "item_id long, text string"), k)) == brute(docs, items, k)


def test_bounds_spare_blocks():
    """A shard with a threshold at hand decompresses fewer blocks than one without, for the same answer."""
    rng = random.Random(1)
    texts = [" ".join(["the"] * rng.randint(1, 3) + (["rare"] * 9 if i == 700 else [f"x{rng.randrange(900)}"] * 4)) for i in range(4000)]
    batches = list(L.shard_rows(0, pa.array(range(4000)), pa.array(texts)))
    n, total = 4000, sum(len(t.split()) for t in texts)
    term = {t: int(L.terms(pa.array([t]))[0][0]) for t in ("the", "rare")}
    opened = []
    for least in (0, 3_000_000_000):
        shard = L.Shard(batches, n, total)
        found, scores, _ = shard.search([(term["the"], 300), (term["rare"], 7000)], 1, least)
        assert found.tolist() == [700]
        opened.append((shard.decoded, int(scores[0])))
    assert opened[0][1] == opened[1][1] and opened[1][0] < opened[0][0] / 4


def test_varbytes_come_back():
    values = np.array([0, 1, 127, 128, 300, 16383, 16384, 2**31, 2**40, 5], np.int64)
    raw, at = L.varbytes(values)
    assert L.unpacked(raw).tolist() == values.tolist() and at[-1] == len(raw)


def test_edges(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "HELLO, world!"), (3, "seven"), (4, "nothing such"), (5, "ü"), (None, "12")], "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    asked = [(r.item_id, r.text) for r in items.collect()]
    assert rows(L.lexical_search(edge_docs, items)) == brute(docs, asked)
    assert L.lexical_search(no_docs, items).count() == 0
    assert L.lexical_search(edge_docs, items.limit(0)).count() == 0
    odd = [(None, "a b"), (None, "a b"), (3, "a b"), (3, "a c"), (2, "a b")]
    frame = spark.createDataFrame([(*r, "x") for r in odd], "doc_id long, text string, term string")
    assert rows(L.lexical_search(frame, spark.createDataFrame([(1, "b c")], "item_id long, text string"))) == brute(odd, [(1, "b c")])
