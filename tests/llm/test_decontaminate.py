import random

from medialake.llm.decontaminate import contaminated, op9_decontamination


def test_edge_rows(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (4, "one two three four five six seven"), (4, "one two three four five six seven"), (5, "quick brown fox jumps over the lazy")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in contaminated(edge_docs, items).collect())
    assert got == sorted([(4, 3), (4, 3), (5, 3), (10, 4), (10, 4), (11, 4), (11, 4), (6, 5), (7, 5)])
    assert contaminated(no_docs, items).count() == 0
    assert contaminated(edge_docs, items.limit(0)).count() == 0


def test_finds_short_items_in_long_documents(spark, sf):
    docs = [(r.doc_id, (r.text or "").lower().split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, (r.text or "").lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    sets = {i: grams(w) for i, w in items}
    want = set()
    for d, w in docs:
        own = grams(w)
        want |= {(d, i) for i, s in sets.items() if len(own & s) >= 0.8 * len(s) - 1e-9}
    got = {(r.doc_id, r.item_id) for r in op9_decontamination(spark, sf).collect()}
    assert got == want and want


def test_item_in_a_very_long_document(spark):
    noise = " ".join(f"n{i}" for i in range(60_000))
    item = " ".join(f"i{k}" for k in range(20))
    docs = spark.createDataFrame([(1, noise), (2, noise[:200_000] + " " + item + " " + noise[200_000:])], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(r.doc_id, r.containment) for r in contaminated(docs, items).collect()] == [(2, 1.0)]


def test_items_of_one_or_two_shingles_in_every_document(spark):
    rng = random.Random(9)
    items = [(k, " ".join(f"i{k}x{j}" for j in range(3 + k % 4))) for k in range(8)]
    rows, want = [], set()
    for d in range(2_000):
        words = [f"n{rng.randrange(500)}" for _ in range(rng.randint(20, 300))]
        k = d % 8
        at = rng.randrange(len(words))
        rows.append((d, " ".join(words[:at] + [items[k][1]] + words[at:])))
        want.add((d, k))
    found = contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want
