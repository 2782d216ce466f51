import random
from collections import Counter

from medialake.llm.jaccard_join import _may_link, allocate, index_rows, indexed_segments, ngram_jaccard_components, op10_ngram_jaccard_join, shingle_sets, size_bands


def brute(rows, size=3, num=90, den=100):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in (t or "")).replace("\x1c", " ").split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * den >= max(len(x), len(y)) * num and len(x & y) * den >= len(x | y) * num:
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_edge_rows(edge_docs, no_docs):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard_components(edge_docs).collect())
    assert sum(got.values()) == edge_docs.count() and got[4, 1, 4] == 2
    assert got[1, 0, 1] and got[2, 0, 2] and got[5, 1, 4] and got[7, 9, 6] and got[11, 5, 10] and got[12, 5, 12]
    assert ngram_jaccard_components(no_docs).count() == 0


def test_random_edits_equal_brute_force(spark):
    rng, rows = random.Random(3), []
    words = [f"w{i}" for i in range(400)]
    for base in range(25):
        text = [rng.choice(words) for _ in range(rng.choice([3, 5, 12, 21, 40, 90, 200]))]
        for _ in range(rng.randint(1, 6)):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_components(docs).collect()}
    assert got == brute(rows)


def test_low_thresholds_equal_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rng = random.Random(8)
    for i, t in rows[:60]:
        words = (t or "").split(" ")
        for _ in range(max(1, len(words) // 60)):
            words[rng.randrange(len(words))] = "edited"
        rows.append((10_000 + i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size, num in ((5, 80), (2, 50)):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_components(docs, size, num, 100).collect()} == brute(rows, size, num)


def test_chain_inside_a_bucket(spark):
    """Neighbours link, ends do not: the hub alone would not find every link."""
    base = [f"t{i}" for i in range(120)]
    rows = [(k, " ".join(base[: 60 - 2 * k] + [f"x{k}_{j}" for j in range(2 * k)] + base[60:])) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_components(docs).collect()} == brute(rows)


def test_whole_table_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op10_ngram_jaccard_join(spark, sf).collect()} == brute(rows)


def test_allowances_cover_the_largest_difference_at_every_size():
    starts = size_bands(5_000)
    for num in (90, 80):
        for n in (10**2, 10**4, 10**6, 10**9):
            for i, p in enumerate(allocate(starts, {i: n for i in range(len(starts))}, num, 100)):
                high = int(starts[i + 1]) - 1
                h = (high + p.largest) * (100 - num) // (100 + num)
                for s in {int(starts[i]), high, p.largest}:
                    partner = min(s * 100 // num, p.largest) if s <= high else high
                    differ = (s + partner) * (100 - num) // (100 + num)
                    taken = int(indexed_segments(s, p, num, 100))
                    assert 2 * p.twos + taken >= differ + 1 and p.others >= taken and p.largest >= high
                assert p.twos >= 1 or h == 0  # subsets with their one-deletion neighbourhoods, whatever the size


def test_index_keeps_subsets_skips_and_deletions(spark):
    """A pair that differs in h elements shares a key however its differences fall, and a set makes the rows the scheme says."""
    rng, starts = random.Random(2), size_bands(400)
    plan = allocate(starts, {i: 10**5 for i in range(40)}, 80, 100)
    rows = [(0, " ".join(f"w{i}" for i in range(300)))]
    for k in range(1, 120):
        words = [f"w{i}" for i in range(300)]
        for _ in range(k % 12):
            words[rng.randrange(300)] = f"x{rng.random()}"
        rows.append((k, " ".join(words)))
    keys = {}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in index_rows(docs, 5, starts, plan, 80, 100).collect():
        keys.setdefault(r.vertex, set()).add(r.key)
    names = {r.doc_id: r.set_hash for r in shingle_sets(docs, 5).collect()}
    shingles = {i: {tuple(t.split()[k : k + 5]) for k in range(296)} for i, t in rows}
    linked = [k for k in range(1, 120) if len(shingles[0] & shingles[k]) * 100 >= 80 * len(shingles[0] | shingles[k])]
    assert len(linked) > 30 and all(keys[names[0]] & keys[names[k]] for k in linked)


def test_sketch_never_rules_out_a_link(spark):
    rng = random.Random(5)
    base = [f"q{i}" for i in range(700)]
    rows = []
    for k in range(30):
        copy = list(base)
        for _ in range(k):
            copy[rng.randrange(len(copy))] = f"r{k}_{rng.random()}"
        rows.append((k, " ".join(copy)))
    sets = shingle_sets(spark.createDataFrame(rows, "doc_id long, text string"), 3)
    side = lambda c: sets.selectExpr(f"doc_id AS {c}", f"n_shingles AS n_{c}", f"sketch AS sketch_{c}")
    passed = {(r.a, r.b) for r in side("a").join(side("b")).where(_may_link("a", "b", 90, 100)).select("a", "b").collect()}
    shingles = {i: {tuple(t.split()[k : k + 3]) for k in range(698)} for i, t in rows}
    for a in shingles:
        for b in shingles:
            x, y = shingles[a], shingles[b]
            assert len(x & y) * 100 < len(x | y) * 90 or (a, b) in passed
