import hashlib
import random
import re
import zlib

import pytest

from medialake.llm.periodic_runs import op11_periodic_runs, periodic_runs, with_repeats

GAP = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text):
    return [w for w in GAP.split(text or "") if w]


def brute_runs(words):
    """Every run by its definition: for each period, stretches of equal words q apart; smallest periods only."""
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            stretch = words[i : j + q]
            smallest = all(any(stretch[k] != stretch[k + p] for k in range(length - p)) for p in range(1, q))
            if length >= max(6, 4 * q) and smallest:
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def altered(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: ([(x.start, x.length, x.period) for x in r.runs], r.collapsed) for r in periodic_runs(docs).collect()}


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_equals_the_definition_on_random_texts(spark, letters):
    rng = random.Random(letters)
    rows = []
    for k in range(300):
        unit = [f"w{rng.randrange(letters + 1)}" for _ in range(rng.randint(1, 9))]
        parts = [[f"w{rng.randrange(letters + 1)}" for _ in range(rng.randint(0, 12))]]
        for _ in range(rng.randint(0, 3)):
            parts += [unit * rng.randint(1, 7) + unit[: rng.randrange(len(unit))], [f"w{rng.randrange(letters + 1)}" for _ in range(rng.randint(0, 8))]]
        rows.append((k, rng.choice([" ", "\n", " \t "]).join(w for part in parts for w in part)))
    got = found(spark, rows)
    for k, text in rows:
        words = words_of(text)
        runs = brute_runs(words)
        assert got[k] == (runs, collapsed(words, runs)), text


def test_runs_over_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in op11_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs)
    with_runs = 0
    for doc_id, text in docs:
        words = altered(doc_id, words_of(text))
        if len(words) > 1500:
            continue  # the definition is quadratic; these are held against their own periods below
        runs = brute_runs(words)
        r = got[doc_id]
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
        if runs:
            s, n, q = min(runs, key=lambda x: (-x[1], x[0], x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, n, q, 1000 * n // q)
            with_runs += 1
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
    assert with_runs > 10


def test_repeats_as_stated(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in with_repeats(spark.read.parquet(f"{sf}/documents.parquet")).collect():
        assert words_of(r.text) == altered(r.doc_id, words_of(docs[r.doc_id]))


def test_very_long_runs(spark):
    got = found(spark, [(1, "ha " * 200_000), (2, " ".join(f"x{i % 5000}" for i in range(120_000))), (3, " ".join(f"u{i}" for i in range(100_000)))])
    assert got[1] == ([(0, 200_000, 1)], "ha")
    assert got[2] == ([(0, 120_000, 5000)], " ".join(f"x{i}" for i in range(5000)))
    assert got[3][0] == [] and len(got[3][1].split()) == 100_000


def test_edges(spark, edge_docs, no_docs):
    rows = {(r.doc_id, r.n_words, len(r.runs)) for r in periodic_runs(edge_docs).collect()}
    assert {(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 2, 0), (6, 45_000, 1)} <= rows
    assert periodic_runs(edge_docs).count() == edge_docs.count() and periodic_runs(no_docs).count() == 0
    five = found(spark, [(1, "a a a a a"), (2, "a a a a a a"), (3, "a b a b a b a"), (4, "a b a b a b a b"), (5, "A a A a A a A a"), (6, "a a a a a a a a a a a a")])
    assert [len(five[k][0]) for k in range(1, 7)] == [0, 1, 0, 1, 1, 1]
    assert five[4][1] == "a b"
    nulls = spark.createDataFrame([(None, "x " * 9), (None, None)], "doc_id long, text string")
    assert sorted(r.n_words for r in periodic_runs(with_repeats(nulls)).collect()) == [0, 9]
