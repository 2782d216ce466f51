import random

import numpy as np
import pyarrow as pa

from medialake.llm import line_dedup as L


def fold(line):
    return " ".join("".join(chr(L._FOLD[ord(c)]) if ord(c) < 128 else c for c in line).split())


def grouped(rows, linked):
    """Groups by comparing every pair of distinct lines."""
    lines = [(i, k, fold(t)) for i, text in rows for k, t in enumerate((text or "").split("\n")) if fold(t)]
    texts = sorted({t for *_, t in lines})
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked(texts):
        parent[find(a)] = find(b)
    first = {}
    for i, k, t in lines:
        g = find(texts.index(t))
        first[g] = min(first.get(g, (i, k)), (i, k))
    return {(i, k): first[find(texts.index(t))] for i, k, t in lines}


def similar(x, y):
    return L.edit_within(x, y, int(max(len(x), len(y)) * 0.2 + 1e-9))


def brute(rows):
    def linked(texts):
        _, _, _, sizes, sims, keys, holds = L._lines_of(pa.array(texts))
        keys = [set(k[h].tolist()) for k, h in zip(keys, holds)]
        for a in range(len(texts)):
            for b in range(a + 1, len(texts)):
                if keys[a] & keys[b] and (bin(int(sims[a] ^ sims[b])).count("1") <= L.DISTANCE or max(sizes[a], sizes[b]) <= L.SHORT) and similar(texts[a], texts[b]):
                    yield a, b

    return grouped(rows, linked)


def result(docs):
    return {(r.doc_id, r.line_no): (r.keep_doc_id, r.keep_line_no) for r in L.fuzzy_line_dedup(docs).collect()}


def test_edge_rows(edge_docs, no_docs):
    rows = L.fuzzy_line_dedup(edge_docs).collect()
    got = {r.doc_id: (r.keep_doc_id, r.group_size) for r in rows}
    assert 1 not in got and 2 not in got and 3 not in got
    assert got[5] == (4, 3) and got[7] == (6, 2) and got[11][0] == 10 and got[8] == (8, 1)
    assert L.fuzzy_line_dedup(no_docs).count() == 0


def test_equals_brute_force(spark):
    rng, rows = random.Random(4), []
    words = [f"word{i}" for i in range(300)]
    for k in range(12):
        base = [rng.choice(words) for _ in range(60)]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(60)] = rng.choice(words)
            rows.append((len(rows), "Short line.\n" + " ".join(copy) + "\n\n" + " ".join(base[: k + 1])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(docs) == brute(rows)


def test_whole_table_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_lines_are_taken_out(spark):
    docs = spark.createDataFrame([(1, "a b c\nd"), (2, "x\nA b, c!\n\ny"), (3, None)], "doc_id long, text string")
    cleaned = L.without_duplicate_lines(docs, L.fuzzy_line_dedup(docs))
    assert {r.doc_id: r.text for r in cleaned.collect()} == {1: "a b c\nd", 2: "x\n\ny", 3: None}


def test_edit_within_equals_the_matrix():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(0)
    for _ in range(3_000):
        a, b = ("".join(rng.choice("abé ") for _ in range(rng.randint(0, 12))) for _ in range(2))
        most = rng.randint(0, 8)
        assert L.edit_within(a, b, most) == (distance(a, b) <= most)


def test_counts_of_characters_lose_no_pair():
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcé😀 p0") for _ in range(rng.randint(0, 14))) for _ in range(4_000)]
    a, b = texts[::2], [t if rng.random() < 0.5 else u[: rng.randint(0, 14)] + t[2:] for t, u in zip(texts[1::2], texts[::2])]
    may = L.may_be_within(pa.array(a), pa.array(b), 0.8)
    assert all(m or not similar(x, y) for x, y, m in zip(a, b, may)) and 0 < may.sum() < len(a)


def test_recall_against_edit_similarity_alone(spark):
    """Edits of distinct lines of the tables: a character, a word, and several words of longer lines; nothing dissimilar is linked."""
    rng = random.Random(6)
    texts = sorted({fold(t) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() for t in (r.text or "").split("\n")})
    texts = [t for t in texts if 5 <= len(t.split()) <= 120]
    pairs = []
    for t in rng.sample(texts, 1_200):
        words = t.split()
        kind = len(pairs) % 3
        if kind == 0:
            at = rng.randrange(len(t))
            other = t[:at] + "q" + t[at + 1 :]
        else:
            for _ in range(1 if kind == 1 else max(1, len(words) // 12)):
                at = rng.randrange(len(words))
                words[at] = rng.choice(texts).split()[0]
            other = " ".join(words)
        if fold(other) != t and similar(t, fold(other)):
            pairs.append((t, fold(other)))
    rows = [(i, "\n".join(p)) for i, p in enumerate(pairs)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.line_no): (r.keep_doc_id, r.keep_line_no) for r in L.fuzzy_line_dedup(docs).collect()}
    found = sum(got[i, 0] == got[i, 1] for i in range(len(pairs)))
    assert len(pairs) > 900 and found / len(pairs) > 0.95, found / len(pairs)


def test_the_same_answer_however_rows_are_dealt(spark):
    """Thousands of copies of a line and variants of it with a changed character: one group for any number of partitions."""
    words = "quarterly revenue figures exceeded analyst expectations throughout every northern region".split()
    rows = [(i, " ".join(words)) for i in range(3_000)] + [(5_000 + k, " ".join(words)[:k] + "q" + " ".join(words)[k + 1 :]) for k in range(20, 60)]
    answers = []
    for n in (1, 8, 100):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        answers.append({(r.doc_id, r.keep_doc_id, r.group_size) for r in L.fuzzy_line_dedup(docs).collect()})
    assert answers[0] == answers[1] == answers[2] == {(i, 0, 3_040) for i, _ in rows}


def test_recall_on_natural_pairs(spark):
    """Lines of the table itself: of the pairs with an edit similarity of 0.8, by that alone, nearly all are in one group."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {}
    texts = {r.doc_id: (r.text or "").split("\n") for r in docs.select("doc_id", "text").collect()}
    for r in L.fuzzy_line_dedup(docs).collect():
        found[fold(texts[r.doc_id][r.line_no])] = (r.keep_doc_id, r.keep_line_no)
    lines = sorted(t for t in found if len(t.split()) > 1)
    counts = np.zeros((len(lines), 256), np.int32)
    for row, t in zip(counts, lines):
        np.add.at(row, np.frombuffer(t.encode(), np.uint8), 1)
    sizes = counts.sum(1)
    total = hits = 0
    for i in range(0, len(lines), 6):
        apart = np.maximum(np.maximum(counts - counts[i], 0).sum(1), np.maximum(counts[i] - counts, 0).sum(1))
        for j in np.flatnonzero(apart <= 0.2 * np.maximum(sizes, sizes[i]) * 2).tolist():
            if j != i and similar(lines[i], lines[j]):
                total += 1
                hits += found[lines[i]] == found[lines[j]]
    assert total > 100 and hits / total >= 0.95, (hits, total)


def test_a_repeated_common_word_makes_no_key():
    """Unlike lines that repeat one word share no key, though that word outnumbers the others of its block; lines of one repeated word do."""
    rng = random.Random(11)
    common = "that that that that that"
    lines = [" ".join(rng.sample(["".join(rng.choices("bcdfghjk", k=9)) for _ in range(28)] + common.split(), 33)) for _ in range(200)]
    keys = [set(k[h].tolist()) for k, h in zip(*L._lines_of(pa.array(lines))[5:])]
    assert sum(bool(keys[i] & keys[j]) for i in range(200) for j in range(i)) == 0
    same = [" ".join(["blestou"] * 30 + [x]) for x in ("wordone", "another")]
    one, two = (set(k[h].tolist()) for k, h in zip(*L._lines_of(pa.array(same))[5:]))
    assert one & two


def test_words_exchanged_in_place_are_within():
    rng = random.Random(12)
    accepted = 0
    for _ in range(2_000):
        a = [rng.choice(["the", "of", "ab", "é", "word", "quarterly"]) for _ in range(rng.randint(1, 12))]
        b = list(a)
        for _ in range(rng.randint(0, 2)):
            b[rng.randrange(len(b))] = rng.choice(["the", "xy", "longerword"])
        at = rng.randrange(len(b) + 1)
        b[at:at] = [rng.choice(["in", "then"]) for _ in range(rng.randint(0, 2))]
        a, b = " ".join(a), " ".join(b)
        most = rng.randint(0, 15)
        accepted += L.words_within(a, b, most)
        assert not L.words_within(a, b, most) or L.edit_within(a, b, most)
    assert accepted > 200
