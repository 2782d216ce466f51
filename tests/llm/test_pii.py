import hashlib
import re

from medialake.llm.pii import op4_pii, personal_data

KINDS = ("email", "ip", "card", "phone")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


CASES = [
    None, "", "a@b.c", "x a@b.c_d@e.f y", "é 😀 a.b+c@d-e.fg.hi, z", "1.2.3.4.5.6.7.8", "0001.002.0300.255", "256.1.1.1 1.1.1.1", "4041 8949-7460 8795", "4041894974608795 4041894974608795",
    "404189497460879512345678901234", "1 2  3 4", "call +1 (456) 555-2186 or +49 30 1234567.", "+12-", "++1 234 567 8901", "4111 1111 1111 1111-", "x" * 70_000 + "@" + "y" * 10 + ".z",
    "9" * 60_000, "1 " * 30_000, "a@" * 2_000, "+1" + " 2" * 3_000, "12.34." * 5_000,
    "a@b" + ".c" * 200_000, "7x " * 3_000 + "a@b.c", "w" * 4_000 + " 1.2.3.4",
]


def test_base_spans_equal_the_patterns(spark):
    docs = spark.createDataFrame([(i, t, "k", 3) for i, t in enumerate(CASES)], "doc_id long, text string, kind string, at int")
    got = {r.doc_id: r.base for r in personal_data(docs).collect()}
    for i, t in enumerate(CASES):
        assert ",".join(f"{KINDS[s.kind]}:{s.at}:{s.to}" for s in got[i]) == base(t), (i, (t or "")[:40])


def test_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op4_pii(spark, sf).collect():
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert r.n_email == want.count("email:") and r.n_phone == want.count("phone:")
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


def test_context_finds_unseen_identifiers(spark):
    seeds = [(i, f"Please write: contact mail user{i}@example.com today") for i in range(12)]
    unseen = [(100, "Please write: contact mail agent007#corp now"), (101, "an ordinary walk of 12345 steps")]
    plain = [(200 + i, f"an ordinary walk of {10_000 + i} steps") for i in range(20)]
    docs = spark.createDataFrame(seeds + unseen + plain, "doc_id long, text string")
    added = {r.doc_id: [(s.at, s.to, s.kind) for s in r.added] for r in personal_data(docs).collect() if r.added}
    assert added == {100: [(27, 40, 0)]}


def test_edges(edge_docs, no_docs):
    assert personal_data(edge_docs).count() == edge_docs.count()
    assert personal_data(no_docs).count() == 0


def test_spans_of_every_form_seed_their_contexts(spark):
    names = [a + b for a in ("ann", "bob", "cleo") for b in ("x", "y", "z", "w")]
    rows = [f"Sales  desk\tdial +1 (743) 555-38{i:02d} now" for i in range(12)] + [f"we write to {n}@example.com now" for n in names]
    rows += ["please charge card 4041 8949 7460 8795" + " " * i + f" then {i}" for i in range(2)]
    rows += ["sales desk dial ext#77123 now", "we write to user77#corp now", "an ordinary walk of 12345 steps"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    added = {r.doc_id: [(rows[r.doc_id][s.at : s.to], s.kind) for s in r.added] for r in personal_data(docs).collect() if r.added}
    assert added == {26: [("ext#77123", 3)], 27: [("user77#corp", 0)]}


def test_grouped_cards_seed_their_context(spark):
    cards = [f"4041 8949 74{i:02d} {j:04d}" for i in range(12) for j in range(1000, 1010)]
    cards = [c for c in cards if luhn(c.replace(" ", ""))][:8]
    rows = [f"{c} was charged" for c in cards] + [f"charge my card {c} today" for c in cards] + ["charge my card A99-1234 today"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    added = {r.doc_id: [(s.at, s.to, s.kind) for s in r.added] for r in personal_data(docs).collect() if r.added}
    assert len(cards) == 8 and added == {16: [(15, 23, 2)]}


def test_bootstrapping_reaches_what_no_seed_stands_beside(spark):
    """Identifiers after common words lead to the words before keys, and these to keys among rare words; numbers are left alone."""
    rows = [f"ask the 10.0.0.{i} for more" for i in range(30)] + [f"ask the AKIA{i:02d}XK99 for key word {i}" for i in range(6)]
    rows += [f"rare{'abcdefghij'[i]} AKIA7{i}QQ8 word{'abcdefghij'[i]}" for i in range(4)]
    rows += [f"ask the secret={i:02d}f9a8b for more" for i in range(6)] + ["lone secret = 'ff00aa11' again"]
    rows += [f"there were {n} people in {1900 + n} rooms" for n in range(10_000, 10_200)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    added = {r.doc_id: [rows[r.doc_id][s.at : s.to] for s in r.added] for r in personal_data(docs).collect() if r.added}
    keys = {i: [rows[i].split()[2].split("=")[-1]] for i in [*range(30, 36), *range(40, 46)]}
    assert added == keys | {36 + i: [f"AKIA7{i}QQ8"] for i in range(4)} | {46: ["ff00aa11"]}


def test_no_python_in_the_plan(spark, sf):
    plan = op4_pii(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
