"""Edge cases and invariants of the library's operators."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from medialake.functions import names, scores, signal
from medialake.operators import balance, clusters, facets, integrity, linkage
from medialake.plans import rules
from medialake.sources import listing, sinks


def column(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", build(F.col("v")).alias("x")).orderBy("i").collect()]


def test_names(spark):
    assert column(spark, ["db / c#", "Eb/D#", "g#M", "H", " ", None], names.normalize_key) == ["Db", "Eb", "Abm", None, None, None]
    assert column(spark, ["12.5 dB", "x", "", None], names.parse_sdr) == [12.5, None, None, None]
    assert column(spark, ["A (Original Song)", "A (lead vocals) [x]", "A instrumental", "A (inst)", "beat"], names.classify_role) == ["original", "acapella", "instrumental", "instrumental", None]
    assert column(spark, [59, 3600, 3725], names.hours_clock, "int") == ["0m59s", "1h00m00s", "1h02m05s"]


def test_histogram_keeps_the_top_edge(spark):
    df = spark.createDataFrame([(v,) for v in (30.0, 44.9, 45.0, float("inf"), float("-inf"), float("nan"), None)], "v double")
    assert {(r.bin, r.n) for r in facets.histogram(df, "v").collect()} == {(30, 1), (35, 0), (40, 1), (45, 1)}
    assert facets.histogram(df.limit(0), "v").count() == 0


def test_balance_gives_equal_strata(spark, sf):
    from medialake.queries.fixtures import units

    u = units(spark, sf)
    for features in (("genre",), ("gender",), ("genre", "gender"), ()):
        chosen = balance.select_balanced(u, features)
        sizes = {r["count"] for r in chosen.where("role <> 'vocal'").groupBy("stratum").count().collect()}
        assert len(sizes) <= 2 and chosen.select("id").distinct().count() == chosen.count()
        assert sorted(map(tuple, chosen.select("id", "stratum").collect())) == sorted(map(tuple, balance.select_balanced(u.repartition(7), features).select("id", "stratum").collect()))
    assert balance.select_balanced(u.limit(0), ("genre",)).count() == 0


def test_greedy_assignment_equals_the_sequential_one(spark):
    rng = random.Random(1)
    for _ in range(3):
        edges = {(rng.randrange(12), 100 + rng.randrange(12)): rng.choice([0.6, 0.7, 0.8, 0.9, 1.0]) for _ in range(60)}
        want, used = set(), set()
        for (a, b), s in sorted(edges.items(), key=lambda e: (-e[1], e[0])):
            if a not in used and b not in used:
                want.add((a, b, s))
                used |= {a, b}
        df = spark.createDataFrame([(a, b, s) for (a, b), s in edges.items()], "ref long, partner long, score double")
        assert {tuple(r) for r in linkage.assign_greedily(df).select("ref", "partner", "score").collect()} == want


def test_similarity(spark):
    pairs = spark.createDataFrame([("", ""), ("", "a"), ("tide", "diet"), ("same", "same"), ("long name here", "long name here x")], "a string, b string")
    got = {(r.a, r.b): r.s for r in linkage.with_similarity(pairs, "a", "b", "s").collect()}
    assert got["", ""] == 1 and got["", "a"] == 0 and got["same", "same"] == 1 and got["tide", "diet"] == SequenceMatcher(None, "tide", "diet").ratio()
    folder = {(r.a, r.b): r.s for r in linkage.folder_similarity(pairs, "a", "b", "s").collect()}
    assert folder["", ""] == 0 and folder["long name here", "long name here x"] >= 0.92


def test_best_folder_equals_all_pairs(spark):
    rng = random.Random(2)
    words = ["blue", "song", "long", "night", "tonight", "of", "the", "drums", "x"]
    make = lambda k: " ".join(rng.choice(words) for _ in range(rng.randrange(k)))
    names, listed = {make(6) for _ in range(60)}, [(make(5), i) for i in range(40)]

    def score(a, b):
        if not a or not b:
            return 0.0
        s = 1.0 if a == b else SequenceMatcher(None, a, b).ratio()
        small, large = sorted((a, b), key=len)
        return max(s, 0.92) if len(small) >= 8 and small in large and len(small) >= 0.55 * len(large) else s

    files = spark.createDataFrame([(n,) for n in names] + [(None,), ("blue song",)], "name string")
    folders = spark.createDataFrame(listed + [(None, 99)], "folder string, ord int")
    for t in (0.6, 0.85, 0.92):
        best = {n: min(((-score(n, f), i, f) for f, i in listed), default=None) for n in names | {"blue song"}}
        want = {(n, f, -s) for n, (s, i, f) in best.items() if -s >= t}
        assert {tuple(r) for r in linkage.best_match(files, folders, t).collect()} == want


def test_fuzzy_linkage_is_one_to_one(spark):
    left = spark.createDataFrame([(1, "abc", "blue song"), (2, "abc", "blue songs"), (3, "xyz", "other")], "id long, artist string, title string")
    right = spark.createDataFrame([(10, "abc", "blue song"), (11, "abd", "blue song"), (12, "q", "nothing")], "id long, artist string, title string")
    matched, lonely, rest = linkage.find_pairs(left, right, 0.6)
    assert {(r.ref, r.partner) for r in matched.collect()} == {(1, 10), (2, 11)}
    assert [r.id for r in lonely.collect()] == [3] and [r.id for r in rest.collect()] == [12]


def test_components_are_a_partition(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    assert {(r.node, r.component) for r in clusters.components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100), (102, 100)}


def test_leaders_in_order(spark):
    t = spark.createDataFrame([(1, "a", "song one"), (2, "a", "song ona"), (3, "a", "song one"), (4, "b", "else")], "id long, artist string, title string")
    assert {(r.id, r.leader) for r in clusters.leader_groups(t, 0.8).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_rename_rules(spark):
    df = spark.createDataFrame([(1, "01 - hi strings (final)"), (2, "Kick DRUMS_2"), (3, "FX - kick"), (4, "")], "id long, name string").withColumns(
        {c: F.lit("") for c in ("group", "bpm", "key", "instrument", "category")} | {"is_group": F.lit(False)}
    )
    cats = [{"name": "Strings", "keywords": "string", "affix": "STRINGS - "}, {"name": "Drums", "keywords": "kick,drum", "affix": "DRUMS - "}, {"name": "FX", "keywords": "riser", "affix": "FX - "}]
    tree = [{"kind": "op", "op": "stripLeadingNumberPrefix"}, {"kind": "op", "op": "removeText", "params": {"text": r"\(.*?\)", "regex": True}}, {"kind": "op", "op": "trim"},
            {"kind": "op", "op": "categoryBundle", "params": {"categories": cats}}, {"kind": "op", "op": "padNumericSuffix", "enabled": False}]
    got = {r.id: (r.new_name, r.matched_keyword) for r in rules.preview(df, tree).collect()}
    assert got == {1: ("STRINGS - hi strings", "string"), 2: ("DRUMS - Kick DRUMS_2", "kick"), 3: ("DRUMS - FX - kick", "kick"), 4: ("", "")}


def test_template_leaves_what_it_does_not_know(spark):
    df = spark.createDataFrame([("n", 7)], "name string, index int")
    assert df.select(rules.template("{counter:abc}{counter:3}{x}{name}", F.col("name")).alias("t")).first().t == "{counter:abc}007{x}n"


def test_collisions_skip_taken_suffixes(spark):
    plan = spark.createDataFrame([(1, "d", "a", "t", "wav"), (2, "d", "b", "T", "wav"), (3, "d", "c", "t_1", "wav"), (4, "d", "e", "e", "wav"), (5, "d", "f", "", "wav"), (6, "d", "g", "t", "wav")],
                                 "id long, folder string, source string, target string, ext string")
    final = {r.id: r.final for r in rules.resolve_collisions(plan).collect()}
    assert final == {1: "t", 2: "T_2", 3: "t_1", 6: "t_3"}


def test_scores_edges(spark):
    labels = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    df = spark.createDataFrame([(1, [0.0, 0.0, 0.0]), (2, [0.5, 0.5, 0.1])], "i int, v array<double>")
    got = {r.i: r.t for r in df.select("i", scores.top_k(F.col("v"), labels, 2, 0.6).alias("t")).collect()}
    assert got[1].silent and got[1].label == "" and got[2].label == "a" and got[2].top == ["a"] and got[2].above == []
    assert abs(sum(df.select(scores.softmax(F.col("v")).alias("p")).first().p) - 1) < 1e-12


def test_signals(spark):
    df = spark.createDataFrame([([0.0, 0.0, 1.0, -1.0, 0.5, 0.0, 0.0, 0.0], [1.0, -1.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0])], "a array<double>, b array<double>")
    row = df.select(signal.delay("a", "b").alias("lag"), signal.si_sdr(F.col("a"), F.col("a")).alias("same"), signal.si_sdr(F.transform("a", lambda x: x * 0), F.col("a")).alias("silent")).first()
    assert row.lag == -2 and row.same > 60 and row.silent == float("-inf")
    ends = spark.range(1).select(signal.windows(F.lit(1000), 300).alias("w")).first().w
    assert [(w.start, w.end) for w in ends] == [(0, 300), (300, 600), (600, 900), (900, 1000)]


def test_resampling_equals_filtering_the_stuffed_signal(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    given = [rng.normal(size=n).tolist() for n in (1, 7, 50)] + [[]]
    df = spark.createDataFrame(list(enumerate(given)), "i int, v array<double>")
    for up, down in ((2, 3), (3, 2), (1, 4), (5, 1), (4, 4)):
        half = 10 * max(up, down)
        m = np.arange(-half, half + 1)
        taps = np.sinc(m / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
        for r in df.withColumn("y", signal.resampled(F.col("v"), up * 100, down * 100)).collect():
            stuffed = np.zeros(len(r.v) * up)
            stuffed[::up] = r.v
            want = np.convolve(stuffed, taps / taps.sum() * up)[half : half + len(stuffed) : down] if r.v and up != down else np.array(r.v)
            assert len(r.y) == -(-len(r.v) * up // down) and np.allclose(r.y, want, atol=1e-9), (up, down, len(r.v))


def test_overlap_add_edges(spark):
    parts = spark.createDataFrame([(1, 0, [1.0] * 4), (1, 2, [1.0] * 3), (2, 0, []), (3, 0, [5.0])], "key int, start int, v array<double>")
    got = {(r.key, r.idx): round(r.y, 6) for r in facets.overlap_add(parts, "key", "start", "v", 4, 2).collect()}
    assert got == {(1, 0): 0.0, (1, 1): 1.0, (1, 2): 1.0, (1, 3): 1.0, (1, 4): 1.0, (3, 0): 0.0}
    plain = {(r.key, r.idx): r.y for r in facets.overlap_add(parts, "key", "start", "v", 4, 0).collect()}
    assert set(plain.values()) == {1.0, 5.0}


def test_mp3_walk():
    frame = bytes.fromhex("fffb9000") + bytes(413)
    assert integrity.mp3_frames(frame * 3) == (3, "", None) and integrity.mp3_frames(frame * 2 + frame[:100]) == (2, "TRUNCATED", None)
    assert integrity.mp3_frames(frame + b"\0\0\0\0\0") == (1, "LOST SYNC", None) and integrity.mp3_frames(b"") == (0, "NO FRAMES", None)
    assert integrity.mp3_frames(b"ID3\x03\x00\x00\x00\x00\x00\x02xx" + frame + b"TAG" + bytes(125)) == (1, "", None)
    one, two = bytes.fromhex("ffff9000") + bytes(308), bytes.fromhex("fffd9000") + bytes(518)  # layers I (288 kbit/s) and II (160 kbit/s)
    assert integrity.mp3_frames(one * 2) == (2, "", None) and integrity.mp3_frames(two * 3) == (3, "", None)
    info = frame[:36] + b"Info" + bytes([0, 0, 0, 1, 0, 0, 0, 2]) + frame[48:]
    assert integrity.mp3_frames(info + frame * 2) == (3, "", 2)


def test_tags_of_any_script(spark):
    given = ["Beyoncé", "Привет", "日本語", "Straße & Co.", "ﬁne (Live) [HD]", "Ａ１", "a(b)c", ""]
    want = ["beyonce", "привет", "日本語", "strasse and co", "fine", "a1", "a c", ""]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, t string").select("i", names.normalize_tag(F.col("t")).alias("n")).collect()
    assert [r.n for r in sorted(rows)] == want


def test_parts_linked_by_orders(spark, sf):
    from medialake.queries.clustering import clu02_components

    ends = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        lo, hi = ends.get(r[0], (r[1], r[1]))
        ends[r[0]] = min(lo, r[1]), max(hi, r[1])
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in ends.values():
        if a != b:
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    assert {r.node: r.component for r in clu02_components(spark, sf).collect()} == {x: find(x) for x in parent}


def test_leaders_without_names_join_their_own_title_only(spark):
    rows = [(1, "ann", "song one"), (2, "", "song onf"), (3, "", "song onf"), (4, "ann", "song onf")]
    got = {r.id: r.leader for r in clusters.leader_groups(spark.createDataFrame(rows, "id long, artist string, title string"), 0.0).collect()}
    assert got[2] == 2 and got[3] == 2 and got[1] == 1


def test_near_texts_share_a_key():
    from medialake.functions.near_keys import earlier_keys, later_keys

    rng = random.Random(5)
    texts = ["", "a", "ab", "blue song", "x" * 40, "the long road home again tonight"]
    for t in (0.5, 0.8, 0.9, 0.95, 1.0):
        for base in texts:
            for _ in range(150):
                other = list(base)
                for _ in range(rng.randrange(6)):
                    at = rng.randrange(len(other) + 1)
                    other[at : at + rng.randrange(2)] = rng.choice(["", "a", "z", "qq"])
                other = "".join(other)
                for a, b in ((base, other), (other, base)):
                    if a == b or a and b and SequenceMatcher(None, a, b).ratio() >= t:
                        assert set(earlier_keys(b, t)) & set(later_keys(a, t)), (t, a, b)


def test_leaders_equal_the_sequential_ones(spark):
    def one(x, y):
        return 1.0 if x == y else 0.0 if not x or not y else SequenceMatcher(None, x, y).ratio()

    rng = random.Random(11)
    titles = ["blue song", "blue songs", "blue sony", "blu song", "blueberry", "", "bl", "red songs in the night", "red songs in the light"]
    rows = [(i, rng.choice(["ann", "anne", "", "bob and the band", "bob and the bend"]), rng.choice(titles) + rng.choice(["", "", "x"])) for i in range(150)]
    rows += [(900 + i, "chain", "m" * (20 + i)) for i in range(12)] + [rows[3]]
    df = spark.createDataFrame(rows, "id long, artist string, title string")
    for t in (0.6, 0.85, 0.95):
        leaders, want = [], set()
        for i, a, title in sorted(rows):
            near = [x for x in leaders if x[2] == title] + ([x for x in leaders if x[2][:3] == title[:3]] if a and title else [])
            found = next((x[0] for x in near if min(one(a, x[1]), one(title, x[2])) >= t), None)
            if found is None:
                leaders.append((i, a, title))
            want.add((i, i if found is None else found))
        got = [tuple(r) for r in clusters.leader_groups(df, t).collect()]
        assert set(got) == want and len(got) == len(rows)
    assert clusters.leader_groups(df.limit(0), 0.9).count() == 0


def test_listing_and_sinks(spark, tmp_path):
    for p in ("a.wav", "sub/b.MP3", "sub/c.txt", "_backup_before_align/d.wav"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b"x" * 3)
    found = listing.list_files(spark, str(tmp_path), kind="inventory").collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in found) == ["a.wav", "b.MP3"] and {r.length for r in found} == {3}
    sinks.write_list(spark.createDataFrame([("b",), ("a",)], "n string"), "n", str(tmp_path / "list"))
    assert [r.value for r in spark.read.text(str(tmp_path / "list")).collect()] == ["a", "b"]


def test_streaming_takes_files_once(spark, sf, tmp_path):
    from medialake.operators.facets import facets as count
    from medialake.queries.fixtures import units
    from medialake.streaming.incremental import facet_totals, facet_updates

    u = units(spark, sf)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in u.schema)
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    u.where("id % 2 = 0").write.parquet(folder)
    facet_updates(spark, folder, schema, out, mark)
    u.where("id % 2 = 1").write.mode("append").parquet(folder)
    facet_updates(spark, folder, schema, out, mark)
    facet_updates(spark, folder, schema, out, mark)
    key = lambda df: sorted((r.facet, r.value, r.n, r.bytes) for r in df.collect())
    assert key(facet_totals(spark, out)) == key(count(u))


def test_components_of_a_long_chain_with_shuffled_ids(spark):
    from medialake.components import connected_components

    rng = random.Random(3)
    ids = [rng.randrange(-(2**62), 2**62) for _ in range(1_000)]
    chain = list(zip(ids, ids[1:]))
    star = [(2**62 + 10 + i, 2**62 + 500) for i in range(300)]
    edges = spark.createDataFrame(chain + star + [(b, a) for a, b in chain[:50]] + [(7, 7)], "a long, b long").persist()
    want = {(i, min(ids)) for i in ids} | {(i, 2**62 + 10) for e in star for i in e}
    assert {(r.node, r.component) for r in connected_components(edges).collect()} == want
    assert {(r.node, r.component) for r in clusters.components(edges).collect()} == want | {(7, 7)}
    assert connected_components(edges.limit(0)).count() == 0


def test_equal_scores_are_all_assigned(spark):
    from medialake.operators.linkage import assign_greedily

    left = spark.range(500).select(F.col("id").alias("ref"))
    right = spark.range(1_000, 1_500).select(F.col("id").alias("partner"))
    scored = left.join(right, F.lit(True)).select("ref", "partner", F.lit(1.0).alias("score"))
    assert {tuple(r) for r in assign_greedily(scored).collect()} == {(i, 1_000 + i, 1.0) for i in range(500)}


def test_alignment_takes_the_delay_of_whole_signals(spark, sf):
    import numpy as np

    from medialake.queries import signals

    pairs = {r.vec_id: np.correlate(np.array(r.w), np.array(r.v), "full") for r in signals._pairs(spark, sf).collect()}
    got = {r.vec_id: r.lag for r in signals.sig12_alignment(spark, sf).collect()}
    assert set(got) == set(pairs) and any(abs(lag) > 11 for lag in got.values())
    assert all(pairs[i][63 + lag] >= pairs[i].max() - 1e-9 for i, lag in got.items())


def test_banded_pairs_equal_all_pairs_of_a_user(spark, sf):
    from medialake.queries.matching import jon04_greedy

    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_type", "event_id", "value")
    a = e.where("event_type = 'click'").selectExpr("user_id", "event_id as ref", "value as va")
    b = e.where("event_type = 'view'").selectExpr("user_id", "event_id as partner", "value as vb")
    scored = a.join(b, "user_id").selectExpr("ref", "partner", "1 / (1 + abs(va - vb)) as score").where("score >= 0.5")
    want = {tuple(r) for r in linkage.assign_greedily(scored).select("ref", "partner", "score").collect()}
    assert want and {tuple(r) for r in jon04_greedy(spark, sf).select("ref", "partner", "score").collect()} == want
