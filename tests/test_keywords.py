"""The keyword dictionary against the compiled matcher and against brute force with very many keywords."""

import random

from pyspark.sql import functions as F

from medialake.operators.keywords import spellings, with_category
from medialake.plans.dictionary import CATEGORIES
from medialake.plans.rules import best_category

MIXED = [
    {"name": "A", "keywords": "bolt, ring, rod"}, {"name": "B", "keywords": "small ring,widget, ,"}, {"name": "C", "keywords": "anv,ing", "matchMode": "contains"},
    {"name": "D", "keywords": "anvil", "enabled": False}, {"name": "E", "keywords": "berry,box,808"}, {"name": "F", "keywords": "éa", "matchMode": "contains"},
]


def _same(spark, names, categories):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, name string")
    best = best_category(F.coalesce("name", F.lit("")), categories)
    labels = F.array(*[F.lit(c["name"]) for c in categories])
    want = df.select("id", F.try_element_at(labels, best["category"] + 1).alias("category"), best["keyword"].alias("keyword"))
    got = with_category(df, "name", categories).select("id", "category", "keyword")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    return got


def test_equals_the_compiled_matcher(spark):
    rnd = random.Random(4)
    words = ["small", "Ring", "RINGS", "bolts", "Anvil", "anvils", "rod", "widgetX", "boxes", "berries", "808", "TR808", "ing", "XÉA", "", "small_ring", "smallRing", "hats", "Kick2", "violas"]
    names = [None, "", " ", *words, *(rnd.choice(" _-").join(rnd.choices(words, k=rnd.randint(1, 5))) for _ in range(300)), "ring " * 5000]
    got = _same(spark, names, MIXED)
    assert got.where("keyword is not null").count() > 100
    _same(spark, names, CATEGORIES)
    _same(spark, names, [])


def test_ten_thousand_keywords_in_one_pass(spark):
    rnd = random.Random(5)
    keywords = list(dict.fromkeys("".join(rnd.choices("abcde", k=rnd.randint(4, 9))) + "q" for _ in range(10_000)))
    half = len(keywords) // 2
    categories = [{"name": f"C{i}", "keywords": ",".join(keywords[i:half:7])} for i in range(7)] + [{"name": "in", "keywords": ",".join(keywords[half:]), "matchMode": "contains"}]
    names = [" ".join("".join(rnd.choices("abcdeq", k=rnd.randint(3, 14))) for _ in range(6)) for _ in range(200)] + [f"x {k} y" for k in keywords[:50]]
    entries = spellings(categories)
    want = {}
    for n in names:
        found = [e[2:] for e in entries if (e[0] in n.split() if e[1] else e[0] in n) or (e[1] and any(" ".join(n.split()[i : i + k]) == e[0] for k in (2, 3) for i in range(6)))]
        want[n] = max(found)[2:] if found else (None, None)
    df = spark.createDataFrame([(n, "kept") for n in names], "name string, keyword string")
    out = with_category(df, "name", categories)
    assert sorted(out.columns) == ["category", "keyword", "name"]
    assert {r.name: (r.category, r.keyword) for r in out.collect()} == want
    assert sum(v[0] is not None for v in want.values()) > 60
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "kick"), (1, "kick"), (2, None)], "id long, name string")
    assert sorted((r.id, r.category) for r in with_category(df, "name", CATEGORIES).collect() if r.category) == [(1, "Drums"), (1, "Drums")]
    assert with_category(df, "name", CATEGORIES).count() == 3 and with_category(df.limit(0), "name", CATEGORIES).count() == 0
