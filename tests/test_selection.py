"""Exact order statistics against sorting."""

import random

from pyspark.sql import functions as F

from medialake.operators import selection as S
from medialake.operators.facets import continuous


def middle(values):
    s = sorted(values)
    return (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2


def test_medians_of_skewed_groups_in_rounds(spark, monkeypatch):
    """With room for 40 values, every kind of group takes rounds: spread, heavy ties, two values, wild magnitudes, one value."""
    monkeypatch.setattr(S, "FEW", 40)
    rng = random.Random(4)
    groups = {
        "spread": [rng.gauss(0, 1) for _ in range(9001)], "ties": [1.0] * 3000 + [2.0] * 2999 + [rng.random() for _ in range(500)], "two": [0.0] * 500 + [7.5] * 500,
        "wild": [10.0 ** rng.uniform(-300, 300) * rng.choice((-1, 1)) for _ in range(4000)], "one": [3.0], "even": [float(i) for i in range(5000)], "same": [4.25] * 2000,
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [(None, 1.0), (None, 2.0), ("spread", None), ("nothing", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r["median"] for r in S.medians(df, "v", ["g"]).collect()}
    assert got == {**{g: middle(v) for g, v in groups.items()}, None: 1.5}
    ends = {r.g: (r.least, r.most, r.p90) for r in S.order_statistics(df, "v", ["g"], {"least": F.lit(0), "most": F.col("n") - 1, "p90": F.floor(F.col("n") * 0.9)}).collect()}
    for g, v in groups.items():
        assert ends[g] == (min(v), max(v), sorted(v)[int(len(v) * 0.9)])


def test_continuous_keeps_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", None), (None, 3.0), (None, float("nan"))], "g string, v double")
    got = {r.g: (r.n, r.total, r["median"]) for r in continuous(df, "v", ["g"]).collect()}
    assert got["a"] == (2, 5.0, 2.5) and got["b"] == (0, None, None) and got[None][0] == 2 and str(got[None][2]) == "nan"
    assert continuous(df.limit(0), "v", ["g"]).count() == 0
    assert S.medians(df.where("v < 5"), "v", []).first()["median"] == 3.0


def test_rows_of_large_groups_are_not_shuffled_by_group(spark, monkeypatch):
    """Both joins with the bounds of a round bring these to the rows, also where Spark would not broadcast by itself."""
    monkeypatch.setattr(S, "FEW", 40)
    plans, write = [], S.staged
    monkeypatch.setattr(S, "staged", lambda df, label: (plans.append((label, df._jdf.queryExecution().optimizedPlan().toString())), write(df, label))[1])
    df = spark.range(3_000).selectExpr("id % 2 AS g", "cast(id * 7919 % 3001 AS double) AS v")
    S.medians(df, "v", ["g"]).collect()
    counted = [p for label, p in plans if label == "rank-counted"]
    assert counted and all(line.count("strategy=broadcast") == 1 for p in counted for line in p.splitlines() if "Join " in line)
