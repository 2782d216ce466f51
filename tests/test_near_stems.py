"""Near stems by blocking against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from medialake.operators import near_stems as N
from medialake.operators.clusters import components


def rms(x):
    return math.sqrt(sum(v * v for v in x) / len(x))


def brute(stems, threshold):
    out = set()
    for i, (song, a, x) in enumerate(stems):
        for other, b, y in stems[i + 1 :]:
            n = min(len(x), len(y))
            if song == other and n and rms([p - q for p, q in zip(x[:n], y[:n])]) / max(rms(x[:n]), rms(y[:n]), 1e-12) < threshold:
                out.add((min(a, b), max(a, b)))
    return out


def frame(spark, stems):
    return spark.createDataFrame(stems, "song string, id long, v array<double>")


@pytest.mark.parametrize("threshold", [0.05, 0.3])
def test_equals_all_pairs(spark, threshold):
    rng = random.Random(7)
    base = [[rng.gauss(0, 1) * 10 ** rng.uniform(-3, 2) for _ in range(24)] for _ in range(12)]
    stems = []
    for i in range(240):
        x = rng.choice(base)
        spread = threshold * rng.choice((0.2, 0.9, 1.0, 1.1, 3)) * rms(x)
        y = [v * rng.choice((1, 1 - threshold / 3)) + rng.gauss(0, 1) * spread for v in x]
        stems.append((f"s{i % 3}", i, y[: rng.choice((24, 24, 24, 17))]))
    stems += [("s0", 1000, [0.0] * 24), ("s0", 1001, [0.0] * 24), ("s0", 1002, [1e-14] * 24), ("s0", 1003, []), ("s1", 1004, [0.0] * 17)]
    want = brute(stems, threshold)
    assert len(want) > 50
    assert {(r.a, r.b) for r in N.near_pairs(frame(spark, stems), threshold).collect()} == want


def test_components_of_copies_and_near_stems(spark):
    rng = random.Random(2)
    x, y = ([rng.gauss(0, 1) for _ in range(32)] for _ in range(2))
    near = [v * 1.01 for v in x]
    stems = [("s", i, x if i % 3 else near) for i in range(300)] + [("s", 999, y), ("t", 1000, x), ("s", 1001, [])]
    links = N.near_links(frame(spark, stems))
    assert links.count() == 299
    parts = {r.node: r.component for r in components(links).collect()}
    assert parts == {i: 0 for i in range(300)}


def test_candidates_of_one_large_song_are_few(spark):
    """Stems with a near copy each in one song: what meets grows with the stems, not with their square."""
    rng = random.Random(5)
    stems = []
    for i in range(600):
        x = [rng.gauss(0, 1) for _ in range(64)]
        stems += [("one", 2 * i, x), ("one", 2 * i + 1, [v + rng.gauss(0, 0.01) for v in x])]
    assert {(r.a, r.b) for r in N.near_pairs(frame(spark, stems)).collect()} == {(2 * i, 2 * i + 1) for i in range(600)}
    assert N.candidates(frame(spark, stems), 0.05).count() < 2_000  # of 719,400 pairs


def test_threshold_and_empty(spark):
    with pytest.raises(ValueError):
        N.near_pairs(frame(spark, [("a", 1, [1.0])]), 1.3)
    assert N.near_pairs(frame(spark, []).where(F.lit(True))).count() == 0


def test_stems_are_asked_for_in_few_cells(spark):
    """The cells that a ball touches, in two bands: 42 a stem or so, where all neighbours in three bands were 96; also where norms go
    beyond single precision."""
    rng = random.Random(9)
    stems = [("one", i, [rng.gauss(0, 10.0 ** (i % 7 - 3)) for _ in range(64)]) for i in range(300)]
    wide = [("one", 1000 + i, [1e100 * (1 + i / 100)] * 20) for i in range(8)]
    assert N.asked_cells(N.described(frame(spark, stems)), 0.05).count() < 50 * len(stems)
    assert {(r.a, r.b) for r in N.near_pairs(frame(spark, stems + wide)).collect()} == brute(stems + wide, 0.05) != set()
