import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from medialake.llm import nearest as N


def brute(rows, top=20, by=20):
    """Every usable row against every query, in plain Python."""
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = min(good.get(i, v), v)
    out = {}
    for q, a in good.items():
        if q % by == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good.items() if i != q and len(a) == len(b))
            out[q] = [(i, -s) for s, i in scored[:top]]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for rows in out.values():
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
        assert [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows)
    return {q: [(i, s) for _, i, s in rows] for q, rows in out.items()}


def share(got, want):
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in rows}) for q, rows in want.items())
    return hits / sum(map(len, want.values()))


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def exact(rows, asking, top=20):
    """Every row against every query."""
    blocks = asking.select("vec_id", "v").toPandas()

    def run(batches):
        asked_ids, asked = blocks["vec_id"].to_numpy(), np.array(blocks["v"].tolist(), np.float64)
        for batch in batches:
            ids, v = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), np.float64)
            for query, vector in zip(asked_ids, asked):
                score = N.products(v, np.broadcast_to(vector, v.shape))
                score = np.where(ids == query, -np.inf, score)
                by = np.lexsort((ids, -score))[:top]
                by = by[np.isfinite(score[by])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(by), query)), pa.array(ids[by]), pa.array(score[by])], ["query_id", "vec_id", "score"])

    found = rows.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def test_the_given_table(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = answers(N.op12_nearest(spark, sf)), brute(rows)
    assert set(got) == set(want) and share(got, want) >= 0.95
    vectors = dict(rows)
    for q, found in got.items():
        assert len(found) == 20 and all(i != q for i, _ in found)
        for i, s in found:
            assert s == pytest.approx(sum(x * y for x, y in zip(vectors[q], vectors[i])), abs=1e-12)


def test_recall_over_shards_with_clusters_and_uneven_norms(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 48))
    spread = np.concatenate([rng.normal(size=(3000, 48)), centres[rng.integers(0, 12, 3000)] + 0.05 * rng.normal(size=(3000, 48))])
    spread *= rng.lognormal(0, 0.5, size=(6000, 1))
    rows = N.usable(frame(spark, [(i, [float(x) for x in v]) for i, v in enumerate(spread.astype(np.float32))]))
    index = N.build_index(N.candidates(rows), 1500)
    assert index.count() == 4
    asking = rows.where("vec_id % 20 = 0")
    assert N.recall(N.search(index, asking), exact(rows, asking)) >= 0.95


def test_a_vector_of_a_third_of_all_rows(spark):
    rng = random.Random(3)
    hot = [0.5] * 8
    rows = [(i, hot if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(8)]) for i in range(3000)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    data = frame(spark, rows)
    assert N.candidates(N.usable(data)).count() == 2000 + 21
    got, want = answers(N.nearest(data, shard_rows=500)), brute(rows)
    assert share(got, want) >= 0.97
    for q in (0, 60, 2940):
        assert got[q] == want[q]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (None, [1.0, 1.0]), (20, [1.0, 0.0]),
            (20, [1.0, 0.0]), (40, [3.0, 1.0]), (40, [-1.0, 2.0]), (60, [1.0, 2.0, 3.0]), (80, [2.0, 0.0, 1.0]), (100, [9.0])]
    data = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<float>, rank string, score double")
    got, want = answers(N.nearest(data)), {q: r for q, r in brute(rows).items() if r}
    assert got == want and set(got) == {0, 20, 40, 60, 80}
    assert N.nearest(data.limit(0)).count() == 0
    assert N.nearest(data.where("vec_id = 0")).count() == 0
    doubles = spark.createDataFrame([(0, [0.1, 0.2]), (1, [0.3, 0.4])], "vec_id long, embedding array<double>")
    assert answers(N.nearest(doubles)) == {0: [(1, 0.1 * 0.3 + 0.2 * 0.4)]}
