import numpy as np
from pyspark.sql import functions as F

from medialake.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1
    n1, n0 = (label == 1).sum(), (label == 0).sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.op3_quality(spark, SF).where("held_out").join(labels, "doc_id").toPandas()
    assert auc(rows["score"].to_numpy(), rows["quality"].to_numpy()) > 0.95
    assert (rows["predicted"] == rows["quality"]).mean() > 0.9


def test_quality_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (4, 1), (4, 0), (10, 1), (99, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(edge_docs, labels, F.lit(True))
    scores = [r.score for r in quality.score(edge_docs, model, ["doc_id"]).collect()]
    assert len(scores) == edge_docs.count() and all(0 <= s <= 1 for s in scores)
    assert quality.score(no_docs, model, ["doc_id"]).count() == 0
    blank = quality.fit(no_docs, labels.limit(0), F.lit(True))
    assert {r.score for r in quality.score(edge_docs, blank, ["doc_id"]).collect()} == {0.5}


def test_prior_is_found():
    rng = np.random.default_rng(0)
    positive, negative = rng.normal(2, 1, 4_000), rng.normal(-2, 1, 1_500)
    prior = quality.class_prior(positive[:2_000], np.concatenate([positive[2_000:], negative]))
    assert 0.5 < prior < 0.68


def test_risk_gradient_equals_differences_of_the_risk():
    rng = np.random.default_rng(1)
    cuts = [np.array([0.0]), np.array([-1.0, 1.0])]
    p, u, prior = rng.integers(0, 2, (30, 2)), rng.integers(0, 2, (50, 2)), 0.4

    def parts(weights, bias):
        loss = lambda rows, sign: sum(np.log1p(np.exp(-sign * (bias + weights[0, r[0]] + weights[1, r[1]]))) for r in rows) / len(rows)
        return prior * loss(p, 1), loss(u, -1) - prior * loss(p, -1)

    fired = set()
    for bias in (0.0, 1.0):
        for lift in (0.0, 3.0):
            weights = rng.normal(size=(2, 3)) * 0.3
            weights[0, 0] -= lift * 4 * bias
            q = p if not lift else np.column_stack([np.ones(30, int), p[:, 1]])
            v = u if not lift else np.column_stack([np.zeros(50, int), u[:, 1]])
            p_old, u_old = p, u
            p, u = q, v
            got, corrected = quality.risk_gradient(quality.Model(cuts, weights, bias), p, u, prior)
            fired.add(corrected)
            assert corrected == (parts(weights, bias)[1] < 0)
            goal = lambda w, b: -parts(w, b)[1] if corrected else sum(parts(w, b))  # noqa: B023, E731
            want, step = [], 1e-5
            for i in range(6):
                d = np.zeros(6)
                d[i] = step
                d = d.reshape(2, 3)
                want.append((goal(weights + d, bias) - goal(weights - d, bias)) / (2 * step))
            want.append((goal(weights, bias + step) - goal(weights, bias - step)) / (2 * step))
            assert np.allclose(got, want, atol=1e-6)
            p, u = p_old, u_old
    assert fired == {False, True}


def test_toxicity_gradient_equals_differences_of_the_noisy_or():
    rng = np.random.default_rng(2)
    docs = [[[0, 1], [2]], [[1], [], [3, 0]], [[2, 3]], [[], []]]  # features by sentence
    y = np.array([1.0, 0.0, 1.0, 0.0])
    w, bias, decay = rng.normal(size=4), -1.5, 0.01
    doc, feat, sent, plain = [], [], [], np.zeros(4)
    for d, sentences in enumerate(docs):
        for features in sentences:
            if features:
                feat += features
                sent += [len(doc)] * len(features)
                doc.append(d)
            else:
                plain[d] += 1

    def goal(w, bias):
        total = 0.0
        for label, sentences in zip(y, docs):
            clean = np.prod([1 - 1 / (1 + np.exp(-(bias + sum(w[f] for f in s)))) for s in sentences])
            total -= np.log(1 - clean) if label else np.log(clean)
        return total / len(y) + decay / 2 * (w**2).sum()

    got = toxicity.likelihood_gradient(w, bias, y, plain, np.array(doc), np.array(feat), np.array(sent), decay)
    step = 1e-6
    want = [(goal(w + e, bias) - goal(w - e, bias)) / (2 * step) for e in np.eye(4) * step] + [(goal(w, bias + step) - goal(w, bias - step)) / (2 * step)]
    assert np.allclose(got, want, atol=1e-6)


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.op5_toxicity(spark, SF).where("held_out").join(labels, "doc_id").toPandas()
    assert auc(rows["score"].to_numpy(), rows["toxic"].to_numpy()) > 0.8
    assert rows[rows["toxic"] == 0]["predicted"].mean() < 0.02


def test_toxicity_edges_and_spans(spark, edge_docs, no_docs):
    bad = [(100 + i, f"A calm line number {i}. You utter nitwit number {i}! Good bye {i}.") for i in range(40)]
    good = [(200 + i, f"A calm line number {i}. Good bye {i}.") for i in range(80)]
    docs = spark.createDataFrame(bad + good, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in bad] + [(i, 0) for i, _ in good] + [(200, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    score, spans = model.score("Hello there. You utter nitwit! Bye.")
    assert score > 0.7 and [("Hello there. You utter nitwit! Bye."[a:b]).strip() for a, b in spans] == ["You utter nitwit!"]
    assert model.score("Hello there. Bye.")[0] < 0.3
    got = {r.doc_id: r.score for r in toxicity.score(edge_docs, model, ["doc_id"]).collect()}
    assert got[1] == got[2] == 0 and all(0 <= s <= 1 for s in got.values())
    assert toxicity.score(no_docs, model, ["doc_id"]).count() == 0
    nothing = toxicity.fit(docs, labels.where("toxic = 0"), F.lit(True))
    assert nothing.score("nitwit")[0] == 0
