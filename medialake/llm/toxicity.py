"""Toxicity by multiple-instance learning: sentences scored one by one, combined by noisy-or, trained from document labels.

A document is a bag of sentences. A sentence's probability is sigmoid(bias + weights of its words); a document is toxic if any
sentence is, so its probability is 1 - prod(1 - p_sentence). Only documents carry labels; the noisy-or's gradient finds the
sentences that explain them. The same sentence scores then locate the offending sentences.

A word's weight is the sum of the weights of its features: the word itself and its prefixes of 3 to 6 letters (inflected
and derived forms share prefixes). Fit on a bounded sample: at most about FIT_TOXIC toxic and FIT_CLEAN clean documents of
the learning split, chosen by a hash of the id. Spark counts in how many of them each feature occurs, by label; the
VOCABULARY features with the strongest association with toxic documents, seen in at least MIN_DOCS of them, are kept, and
only their places in the sample reach the driver.

Defined cases: null and empty texts have no sentence and score 0; null labels are ignored; a document with several labels
counts as toxic if any is; without toxic or without clean examples every score is 0; rows that repeat a doc_id are each scored,
and equal texts get equal scores; of features with an equal association the alphabetically first is kept; a score equal to the
threshold counts as toxic; an empty table gives no rows. Texts are taken whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import split_of, table

FIT_TOXIC = 8_000
FIT_CLEAN = 16_000
VOCABULARY = 4_096
MIN_DOCS = 5
THRESHOLD = 0.7
CACHED = 400_000
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


def word_features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in range(3, min(6, len(word)) + 1))]


def _labelled(docs: DataFrame, labels: DataFrame, learn: Column, toxic: int, clean: int) -> DataFrame:
    """(y, text) of the sample; its ids, at most about toxic + clean, are broadcast."""
    marked = labels.where(learn & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    n = {r[0]: r[1] for r in marked.groupBy("y").count().collect()}
    share = F.when(F.col("y") == 1, min(1.0, toxic / n.get(1, 1))).otherwise(min(1.0, clean / n.get(0, 1)))
    chosen = marked.where(F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1_000_000)) < share * 1_000_000)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("y", "text")


def feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, toxic, clean): in how many documents of each label a feature occurs."""

    def run(batches):
        for batch in batches:
            found: dict[str, list[int]] = {}
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(_WORD.findall((text or "").lower()))
                for f in {f for w in words for f in word_features(w)}:
                    found.setdefault(f, [0, 0])[0 if y == 1 else 1] += 1
            if found:
                toxic, clean = zip(*found.values())
                yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(toxic, pa.int64()), pa.array(clean, pa.int64())], ["feature", "toxic", "clean"])

    counts = sample.mapInArrow(run, "feature string, toxic long, clean long")
    return counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


class Model:
    """Weights of the features and the bias of a sentence."""

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias = weights, bias
        self.words: dict[str, float] = {}

    def word(self, word: str) -> float:
        out = self.words.get(word)
        if out is None:
            out = sum(self.weights.get(f, 0.0) for f in word_features(word))
            if len(self.words) < CACHED:
                self.words[word] = out
        return out

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, probability) of every sentence."""
        out = []
        for m in _SENTENCE.finditer(text):
            z = self.bias + sum(map(self.word, set(_WORD.findall(m[0].lower()))))
            out.append((m.start(), m.end(), float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))))
        return out

    def score(self, text: str, above: float = 0.5) -> tuple[float, list[tuple[int, int]]]:
        """The noisy-or over the sentences, and the spans of the offending ones."""
        if not self.weights:
            return 0.0, []
        found = self.sentences(text)
        clean = np.log1p(-np.minimum([p for *_, p in found], 1 - 1e-12)).sum() if found else 0.0
        return float(1 - np.exp(clean)), [(a, b) for a, b, p in found if p >= above]


def _bags(sample: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(y, n_sentences, sentence, feature): per document the places of vocabulary features."""
    shared = sample.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(vocabulary)})

    def run(batches):
        place = shared.value
        for batch in batches:
            rows = []
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = [set(_WORD.findall(m.lower())) for m in _SENTENCE.findall(text or "")]
                hits = [(k, place[f]) for k, words in enumerate(parts) for w in words for f in word_features(w) if f in place]
                rows.append((int(y == 1), len(parts), [k for k, _ in hits], [f for _, f in hits]))
            if rows:
                y, n, s, f = zip(*rows)
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(n), pa.array(s, ints), pa.array(f, ints)], ["y", "n", "sentence", "feature"])

    return sample.mapInArrow(run, "y long, n long, sentence array<int>, feature array<int>")


def likelihood_gradient(w: np.ndarray, bias: float, y, plain, doc, feat, sent, decay: float) -> np.ndarray:
    """The gradient, by weights and bias, of the mean negative log likelihood of the noisy-or plus decay / 2 * |w|^2.

    doc is the document of each sentence that has features, plain the count of each document's other sentences; feature feat[i]
    occurs in sentence sent[i].
    """
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    z = bias + np.bincount(sent, w[feat], len(doc))
    u = np.bincount(doc, np.logaddexp(0, z), len(y)) + plain * np.logaddexp(0, bias) + 1e-9
    du = np.where(y == 1, -np.exp(-u) / -np.expm1(-u), 1.0) / len(y)
    dz = du[doc] * sigmoid(z)
    return np.append(np.bincount(feat, dz[sent], len(w)) + decay * w, dz.sum() + (du * plain).sum() * sigmoid(bias))


def train(bags, vocabulary: list[str], steps: int = 400, rate: float = 0.05, decay: float = 8e-5) -> Model:
    """Fit weights and bias by Adam on the noisy-or likelihood; bags is a list of (y, n, sentence, feature)."""
    y = np.array([b[0] for b in bags], float)
    if not len(y) or y.min() == y.max():
        return Model({}, 0.0)
    total = np.array([b[1] for b in bags], float)
    docs, feats, sents, at = [], [], [], 0
    for d, (_, _, sentence, feature) in enumerate(bags):
        sentence = np.asarray(sentence, np.int64)
        names, inverse = np.unique(sentence, return_inverse=True)
        docs.append(np.full(len(names), d))
        feats.append(np.asarray(feature, np.int64))
        sents.append(inverse + at)
        at += len(names)
    doc, feat, sent = (np.concatenate(x).astype(np.int64) for x in (docs, feats, sents))
    plain = total - np.bincount(doc, minlength=len(y))  # sentences without a feature
    w, bias = np.zeros(len(vocabulary)), -4.0
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        g = likelihood_gradient(w, bias, y, plain, doc, feat, sent, decay)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        bias -= move[-1]
    return Model(dict(zip(vocabulary, w.tolist())), float(bias))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, toxic: int = FIT_TOXIC, clean: int = FIT_CLEAN, vocabulary: int = VOCABULARY) -> Model:
    """Learn from rows where learn (a condition on doc_id) holds; labels has doc_id and toxic."""
    sample = _labelled(docs, labels, learn, toxic, clean)
    counts = feature_counts(sample).where(F.col("toxic") >= MIN_DOCS)
    # Strength: how far the toxic count stands above the clean rate, in its own spread; a top-k report of the vocabulary.
    ratio = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5))
    strength = ratio * F.sqrt(F.col("toxic"))
    names = [r[0] for r in counts.where(ratio > 0).orderBy(strength.desc(), "feature").limit(vocabulary).select("feature").collect()]
    bags = [(r[0], r[1], r[2], r[3]) for r in _bags(sample, names).toLocalIterator()] if names else []
    return train(bags, names)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """docs' columns keep with score and offending: the spans start:end of offending sentences, comma-joined."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches):
        own = Model(*shared.value)
        for piece in K.blocks(batches, "text"):
            found = [own.score(t or "") for t in piece.column(piece.schema.get_field_index("text")).to_pylist()]
            spans = [",".join(f"{a}:{b}" for a, b in s) for _, s in found]
            kept = [piece.column(piece.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([s for s, _ in found], pa.float64()), pa.array(spans, pa.string())], [*keep, "score", "offending"])

    return docs.select(*keep, "text").mapInArrow(run, f"{fields}, score double, offending string")


def op5_toxicity(spark, sf_dir):
    split = split_of("doc_id", 3)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), split != 1)
    scored = score(docs.withColumn("held_out", split == 1), model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
