"""A quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are labelled good documents; the unlabelled set is web text as it comes, good and bad mixed. The share of
good text in it (the class prior) is estimated first: a plain positive-against-unlabelled model is fitted, and over the
score thresholds the least ratio of the unlabelled share above a threshold to the positive share, with a confidence margin,
is taken (the best bin: where the unlabelled tail holds almost only positives). Then an additive model of binned text
features minimises prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)); where the bracket would be negative its gradient is
reversed, so the model cannot gain by memorising positives as not negative. With the logistic loss the output is an estimate
of the probability of good text.

Fit on a bounded sample, chosen by a hash of the id: FIT_POSITIVES positives and FIT_UNLABELLED unlabelled rows, all of the
learning split; only their features (a dozen numbers a row) reach the driver. Features are measured on the whole text; labels,
lang, source and doc_id are not among them.

Defined cases: null and empty texts get the features of an empty text and a score; labels that are null or belong to no
document are ignored; a document with several labels counts as positive if any is; without positives every score is 0.5; rows that repeat a doc_id
are each scored, and equal texts get equal scores; a score equal to the threshold counts as good; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import split_of, table

FIT_POSITIVES = 12_000
FIT_UNLABELLED = 24_000
BINS = 16
THRESHOLD = 0.3

FEATURES = (
    "log_words", "distinct_words", "log_distinct", "repeated_next", "commonest_word", "distinct_trigrams", "upper_case", "marks", "digits",
    "word_length", "word_length_spread", "distinct_lines", "line_length", "odd_endings", "longest_word", "outside_ascii",
)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_MARK = ~(_LETTER | _DIGIT | _GAP)
_ODD = _MARK.copy()
_ODD[[ord(","), ord(".")]] = False
_LINE = np.zeros(256, bool)
_LINE[10] = True


def features(column: pa.Array) -> np.ndarray:
    """(rows, FEATURES) of a column of texts."""
    data, offsets = K.text_bytes(column)
    n_bytes = np.diff(offsets)
    n = len(n_bytes)

    def per_row(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    starts, ends, rows = K.word_bounds(data, offsets)
    words = K.hash_runs(data, starts, ends)
    length = (ends - starts).astype(float)
    tri, tri_rows = K.shingle_hashes(words, rows, 3)
    first, last, lines = K.word_bounds(data, offsets, _LINE)
    line = K.hash_runs(data, first, last)
    letters, upper, marks, digits, wide = (per_row(t[data]) for t in (_LETTER, _UPPER, _MARK, _DIGIT, np.arange(256) > 127))
    odd = _ODD[data[ends - 1]] if len(ends) else np.zeros(0, bool)
    out = np.zeros((n, len(FEATURES)))
    for r in range(n):
        a, b = rows[r], rows[r + 1]
        size = b - a
        if not size:
            continue
        own, sizes = words[a:b], length[a:b]
        _, counts = np.unique(own, return_counts=True)
        tris = tri[tri_rows[r] : tri_rows[r + 1]]
        own_lines = line[lines[r] : lines[r + 1]]
        mean = sizes.mean()
        out[r] = (
            np.log1p(size), len(counts) / size, np.log1p(len(counts)) / np.log1p(size), (own[1:] == own[:-1]).mean() if size > 1 else 0.0,
            counts.max() / size, len(np.unique(tris)) / len(tris), upper[r] / max(1.0, letters[r]), marks[r] / n_bytes[r], digits[r] / n_bytes[r],
            mean, sizes.std() / mean, len(np.unique(own_lines)) / max(1, len(own_lines)), np.log1p(size / max(1, len(own_lines))), odd[a:b].mean(),
            np.log1p(sizes.max()), wide[r] / n_bytes[r],
        )
    return out


class Model:
    """An additive model over quantile bins of the features."""

    def __init__(self, cuts: list[np.ndarray], weights: np.ndarray, bias: float) -> None:
        self.cuts, self.weights, self.bias = cuts, weights, bias

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], axis=1)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        return self.bias + self.weights[np.arange(len(self.cuts)), bins].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.bins(x)), -30, 30)))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def risk_gradient(model: Model, p: np.ndarray, u: np.ndarray, prior: float | None) -> tuple[np.ndarray, bool]:
    """The gradient by weights and bias, and whether the correction fired: the part of the negatives was below 0 and is climbed."""
    k = len(model.cuts)
    cells = np.arange(k) * model.weights.shape[1]

    def gradient(bins: np.ndarray, per_row: np.ndarray) -> np.ndarray:
        out = np.bincount((bins + cells).ravel(), np.repeat(per_row, k), model.weights.size)
        return np.append(out, per_row.sum())

    zp, zu = model.margin(p), model.margin(u)
    sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
    if prior is None:
        return gradient(p, (sp - 1) / len(p)) + gradient(u, su / len(u)), False
    bracket = gradient(u, su / len(u)) - prior * gradient(p, sp / len(p))
    if _softplus(zu).mean() - prior * _softplus(zp).mean() < 0:
        return -bracket, True
    return prior * gradient(p, (sp - 1) / len(p)) + bracket, False


def _descend(model: Model, p: np.ndarray, u: np.ndarray, prior: float | None, steps: int, rate: float = 0.05, decay: float = 5e-4) -> Model:
    """Minimise the non-negative risk (with a prior) or the plain positive-against-unlabelled risk (without)."""
    first, second = np.zeros(model.weights.size + 1), np.zeros(model.weights.size + 1)
    for step in range(1, steps + 1):
        g, _ = risk_gradient(model, p, u, prior)
        g[:-1] += decay * model.weights.ravel()
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        model.weights -= move[:-1].reshape(model.weights.shape)
        model.bias -= move[-1]
    return model


def class_prior(scores_p: np.ndarray, scores_u: np.ndarray, doubt: float = 0.1) -> float:
    """The least ratio of unlabelled to positive share above a threshold, each with its margin at confidence 1 - doubt."""
    cut = np.unique(np.quantile(scores_p, np.linspace(0.02, 0.98, 97)))
    tail = lambda s: 1 - np.searchsorted(np.sort(s), cut, "left") / len(s)
    margin = lambda s: np.sqrt(np.log(4 / doubt) / (2 * len(s)))
    p, u = tail(scores_p), tail(scores_u)
    usable = p > 2 * margin(scores_p)
    upper = np.where(usable, (u + margin(scores_u)) / np.maximum(p - margin(scores_p), 1e-9), np.inf)
    return float(np.clip(upper.min(initial=np.inf), 0.05, 0.98))


def train(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """A model from feature rows of trusted positives and of unlabelled text."""
    both = np.concatenate([positive, unlabelled]) if len(positive) else unlabelled
    cuts = [np.unique(np.quantile(both[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(both) else np.zeros(0) for j in range(len(FEATURES))]
    fresh = lambda: Model(cuts, np.zeros((len(FEATURES), BINS + 1)), 0.0)
    model = fresh()
    if not len(positive) or not len(unlabelled):
        return model
    p, u = model.bins(positive), model.bins(unlabelled)
    plain = _descend(model, p, u, None, 200)
    prior = class_prior(plain.margin(p), plain.margin(u))
    return _descend(fresh(), p, u, prior, 400)


def _measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches):
        for piece in K.blocks(batches, "text"):
            x = features(piece.column(piece.schema.get_field_index("text")))
            kept = [piece.column(piece.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(list(x), pa.list_(pa.float64()))], [*keep, "x"])

    return docs.select(*keep, "text").mapInArrow(run, f"{fields}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, positives: int = FIT_POSITIVES, unlabelled: int = FIT_UNLABELLED) -> Model:
    """Learn from rows where learn (a condition on doc_id) holds; labels has doc_id and quality."""
    draw = lambda salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000))
    good = labels.where(learn & (F.col("quality") == 1)).select("doc_id").distinct()
    n_good, n_all = good.count(), docs.where(learn).count()
    if not n_good or not n_all:
        return train(np.zeros((0, len(FEATURES))), np.zeros((0, len(FEATURES))))
    trusted = good.where(draw("trusted") < 1_000_000 * min(1.0, positives / n_good)).withColumn("trusted", F.lit(True))
    drawn = docs.where(learn).select("doc_id", "text", (draw("web") < 1_000_000 * min(1.0, unlabelled / n_all)).alias("web"))
    drawn = drawn.join(F.broadcast(trusted), "doc_id", "left").where("web or trusted")  # at most about `positives` ids
    rows = _measured(drawn.withColumn("trusted", F.coalesce("trusted", F.lit(False))), ["web", "trusted"]).toPandas()
    x = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, len(FEATURES)))
    return train(x[rows["trusted"].to_numpy(bool)], x[rows["web"].to_numpy(bool)])


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """docs' columns keep with score."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches):
        for piece in K.blocks(batches, "text"):
            s = model.score(features(piece.column(piece.schema.get_field_index("text"))))
            yield pa.RecordBatch.from_arrays([*(piece.column(piece.schema.get_field_index(c)) for c in keep), pa.array(s)], [*keep, "score"])

    return docs.select(*keep, "text").mapInArrow(run, f"{fields}, score double")


def op3_quality(spark, sf_dir):
    split = split_of("doc_id", 5)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), split != 0)
    scored = score(docs.withColumn("held_out", split == 0), model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
