"""Language identification by language-bitmask n-gram filters.

One Bloom filter serves all languages: every slot holds a mask with a bit for each language, so the filter is cut into one
bit slice a language. An n-gram's slots are combined with AND, which yields in one step the mask of all languages that
contain it. A document's popcount for a language is the number of its n-grams that have that language's bit. With n n-grams
and a slice whose false positive rate is r (its share of set bits to the power of the hash functions), a popcount c stands
for (c - n * r) / (1 - r) true members; the language with the largest corrected count is predicted.

Fit: labelled documents of the learning split, at most FIT_ROWS a language, chosen by a hash of their id; their n-grams are
counted by Spark, and an n-gram enters a language's slice when at least MIN_SHARE of that language's sample has it.
n-grams are the 3- and 4-character windows of lower-cased words, with a mark at each end of a word.

Defined cases: null text, or text without a letter (Unicode category L), gives "und" and score 0. Ties go to the alphabetically
first language; so, with score 0, does text with letters whose n-grams are in no slice, since there all languages tie.
Without labelled rows everything is "und". Rows that repeat a doc_id each come back; other columns are carried or not read.
Texts are taken whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import in_batches, split_of, table

FIT_ROWS = 3_000
MIN_SHARE = 0.01
SLOTS = 1 << 20
HASHES = 3
CACHED = 150_000
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")


def word_grams(word: str) -> set[str]:
    marked = f"_{word}_"
    return {marked[i : i + n] for n in (3, 4) for i in range(len(marked) - n + 1)}


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): in how many of docs each n-gram occurs."""

    def run(batches):
        for batch in batches:
            found: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams: set[str] = set()
                for word in set(_WORD.findall((text or "").lower())):
                    grams |= word_grams(word)
                for g in grams:
                    found[lang, g] = found.get((lang, g), 0) + 1
            if found:
                langs, grams = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(grams), pa.array(list(found.values()), pa.int64())], ["lang", "gram", "n"])
            del batch, found
            K.hand_back()

    return in_batches(docs).select("lang", "text").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class GramFilter:
    """The bit-sliced Bloom filter."""

    def __init__(self, langs: list[str], grams: dict[str, list[str]], slots: int = SLOTS, hashes: int = HASHES) -> None:
        self.langs, self.hashes, self.mask = langs, hashes, np.uint64(slots - 1)
        self.table = np.zeros((slots, max(1, -(-len(langs) // 64))), np.uint64)
        for i, lang in enumerate(langs):
            if grams.get(lang):
                for at in self.places(grams[lang]):
                    self.table[at, i // 64] |= np.uint64(1 << (i % 64))
        bits = np.array([np.count_nonzero(self.table[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(langs))])
        self.false = (bits / slots) ** hashes

    def places(self, grams: list[str]) -> list[np.ndarray]:
        data, offsets = K.text_bytes(pa.array(grams, pa.string()))
        h = K.hash_runs(data, offsets[:-1], offsets[1:])
        step = K.mix(h) | np.uint64(1)
        return [((h + np.uint64(j) * step) & self.mask).astype(np.int64) for j in range(self.hashes)]

    def members(self, grams: list[str]) -> np.ndarray:
        """(n-grams, languages) 0/1: the languages whose slice holds each n-gram, from one AND of masks."""
        masks = self.table[(at := self.places(grams))[0]]
        for more in at[1:]:
            masks = masks & self.table[more]
        i = np.arange(len(self.langs))
        return (masks[:, i // 64] >> (i % 64).astype(np.uint64) & np.uint64(1)).astype(np.int64)


class Detector:
    """Counts a document's n-grams by language; keeps the popcounts of the words it has met, up to CACHED of them."""

    def __init__(self, filt: GramFilter) -> None:
        self.filter, self.words = filt, {}
        self.counts = np.zeros((1024, len(filt.langs) + 1), np.int32)

    def rows(self, words: list[str]) -> np.ndarray:
        """The row of each word in self.counts."""
        found = list(map(self.words.get, words))
        if None in found:
            fresh = list(dict.fromkeys(w for w, i in zip(words, found) if i is None))
            if len(self.words) + len(fresh) > CACHED:
                self.words.clear()
                fresh = list(dict.fromkeys(words))
            grams = [list(word_grams(w)) for w in fresh]
            sizes = np.fromiter(map(len, grams), np.int64, len(grams))
            hits = self.filter.members([g for gs in grams for g in gs])
            start = len(self.words)
            while start + len(fresh) > len(self.counts):
                self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
            bounds = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            self.counts[start : start + len(fresh), :-1] = np.add.reduceat(hits, bounds, axis=0)
            self.counts[start : start + len(fresh), -1] = sizes
            self.words.update(zip(fresh, range(start, start + len(fresh))))
            found = list(map(self.words.get, words))
        return np.array(found, np.int64)

    def detect(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        filt = self.filter
        words = [_WORD.findall(t.lower()) if t else [] for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        some = np.flatnonzero(sizes)
        if not len(some) or not filt.langs:
            return langs, scores
        counts = self.counts_of([w for ws in words for w in ws])
        bounds = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        sums = np.add.reduceat(counts, bounds, axis=0)
        n = sums[:, -1:]
        true = np.maximum(0.0, (sums[:, :-1] - n * filt.false) / (1 - filt.false))
        best = true.argmax(axis=1)
        top, total = true[np.arange(len(some)), best], true.sum(axis=1)
        for k, doc in enumerate(some.tolist()):
            if any(c.isalpha() for w in words[doc] for c in w):  # ends at the first letter
                langs[doc] = filt.langs[best[k]]
                scores[doc] = float(min(1.0, top[k] / total[k])) if top[k] > 0 else 0.0
        return langs, scores

    def counts_of(self, words: list[str]) -> np.ndarray:
        parts = []
        for i in range(0, len(words), CACHED // 2):  # so that the words of a step are in the cache together
            rows = self.rows(words[i : i + CACHED // 2])
            parts.append(self.counts[rows].astype(np.int64))
        return np.concatenate(parts)


def fit(docs: DataFrame, learn: Column, rows: int = FIT_ROWS, min_share: float = MIN_SHARE) -> GramFilter:
    """Learn from the labelled rows of docs where learn holds; per language a sample of about rows of them, by a hash of the id."""
    labelled = docs.where(learn & F.col("lang").isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}  # a row a language
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, rows / n)).otherwise(share)
    drawn = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)) < share * 1_000_000)
    counts = gram_counts(drawn)
    least = F.lit(1.0)
    for lang, n in sizes.items():
        least = F.when(F.col("lang") == lang, max(1.0, min_share * min(rows, n))).otherwise(least)
    grams: dict[str, list[str]] = {}
    for r in counts.where(F.col("n") >= least).select("lang", "gram").toLocalIterator():  # bounded by the sample
        grams.setdefault(r[0], []).append(r[1])
    return GramFilter(sorted(sizes), grams)


def identify(docs: DataFrame, filt: GramFilter, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' columns keep with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast((filt.langs, filt.table, filt.false))
    columns = list(dict.fromkeys([*keep, "text"]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def load():
        bare = GramFilter.__new__(GramFilter)
        bare.langs, bare.table, bare.false = shared.value
        bare.hashes, bare.mask = HASHES, np.uint64(len(bare.table) - 1)
        return bare

    def run(batches):
        detector = Detector(load())
        for piece in K.blocks(batches, "text", 1 << 20):
            langs, scores = detector.detect(piece.column(piece.schema.get_field_index("text")).to_pylist())
            kept = [piece.column(piece.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return in_batches(docs).select(*columns).mapInArrow(run, f"{fields}, lang_pred string, score double")


def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    split = split_of("doc_id", 3)
    filt = fit(docs, split != 1)
    held = docs.select("doc_id", "text", (split == 1).alias("held_out"))
    return identify(held, filt, ("doc_id", "held_out"))
