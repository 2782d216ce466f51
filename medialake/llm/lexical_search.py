"""Ranked lexical search: an inverted index in shards, searched with Block-Max MaxScore, shard heaps merged.

Index. Each task turns the documents that it reads into shards of about SHARD_BYTES of text, so postings are never shuffled. A
shard holds, for each term, blocks of BLOCK postings: document numbers as varbyte deltas, frequencies as varbytes, and the pairs
(frequency, document length) that no other posting of the block beats in both. These pairs bound the block's scores for any
corpus statistics, which are only known when all shards exist; so the texts are read once. One row a shard lists its documents.

Search. A term's weight comes from its document frequency over all shards. Queries are packed in blocks of BLOCK_QUERIES and dealt
to every shard; a task holds one shard at a time and streams over the queries. In each window of WINDOW documents the lists are
ordered by their bound there. Lists whose bounds together stay below the threshold (the least of the K best scores so far) are
not essential: a document that has only these cannot enter. Essential lists are decoded and added up; for the others, from the
greatest bound down, documents that the bounds still allow are looked up: first the bound of their block is asked, and only blocks
that hold a surviving document are decompressed. Each shard gives its K best for every query; a window over a query's rows merges
them. Thresholds go along from shard to shard in a task. Equal scores go to the smaller doc_id, so documents at the threshold stay.

Terms are 64-bit hashes of their bytes: over 10^8 different terms the chance that any two share a hash is 3e-4.

Defined cases: null and empty texts have no terms, match nothing and count nowhere; rows that repeat a doc_id are documents of their
own; a null doc_id ranks behind the others of its score; rows that repeat an item_id are one query of all their terms; an item whose
terms no document holds has no rows; other columns are not read. A very long document is a shard by itself.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkernel as K
from .common import discard, staged, streamed, table

SHARD_BYTES = 8 << 20
BLOCK = 128
BLOCK_QUERIES = 500
WINDOW = 2048
TOP = 50
_LAST = np.iinfo(np.int64).max
#: ASCII but letters and digits stands between terms.
_BETWEEN = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])

_INDEX = (
    "shard long, term long, n int, first int, last int, docs binary, freqs binary, top_freqs array<int>, top_sizes array<int>, "
    "ids array<long>, sizes array<int>, n_docs long, n_terms long"
)
_NAMES = [c.split()[0] for c in _INDEX.split(", ")]


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each term, terms before each row)."""
    data, offsets = K.text_bytes(column)
    data = K._LOWER[data]
    starts, ends, rows = K.word_bounds(data, offsets, _BETWEEN)
    return K.hash_runs(data, starts, ends).view(np.int64), rows


def varbytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offset of each value): seven bits a byte, low ones first, the top bit set where more follow."""
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 9):
        sizes += values >> (7 * k) > 0
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(at[-1], np.uint8)
    for k in range(int(sizes.max(initial=0))):
        some = sizes > k
        out[at[:-1][some] + k] = (values[some] >> (7 * k) & 127) | np.where(sizes[some] > k + 1, 128, 0)
    return out, at


def unpacked(raw: np.ndarray) -> np.ndarray:
    """The values of a run of varbytes."""
    if not (raw & 128).any():
        return raw.astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], raw[:-1] < 128]))
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)


def _binary(raw: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def shard_rows(shard: int, ids: pa.Array, text: pa.Array):
    """The index rows of one shard: blocks of postings by term and document number, then the row that lists the documents."""
    words, rows = terms(text)
    sizes, n_rows = np.diff(rows), len(ids)
    names, rank = np.unique(words, return_inverse=True)
    key, count = np.unique(rank * n_rows + np.repeat(np.arange(n_rows), sizes), return_counts=True)
    del words, rank
    term, doc = key // n_rows, key % n_rows
    total = len(key)
    begins = np.flatnonzero(np.diff(term, prepend=-1))
    nth = np.arange(total) - np.repeat(begins, np.diff(np.append(begins, total)))
    starts = np.flatnonzero(nth % BLOCK == 0)
    bounds = np.append(starts, total)
    block = np.repeat(np.arange(len(starts)), np.diff(bounds))
    gaps = np.diff(doc, prepend=0)
    gaps[starts] = 0  # counted from the block's first document
    docs, docs_at = varbytes(gaps)
    freqs, freqs_at = varbytes(count)
    by = np.lexsort((sizes[doc], -count, block))
    best_block, size = block[by], sizes[doc][by]
    falling = size - best_block * (int(sizes.max(initial=0)) + 1)  # so that a running minimum starts anew with each block
    top = np.concatenate([[True], falling[1:] < np.minimum.accumulate(falling)[:-1]]) if total else np.zeros(0, bool)
    top_at = np.concatenate([[0], np.cumsum(np.bincount(best_block[top], minlength=len(starts)))])
    top_freqs, top_sizes = count[by][top].astype(np.int32), size[top].astype(np.int32)
    n, none = len(starts), lambda kind, m: pa.nulls(m, kind)
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    for lo in range(0, n, 50_000):
        hi = min(n, lo + 50_000)
        cut = lambda at: at[lo : hi + 1] - at[lo]  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(hi - lo, shard)), pa.array(names[term[starts[lo:hi]]]), pa.array(np.diff(bounds)[lo:hi].astype(np.int32)),
            pa.array(doc[starts[lo:hi]].astype(np.int32)), pa.array(doc[bounds[lo + 1 : hi + 1] - 1].astype(np.int32)),
            _binary(docs[docs_at[bounds[lo]] : docs_at[bounds[hi]]], cut(docs_at[bounds])), _binary(freqs[freqs_at[bounds[lo]] : freqs_at[bounds[hi]]], cut(freqs_at[bounds])),
            _lists(top_freqs[top_at[lo] : top_at[hi]], cut(top_at)), _lists(top_sizes[top_at[lo] : top_at[hi]], cut(top_at)),
            none(longs, hi - lo), none(ints, hi - lo), none(pa.int64(), hi - lo), none(pa.int64(), hi - lo),
        ], _NAMES)
    whole = np.array([0, n_rows])
    yield pa.RecordBatch.from_arrays([
        pa.array([shard]), none(pa.int64(), 1), *[none(pa.int32(), 1)] * 3, *[none(pa.binary(), 1)] * 2, *[none(ints, 1)] * 2,
        _lists(pc.fill_null(ids, _LAST).to_numpy(zero_copy_only=False), whole), _lists(sizes.astype(np.int32), whole), pa.array([int((sizes > 0).sum())]), pa.array([int(rows[-1])]),
    ], _NAMES)


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of every term of every whole text, written to the shared folder; a shard is named by its task and its turn."""

    def run(batches):
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for turn, piece in enumerate(K.blocks(batches, "text", shard_bytes)):
            yield from shard_rows(first + turn, *(piece.column(piece.schema.get_field_index(c)) for c in ("doc_id", "text")))

    return staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _INDEX), "lexical-index")


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), once each."""

    def run(batches):
        for piece in K.blocks(batches, "text"):
            ids, text = (piece.column(piece.schema.get_field_index(c)) for c in ("item_id", "text"))
            found, rows = terms(text)
            owner = np.repeat(np.arange(len(ids)), np.diff(rows))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), pa.array(found)], ["item_id", "term"])

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, term long").distinct()


class Postings:
    """A term's blocks in a shard: bounds at hand, postings decompressed when asked for."""

    def __init__(self, first, last, docs, freqs, bounds) -> None:
        by = np.argsort(first)
        self.first, self.last, self.bound = first[by], last[by], bounds[by]
        self.raw = [(docs[i], freqs[i]) for i in by.tolist()]
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, i: int, shard: "Shard") -> tuple[np.ndarray, np.ndarray]:
        """(document numbers, what each adds per weight)."""
        if i not in self.open:
            docs, freqs = (unpacked(np.frombuffer(x, np.uint8)) for x in self.raw[i])
            docs = np.cumsum(docs) + self.first[i]
            self.open[i] = docs, shard.part(freqs, shard.sizes[docs])
            shard.decoded += 1
        return self.open[i]


class Shard:
    """One shard, restricted to the terms of the queries."""

    def __init__(self, rows: list[pa.RecordBatch], n: int, total: int) -> None:
        self.n, self.total, self.decoded, self.lists = n, total, 0, {}
        held = pa.Table.from_batches(rows).combine_chunks()
        listed = held.filter(pc.is_null(held["term"]))
        self.ids, self.sizes = (np.asarray(listed[c].combine_chunks().flatten()).astype(np.int64) for c in ("ids", "sizes"))
        held = held.filter(pc.is_valid(held["term"])).sort_by("term")
        if not len(held):
            return
        names, first, last = (held[c].to_numpy() for c in ("term", "first", "last"))
        freqs, sizes = (held[c].combine_chunks() for c in ("top_freqs", "top_sizes"))
        at = np.asarray(freqs.offsets)[:-1] - freqs.offsets[0].as_py()
        bounds = np.maximum.reduceat(self.part(np.asarray(freqs.flatten()).astype(np.int64), np.asarray(sizes.flatten()).astype(np.int64)), at)
        docs, counts = held["docs"].to_pylist(), held["freqs"].to_pylist()
        cuts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1], [True]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            self.lists[int(names[a])] = Postings(first[a:b].astype(np.int64), last[a:b].astype(np.int64), docs[a:b], counts[a:b], bounds[a:b])

    def part(self, freqs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """What a term of that frequency adds per weight in a document of that size."""
        m = 50 + (50 * sizes * self.n) // self.total
        return (1_000_000_000 * freqs) // (1000 * freqs + 20 * m)

    def search(self, query: list[tuple[int, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(document numbers, scores) of the k best that score at least least, and the new least."""
        lists = [(self.lists[t], w) for t, w in query if w > 0 and t in self.lists]
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = max(1, least)
        if not lists or sum(w * int(p.bound.max()) for p, w in lists) < least:
            return rows, scores, least
        for lo in range(0, len(self.ids), WINDOW):
            hi = min(len(self.ids), lo + WINDOW)
            here = []
            for p, w in lists:
                a, b = np.searchsorted(p.last, lo), np.searchsorted(p.first, hi)
                if a < b:
                    here.append((w * int(p.bound[a:b].max()), w, p, int(a), int(b)))
            here.sort(key=lambda x: x[0])
            below = np.concatenate([[0], np.cumsum([x[0] for x in here])]) if here else np.zeros(1, np.int64)
            essential = int(np.searchsorted(below, least)) - 1  # lists before it stay below the threshold together
            if essential >= len(here):
                continue
            sums = np.zeros(hi - lo, np.int64)
            for _, w, p, a, b in here[essential:]:
                for i in range(a, b):
                    docs, parts = p.block(i, self)
                    if docs[0] < lo or docs[-1] >= hi:
                        some = (docs >= lo) & (docs < hi)
                        docs, parts = docs[some], parts[some]
                    sums[docs - lo] += w * parts
            left = np.flatnonzero(sums)
            got = sums[left]
            for nth in range(essential - 1, -1, -1):
                _, w, p, a, b = here[nth]
                able = got + below[nth + 1] >= least
                left, got = left[able], got[able]
                if not len(left):
                    break
                i = np.searchsorted(p.last[a:b], left + lo) + a
                inside = i < b
                inside[inside] = p.first[i[inside]] <= left[inside] + lo
                most = np.zeros(len(left), np.int64)
                most[inside] = w * p.bound[i[inside]]
                able = got + most + below[nth] >= least  # the block's bound, before the block is decompressed
                left, got, i, inside = left[able], got[able], i[able], inside[able]
                for one in np.unique(i[inside]).tolist():
                    docs, parts = p.block(one, self)
                    mine = np.flatnonzero(inside & (i == one))
                    at = np.minimum(np.searchsorted(docs, left[mine] + lo), len(docs) - 1)
                    hit = docs[at] == left[mine] + lo
                    got[mine[hit]] += w * parts[at[hit]]
            able = got >= least
            rows, scores = np.concatenate([rows, left[able] + lo]), np.concatenate([scores, got[able]])
            if len(rows) > k:
                by = np.lexsort((self.ids[rows], -scores))[:k]
                rows, scores = rows[by], scores[by]
            if len(rows) == k:
                least = max(least, int(scores.min()))
        return rows, scores, least


def search(index: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0."""
    spark = index.sparkSession
    schema = "item_id long, doc_id long, score long"
    documents = index.where("term is null")
    n, total = documents.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    asked = staged(query_terms(items), "lexical-asked")
    n_items = asked.select("item_id").distinct().count()
    if not n or not n_items:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    names = asked.select("term").distinct()
    postings = index.where("term is not null").join(names, "term", "left_semi")
    # A term's weight: floor(1000 ln((2N + 2) / (2 df + 1))).
    weights = postings.groupBy("term").agg(F.sum("n").alias("df")).select("term", F.floor(1000 * F.log((2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long").alias("w"))
    blocks = math.ceil(n_items / BLOCK_QUERIES)
    weighted = asked.join(weights, "term").groupBy("item_id").agg(F.collect_list(F.struct("term", "w")).alias("terms"))
    packed = staged(weighted.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("item_id", "terms")).alias("queries")), "lexical-queries")
    dealt = documents.select("shard", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block")).join(packed, "block")
    held = postings.unionByName(documents).drop("n", "n_docs", "n_terms")

    def run(pieces):
        shard, rows, least = None, [], {}
        for key, kind, batch in pieces:
            if kind == 0:
                if shard is not None or rows and key != rows[0][0]:
                    shard, rows = None, []
                rows.append((key, batch))
                continue
            shard = shard or Shard([b for _, b in rows], n, total)
            out = [[], [], []]
            for turn in batch.column("queries").to_pylist():
                for query in turn:
                    item = query["item_id"]
                    found, scores, least[item] = shard.search([(t["term"], t["w"]) for t in query["terms"]], k, least.get(item, 0))
                    out[0] += [item] * len(found)
                    out[1].append(shard.ids[found])
                    out[2].append(scores)
            if out[0]:
                ids = np.concatenate(out[1])
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(ids, mask=ids == _LAST), pa.array(np.concatenate(out[2]))], ["item_id", "doc_id", "score"])

    heaps = streamed(held, dealt, "shard", run, schema)
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """The k best documents of each item; the index is written, searched and deleted."""
    index = build_index(docs)
    out = staged(search(index, items, k), "lexical-found")
    discard(index)
    return out


def op13_lexical_search(spark, sf_dir):
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
