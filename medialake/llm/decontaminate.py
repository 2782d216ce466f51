"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item is found in a document when the document holds at least THRESHOLD of the item's distinct shingles of SIZE words
(an item of fewer words is one shingle of its own length). Documents are partitioned by the size of their shingle set; the
signature of a partition is a one-permutation MinHash whose number of bins is BINS_PER_ELEMENT times the partition's upper
size. Containment of a short item in a long document is a tiny Jaccard similarity, which a signature of fixed length would
miss; with bins in proportion to the document, each of its elements is the minimum of its bin with probability of about 0.88
or more, so an item with several shared shingles is missed with a probability that vanishes as a power of their number: from
FEW shingles on at least 7 are shared, and 0.12 to the power of 7 is 4e-7. An item has one signature per partition. A document
is a candidate for every item with an equal minimum in a bin, and for every item of fewer than FEW shingles of which it holds
any at all, minimum or not. Candidates are verified against their exact sets (64-bit hashes of shingles).

Items are a query set: they go to the workers in blocks of at most BLOCK_ITEMS items and BLOCK_WORDS words each, so what is
broadcast is bounded however many there are, and each block is searched over all documents. Documents are neither shuffled nor
collected; a document is read whole.

Defined cases: an item without words, or with null text, is found nowhere; null documents hold nothing; equal items are each
reported; rows that repeat a doc_id are each reported.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import in_batches, table

SIZE = 5
THRESHOLD = 0.8
BINS_PER_ELEMENT = 4
FEW = 8
BLOCK_ITEMS = 20_000
BLOCK_WORDS = 2_000_000


def partition_of(sizes: np.ndarray) -> np.ndarray:
    """Documents of 2**(p-1) < size <= 2**p elements make partition p."""
    return np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)


def _bins(elements: np.ndarray, partition) -> np.ndarray:
    """The bin of each element in its partition's signature."""
    bits = np.asarray(partition) + int(np.log2(BINS_PER_ELEMENT))
    return (K.mix(elements) >> (np.uint64(64) - np.asarray(bits).astype(np.uint64))).astype(np.int64)


def minima(elements: np.ndarray, owner: np.ndarray, partition: np.ndarray) -> np.ndarray:
    """Which elements are the smallest of their owner's bin; owner is ascending, partition is per element."""
    if not len(elements):
        return np.zeros(0, bool)
    bins = _bins(elements, partition)
    order = np.lexsort((elements, bins, owner))
    first = np.ones(len(order), bool)
    first[1:] = (owner[order][1:] != owner[order][:-1]) | (bins[order][1:] != bins[order][:-1])
    out = np.zeros(len(order), bool)
    out[order[first]] = True
    return out


class ItemBlock:
    """Exact sets and signatures of a block of items of one shingle length."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], size: int) -> None:
        self.ids, self.size = np.array(ids, np.int64), size
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.elements, self.owners = flat[order], owner[order]
        self.universe = np.unique(flat)
        self.has_few = bool((self.sizes < FEW).any())
        self.flat, self.owner = flat, owner
        self._signatures: dict[int, np.ndarray] = {}

    def signature(self, partition: int) -> np.ndarray:
        """Sorted elements that are minima of some item in a partition's signature."""
        if partition not in self._signatures:
            chosen = minima(self.flat, self.owner, np.full(len(self.flat), partition))
            self._signatures[partition] = np.unique(self.flat[chosen])
        return self._signatures[partition]

    def search(self, values: np.ndarray, bounds: np.ndarray, threshold: float):
        """(row, item, shared, size of the item) of every verified pair; values has the distinct elements of each row."""
        sizes = np.diff(bounds)
        row = np.repeat(np.arange(len(sizes)), sizes)
        # Only an element of some item can be the equal minimum, so the others are looked up once and left.
        at = np.minimum(np.searchsorted(self.universe, values), len(self.universe) - 1)
        hit = np.flatnonzero(self.universe[at] == values)
        if not len(hit):
            return []
        rows = np.unique(row[hit])
        part = partition_of(sizes)
        out = []
        for r in rows.tolist():
            own = values[bounds[r] : bounds[r + 1]]
            p = int(part[r])
            lowest = own[minima(own, np.zeros(len(own), np.int64), np.full(len(own), p))]
            equal = np.intersect1d(lowest, self.signature(p), assume_unique=True)
            if not len(equal) and not self.has_few:
                continue
            shared = np.bincount(self._owners_of(np.intersect1d(own, self.universe, assume_unique=True)), minlength=len(self.sizes))
            candidates = np.union1d(self._owners_of(equal), np.flatnonzero((shared > 0) & (self.sizes < FEW)))
            for i in candidates[shared[candidates] >= threshold * self.sizes[candidates] - 1e-9].tolist():
                out.append((r, int(self.ids[i]), int(shared[i]), int(self.sizes[i])))
        return out

    def _owners_of(self, elements: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.elements, elements, "left"), np.searchsorted(self.elements, elements, "right")
        n = hi - lo
        return self.owners[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]


def item_blocks(items: DataFrame, size: int):
    """Blocks of items, each read to the driver by itself: at most BLOCK_ITEMS items and about BLOCK_WORDS words."""
    held: dict[int, tuple[list, list]] = {}
    words_held = 0
    for r in items.select("item_id", "text").where("text is not null").toLocalIterator():
        words, rows = K.word_hashes(pa.array([r[1]], pa.string()))
        if not len(words):
            continue
        n = min(size, len(words))
        shingles, _ = K.shingle_hashes(words, rows, n)
        ids, sets = held.setdefault(n, ([], []))
        ids.append(r[0])
        sets.append(np.unique(shingles))
        words_held += len(words)
        if words_held >= BLOCK_WORDS or sum(len(v[0]) for v in held.values()) >= BLOCK_ITEMS:
            yield [ItemBlock(*v, n) for n, v in held.items()]
            held, words_held = {}, 0
    if held:
        yield [ItemBlock(*v, n) for n, v in held.items()]


def contaminated(docs: DataFrame, items: DataFrame, size: int = SIZE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every item found in a document."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, n_shared long, n_item long, containment double"

    def searcher(shared):
        def run(batches):
            for piece in K.blocks(batches, "text"):
                words, rows = K.word_hashes(piece.column(piece.schema.get_field_index("text")))
                found = []
                for block in shared.value:
                    shingles, bounds = K.shingle_hashes(words, rows, block.size)
                    at = np.minimum(np.searchsorted(block.universe, shingles), len(block.universe) - 1)
                    hits = np.concatenate([[0], np.cumsum(block.universe[at] == shingles)])
                    some = np.flatnonzero(hits[bounds[1:]] > hits[bounds[:-1]])  # rows with an element of some item
                    parts = [np.unique(shingles[bounds[r] : bounds[r + 1]]) for r in some.tolist()]
                    if parts:
                        cut = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
                        found += [(int(some[r]), *rest) for r, *rest in block.search(np.concatenate(parts), cut, threshold)]
                if found:
                    row, item, n, of = (np.array(x) for x in zip(*found))
                    ids = piece.column(piece.schema.get_field_index("doc_id")).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(item), pa.array(n), pa.array(of), pa.array(n / of)], ["doc_id", "item_id", "n_shared", "n_item", "containment"]
                    )

        return run

    texts = in_batches(docs).select("doc_id", "text")
    passes = [texts.mapInArrow(searcher(spark.sparkContext.broadcast(block)), schema) for block in item_blocks(items, size)]
    return reduce(DataFrame.unionByName, passes) if passes else spark.createDataFrame([], schema)


def op9_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH w AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), t AS (
  SELECT kind, id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM w
), z AS (SELECT DISTINCT least(5, len(ws)) AS n FROM t WHERE kind = 1 AND len(ws) > 0
), k AS (
  SELECT kind, id, ws, least(5, len(ws)) AS n FROM t WHERE kind = 1 UNION ALL SELECT kind, id, ws, z.n FROM t CROSS JOIN z WHERE kind = 0
), s AS (
  SELECT kind, id, n, unnest(list_distinct(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i+n-1], ' ')))) AS g FROM k
), n AS (SELECT id, count(*) AS n_item FROM s WHERE kind = 1 GROUP BY id
), p AS (
  SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared
  FROM s d JOIN s b ON d.n = b.n AND d.g = b.g AND d.kind = 0 AND b.kind = 1 GROUP BY 1, 2
)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM p JOIN n ON n.id = p.item_id WHERE 10 * n_shared >= 8 * n_item
"""
