"""Periodic run detection: stretches of words that repeat themselves, by descending LCP.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) of at least max(MIN_WORDS,
MIN_EXPONENT * q) words that no neighbouring word extends keeping period q. Its first copy is worth keeping; the words after its
first q words are dropped.

Method. The suffixes of a document, in the order of their words, form classes by the length of what they share (LCP). Classes
are united by decreasing LCP with union-find; each class holds its positions in order. When two classes unite at LCP l, every
pair of positions i < j that becomes adjacent in the united set with j - i <= l is a seed: the words [i, j + l) have the period
j - i and no word to the right extends them. A run (s, q) has its seed at (s, s + q): a position between them with as long an
LCP would give the run a smaller period (Fine and Wilf), and the pair meets exactly at its own LCP. So the seeds that no word to
the left extends are all the runs, each once, with smallest periods. A run of exponent MIN_EXPONENT or more needs an LCP of
(MIN_EXPONENT - 1) * q and of MIN_WORDS - 1 at q = 1, so suffixes that share fewer than GATE words are never united.

The suffix order comes from prefix doubling over a whole batch of documents at once: ranks of 1, 2, 4, ... words, and from
four words on only where ranks are still shared. Words are 64-bit hashes of their bytes; that two words of one document of 10^5
words share a hash has the probability 3e-10. A document is read whole in one task and takes O(n log^2 n) time and O(n) memory;
documents never meet, so nothing is shuffled and hot copies or sources don't matter.

Defined cases: null, empty and blank texts have no words, no runs and an empty collapsed text; rows that repeat a doc_id are
each reported; a null doc_id is reported and its text is left as it is by `with_repeats`; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import table

MIN_WORDS = 6
MIN_EXPONENT = 4
#: The least LCP of a seed of a run: MIN_WORDS - 1 words at period 1, (MIN_EXPONENT - 1) * q at longer ones.
GATE = min(max(MIN_WORDS, MIN_EXPONENT * q) - q for q in range(1, MIN_WORDS + 1))
BLOCK_BYTES = 4 << 20

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each key among the distinct ones, how many share it)."""
    _, rank, count = np.unique(keys, return_inverse=True, return_counts=True)
    return rank, count[rank]


def suffix_order(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, lcp): the positions whose suffix shares GATE words or more with another of its row, each row's in the order
    of their suffixes, and how many words each shares with the position listed before it (0: none that matter)."""
    n = len(words)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    end = np.repeat(rows[1:], np.diff(rows))
    place = np.arange(n)
    rank, shared = dense(words)
    for width in (1, 2):  # two words, then four: by far the most suffixes are told apart
        after = np.zeros(n, np.int64)  # 0 stands for the end of a row
        inner = place + width < end
        after[inner] = rank[place[inner] + width] + 1
        rank, shared = dense(rank * (n + 1) + after)
    rank, shared = dense(row * (n + 1) + rank)  # rows apart
    # From here on a rank is one more than the place of its class in the order of all, so that classes split in place.
    at = np.flatnonzero(np.concatenate([[True], np.diff(np.sort(rank)) > 0])) if n else rank
    rank = at[rank] + 1
    open_ = np.flatnonzero(shared > 1)
    width = 4
    while len(open_):
        nxt = np.zeros(len(open_), np.int64)
        inner = open_ + width < end[open_]
        nxt[inner] = rank[open_[inner] + width]
        by = np.lexsort((nxt, rank[open_]))
        o, r, x = open_[by], rank[open_][by], nxt[by]
        same_class = np.concatenate([[False], r[1:] == r[:-1]])
        same = same_class & np.concatenate([[False], x[1:] == x[:-1]])
        start = np.maximum.accumulate(np.where(same_class, 0, np.arange(len(o))))
        mine = np.maximum.accumulate(np.where(same, 0, np.arange(len(o))))
        rank[o] = r + (mine - start)
        open_ = o[same | np.concatenate([same[1:], [False]])]
        width *= 2
    order = place[shared > 1]
    order = order[np.argsort(rank[order])]
    lcp = neighbour_lcp(words, end, row, order)
    joins = lcp >= GATE
    kept = joins | np.append(joins[1:], False)[: len(joins)]
    return order[kept], np.where(joins, lcp, 0)[kept]


def neighbour_lcp(words: np.ndarray, end: np.ndarray, row: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Words shared by each suffix of order and the one before it in the same row: stretches of 1, 2, 4, ... words are compared by
    chained hashes while they are equal, then ever shorter ones, so a pair costs the logarithm of its LCP."""
    n, out = len(words), np.zeros(len(order), np.int64)
    live = np.flatnonzero(row[order[:-1]] == row[order[1:]])
    a, b = order[live], order[live + 1]
    got, chains, going = np.zeros(len(live), np.int64), [], np.arange(len(live))

    def equal(level: int, which: np.ndarray) -> np.ndarray:
        """Those of which whose next 2**level words are equal and in the row."""
        x, y = a[which] + got[which], b[which] + got[which]
        ok = (x + (1 << level) <= end[a[which]]) & (y + (1 << level) <= end[b[which]])
        x, y, which = x[ok], y[ok], which[ok]
        return which[chains[level][x] == chains[level][y]]

    while len(going):
        level = len(chains)
        w, half = 1 << level, chains[-1] if chains else words
        chains.append(K.mix(K.mix(half[: max(0, n - w + 1)]) ^ half[w // 2 :][: max(0, n - w + 1)]) if level else words)
        going = equal(level, going)
        got[going] += w
    for level in range(len(chains) - 1, -1, -1):
        got[equal(level, np.arange(len(live)))] += 1 << level
    out[live + 1] = got
    return out


def united(positions: np.ndarray, lcp: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Seeds (i, j, l) of the suffix classes in positions: edges between neighbours by decreasing LCP, union-find with the smaller
    ordered set poured into the larger, a seed for every pair that becomes adjacent at a distance within the LCP."""
    edges = np.flatnonzero(lcp)
    left, right = positions[edges - 1], positions[edges]
    # Classes of two unite in one step.
    begins = lcp == 0
    size = np.diff(np.concatenate([np.flatnonzero(begins), [len(positions)]]))
    pair = size[np.cumsum(begins)[edges] - 1] == 2
    i, j, l = np.minimum(left, right)[pair], np.maximum(left, right)[pair], lcp[edges][pair]
    near = (j - i) * (MIN_EXPONENT - 1) <= l
    starts, ends, lengths = i[near].tolist(), j[near].tolist(), l[near].tolist()
    rest = edges[~pair]
    rest = rest[np.argsort(-lcp[rest], kind="stable")]
    parent: dict[int, int] = {}
    sets: dict[int, list[int]] = {}
    for e, l in zip(rest.tolist(), lcp[rest].tolist()):
        roots = []
        for place in (e - 1, e):
            root = place
            while (up := parent.get(root, root)) != root:
                parent[root] = root = parent.get(up, up)
            roots.append(root)
        a, b = roots
        sa, sb = sets.pop(a, None) or [int(positions[a])], sets.pop(b, None) or [int(positions[b])]
        if len(sa) < len(sb):
            a, b, sa, sb = b, a, sb, sa
        parent[b] = a
        reach = l // (MIN_EXPONENT - 1)
        if len(sb) * 8 > len(sa):
            # Of like size: one merge of two ordered lists.
            merged = sorted(sa + sb)
            inside = set(sb)
            for x, y in zip(merged, merged[1:]):
                if y - x <= reach and (x in inside) != (y in inside):
                    starts.append(x), ends.append(y), lengths.append(l)
            sets[a] = merged
            continue
        for x in sb:
            insort(sa, x)
        for k, x in enumerate(sb):
            at = bisect_left(sa, x)
            if at and x - sa[at - 1] <= reach and not (k and sa[at - 1] == sb[k - 1]):
                starts.append(sa[at - 1]), ends.append(x), lengths.append(l)
            if at + 1 < len(sa) and sa[at + 1] - x <= reach and not (k + 1 < len(sb) and sa[at + 1] == sb[k + 1]):
                starts.append(x), ends.append(sa[at + 1]), lengths.append(l)
        sets[a] = sa
    return starts, ends, lengths


def find_runs(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, period) of every run, by row, start and period; starts count within the row."""
    positions, lcp = suffix_order(words, rows)
    i, j, l = (np.array(x, np.int64) for x in united(positions, lcp))
    period, length = j - i, j - i + l
    row = np.searchsorted(rows, i, "right") - 1
    extended = (i > rows[row]) & (words[i - 1] == words[j - 1]) if len(i) else np.zeros(0, bool)
    keep = ~extended & (length >= np.maximum(MIN_WORDS, MIN_EXPONENT * period))
    row, i, length, period = row[keep], i[keep], length[keep], period[keep]
    by = np.lexsort((period, i, row))
    return row[by], (i - rows[row])[by], length[by], period[by]


def kept_words(rows: np.ndarray, row: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words are outside every run's later copies."""
    depth = np.zeros(rows[-1] + 1, np.int64)
    np.add.at(depth, rows[row] + start + period, 1)
    np.add.at(depth, rows[row] + start + length, -1)
    return np.cumsum(depth)[:-1] == 0


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by one space."""
    before = np.concatenate([[0], np.cumsum(keep)])
    counts = before[rows[1:]] - before[rows[:-1]]
    a, sizes = starts[keep], (ends - starts)[keep] + 1  # each with the byte behind it, which becomes the space
    target = np.concatenate([[0], np.cumsum(sizes)])
    source = np.repeat(a - target[:-1], sizes) + np.arange(target[-1])
    out = np.concatenate([data, np.zeros(1, np.uint8)])[source]
    out[target[1:] - 1] = 0x20
    first, last = target[before[rows[:-1]]], target[before[rows[1:]]] - (counts > 0)
    drop = np.zeros(len(out), bool)
    drop[last[counts > 0]] = True  # no space behind a row's last word
    offsets = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int64)
    text = pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(out[~drop].tobytes()))
    return text.cast(pa.string())


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): every run of every whole text, by start and period, and the text without the later
    copies of each."""

    def run(batches):
        for piece in K.blocks(batches, "text", BLOCK_BYTES):
            ids, text = (piece.column(piece.schema.get_field_index(c)) for c in ("doc_id", "text"))
            data, offsets = K.text_bytes(text)
            starts, ends, rows = K.word_bounds(data, offsets)
            row, start, length, period = find_runs(K.hash_runs(data, starts, ends), rows)
            keep = kept_words(rows, row, start, length, period)
            at = pa.array(np.searchsorted(row, np.arange(len(ids) + 1)).astype(np.int32))
            runs = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(_RUN)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(rows)), runs, joined_words(data, starts, ends, rows, keep)], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): documents of which every tenth, by the crc32 of its id, has its words from a on repeated with a period p.

    h = crc32(doc_id as text), g = h / 10: if h % 10 = 0, each word i >= a becomes word a + (i - a) % p, where a = g % n and
    p = 1 + (n - a) / (3 + g % 8) over n words; these texts have one space between words.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    mine = docs.select(F.col("doc_id").cast("long"), "text", h.alias("h"))
    words: Column = F.filter(F.split(F.when(F.col("h") % 10 == 0, F.col("text")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    mine = mine.withColumn("words", words).withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    mine = mine.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("copies", 3 + F.col("g") % 8)
    mine = mine.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / F.col("copies")))
    head = F.slice("words", F.lit(1), F.col("a").cast("int"))
    unit = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    altered = F.array_join(F.slice(F.concat(head, F.flatten(F.array_repeat(unit, F.col("copies").cast("int")))), F.lit(1), F.col("n")), " ")
    return mine.select("doc_id", F.when(F.col("n") > 0, altered).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The longest run (ties: smallest start, then period) and hashes of all runs and of the collapsed text."""
    best = F.expr("array_sort(transform(runs, r -> struct(-r.length AS low, r.start AS start, r.period AS period)))[0]")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    length, period = -F.col("best.low"), F.col("best.period")
    return found.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark, sf_dir):
    return digests(periodic_runs(with_repeats(table(spark, sf_dir, "documents"))))
