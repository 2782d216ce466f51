"""Line dedup: near-equal lines across all documents, one occurrence of each connected group kept.

A line is normalised: A-Z lower-cased, digits read as 0, every run of other ASCII characters one space. Lines of equal normal
form is one class; of each class only one line goes on. Its features are its distinct words of LONG bytes or more (all distinct words, if
fewer than three words are that long). They are dealt by hash into 8 shares, pairs of shares make 4, and a line's fingerprint has one
64-bit SimHash a share, so that a changed word touches one block instead of bits of all blocks. Pigeonhole on the blocks:

* up to 12 features: every choice of 2 of the 4 blocks is a key; one replaced word leaves two of them untouched at least;
* 10 to 28 features: each of the 4 blocks is a key; one replaced word leaves two untouched;
* 22 features and more: each of the 8 blocks is a key; three replaced words leave two untouched.

A key needs two words or more. A line with REPEATS times as many words as distinct ones has the keys of its words with repeats too. Lines of a key whose SimHashes over all features differ in at most DISTANCE bits (unrelated ones in
about 32; not asked of lines of up to SHORT characters) are verified by edit similarity, 1 - distance / longer length >= SIMILARITY, on
their whole normal forms. Each key's smallest line is its hub: lines are first verified against their hubs and components are formed.
Then, in STAR_ROUNDS rounds, a line of each key's largest component is verified against the key's lines in other components, unless the
pairs across components are few. What is left are pairs of the same key in different components; these meet by length too, in bands that
the similarity implies, and are verified.
So a dense group costs about one verification a line and no link between the components of a key is left untested, however many lines
share it and however the rows are partitioned. Of each group the first line by (doc_id, line_no) stays.

Defined cases: null text has no lines; lines without a letter or digit are never duplicates and are not listed; equal lines
within a document are duplicates too; lines of one word are duplicates only when equal; rows that repeat a doc_id share their
line numbers, and the first stays; other columns are not read.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import connected_components, discard, staged, table

DISTANCE = 22
SIMILARITY = 0.8
LONG = 4
SHORT = 30
#: Lines with so many words for each distinct one are mostly repeats.
REPEATS = 1.5
STAR_ROUNDS = 2
#: Rounds of stars are left out where all pairs across components are no more than this times the rows of keys: these are tested at once.
STAR_ABOVE = 8
BROADCAST_IDS = 500_000
#: Lines that a task remembers, to give the keys of equal lines once; beyond, they only cost rows.
_SEEN = 200_000
_PAIRS = list(combinations(range(4), 2))

_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58] = 48
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_FOLD[10] = 10
_FOLD_BYTES = _FOLD.tobytes()


def _packed(more: np.ndarray) -> np.ndarray:
    return np.packbits(more, axis=-1, bitorder="little").view(np.uint64)[..., 0]


def _block_keys(words: np.ndarray, owner: np.ndarray, lines: int):
    """(SimHash of each line, its keys, which of these hold) of the given words, sorted by line and share."""
    group = owner * 8 + (words >> np.uint64(61)).astype(np.int64)
    count = np.bincount(group, minlength=lines * 8)
    n8 = count.reshape(lines, 8)
    n4, n = n8.reshape(lines, 4, 2).sum(2), n8.sum(1)
    kind = np.uint16 if n.max(initial=0) < 1 << 16 else np.int32
    ones = np.zeros((lines * 8, 64), kind)
    if len(words):
        bits = np.unpackbits(K.mix(words).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        filled = np.flatnonzero(count)
        at = np.concatenate([[0], np.cumsum(count[filled])[:-1]])
        eights = np.add.reduceat(np.ascontiguousarray(bits.view(np.uint64).T), at, axis=1)  # eight sums of a byte each in one number
        ones[filled] = np.ascontiguousarray(eights.T).view(np.uint8)
        for i in np.flatnonzero(count[filled] > 255).tolist():
            ones[filled[i]] = bits[at[i] : at[i] + count[filled[i]]].sum(0)
    ones8 = ones.reshape(lines, 8, 64)
    ones4 = ones8[:, 0::2] + ones8[:, 1::2]
    sim, sims8, sims4 = (_packed(x > (k // 2).astype(kind)[..., None]) for x, k in ((ones8.sum(1, dtype=kind), n), (ones8, n8), (ones4, n4)))
    tag = lambda j: K.mix(np.array([j], np.uint64))
    two = [K.mix(K.mix(sims4[:, i] ^ tag(j)) ^ sims4[:, k]) for j, (i, k) in enumerate(_PAIRS)]
    keys = [*two, *(K.mix(sims4[:, i] ^ tag(10 + i)) for i in range(4)), *(K.mix(sims8[:, i] ^ tag(20 + i)) for i in range(8))]
    holds = [(n <= 12) & (n4[:, i] + n4[:, k] >= 2) for i, k in _PAIRS]
    holds += [(n >= 10) & (n <= 28) & (n4[:, i] >= 2) for i in range(4)]
    holds += [(n >= 22) & (n8[:, i] >= 2) for i in range(8)]
    return sim, np.stack(keys, 1), np.stack(holds, 1)


def fingerprints(words: np.ndarray, lengths: np.ndarray, owner: np.ndarray, lines: int):
    """(SimHash of each line, its keys, which of these hold): words with their lengths and ascending line numbers. A word counts once
    a line: else a common word that a line repeats would outvote the others of its block, and unlike lines would share the key.
    Lines that are mostly repeats have the keys with repeats too."""
    long = lengths >= LONG
    many = np.bincount(owner[long], minlength=lines) >= 3
    taken = long | ~many[owner]
    words, owner = words[taken], owner[taken]
    if lines < 1 << 18:  # one sort of numbers that hold the line and 46 bits of the word
        order = np.argsort(owner.astype(np.uint64) << np.uint64(46) | words >> np.uint64(18))
    else:
        order = np.lexsort((words, owner))
    words, owner = words[order], owner[order]
    fresh = np.ones(len(words), bool)
    fresh[1:] = (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])
    sim, keys, holds = _block_keys(words[fresh], owner[fresh], lines)
    again = np.bincount(owner, minlength=lines) >= REPEATS * np.bincount(owner[fresh], minlength=lines)
    if again.any():
        mine = again[owner]
        _, more, these = _block_keys(words[mine], (np.cumsum(again) - 1)[owner[mine]], int(again.sum()))
        wide = np.zeros((2, *keys.shape), np.uint64), np.zeros((2, *holds.shape), bool)
        wide[0][0], wide[1][0], wide[0][1, again], wide[1][1, again] = keys, holds, more, these
        keys, holds = (np.concatenate(list(x), axis=1) for x in wide)
    return sim, keys, holds


def _lines_of(column: pa.Array):
    """(row, number in its row, hash, characters, SimHash, keys, which keys hold) of every line with a word."""
    data, offsets = K.text_bytes(column)
    data = _FOLD[data]
    gap = np.zeros(256, bool)
    gap[[10, 32]] = True
    starts, ends, _ = K.word_bounds(data, offsets, gap)
    words = K.mix(K.hash_runs(data, starts, ends))
    breaks = np.flatnonzero(data == 10)
    opens = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))  # each line's first byte
    opens = opens[opens < len(data)]
    row = np.searchsorted(offsets, opens, "right") - 1
    number = np.arange(len(opens)) - np.searchsorted(opens, offsets[:-1][row], "left")
    bounds = np.append(np.searchsorted(starts, opens), len(starts))
    place = np.arange(len(words)) - np.repeat(bounds[:-1], np.diff(bounds))
    total = np.concatenate([[np.uint64(0)], np.cumsum(K.mix(words ^ K.mix(place.astype(np.uint64))), dtype=np.uint64)])
    hashes = K.mix(total[bounds[1:]] - total[bounds[:-1]])
    filled = np.flatnonzero(bounds[1:] > bounds[:-1])
    upto = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters: bytes that continue none
    sized = np.concatenate([[0], np.cumsum(upto[ends] - upto[starts] + 1)])  # a word and a space, the last without
    chars = (sized[bounds[1:]] - sized[bounds[:-1]] - 1)[filled]
    owner = np.repeat(np.arange(len(filled)), np.diff(bounds)[filled])
    return row[filled], number[filled], hashes[filled], chars, *fingerprints(words, ends - starts, owner, len(filled))


def text_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, sim, size, keys): every line with a word; line is a hash of its normal form, size its length.

    keys is empty where the task has given the keys of an equal line.
    """

    def run(batches):
        seen: set[int] = set()
        for piece in K.blocks(batches, "text", 1 << 20):
            row, number, hashes, sizes, sims, keys, holds = _lines_of(piece.column(piece.schema.get_field_index("text")))
            fresh = np.zeros(len(hashes), bool)
            for i, h in enumerate(hashes.tolist()):
                if h not in seen:
                    fresh[i] = True
                    if len(seen) < _SEEN:
                        seen.add(h)
            holds &= fresh[:, None]
            offsets = np.concatenate([[0], np.cumsum(holds.sum(1))]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[holds].view(np.int64)))
            ids = piece.column(piece.schema.get_field_index("doc_id")).take(pa.array(row))
            columns = [ids, pa.array(number), pa.array(hashes.view(np.int64)), pa.array(sims.view(np.int64)), pa.array(sizes.astype(np.int32)), listed]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "line_no", "line", "sim", "size", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, line_no long, line long, sim long, size int, keys array<long>")


def normal_forms(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, text): the normal forms of wanted, (doc_id, line_no, line), the place of one occurrence of each line."""
    places = wanted.groupBy("doc_id").agg(F.collect_list("line_no").alias("numbers"))  # within one document
    few = places.count() <= BROADCAST_IDS
    found = docs.select("doc_id", "text").join(F.broadcast(places) if few else places, "doc_id")

    def run(batches):
        for piece in K.blocks(batches, "text", 1 << 20):
            texts = []
            for text, numbers in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist()):
                lines = text.encode().translate(_FOLD_BYTES).split(b"\n")
                texts += [b" ".join(lines[i].split()).decode() for i in numbers if i < len(lines)]  # rows may repeat a doc_id
            row, _, hashes, *_ = _lines_of(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array([texts[r] for r in row.tolist()], pa.string())], ["line", "text"])

    out = found.select("doc_id", "text", "numbers").where("text is not null").mapInArrow(run, "line long, text string").dropDuplicates(["line"])
    return out.join(wanted.select("line"), "line", "left_semi")


def edit_within(a: str, b: str, most: int) -> bool:
    """Whether the Levenshtein distance is at most `most`.

    What the texts share at both ends is cut off; the counts of characters give a lower bound; the rest is one pass of the
    bit-parallel recurrence (a column of the matrix in two integers), left as soon as the bound cannot be met.
    """
    if abs(len(a) - len(b)) > most:
        return False
    x, y = np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32)
    n = min(len(x), len(y))
    unequal = np.flatnonzero(x[:n] != y[:n])
    lead = int(unequal[0]) if len(unequal) else n
    x, y = x[lead:], y[lead:]
    n = min(len(x), len(y))
    unequal = np.flatnonzero(x[::-1][:n] != y[::-1][:n])
    trail = int(unequal[0]) if len(unequal) else n
    x, y = x[: len(x) - trail], y[: len(y) - trail]
    if max(len(x), len(y)) <= most:
        return True
    if not len(x) or not len(y):
        return False
    _, folded = np.unique(np.concatenate([x, y]), return_inverse=True)
    gap = np.bincount(folded[: len(x)], minlength=folded.max() + 1) - np.bincount(folded[len(x) :], minlength=folded.max() + 1)
    if max(gap[gap > 0].sum(), -gap[gap < 0].sum()) > most:
        return False
    m, full = len(x), (1 << len(x)) - 1
    where: dict[int, int] = {}
    for c in np.unique(folded[:m]).tolist():
        where[c] = int.from_bytes(np.packbits(folded[:m] == c, bitorder="little").tobytes(), "little")
    up, down, score, top, left = full, 0, m, 1 << (m - 1), len(y)
    for c in folded[m:].tolist():
        match = where.get(c, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        plus, minus = down | ~(diagonal | up) & full, diagonal & up
        score += (plus & top != 0) - (minus & top != 0)
        left -= 1
        if score - left > most:
            return False
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        up, down = minus | ~(diagonal | plus) & full, plus & diagonal
    return score <= most


def may_be_within(a: pa.Array, b: pa.Array, similarity: float) -> np.ndarray:
    """Which pairs of texts may be similar enough by the counts of their characters: an edit takes one away and adds one at most.
    Characters are counted by their first byte, in 64 bins a text."""

    def counted(column: pa.Array) -> np.ndarray:
        data, offsets = K.text_bytes(column)
        row = np.repeat(np.arange(len(column)), np.diff(offsets))
        first = (data & 0xC0) != 0x80
        return np.bincount(row[first] * 64 + (data[first] & 63), minlength=64 * len(column)).reshape(-1, 64)

    x, y = counted(a), counted(b)
    most = np.floor(np.maximum(x.sum(1), y.sum(1)) * (1 - similarity) + 1e-9)
    gap = x - y
    return np.maximum(np.maximum(gap, 0).sum(1), np.maximum(-gap, 0).sum(1)) <= most


def words_within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most `most` already when words are only exchanged in place and one stretch of words is left out,
    wherever that is cheapest; False says nothing."""
    x, y = a.split(" "), b.split(" ")
    if len(x) > len(y):
        x, y = y, x
    lead = [0]
    for p, q in zip(x, y):
        lead.append(lead[-1] if p == q else lead[-1] + max(len(p), len(q)))
    more = len(y) - len(x)
    gap = sum(map(len, y[len(x) :])) + more  # the words left out and their spaces
    if lead[-1] + gap <= most:
        return True
    trail = 0
    for i in range(len(x) - 1, -1, -1) if more else ():
        p, q = x[i], y[i + more]
        trail += 0 if p == q else max(len(p), len(q))
        gap += len(y[i]) - len(q)
        if lead[i] + gap + trail <= most:
            return True
        if trail > most:
            return False
    return False


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (a, b) those whose normal forms are similar enough, by 1 - distance / longer length."""
    left = texts.select(F.col("line").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("line").alias("b"), F.col("text").alias("tb"))

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(may_be_within(batch.column(2), batch.column(3), similarity)))
            one, two = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            most = [int(max(len(x), len(y)) * (1 - similarity) + 1e-9) for x, y in zip(one, two)]
            ok = [words_within(*pair) or edit_within(*pair) for pair in zip(one, two, most)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def _shared_rows(keyed: DataFrame) -> DataFrame:
    """(key, line, hub): the lines of the keys that several lines have, each beside its key's smallest line, which has no row."""
    dealt = keyed.repartition("key")  # once for both: nearly every key has one row, so counts before the shuffle would save nothing
    hubs = dealt.groupBy("key").agg(F.min("line").alias("hub"), F.max("line").alias("far")).where("hub <> far").select("key", "hub")
    return dealt.join(hubs.hint("shuffle_hash"), "key").where("line <> hub").select("key", "line", "hub")


def _merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """The components parts, (node, component), when the links (a, b) are added; only the components that these meet are worked on."""
    named = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    met = links.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    more = connected_components(met)
    alone = more.join(parts.select(F.col("component").alias("node")), "node", "left_anti")
    moved = more.select(F.col("node").alias("component"), F.col("component").alias("into"))
    out = parts.join(moved, "component", "left").select("node", F.coalesce("into", "component").alias("component")).union(alone.select("node", "component"))
    return staged(out, "lines-parts")


def length_bands(size: str, similarity: float, around: bool) -> Column:
    """The band of a length, or with its neighbours: lengths of similar lines differ by less than a band's ratio."""
    band = F.floor(F.log(F.col(size).cast("double")) / F.lit(-math.log(similarity) * (1 + 1e-9))).cast("int")
    return F.array(band - 1, band, band + 1) if around else band


def line_groups(docs: DataFrame, lines: DataFrame, distance: int = DISTANCE, similarity: float = SIMILARITY) -> DataFrame:
    """(line, keep_doc_id, keep_line_no, group_size) of every line class with more than one occurrence in its group."""
    first = F.min(F.struct("doc_id", "line_no")).alias("first")
    classes = staged(lines.groupBy("line", "sim", "size").agg(first, F.count(F.lit(1)).alias("n")), "lines-classes")
    keyed = lines.select("line", F.explode("keys").alias("key"))
    # Dealt by both columns: equal lines of several tasks become one row, and the rows of a common key do not meet in one task.
    bucketed = staged(_shared_rows(keyed).repartition("key", "line").distinct(), "lines-bucketed")

    described = lambda c: classes.select(F.col("line").alias(c), F.col("sim").alias(f"sim_{c}"), F.col("size").alias(f"size_{c}"))
    longer = F.greatest("size_a", "size_b")
    near = (F.bit_count(F.col("sim_a").bitwiseXOR(F.col("sim_b"))) <= distance) | (longer <= SHORT)
    alike = near & (longer - F.least("size_a", "size_b") <= F.floor(longer * F.lit(1 - similarity) + F.lit(1e-9)))

    def texts_of(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("line")).distinct()
        return staged(normal_forms(docs, staged(classes.join(ends, "line").select("first.*", "line"), "lines-wanted")), "lines-texts")

    def tested(pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b) of lines."""
        pairs = staged(pairs.distinct().join(described("a"), "a").join(described("b"), "b").where(alike).select("a", "b"), "lines-pairs")
        if not pairs.limit(1).count():
            return pairs
        found = staged(_verified(pairs, texts_of(pairs), similarity), "lines-found")
        discard(pairs)
        return found

    parts = connected_components(tested(bucketed.select(F.col("hub").alias("a"), F.col("line").alias("b"))))

    def open_rows(parts: DataFrame) -> DataFrame:
        """(key, line, component) of the keys that hold several components beside their hub, which is tested."""
        placed = bucketed.select("key", "line").join(parts.withColumnRenamed("node", "line"), "line", "left")
        placed = staged(placed.withColumn("component", F.coalesce("component", "line")), "lines-placed")
        # Written before the join, so that Spark can split the rows of a common key there.
        several = staged(placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key"), "lines-several")
        out = staged(placed.join(several, "key", "left_semi").select("key", "line", "component"), "lines-open")
        discard(placed, several)
        return out

    left = open_rows(parts)
    for turn in range(STAR_ROUNDS):
        per = left.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.min_by("line", F.xxhash64("key", "line", F.lit(turn))).alias("a"))
        across = (F.pow(F.sum("c"), F.lit(2)) - F.sum(F.pow("c", F.lit(2)))).alias("across")
        stars = staged(per.groupBy("key").agg(F.max_by(F.struct("a", "component"), F.struct("c", "component")).alias("star"), across), "lines-stars")
        if (stars.agg(F.sum("across")).first()[0] or 0) <= STAR_ABOVE * bucketed.count():
            discard(stars)
            break
        found = tested(left.join(stars, "key").where("component <> star.component").select("star.a", F.col("line").alias("b")))
        discard(stars)
        if found.limit(1).count():
            parts = _merged(parts, found)
            discard(left)
            left = open_rows(parts)

    left = staged(left.join(classes.select("line", "sim", "size"), "line").withColumn("band", length_bands("size", similarity, False)), "lines-rest")
    side = lambda df, c: df.select("key", "band", F.col("line").alias(c), F.col("component").alias(f"c{c}"), F.col("sim").alias(f"sim_{c}"), F.col("size").alias(f"size_{c}"))
    around = left.withColumn("band", F.explode(length_bands("size", similarity, True)))
    rest = side(left, "a").join(side(around, "b"), ["key", "band"]).where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & alike)
    more = tested(rest.select("a", "b"))
    if more.limit(1).count():
        parts = _merged(parts, more)
    discard(bucketed, left)

    placed = classes.join(parts.withColumnRenamed("node", "line"), "line", "left").withColumn("component", F.coalesce("component", "line"))
    placed = staged(placed.select("line", "component", "first", "n"), "lines-placed")
    groups = placed.groupBy("component").agg(F.min("first").alias("keep"), F.sum("n").alias("group_size")).where("group_size > 1")
    out = staged(placed.join(staged(groups, "lines-groups"), "component").select("line", "keep.*", "group_size"), "lines-result")
    discard(placed, classes)
    return out.select("line", F.col("doc_id").alias("keep_doc_id"), F.col("line_no").alias("keep_line_no"), "group_size")


def fuzzy_line_dedup(docs: DataFrame, distance: int = DISTANCE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, line_no, keep_doc_id, keep_line_no, group_size, kept) of every line that has a word."""
    lines = staged(text_lines(docs), "lines-all")
    groups = line_groups(docs, lines, distance, similarity)
    out = lines.join(groups, "line", "left")
    return out.select(
        "doc_id", "line_no", F.coalesce("keep_doc_id", "doc_id").alias("keep_doc_id"), F.coalesce("keep_line_no", "line_no").alias("keep_line_no"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
    ).withColumn("kept", (F.col("keep_doc_id") == F.col("doc_id")) & (F.col("keep_line_no") == F.col("line_no")))


def without_duplicate_lines(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """docs with the lines taken out of their texts that decisions drops."""
    dropped = decisions.where("not kept").groupBy("doc_id").agg(F.collect_set("line_no").alias("dropped_lines"))  # within one document
    kept = F.filter(F.transform(F.split("text", "\n"), lambda t, i: F.when(~F.array_contains("dropped_lines", i.cast("long")), t)), lambda t: t.isNotNull())
    joined = docs.join(dropped, "doc_id", "left")
    return joined.withColumn("text", F.when(F.col("dropped_lines").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).drop("dropped_lines").select(docs.columns)


def op1_line_dedup(spark, sf_dir):
    return fuzzy_line_dedup(table(spark, sf_dir, "documents"))
