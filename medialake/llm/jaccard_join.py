"""N-gram Jaccard join: universe-partition pigeonhole with one-deletion neighbourhoods, verified exactly.

Two documents link when their sets of word shingles have a Jaccard similarity of at least num/den. How it works:

* Set sizes fall into bands that double. A band is one scheme; a set takes part in its own band's scheme and in the lower ones
  where it can still be the larger partner.
* A set of s elements differs from its partners of a scheme, l elements at most, in at most h = (s + l) * (den - num) // (den + num)
  elements. The universe is hashed into
  segments of two kinds. T segments have the allowance 2: they are indexed by their subset (the sum of its elements' hashes)
  and its one-deletion neighbourhood, so a pair is found when one of them differs by at most one element. If none does, they
  hold 2T of the differences, and of the M other segments at most h - 2T differ. Of these a set indexes the subsets of the
  h - 2T + 1 that stand first in an order all sets share, fullest first, with the allowance 1, and skips the rest (allowance 0):
  among M segments of which M - (h - 2T) are equal, the first equal one is among the indexed of both sets, by the h of each,
  since the pair's own bound is no larger than either. No link is lost,
  and segments that are alike by chance because they are nearly empty are skipped.
* A cost model over the counts of sets in every scheme chooses T (1 at least wherever sets may differ), how much fuller
  these segments are, and M. It weighs index rows against chance candidates; the method is one and the same at every size.
* Sets that share a key are candidates, unless a sketch rules the pair out: the parities of the elements' counts by bin differ in
  no more bins than the sets differ in elements, so too many odd bins prove a similarity below the threshold. Each key's
  smallest set is its hub: first every set is verified against its hubs and components are formed, then keys that still hold several components are verified pair by pair across components. A dense
  group of g near copies so costs about g verifications, and no link between components is left untested.

Keys are 64-bit hashes: an accidental collision only adds a candidate, which the exact verification rejects. Shingles are
compared by 64-bit hashes. Candidate counts, hubs and components are aggregations with map-side combination or joins of
written tables, which Spark can split; nothing is capped.

Defined cases: null or empty text gives an empty set, linked with nothing; fewer words than a shingle make one shingle of
the whole sequence; rows that repeat a doc_id each come back.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import connected_components, discard, in_batches, staged, table

_GROWTH = 2
_COST_PER_CANDIDATE = 4.0
#: Sets remembered by a task so that copies within it are indexed once; beyond this many, copies just cost rows.
_SEEN = 200_000
#: Bits of the largest sketch.
MOST_BITS = 8192
#: How often two unrelated sets share a segment's only element, as the cost model reckons.
_SINGLE_ALIKE = 1e-3
#: Rounds in which open keys test a star before all pairs across their components are.
STAR_ROUNDS = 2
#: Ids of verified documents that are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000


def size_bands(largest: int) -> np.ndarray:
    """The smallest size of each band: 1, 2, 4, 8, ... beyond largest."""
    starts = [1]
    while starts[-1] <= largest:
        starts.append(max(starts[-1] + 1, int(starts[-1] * _GROWTH)))
    return np.array(starts)


@dataclass(frozen=True)
class Scheme:
    """How the sets of a band and their larger partners are cut and indexed."""

    high: int  #: the largest set of the band
    largest: int  #: the largest set that takes part
    twos: int  #: segments of allowance 2
    weight: int  #: how many times fuller these are than the others
    others: int  #: segments of allowance 1 or 0


def indexed_segments(n, scheme: Scheme | np.ndarray, num: int, den: int):
    """How many of the other segments sets of n elements index; scheme is one, or its high, largest and twos by set."""
    high, largest, twos = (scheme.high, scheme.largest, scheme.twos) if isinstance(scheme, Scheme) else scheme
    partner = np.where(n <= high, np.minimum(n * den // num, largest), high)
    return np.maximum((n + partner) * (den - num) // (den + num) + 1 - 2 * twos, 0)


def _cost(n: float, size: float, twos: int, weight: int, others: int, indexed: float) -> float:
    """Index rows of n sets of about size elements, and chance candidates: pairs whose indexed segments are (nearly) empty alike."""
    mean = size / (twos * weight + others)
    rows = indexed + twos * (1 + weight * mean)
    alike = 0.0
    if others > 1:
        skipped, empty = 1 - indexed / others, exp(-mean)
        none = max(0.0, empty - skipped)
        single = max(0.0, min(empty * mean, empty * (1 + mean) - skipped))
        alike += others * (none**2 + _SINGLE_ALIKE * single**2)
    if twos * weight + others > weight:
        alike += twos * (exp(-mean * weight) * (1 + mean * weight)) ** 2
    return n * rows + _COST_PER_CANDIDATE * n * n / 2 * alike


def allocate(starts: np.ndarray, counts: dict[int, int], num: int, den: int) -> list[Scheme]:
    """Per band the cheapest scheme; counts has the number of sets by band."""
    out = []
    for i, low in enumerate(starts[:-1].tolist()):
        high = int(starts[i + 1]) - 1
        largest = high * den // num
        h = (high + largest) * (den - num) // (den + num)
        n = counts.get(i, 0) + counts.get(i + 1, 0)
        if h == 0:
            out.append(Scheme(high, largest, 0, 1, 1))
            continue
        most = (h + 1) // 2
        best = None
        for twos in sorted({min(most, 1 << k) for k in range(most.bit_length() + 1)}):
            needed, size = h + 1 - 2 * twos, int(low * 1.3)
            for others in sorted({ceil(needed * slack) for slack in (1, 1.15, 1.3, 1.6, 2, 3)}):
                for weight in (1, 2, 4, 8) if others else (1,):
                    scheme = Scheme(high, largest, twos, weight, others)
                    cost = _cost(n, size, twos, weight, others, float(indexed_segments(size, scheme, num, den)))
                    if best is None or cost < best[0]:
                        best = (cost, scheme)
        out.append(best[1])
    return out


def _sets(batches, size: int):
    """(batch, distinct shingle hashes, bounds) of pieces of the batches."""
    for piece in K.blocks(batches, "text", 1 << 20):
        words, rows = K.word_hashes(piece.column(piece.schema.get_field_index("text")))
        shingles, bounds = K.shingle_hashes(words, rows, size)
        yield piece, *K.distinct_per_row(shingles, bounds)


def _set_hash(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[np.uint64(0)], np.cumsum(K.mix(values), dtype=np.uint64)])
    return K.mix(total[bounds[1:]] - total[bounds[:-1]])


def _column(batch, name):
    return batch.column(batch.schema.get_field_index(name))


def _sketches(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """Per set the parities of its elements' counts in at least twice as many bins as it has elements (a power of two, 64 to MOST_BITS)."""
    n = np.diff(bounds)
    words = np.minimum(1 << np.ceil(np.log2(np.maximum(n, 32) / 32)).astype(np.int64), MOST_BITS // 64)
    at = np.concatenate([[0], np.cumsum(words)])
    owner = np.repeat(np.arange(len(n)), n)
    bin_ = (K.mix(values) & (words[owner] * 64 - 1).astype(np.uint64)).astype(np.int64)
    bits = np.zeros(at[-1], np.uint64)
    np.bitwise_xor.at(bits, at[owner] + (bin_ >> 6), np.uint64(1) << (bin_ & 63).astype(np.uint64))
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(bits.view(np.int64)))


def _may_link(a: str, b: str, num: int, den: int):
    """A necessary condition on two rows with n and sketch: odd bins never outnumber the elements in which the sets differ."""
    na, nb, sa, sb = (F.col(c) for c in (f"n_{a}", f"n_{b}", f"sketch_{a}", f"sketch_{b}"))
    k = F.least(F.size(sa), F.size(sb))
    folded = lambda s: F.when(F.size(s) == k, s).otherwise(F.zip_with(F.slice(s, F.lit(1), k), F.slice(s, k + 1, k), lambda x, y: x.bitwiseXOR(y)))
    odd = F.aggregate(F.zip_with(folded(sa), folded(sb), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return (F.least(na, nb) * den >= F.greatest(na, nb) * num) & (odd * (den + num) <= (na + nb) * (den - num))


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, set_hash, sketch) of every document."""

    def run(batches):
        for piece, values, bounds in _sets(batches, size):
            columns = [_column(piece, "doc_id"), pa.array(np.diff(bounds)), pa.array(_set_hash(values, bounds).view(np.int64)), _sketches(values, bounds)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_hash", "sketch"])

    return in_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_hash long, sketch array<long>")


def index_rows(docs: DataFrame, size: int, starts: np.ndarray, plan: list[Scheme], num: int, den: int) -> DataFrame:
    """(key, vertex): the index entries of every non-empty set."""
    high, largest, twos, weight, others = np.array([(p.high, p.largest, p.twos, p.weight, p.others) for p in plan], np.int64).reshape(-1, 5).T
    # A set belongs to its own band and to as many lower ones as still let it in.
    reach = max((int(np.searchsorted(starts, p.largest, "right")) - 1 - i for i, p in enumerate(plan)), default=0)

    def entries(values, bounds, vertices):
        n = np.diff(bounds)
        band = np.searchsorted(starts, n, "right") - 1
        for back in range(reach + 1):
            scheme = band - back
            some = np.flatnonzero((scheme >= 0) & (n > 0) & (n <= largest[np.maximum(scheme, 0)]))
            if not len(some):
                continue
            of = scheme[some]
            t, w, m = twos[of], weight[of], twos[of] + others[of]
            base = np.concatenate([[0], np.cumsum(m)])
            owner = np.repeat(np.arange(len(some)), n[some])
            pick = np.arange(len(owner)) + np.repeat(bounds[:-1][some] - np.concatenate([[0], np.cumsum(n[some])])[:-1], n[some])
            element = K.mix(values[pick] ^ np.uint64(0xA5A5A5A5))
            cell = ((element >> np.uint64(32)) * (t * w + others[of]).astype(np.uint64)[owner] >> np.uint64(32)).astype(np.int64)
            heavy = (t * w)[owner]
            in_two = cell < heavy
            segment = base[owner] + np.where(in_two, cell // w[owner], cell - heavy + t[owner])
            element = K.mix(element)
            sums = np.zeros(base[-1], np.uint64)
            np.add.at(sums, segment, element)
            whose = np.repeat(np.arange(len(some)), m)
            within = np.arange(base[-1]) - base[whose]
            tag = K.mix(of[whose].astype(np.uint64) * np.uint64(1 << 32) + within.astype(np.uint64))
            keys, filled = K.mix(sums ^ tag), np.bincount(segment, minlength=base[-1])
            # Segments of allowance 2 come first, then the fullest; a set indexes all of the former and as many of the latter as it needs.
            wanted = t + indexed_segments(n[some], (high[of], largest[of], t), num, den)
            order = np.lexsort((keys, -filled, within >= t[whose], whose))
            rank = np.arange(base[-1]) - base[whose]
            kept = order[rank < wanted[whose]]
            yield keys[kept], vertices[some][whose[kept]]
            if in_two.any():
                at = segment[in_two]
                yield K.mix((sums[at] - element[in_two]) ^ tag[at]), vertices[some][owner[in_two]]

    def run(batches):
        seen: set[int] = set()
        for piece, values, bounds in _sets(batches, size):
            vertices = _set_hash(values, bounds)
            fresh = np.zeros(len(vertices), bool)
            for i, v in enumerate(vertices.tolist()):
                if v not in seen:
                    fresh[i] = True
                    if len(seen) < _SEEN:
                        seen.add(v)
            keep = np.repeat(fresh, np.diff(bounds))
            sizes = np.where(fresh, np.diff(bounds), 0)
            for keys, vertex in entries(values[keep], np.concatenate([[0], np.cumsum(sizes)]), vertices):
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(vertex.view(np.int64))], ["key", "vertex"])

    return in_batches(docs).select("doc_id", "text").mapInArrow(run, "key long, vertex long")


def _with_set_hash(docs: DataFrame, size: int) -> DataFrame:
    """(vertex, text): each document's text beside the hash of its set."""

    def run(batches):
        for piece, values, bounds in _sets(batches, size):
            yield pa.RecordBatch.from_arrays([pa.array(_set_hash(values, bounds).view(np.int64)), _column(piece, "text")], ["vertex", "text"])

    return in_batches(docs).select("text").mapInArrow(run, "vertex long, text string")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Of the pairs (a, b) of vertices those that link, by exact intersection of the sets of their texts.

    Texts travel to the pairs, not sets: they compress, hashes do not.
    """
    left = texts.select(F.col("vertex").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("vertex").alias("b"), F.col("text").alias("text"))

    def run(batches):
        for piece, values, bounds in _sets(batches, size):
            words, rows = K.word_hashes(_column(piece, "text_a"))
            shingles, other = K.shingle_hashes(words, rows, size)
            linked = np.zeros(len(bounds) - 1, bool)
            for r in range(len(linked)):
                one, two = values[bounds[r] : bounds[r + 1]], np.unique(shingles[other[r] : other[r + 1]])
                if min(len(one), len(two)) * den >= max(len(one), len(two)) * num:
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    linked[r] = both > 0 and both * den >= (len(one) + len(two) - both) * num
            some = pa.array(np.flatnonzero(linked))
            yield pa.RecordBatch.from_arrays([_column(piece, "a").take(some), _column(piece, "b").take(some)], ["a", "b"])

    return in_batches(pairs).join(left, "a").join(right, "b").select("a", "b", "text_a", "text").mapInArrow(run, "a long, b long")


def _only(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of docs whose key is in ids (a written table): by broadcast up to BROADCAST_IDS of them, else by a shuffle."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_semi")


def ngram_jaccard_components(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document: its shingle count and the smallest doc_id that links reach."""
    members = staged(shingle_sets(docs, size), "jaccard-members")
    filled = members.where("n_shingles > 0")
    firsts = [F.first(c).alias(c) for c in ("n_shingles", "sketch")]
    vertices = staged(filled.groupBy(F.col("set_hash").alias("vertex")).agg(F.min("doc_id").alias("rep"), *firsts), "jaccard-vertices")
    largest = filled.agg(F.max("n_shingles")).first()[0] or 0
    starts = size_bands(largest)
    bands = F.lit(-1)
    for s in starts.tolist():
        bands = bands + (F.col("n_shingles") >= s).cast("int")
    counts = {r[0]: r[1] for r in filled.groupBy(bands.alias("band")).count().collect()}  # a row a band
    plan = allocate(starts, counts, num, den)

    rows = index_rows(docs, size, starts, plan, num, den)
    shared = staged(
        rows.groupBy("key").agg(F.min("vertex").alias("hub"), F.max("vertex").alias("far")).where("hub <> far").select("key", "hub"), "jaccard-shared"
    )
    # Dealt by both columns, so that the rows of a common key do not meet in one task.
    bucketed = staged(rows.join(shared, "key").repartition("key", "vertex").distinct(), "jaccard-bucketed")
    described = lambda c: vertices.select(F.col("vertex").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    pairs = bucketed.where("vertex <> hub").select(F.col("hub").alias("a"), F.col("vertex").alias("b")).distinct()
    hubs = staged(pairs.join(described("a"), "a").join(described("b"), "b").where(_may_link("a", "b", num, den)).select("a", "b"), "jaccard-hubs")

    def texts_of(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("vertex")).distinct().join(vertices, "vertex")
        wanted = staged(ends.select("vertex", F.col("rep").alias("doc_id")), "jaccard-wanted")
        named = _with_set_hash(_only(docs.select("doc_id", "text"), wanted.select("doc_id"), "doc_id"), size)
        return staged(named.join(wanted.select("vertex"), "vertex", "left_semi"), "jaccard-texts")

    links = staged(_verified(hubs, texts_of(hubs), size, num, den).distinct(), "jaccard-links")
    parts = connected_components(links)

    def open_rows(parts: DataFrame) -> DataFrame:
        """The rows of the keys that hold several components beside their hub, which is tested."""
        placed = bucketed.where("vertex <> hub").join(parts.withColumnRenamed("node", "vertex"), "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
        placed = staged(placed, "jaccard-placed")
        # Written before the join, so that Spark can split the rows of a common key there.
        several = staged(placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key"), "jaccard-several")
        out = staged(placed.join(several, "key", "left_semi").select("key", "vertex", "component"), "jaccard-open")
        discard(placed, several)
        return out

    # Stars: each open key tests one member of its largest component against the members of the others.
    for turn in range(STAR_ROUNDS):
        left = open_rows(parts)
        per = left.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.min_by("vertex", F.xxhash64("key", "vertex", F.lit(turn))).alias("a"))
        stars = staged(per.groupBy("key").agg(F.max_by(F.struct("a", "component"), F.struct("c", "component")).alias("star")), "jaccard-stars")
        tested = left.join(stars, "key").where("component <> star.component").select("star.a", F.col("vertex").alias("b")).distinct()
        tested = staged(tested.join(described("a"), "a").join(described("b"), "b").where(_may_link("a", "b", num, den)).select("a", "b"), "jaccard-star")
        discard(left, stars)
        if not tested.limit(1).count():
            break
        found = staged(_verified(tested, texts_of(tested), size, num, den), "jaccard-found")
        if found.limit(1).count():
            links = staged(links.union(found).distinct(), "jaccard-links")
            parts = connected_components(links)

    # What is left: every pair across the components of a key.
    left = open_rows(parts).join(vertices.select("vertex", "n_shingles", "sketch"), "vertex")
    side = lambda c: left.select("key", F.col("vertex").alias(c), F.col("component").alias(f"c{c}"), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    rest = side("a").join(side("b"), "key").where((F.col("ca") != F.col("cb")) & (F.col("a") < F.col("b")) & _may_link("a", "b", num, den))
    rest = staged(rest.select("a", "b").distinct(), "jaccard-rest")
    more = rest if not rest.limit(1).count() else staged(_verified(rest, texts_of(rest), size, num, den).distinct(), "jaccard-more")
    if more.limit(1).count():
        parts = connected_components(links.union(more))

    named = vertices.join(parts, vertices.vertex == parts.node, "left").select("vertex", "rep", F.coalesce("component", "vertex").alias("component"))
    named = staged(named, "jaccard-named")
    least = staged(named.groupBy("component").agg(F.min("rep").alias("component_id")), "jaccard-least")
    final = staged(named.join(least, "component").select(F.col("vertex").alias("set_hash"), "component_id"), "jaccard-final")
    discard(shared, bucketed, hubs, links, rest, more, named, least)
    return members.drop("sketch").join(final, "set_hash", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def op10_ngram_jaccard_join(spark, sf_dir):
    return ngram_jaccard_components(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh
  FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM e a JOIN e b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM p WHERE 100 * c >= 90 * (na + nb - c)
), reach(doc_id, comp) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.comp FROM reach r JOIN l ON l.a = r.doc_id
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(r.comp) AS component_id
FROM s JOIN reach r USING (doc_id) GROUP BY s.doc_id, s.sh
"""
