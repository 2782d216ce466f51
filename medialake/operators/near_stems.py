"""Near-duplicate stems without all pairs of a song: lossless blocking in a metric space.

Two stems are near when RMS(a - b) < threshold * max(RMS a, RMS b, 1e-12) over their common beginning. With the norms |a|, |b| of that
beginning (at least the floor's), this implies, for d = a - b and every unit vector u,

* | |a| - |b| | <= |d| < threshold * max: the norms lie in the same or in neighbouring bands of ratio 1 - threshold;
* the sum of (<a, u> - <b, u>)^2 over orthogonal unit vectors u is at most |d|^2: the points that these products are lie in a ball of
  radius W = threshold * the greatest norm of the longer stem's band.

Each stem has PROJECTIONS such numbers, on unit vectors with signs from a hash, each on its own share of the places and so orthogonal,
in cells of width 2 W. One side of the join is the longer stem of a pair, in its own band and cell; the other is asked for in its own
band and the one above, in every cell that the ball around it touches, so an equi-join meets every near pair once. What meets is
narrow: a key, the id, and numbers in single precision. Pairs whose projections and norms of SEGMENTS pieces are too far apart go (the
pieces' norms differ by no more than the pieces do); only then samples are fetched and compared.

Equal stems are joined to the first of them beforehand, so a song of copies makes a link a stem. Stems of other lengths meet at the
shorter length: each is cut to every length of its song up to its own. A song's stems have few lengths; of N different ones there would
be N cuts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signal import dot, let, residual
from ..tables import discard, staged

PROJECTIONS = 5
SEGMENTS = 8
FLOOR = 1e-12


def _projection(v: Column, j: int) -> Column:
    """The product with a unit vector of equal components at every PROJECTIONS-th place and signs from a hash of the place."""
    signed = F.transform(v, lambda x, i: F.when(i % PROJECTIONS != j, 0.0).when(F.pmod(F.xxhash64(i, F.lit(j)), F.lit(2)) == 0, x).otherwise(-x))
    places = F.floor((F.size(v) - 1 - j) / PROJECTIONS) + 1  # none of a short vector
    return F.aggregate(signed, F.lit(0.0), lambda a, x: a + x) / F.sqrt(F.greatest(F.lit(1), places))


def described(stems: DataFrame) -> DataFrame:
    """(song, length, id, norm, p: projections, s: norms of pieces) of every stem at every length of its song up to its own."""
    sizes = stems.groupBy("song").agg(F.collect_set(F.size("v")).alias("lengths"))  # few
    cut = stems.join(sizes, "song").select("song", "id", "v", F.explode(F.filter("lengths", lambda n: (n > 0) & (n <= F.size("v")))).alias("length"))
    cut = cut.withColumn("v", F.slice("v", F.lit(1), F.col("length")))
    norm = F.greatest(F.sqrt(dot(F.col("v"), F.col("v"))), FLOOR * F.sqrt(F.col("length")))
    piece = lambda k: F.slice("v", F.floor(F.col("length") * k / SEGMENTS).cast("int") + 1, (F.floor(F.col("length") * (k + 1) / SEGMENTS) - F.floor(F.col("length") * k / SEGMENTS)).cast("int"))
    pieces = [F.transform(F.array(piece(k)), lambda x: F.sqrt(dot(x, x)))[0] for k in range(SEGMENTS)]
    return cut.select("song", "length", "id", norm.alias("norm"), F.array(*[_projection(F.col("v"), j) for j in range(PROJECTIONS)]).alias("p"), F.array(*pieces).alias("s"))


#: Rounding of the numbers above, and that of single precision, must not lose a pair at the very edge.
SLACK = 1e-9
SINGLE = 1e-6


def _cell(x: Column) -> Column:
    return F.floor(x / (2 * F.col("w")))


def _band(norm: Column, step: float) -> Column:
    return F.floor(F.log(norm) / step).cast("int")


def _in_band(df: DataFrame, band: Column, threshold: float, step: float) -> DataFrame:
    """df with band and w: norms of band k are below exp((k + 1) * step); the logarithm may be off by a rounding."""
    return df.withColumn("band", band).withColumn("w", threshold * F.exp((F.col("band") + 1) * step) * (1 + SLACK))


def asked_cells(known: DataFrame, threshold: float) -> DataFrame:
    """known with band and cells c of every longer stem that can be near: a row for each."""
    step, w = -math.log(1 - threshold), F.col("w")
    # The longer stem is in this one's band or the next; rounding may put it a band off at the edge.
    bands = F.sequence(_band(F.col("norm") * (1 - SLACK), step), _band(F.col("norm") * (1 + SLACK), step) + 1)
    asked = _in_band(known, F.explode(bands), threshold, step)

    def ends(x: Column) -> Column:
        """A cell is 2 W wide, so W around a number reaches its own cell and one neighbour at most; gap is the way to it."""
        end = lambda c, gap: F.struct(c.alias("c"), gap.alias("gap"))
        around = lambda c: let(x - 2 * w * c, lambda off: F.array(end(c, F.lit(0.0)), end(c - 1, off), end(c + 1, 2 * w - off)))
        return F.filter(let(_cell(x), around), lambda e: e["gap"] <= w * (1 + SLACK))

    asked = asked.withColumn("ends", F.transform("p", ends))
    grown = lambda e: lambda start: F.transform(e, lambda one: F.struct(F.concat(start["c"], F.array(one["c"])).alias("c"), (start["q"] + one["gap"] * one["gap"]).alias("q")))
    every = F.array(F.struct(F.array().cast("array<bigint>").alias("c"), F.lit(0.0).alias("q")))
    for j in range(PROJECTIONS):
        every = F.filter(F.flatten(F.transform(every, grown(F.col("ends")[j]))), lambda e: e["q"] <= w * w * (1 + 3 * SLACK))
    return asked.withColumn("c", F.explode(F.transform(every, lambda e: e["c"]))).drop("ends")


def candidates(stems: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: every near pair, and few others."""
    if not 0 < threshold < 1:
        raise ValueError("blocking needs a threshold between 0 and 1")
    step = -math.log(1 - threshold)
    known = staged(described(stems), "stems-described")
    held = _in_band(known, _band(F.col("norm"), step), threshold, step).withColumn("c", F.transform("p", _cell))
    asked = asked_cells(known, threshold)
    # A key stands for song, length, band and cells; a chance meeting is ruled out with the samples.
    single = F.concat("p", "s").cast("array<float>")
    side = lambda df, x: df.select(F.xxhash64("song", "length", "band", "c").alias("key"), F.col("id").alias(x), F.col("norm").alias(f"norm_{x}"), single.alias(f"n_{x}"))
    longest = F.greatest("norm_a", "norm_b")
    far = threshold * longest * (1 + SLACK) + SLACK * FLOOR
    met = side(held, "a").join(side(asked, "b"), "key").where((F.col("a") != F.col("b")) & (F.abs(F.col("norm_a") - F.col("norm_b")) <= far))
    # Beyond single precision nothing is ruled out.
    apart = lambda x, y: F.aggregate(F.zip_with(x, y, lambda m, n: (m.cast("double") - n) * (m.cast("double") - n)), F.lit(0.0), lambda t, z: t + z)
    part = lambda x, lo, n: F.slice(x, lo, n)
    close = lambda lo, n: apart(part("n_a", lo, n), part("n_b", lo, n)) <= (far + SINGLE * longest) * (far + SINGLE * longest)
    met = met.where((longest > 1e37) | (close(1, PROJECTIONS) & close(PROJECTIONS + 1, SEGMENTS)))
    out = staged(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "stems-candidates")
    discard(known)
    return out


def near_pairs(stems: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(a, b) of the pairs of a song's stems (song, id, v: samples) that are near; a < b."""
    samples = lambda x: stems.select(F.col("id").alias(x), F.col("song").alias(f"song_{x}"), F.col("v").alias(f"v{x}"))
    met = candidates(stems, threshold)
    checked = met.join(samples("a"), "a").join(samples("b"), "b").where((F.col("song_a") == F.col("song_b")) & (residual(F.col("va"), F.col("vb")) < threshold)).select("a", "b")
    out = staged(checked, "stems-near")
    discard(met)
    return out


def near_links(stems: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(a, b): links that connect the near stems of each song: every stem that equals others to the first of them, and every near pair
    of different stems. Components over these are those over all pairs."""
    hashed = stems.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), F.reverse("v"))})
    first = hashed.groupBy("song", "h1", "h2").agg(F.min("id").alias("first"))
    named = hashed.join(first, ["song", "h1", "h2"])
    copies = named.where("id <> first and size(v) > 0").select(F.col("first").alias("a"), F.col("id").alias("b"))
    return near_pairs(named.where("id = first").select("song", "id", "v"), threshold).unionByName(copies)
