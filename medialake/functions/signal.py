"""Signal measures on numeric arrays: one row, one signal."""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELTA = 1e-7
SILENCE = 1e-4


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def let(value: Column, then) -> Column:
    """then(value) with value evaluated once, also inside lambdas over long arrays."""
    return F.transform(F.array(value), then)[0]


def centred(v: Column) -> Column:
    return let(total(v) / F.size(v), lambda mean: F.transform(v, lambda x: x - mean))


def rms(v: Column) -> Column:
    return F.sqrt(dot(v, v) / F.size(v))


def peak(v: Column) -> Column:
    return F.array_max(F.transform(v, lambda x: F.abs(x)))


def si_sdr(reference: Column, estimate: Column) -> Column:
    """Scale-invariant signal-to-distortion ratio in dB of equally long, centred signals; minus infinity for a silent reference."""
    rr, re, ee = dot(reference, reference), dot(reference, estimate), dot(estimate, estimate)
    target = re * re / rr
    return F.when(rr <= DELTA, float("-inf")).otherwise(10 * F.log10((target + DELTA) / (F.greatest(ee - target, F.lit(0.0)) + DELTA)))


def windows(n: Column, seg: int, hop: int | None = None) -> Column:
    """array<struct<start, end>>: segments of seg every hop; a trailing stub below a quarter is dropped unless it is the first; stops
    where a segment reaches the end."""
    hop = hop or seg
    last = F.greatest(F.ceil((n - seg) / F.lit(float(hop))), F.lit(0)).cast("int")
    all_ = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * hop).alias("start"), F.least(i * hop + seg, n.cast("int")).alias("end")))
    kept = F.filter(all_, lambda w, i: (i == 0) | ((w["end"] - w["start"] >= max(1, seg // 4)) & (w["start"] < n)))
    return F.when(n > 0, kept).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def chunks(n: Column, size: int) -> Column:
    """Starts of half-overlapping chunks; one more where the tail is not covered."""
    stride = size // 2
    k = F.greatest(F.floor((n - size) / F.lit(float(stride))) + 1, F.lit(1))
    k = F.when((k - 1) * stride + size < n, k + 1).otherwise(k)
    return F.transform(F.sequence(F.lit(0), (k - 1).cast("int")), lambda i: i * stride)


def even_starts(n: Column, size: int, k: int = 3) -> Column:
    """Starts of k evenly spaced clips; all 0 in a short signal."""
    step = F.greatest(n - size, F.lit(0)) / F.lit(float(k - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * step).cast("int"))


def patch_starts(n: Column, size: int = 128, hop: int = 62) -> Column:
    """Starts of patches, the last one left out; one at 0 in a short signal."""
    k = F.floor((n - size) / F.lit(float(hop))).cast("int")
    return F.when(k >= 1, F.transform(F.sequence(F.lit(0), k - 1), lambda i: i * hop)).otherwise(F.array(F.lit(0)))


def linspace_starts(n: Column, size: int, k: int) -> Column:
    """k starts from 0 to the last possible one, rounded down."""
    room = F.greatest(n - size, F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * room / F.lit(float(max(1, k - 1)))).cast("int"))


def whole_chunks(n: Column, size: int) -> Column:
    k = F.floor(n / F.lit(float(size))).cast("int")
    return F.when(k > 0, F.transform(F.sequence(F.lit(0), k - 1), lambda i: i * size)).otherwise(F.array().cast("array<int>"))


def shifted(v: Column, by: Column, dead: int = 0) -> Column:
    """Padded at the front (by > 0) or trimmed (by < 0); shifts within the dead band leave the signal."""
    padded = F.concat(F.array_repeat(F.lit(0.0), F.greatest(by, F.lit(0))), v)
    trimmed = F.slice(v, 1 - F.least(by, F.lit(0)), F.size(v))
    return F.when(F.abs(by) <= dead, v).when(by > 0, padded).otherwise(trimmed)


def fitted(v: Column, n: Column) -> Column:
    """Cut or zero-padded to n values."""
    return F.concat(F.slice(v, F.lit(1), n), F.array_repeat(F.lit(0.0), F.greatest(n - F.size(v), F.lit(0))))


def onset(v: Column, frame: int) -> Column:
    """Index of the first frame whose RMS reaches max(0.18 peak, 0.35 of the 85th percentile); null in silence."""
    k = F.floor(F.size(v) / F.lit(float(frame))).cast("int")
    levels = F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), lambda i: rms(F.slice(v, i * frame + 1, F.lit(frame))))
    return let(levels, _first_loud)


def _first_loud(level: Column) -> Column:
    ordered = F.array_sort(level)
    at = (F.size(level) - 1) * 0.85
    low, high = F.element_at(ordered, F.floor(at).cast("int") + 1), F.element_at(ordered, F.ceil(at).cast("int") + 1)
    p85 = low + (high - low) * (at - F.floor(at))
    bar = F.greatest(0.18 * F.array_max(level), 0.35 * p85)
    loud = let(bar, lambda least: F.filter(F.transform(level, lambda x, i: F.when((x >= least) & (least > 0), i)), lambda x: x.isNotNull()))
    return F.try_element_at(loud, F.lit(1))


def normalised_peak(v: Column, target_db: float = -1.0) -> Column:
    """Scaled down to the target peak where it is above; never up."""
    target = 10 ** (target_db / 20)
    return let(peak(v), lambda top: F.when(top > target, F.transform(v, lambda x: x * (F.lit(target) / top))).otherwise(v))


def quantised(v: Column, bits: int) -> Column:
    """Clipped to [-1, 1) and rounded to whole steps of the bit depth, without dither."""
    full = float(1 << (bits - 1))
    return F.transform(v, lambda x: F.least(F.greatest(F.rint(x * full), F.lit(-full)), F.lit(full - 1)).cast("int"))


def residual(a: Column, b: Column) -> Column:
    """RMS of the difference over the larger RMS, both cut to the shorter."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    return rms(F.zip_with(x, y, lambda p, q: p - q)) / F.greatest(rms(x), rms(y), F.lit(1e-12))


def peak_bins(v: Column, bins: int) -> Column:
    """Largest magnitude per bin; every value is in a bin, the tail in the last."""
    n = F.size(v)
    edge = lambda b: F.ceil(b * n / F.lit(float(bins))).cast("int")  # noqa: E731  value i is in bin floor(i * bins / n)
    return F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)),
        lambda b: F.coalesce(F.array_max(F.transform(F.slice(v, edge(b) + 1, edge(b + 1) - edge(b)), lambda x: F.abs(x))), F.lit(0.0)),
    )


@F.pandas_udf(T.IntegerType())
def delay(a: pd.Series, b: pd.Series) -> pd.Series:
    """The lag at which b best follows a: the largest value of the full cross-correlation of the peak-normalised signals."""

    def one(x: np.ndarray, y: np.ndarray) -> int:
        x, y = np.asarray(x, float), np.asarray(y, float)
        if not len(x) or not len(y) or not np.abs(x).max() or not np.abs(y).max():
            return 0
        size = 1 << int(np.ceil(np.log2(len(x) + len(y) - 1)))
        full = np.fft.irfft(np.fft.rfft(x / np.abs(x).max(), size) * np.conj(np.fft.rfft(y / np.abs(y).max(), size)), size)
        lags = np.concatenate([np.arange(len(x)), np.arange(-len(y) + 1, 0)])
        values = np.concatenate([full[: len(x)], full[size - len(y) + 1 :]])
        return int(-lags[int(np.argmax(np.round(values, 12)))])

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="int32")


def fade_window(at: Column, size: int, overlap: int) -> Column:
    """Weight at a place of a segment: 1 with linear fades from 0 over the first and the last overlap places."""
    step = max(overlap - 1, 1)
    ramp = F.when(at >= size - overlap, (size - 1 - at) / step).when(at < overlap, at / step).otherwise(1.0)
    return ramp if overlap > 0 else F.lit(1.0)


def resampled(values: Column, up: int, down: int) -> Column:
    """The signal at up / down times its rate: a Kaiser-windowed low-pass of 20 periods of the slower rate, zeros beyond the ends."""
    common = gcd(up, down)
    up, down = up // common, down // common
    if up == down:
        return values
    half = 10 * max(up, down)
    at = np.arange(-half, half + 1)
    taps = np.sinc(at / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    taps = F.array(*[F.lit(float(x)) for x in taps / taps.sum() * up])
    n = F.size(values)

    def sample(i: Column) -> Column:
        first = F.greatest(F.lit(0), F.ceil((i * down - half) / up).cast("int"))
        last = F.least(n - 1, F.floor((i * down + half) / up).cast("int"))
        return F.aggregate(F.sequence(first, last), F.lit(0.0), lambda total, k: total + F.get(values, k) * F.get(taps, (i * down - k * up + half).cast("int")))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.ceil(n * up / down).cast("int") - 1), sample)).otherwise(F.array().cast("array<double>"))


def collapsed_shares(shares: Column, groups: dict[str, str], kept: tuple[str, ...], rest: str) -> Column:
    """A map of shares by source summed to the kept sources, the others to rest, scaled to sum to 1."""
    entries = F.map_entries(shares)
    of = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    to = lambda k: F.coalesce(F.try_element_at(of, k), F.lit(rest))
    every = F.aggregate(entries, F.lit(0.0), lambda a, e: a + e["value"])
    each = lambda name: F.aggregate(F.filter(entries, lambda e: to(e["key"]) == name), F.lit(0.0), lambda a, e: a + e["value"]) / (every + 1e-12)
    return F.create_map(*[x for name in (*kept, rest) for x in (F.lit(name), each(name))])
