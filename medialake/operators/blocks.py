"""Long signals as blocks of rows: frames, spectra, delays and alignment without a row or a task that holds a whole signal.

A signal is rows (id columns, start, samples): stretches of any length with the place of their first sample; what no row covers is
silence. Work that looks beyond a stretch gets its neighbours' edges first: `spans` deals each stretch to all spans that it touches, so a
signal of any length is worked on by as many tasks as it has spans.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 18


def lengths(signal: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): the samples up to each signal's end."""
    return signal.groupBy(*keys).agg(F.max(F.col("start") + F.size("samples")).cast("long").alias("n"))


def spans(signal: DataFrame, keys: list[str], size: int, before: int = 0, after: int = 0, first: int = 0) -> DataFrame:
    """(keys, nth, samples): span nth reaches from nth * size - before to (nth + 1) * size + after, from span first on. Samples begin
    at the span's begin; silence behind the last one may be missing."""
    end = F.col("start") + F.size("samples")
    touched = F.sequence(F.greatest(F.floor((F.col("start") - after) / size), F.lit(first)), F.ceil((end + before) / size) - 1)
    parts = signal.where(F.size("samples") > 0).where(F.ceil((end + before) / size) - 1 >= first).withColumn("nth", F.explode(touched))
    lead = F.col("start") - (F.col("nth") * size - before)
    skip, last = F.greatest(F.lit(0), -lead), F.least(F.lit(size + before + after) - lead, F.size("samples"))
    cut = F.slice("samples", (skip + 1).cast("int"), F.greatest(F.lit(0), last - skip).cast("int"))
    parts = parts.select(*keys, "nth", F.struct(F.greatest(F.lit(0), lead).cast("long").alias("at"), cut.alias("v")).alias("part")).where(F.size("part.v") > 0)
    joined = lambda acc, p: F.concat(acc, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), p["at"] - F.size(acc)).cast("int")), p["v"])
    # As many parts as a span has neighbours.
    return parts.groupBy(*keys, "nth").agg(F.array_sort(F.collect_list("part")).alias("parts")).select(*keys, "nth", F.aggregate("parts", F.array().cast("array<double>"), joined).alias("samples"))


def framed(signal: DataFrame, keys: list[str], size: int, hop: int, of: Callable[[np.ndarray], np.ndarray], ends: str = "cover", block: int = BLOCK) -> DataFrame:
    """(keys, frame, values): of((frames, size)) for frames of size every hop, the k-th around sample k * hop with silence beyond both
    ends. ends: cover goes on until a frame's middle reaches the end, inside stops at the last k * hop that is not beyond it."""
    block = -(-block // hop) * hop
    back = (size + 1) // 2
    each = lengths(signal, keys)
    last = F.ceil((F.col("n") + size % 2) / hop) if ends == "cover" else F.floor(F.col("n") / hop)
    rows = spans(signal, keys, block, back, size - back).join(each.select(*keys, last.cast("long").alias("last"), F.floor((F.col("n") - 1) / block).alias("end")), keys)
    # The last frames may lie behind the last span that starts inside the signal; they go with it.
    rows = rows.where("nth <= end")
    fields = rows.select(*keys).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                nth, samples, last, end = (batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("nth", "samples", "last", "end"))
                lo = nth * block // hop
                hi = last + 1 if nth == end else min(last + 1, (nth + 1) * block // hop)
                for a in range(lo, hi, 1024):
                    k = np.arange(a, min(hi, a + 1024))
                    held = np.zeros((k[-1] - lo) * hop + size)
                    held[: len(samples)] = samples[: len(held)]
                    values = of(held[((k - lo) * hop)[:, None] + np.arange(size)])
                    own = [pa.array([batch.column(batch.schema.get_field_index(f.name))[i].as_py()] * len(k), batch.schema.field(f.name).type) for f in fields]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(k), pa.array(list(values), pa.list_(pa.float64()))], [f.name for f in fields] + ["frame", "values"])

    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return rows.mapInArrow(run, f"{named}, frame long, values array<double>")


def hann(size: int) -> np.ndarray:
    """The symmetric window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size - 1)) if size > 1 else np.ones(1)


def power_spectrum(signal: DataFrame, keys: list[str], size: int = 512, hop: int = 256, block: int = BLOCK) -> DataFrame:
    """(keys, frame, values): squared magnitudes of size // 2 + 1 bins of each windowed frame."""
    window = hann(size)
    return framed(signal, keys, size, hop, lambda frames: np.abs(np.fft.rfft(frames * window, axis=1)) ** 2, "cover", block)


# The mel scale is linear (3 mels each 200 Hz) up to 1000 Hz and logarithmic above (27 steps to 6400 Hz).
_LINEAR, _CORNER, _STEP = 3 / 200, 1000.0, math.log(6.4) / 27


def mels(hertz: np.ndarray) -> np.ndarray:
    return np.where(hertz < _CORNER, hertz * _LINEAR, _CORNER * _LINEAR + np.log(np.maximum(hertz, _CORNER) / _CORNER) / _STEP)


def hertz(mel: np.ndarray) -> np.ndarray:
    return np.where(mel < _CORNER * _LINEAR, mel / _LINEAR, _CORNER * np.exp((np.maximum(mel, _CORNER * _LINEAR) - _CORNER * _LINEAR) * _STEP))


def mel_bands(size: int, bands: int, rate: int) -> list[tuple[int, list[float]]]:
    """Triangular bands of unit area, evenly spaced in mels from 0 to half the rate: (first bin, weights from it on) of each."""
    edges = hertz(np.linspace(0, mels(np.array(rate / 2.0)), bands + 2))
    bins = np.arange(size // 2 + 1) * (rate / size)
    out = []
    for left, middle, right in zip(edges, edges[1:], edges[2:]):
        weights = np.maximum(0, np.minimum((bins - left) / (middle - left), (right - bins) / (right - middle))) * 2 / (right - left)
        some = np.flatnonzero(weights)
        out.append((int(some[0]), weights[some[0] : some[-1] + 1].tolist()) if len(some) else (0, []))
    return out


def band_sums(values: Column, bands: list[tuple[int, list[float]]]) -> Column:
    """The weighted sum of each band's own bins: a sparse product within the row, with no shuffle."""
    table = F.array(*[F.struct(F.lit(first).alias("first"), F.array(*map(F.lit, weights)).cast("array<double>").alias("weights")) for first, weights in bands])
    return F.transform(table, lambda b: F.aggregate(b["weights"], F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("sum")), lambda a, w: F.struct((a["i"] + 1).alias("i"), (a["sum"] + w * F.get(values, b["first"] + a["i"])).alias("sum")))["sum"])


def log_mel(signal: DataFrame, keys: list[str], rate: int = 16_000, size: int = 512, hop: int = 256, bands: int = 96, scale: float = 10_000.0, block: int = BLOCK) -> DataFrame:
    """(keys, frame, values): log10(1 + scale * energy) of each mel band of each frame."""
    power = power_spectrum(signal, keys, size, hop, block)
    return power.withColumn("values", F.transform(band_sums(F.col("values"), mel_bands(size, bands, rate)), lambda x: F.log10(1 + scale * x)))


def constant_q(signal: DataFrame, keys: list[str], rate: int, hop: int, lowest: float, bins: int, octave: int = 12, block: int = BLOCK) -> DataFrame:
    """(keys, frame, values): magnitudes of bins tones, octave of them to an octave from lowest on, each over a window of as many periods
    as set it off from the next tone."""
    periods = 1 / (2 ** (1 / octave) - 1)
    tones = lowest * 2 ** (np.arange(bins) / octave)
    if tones[-1] > rate / 2:
        raise ValueError("the highest tone is above half the rate")
    widths = np.ceil(periods * rate / tones).astype(int)
    size = int(widths[0])
    kernels = np.zeros((bins, size), complex)
    for kernel, tone, width in zip(kernels, tones, widths):
        at = (size - width) // 2
        window = hann(width)
        kernel[at : at + width] = window / window.sum() * np.exp(-2j * np.pi * tone / rate * np.arange(width))
    return framed(signal, keys, size, hop, lambda frames: np.abs(frames @ kernels.T), "cover", block)


def cut_to(signal: DataFrame, keys: list[str], ends: DataFrame) -> DataFrame:
    """The samples before each signal's n of ends (keys, n); its other columns come along."""
    rows = signal.join(ends, keys).where("start < n")
    return rows.withColumn("samples", F.slice("samples", F.lit(1), F.greatest(F.lit(0), F.least(F.col("n") - F.col("start"), F.size("samples"))).cast("int")))


#: Correlations are compared to this many decimals, so that a transform's rounding decides no tie.
DECIMALS = 9


def delays(reference: DataFrame, query: DataFrame, keys: list[str], rate: int, max_seconds: float = 120.0, block: int = BLOCK) -> DataFrame:
    """(keys, lag): how many samples query must be delayed to fit reference best, within max_seconds either way; the lag of the largest
    correlation of the peak-normalised signals, of several the smallest. Both are compared over their common length, at most
    2 * max_seconds + 10 seconds; less than a second in common gives 0. A signal that only one side has gives no row.

    Block j of the query meets block j + d of the reference and the block behind it; that gives the part of the correlation at lags
    from d * block on which is due to them. Parts of a lag block are added up, so no row is longer than two blocks.
    """
    reach = int(max_seconds * rate)
    both = lengths(reference, keys).withColumnRenamed("n", "n_reference").join(lengths(query, keys).withColumnRenamed("n", "n_query"), keys)
    ends = both.select(*keys, F.least("n_reference", "n_query", F.lit(2 * reach + 10 * rate)).cast("long").alias("n"))
    usable = ends.where(F.col("n") >= rate)
    top = F.max(F.array_max(F.transform("samples", lambda x: F.abs(x))))
    cuts = [cut_to(s.select(*keys, "start", F.col("samples").cast("array<double>").alias("samples")), keys, usable) for s in (reference, query)]
    peaks = [c.groupBy(*keys).agg(top.alias(name)) for c, name in zip(cuts, ("top_reference", "top_query"))]
    scale = peaks[0].join(peaks[1], keys).select(*keys, F.when(F.col("top_reference") < 1e-9, 1.0).otherwise(F.col("top_reference")).alias("a"), F.when(F.col("top_query") < 1e-9, 1.0).otherwise(F.col("top_query")).alias("b"))
    low, high = math.floor(-reach / block), math.floor(reach / block)
    held = spans(cuts[0].select(*keys, "start", "samples"), keys, block, 0, block, -1).withColumn("d", F.explode(F.sequence(F.lit(low), F.lit(high))))
    asked = spans(cuts[1].select(*keys, "start", "samples"), keys, block).withColumnRenamed("samples", "asked")
    pairs = held.withColumn("nth", F.col("nth") - F.col("d")).join(asked, [*keys, "nth"]).select(*keys, "d", "samples", "asked")
    fields = pairs.select(*keys).schema
    width = 1 << (3 * block - 1).bit_length()

    def correlate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                x, y = (np.array(batch.column(batch.schema.get_field_index(c))[i].as_py(), np.float64) for c in ("samples", "asked"))
                part = np.fft.irfft(np.fft.rfft(x, width) * np.conj(np.fft.rfft(y, width)), width)[:block]
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)).slice(i, 1) for c in (*keys, "d")], pa.array([part], pa.list_(pa.float64()))], [*keys, "d", "part"])

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.round(np.sum(np.stack(rows["part"].to_numpy()), axis=0) / (rows["a"].iloc[0] * rows["b"].iloc[0]), DECIMALS)
        lags = int(rows["d"].iloc[0]) * block + np.arange(block)
        total = np.where(np.abs(lags) <= reach, total, -np.inf)
        at = int(np.argmax(total))
        return pd.DataFrame({**{k: [rows[k].iloc[0]] for k in keys}, "lag": [int(lags[at])], "value": [total[at]]})

    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    parts = pairs.mapInArrow(correlate, f"{named}, d int, part array<double>").join(scale, keys)
    found = parts.groupBy(*keys, "d").applyInPandas(best, f"{named}, lag long, value double").where("value > double('-infinity')")
    lags = found.groupBy(*keys).agg(F.max_by("lag", F.struct("value", -F.col("lag"))).alias("lag"))
    return ends.select(*keys).join(lags, keys, "left").withColumn("lag", F.coalesce("lag", F.lit(0).cast("long")))


def onsets(signal: DataFrame, keys: list[str], rate: int, seconds: float, size: int = 2048, hop: int = 512, block: int = BLOCK) -> DataFrame:
    """(keys, onset): the second at which the first frame of the first seconds reaches max(0.18 of the loudest, 0.35 of the 85th
    percentile) of the frames' RMS; 0 in silence and in less than a quarter of a second."""
    clip = int(seconds * rate)
    ends = lengths(signal, keys).select(*keys, F.least("n", F.lit(clip)).cast("long").alias("n"))
    cut = cut_to(signal, keys, ends.where(F.col("n") >= rate // 4)).select(*keys, "start", "samples")
    level = framed(cut, keys, size, hop, lambda frames: np.sqrt((frames**2).mean(axis=1))[:, None], "inside", block).select(*keys, "frame", F.col("values")[0].alias("rms"))
    bars = level.groupBy(*keys).agg(F.max("rms").alias("top"), F.percentile("rms", 0.85).alias("p85"))
    loud = level.join(bars, keys).where((F.col("top") >= 1e-9) & (F.col("rms") >= F.greatest(0.18 * F.col("top"), 0.35 * F.col("p85"))))
    first = loud.groupBy(*keys).agg((F.min("frame") * hop / rate).alias("onset"))
    return ends.select(*keys).join(first, keys, "left").withColumn("onset", F.coalesce("onset", F.lit(0.0)))


#: Shifts of less than half a millisecond are left.
DEAD_SECONDS = 0.0005


def alignment_plan(signals: DataFrame, done: DataFrame, folder: str, role: str, rate: int, max_seconds: float = 120.0, analysis_seconds: float = 180.0, block: int = BLOCK) -> DataFrame:
    """(folder, status, and per stem of the folder: role, pad, trim, shift seconds, target length; onsets of the vocals).

    signals: (folder, role, start, samples) with the roles original, instrumental and acapella, all at rate. done: folders that hold a
    backup of an earlier run, which are skipped. Status is missing (a role is not there), skipped or aligned; the first two have one row
    without figures.
    """
    roles = signals.groupBy(folder).agg(F.collect_set(role).alias("roles"))  # three roles
    missing = F.array_join(F.array_except(F.array(*map(F.lit, ("instrumental", "acapella", "original"))), "roles"), ", ")
    known = roles.select(folder, missing.alias("missing")).join(done.select(folder).distinct().withColumn("done", F.lit(True)), folder, "left")
    known = known.withColumn("status", F.when(F.col("missing") != "", "missing").when(F.col("done"), "skipped").otherwise("aligned"))
    ready = signals.join(known.where("status = 'aligned'").select(folder), folder, "left_semi")
    original = ready.where(F.col(role) == "original")
    stems = ready.where(F.col(role).isin("instrumental", "acapella"))
    heard = int((analysis_seconds + max_seconds) * rate)
    clip = lambda df, keys: cut_to(df, keys, lengths(df, keys).select(*keys, F.least("n", F.lit(heard)).cast("long").alias("n"))).select(*keys, "start", "samples")
    pair = original.select(folder, "start", "samples", F.explode(F.array(F.lit("instrumental"), F.lit("acapella"))).alias(role))
    lag = delays(clip(pair, [folder, role]), clip(stems, [folder, role]), [folder, role], rate, max_seconds, block)
    seconds = F.col("lag") / rate
    lag = lag.withColumn("pad", F.when(seconds >= DEAD_SECONDS, F.col("lag")).otherwise(0)).withColumn("trim", F.when(seconds <= -DEAD_SECONDS, -F.col("lag")).otherwise(0))
    vocals = onsets(ready.where(F.col(role).isin("original", "acapella")).select(folder, role, "start", "samples"), [folder, role], rate, analysis_seconds, block=block)
    both = vocals.groupBy(folder).agg(F.max(F.when(F.col(role) == "original", F.col("onset"))).alias("onset_original"), F.max(F.when(F.col(role) == "acapella", F.col("onset"))).alias("onset_acapella"))
    target = lengths(original, [folder]).withColumnRenamed("n", "target")
    figures = lag.select(folder, role, "pad", "trim", ((F.col("pad") - F.col("trim")) / rate).alias("shift")).join(target, folder).join(both, folder)
    return known.select(folder, "status", "missing").join(figures, folder, "left")


def aligned(stems: DataFrame, plan: DataFrame, folder: str, role: str) -> DataFrame:
    """(folder, role, start, samples): the stems of a plan moved to the original's time line and cut to its length; what is not covered
    up to there is silence."""
    moved = stems.join(plan.where("status = 'aligned'").select(folder, role, "pad", "trim", "target"), [folder, role])
    begin = F.col("start") + F.col("pad") - F.col("trim")
    skip = F.greatest(F.lit(0), -begin)
    n = F.least(F.size("samples").cast("long"), F.col("target") - begin) - skip
    out = moved.where(n > 0).select(folder, role, F.greatest(F.lit(0), begin).cast("long").alias("start"), F.slice("samples", (skip + 1).cast("int"), F.greatest(F.lit(0), n).cast("int")).alias("samples"))
    return out
