"""Block-wise signal operators against the whole signal in one array."""

import numpy as np
import pytest

from medialake.operators import blocks as B


def rows(spark, signals, step=333, gap=()):
    """Stretches of uneven length; stretches that begin in gap are left out."""
    out = []
    for key, x in signals.items():
        at = 0
        while at < len(x):
            n = step + at % 97
            if at not in gap:
                out.append((key, at, x[at : at + n].tolist()))
            at += n
    return spark.createDataFrame(out, "id int, start long, samples array<double>").repartition(3)


def whole_frames(x, size, hop, ends):
    back = (size + 1) // 2
    last = -(-(len(x) + size % 2) // hop) if ends == "cover" else len(x) // hop
    padded = np.concatenate([np.zeros(back), x, np.zeros(size + hop)])
    return np.stack([padded[k * hop : k * hop + size] for k in range(last + 1)])


@pytest.mark.parametrize("size,hop,ends,block", [(64, 16, "cover", 200), (51, 20, "cover", 40), (64, 100, "inside", 128), (512, 160, "inside", 100)])
def test_frames_over_blocks(spark, size, hop, ends, block):
    rng = np.random.default_rng(size)
    signals = {1: rng.normal(size=2000), 2: rng.normal(size=37), 3: rng.normal(size=1)}
    got = B.framed(rows(spark, signals), ["id"], size, hop, lambda f: f, ends, block).collect()
    for key, x in signals.items():
        mine = sorted((r.frame, r["values"]) for r in got if r.id == key)
        want = whole_frames(x, size, hop, ends)
        assert [f for f, _ in mine] == list(range(len(want)))
        assert np.allclose(np.array([v for _, v in mine]), want)


def test_spectra(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=9000) * 0.1
    got = B.log_mel(rows(spark, {1: x}), ["id"], block=2048).orderBy("frame").collect()
    power = np.abs(np.fft.rfft(whole_frames(x, 512, 256, "cover") * B.hann(512), axis=1)) ** 2
    bank = np.zeros((96, 257))
    for row, (first, weights) in zip(bank, B.mel_bands(512, 96, 16_000)):
        row[first : first + len(weights)] = weights
    assert np.allclose([r["values"] for r in got], np.log10(1 + 10_000 * power @ bank.T), atol=1e-9)
    assert np.allclose(B.hertz(B.mels(np.array([0.0, 300, 1000, 5000]))), [0, 300, 1000, 5000])
    # The area of a band that spans many bins is one.
    assert abs(bank[-1].sum() * 16_000 / 512 - 1) < 0.02


def test_a_tone_is_in_its_constant_q_bin(spark):
    rate, tone = 8000, 110 * 2 ** (7 / 12)
    x = np.sin(2 * np.pi * tone / rate * np.arange(12_000))
    got = B.constant_q(rows(spark, {1: x}), ["id"], rate, 500, 110, 24, block=3000).orderBy("frame").collect()
    middle = np.array([r["values"] for r in got])[6:-6]
    assert (middle.argmax(axis=1) == 7).all() and np.allclose(middle[:, 7], 0.5, atol=0.01)
    with pytest.raises(ValueError):
        B.constant_q(rows(spark, {1: x}), ["id"], rate, 500, 110, 99)


@pytest.mark.parametrize("block", [64, 500, 5000])
def test_delays_equal_one_transform(spark, block):
    rng = np.random.default_rng(block)
    base = {k: rng.normal(size=4000) for k in range(4)}
    shift = {0: 0, 1: 137, 2: -211, 3: 390}
    query = {k: np.concatenate([np.zeros(max(0, s)), x])[max(0, -s) :] * 0.3 + 0.2 * rng.normal(size=len(x) + s) for (k, x), s in zip(base.items(), shift.values())}
    got = {r.id: r.lag for r in B.delays(rows(spark, base), rows(spark, query), ["id"], 100, 4, block).collect()}
    for k, x in base.items():
        n = min(len(x), len(query[k]), 1800)
        full = np.correlate(x[:n], query[k][:n], "full")
        lags = np.arange(-n + 1, n)
        assert got[k] == lags[np.abs(lags) <= 400][full[np.abs(lags) <= 400].argmax()] == -shift[k]


def test_delays_of_odd_signals(spark):
    x = np.random.default_rng(1).normal(size=500)
    one = rows(spark, {1: x, 2: x[:50], 3: np.zeros(500), 4: x, 5: x})
    two = rows(spark, {1: x, 2: x, 3: x, 4: np.zeros(500)})
    assert {r.id: r.lag for r in B.delays(one, two, ["id"], 100, 4, 128).collect()} == {1: 0, 2: 0, 3: -400, 4: -400}
    assert B.delays(one.limit(0), two, ["id"], 100, 4, 128).count() == 0


def test_onsets(spark):
    x = np.concatenate([np.zeros(3000), np.ones(5000)])
    got = {r.id: r.onset for r in B.onsets(rows(spark, {1: x, 2: np.zeros(4000), 3: np.ones(100), 4: np.ones(4000)}), ["id"], 1000, 30, block=700).collect()}
    level = np.sqrt((whole_frames(x, 2048, 512, "inside") ** 2).mean(axis=1))
    bar = max(0.18 * level.max(), 0.35 * np.percentile(level, 85))
    assert got == {1: float((level >= bar).argmax()) * 512 / 1000, 2: 0.0, 3: 0.0, 4: 0.0}


def test_gaps_are_silence(spark):
    x = np.arange(1.0, 1501)
    gapped = x.copy()
    gapped[333 : 333 + 333 + 333 % 97] = 0
    got = B.framed(rows(spark, {1: x}, gap={333}), ["id"], 100, 50, lambda f: f, "cover", 250).orderBy("frame").collect()
    assert np.allclose([r["values"] for r in got], whole_frames(gapped, 100, 50, "cover"))
