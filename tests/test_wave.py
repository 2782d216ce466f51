"""WAVE files out and in: every kind of sample, ranges of one file, gaps, and jobs that fail."""

import os
import tempfile
import wave as stdlib_wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from medialake.sources import wave as S


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-wave-", dir="/tmp")


def blocks(spark, files, size=700):
    rows = []
    for name, samples in files.items():
        rows += [(name, at, [c[at : at + size].tolist() for c in samples]) for at in range(0, samples.shape[1], size)]
    return spark.createDataFrame(rows, "path string, start long, samples array<array<double>>").repartition(3)


def gathered(df):
    out = {}
    for r in df.orderBy("path", "start").collect():
        out.setdefault(os.path.basename(r.path), []).append(np.array(r.samples, float).reshape(len(r.samples), -1))
    return {k: np.concatenate(v, axis=1) for k, v in out.items()}


@pytest.mark.parametrize("subtype", S.KINDS)
def test_round_trip_of_every_kind(spark, folder, subtype):
    rng = np.random.default_rng(1)
    files = {f"f{n}.wav": rng.uniform(-1, 1, (n, 3001)) for n in (1, 2, 5)}
    S.write_wave(blocks(spark, files), folder, 48_000, subtype)
    assert sorted(os.listdir(folder)) == sorted(files)
    got = S.read_wave(spark, folder, partition_bytes=1000, block_frames=128)
    assert got.rdd.getNumPartitions() > 3 and {(r.rate, r.subtype, r.frames) for r in got.collect()} == {(48_000, subtype, 3001)}
    step = 0 if subtype == "DOUBLE" else 1e-7 if subtype == "FLOAT" else 1 / S.KINDS[subtype][2]
    for name, samples in gathered(got).items():
        want = np.clip(files[name], -1, 1 - step) if subtype not in ("FLOAT", "DOUBLE") else files[name]
        assert samples.shape == want.shape and np.abs(samples - want).max() <= step / 2 + 1e-12 if step != 1e-7 else np.abs(samples - want).max() <= step
        again = S.encode(samples, subtype)
        assert S.decode(again, S.Header(1, len(want), subtype, 0, 3001)).tolist() == samples.tolist()


def test_another_reader_agrees(spark, folder):
    samples = np.array([[0.0, 0.5, -0.5, 1.5, -1.5], [0.25, -0.25, 0.125, 0.0, 1 / 65536 * 3]])
    S.write_wave(blocks(spark, {"a/b.wav": samples}), folder)
    with stdlib_wave.open(f"{folder}/a/b.wav") as f:
        assert (f.getnchannels(), f.getframerate(), f.getsampwidth(), f.getnframes()) == (2, 44_100, 2, 5)
        got = np.frombuffer(f.readframes(5), "<i2").reshape(-1, 2).T
    assert got.tolist() == [[0, 16384, -16384, 32767, -32768], [8192, -8192, 4096, 0, 2]]  # half to even, clipped
    with stdlib_wave.open(f"{folder}/std.wav", "wb") as f:
        f.setparams((1, 2, 8_000, 0, "NONE", ""))
        f.writeframes(np.arange(-50, 50, dtype="<i2").tobytes())
    back = gathered(S.read_wave(spark, folder, partition_bytes=64))["std.wav"]
    assert (back * 32_768).tolist() == [list(range(-50, 50))]


def test_gaps_overlaps_and_guard(spark, folder):
    rows = [("x.wav", 5, [[0.5, 0.5]]), ("x.wav", 0, [[0.25] * 3]), ("x.wav", 6, [[-0.5, -0.5]]), ("loud.wav", 0, [[2.0, -4.0]])]
    df = spark.createDataFrame(rows, "path string, start long, samples array<array<double>>")
    S.write_wave(df, folder, subtype="DOUBLE", guard=True)
    got = gathered(S.read_wave(spark, folder))
    assert got["x.wav"].tolist() == [[0.25] * 3 + [0, 0, 0.5, 0.5, -0.5]] and got["loud.wav"].tolist() == [[0.495, -0.99]]


def test_a_failed_job_leaves_nothing(spark, folder):
    samples = np.zeros((1, 2000))
    S.write_wave(blocks(spark, {"old.wav": samples}), folder)
    bad = blocks(spark, {"new.wav": samples, "old.wav": samples + 0.5, "../out.wav": samples})
    with pytest.raises(Exception):
        S.write_wave(bad, folder)
    assert os.listdir(folder) == ["old.wav"] and not gathered(S.read_wave(spark, folder))["old.wav"].any()
    split = blocks(spark, {"two.wav": samples}, 100).withColumns({"channels": F.lit(1), "frames": F.lit(2000).cast("long")})
    with pytest.raises(Exception):
        split.select("path", "channels", "frames", "start", "samples").repartition(4).write.format("wave").mode("append").save(folder)
    assert os.listdir(folder) == ["old.wav"]


def test_unreadable_and_empty(spark, folder):
    for name, raw in (("a.wav", b""), ("b.wav", b"RIFF\0\0\0\0WAVE"), ("c.wav", b"junk" * 9), ("d.wav", S.header_bytes(8000, 2, "PCM_24", 0)), ("e.WAV", S.header_bytes(8000, 1, "PCM_16", 1000) + b"\1\0\2"), ("_f.wav", b"x"), ("g.txt", b"x")):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(raw)
    got = {os.path.basename(r.path): (r.rate, r.frames, r.samples) for r in S.read_wave(spark, folder).collect()}
    none = (None, None, None)
    assert got == {"a.wav": none, "b.wav": none, "c.wav": none, "d.wav": (8000, 0, [[], []]), "e.WAV": (8000, 1, [[1 / 32_768]])}
    assert S.read_wave(spark, tempfile.mkdtemp(prefix="spark-wave-", dir="/tmp")).count() == 0
