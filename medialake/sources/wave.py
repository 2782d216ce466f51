"""WAVE files as a Spark data source: blocks of samples in, whole files out.

    spark.dataSource.register(WaveSource)
    spark.read.format("wave").load(folder)           # path, rate, channels, subtype, frames, start, samples
    write_wave(blocks, folder, rate=44_100, subtype="PCM_16")

Reading. Files are cut into ranges of `partitionBytes`, so one long file is read by many tasks; a task takes the frames whose first byte
lies in its range and finds the format in the file's own header. A row is a block of at most `blockFrames` frames with one array of
samples a channel, scaled to -1..1. PCM of 8, 16, 24 and 32 bits and floats of 32 and 64 bits are read; an unreadable file is one row
without samples. Sizes in the header that go beyond the file are cut to it.

Writing. Rows are blocks of a file with their start; `write_wave` brings a file's blocks together in order, and a task streams them, so
it holds one block at a time. Gaps are silence; of blocks that overlap the later one's samples count from where it starts. Integer
formats round half to even and clip. Each file is written under `_temporary` in the target folder and gets its name in the job's
commit by a rename; a task or job that fails leaves none behind.

Folders are reached through Arrow's file systems (file, hdfs, s3, gs), from the tasks themselves.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

BLOCK_FRAMES = 1 << 16
PARTITION_BYTES = 64 << 20
GUARDED = 0.99
SCHEMA = "path string, rate int, channels int, subtype string, frames long, start long, samples array<array<double>>"
_ENDINGS = (".wav", ".wave")

# Format codes, bytes a sample, and full scale by kind of sample.
KINDS = {"PCM_U8": (1, 1, 128.0), "PCM_16": (1, 2, 32_768.0), "PCM_24": (1, 3, 8_388_608.0), "PCM_32": (1, 4, 2_147_483_648.0), "FLOAT": (3, 4, 1.0), "DOUBLE": (3, 8, 1.0)}
_EXTENSIBLE = 0xFFFE


@dataclass
class Header:
    """Where a file's samples are and what they are like."""

    rate: int
    channels: int
    subtype: str
    at: int
    frames: int

    @property
    def width(self) -> int:
        return self.channels * KINDS[self.subtype][1]


def read_header(file, size: int) -> Header | None:
    """The header of an open file; None if it is no WAVE file of a known kind."""
    head = file.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= size:
        file.seek(at)
        name, n = struct.unpack("<4sI", file.read(8))
        at += 8
        if name == b"fmt " and n >= 16:
            raw = file.read(min(n, 40))
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", raw[:16])
            code = struct.unpack("<H", raw[24:26])[0] if code == _EXTENSIBLE and len(raw) >= 26 else code
            form = rate, channels, next((k for k, (c, width, _) in KINDS.items() if (c, 8 * width) == (code, bits)), None)
        elif name == b"data":
            if not form or not form[2] or not form[1]:
                return None
            return Header(*form, at, min(n, size - at) // (form[1] * KINDS[form[2]][1]))
        at += n + n % 2
    return None


def decode(raw: bytes, header: Header) -> np.ndarray:
    """(channels, frames) of samples in -1..1."""
    code, width, full = KINDS[header.subtype]
    if code == 3:
        flat = np.frombuffer(raw, f"<f{width}").astype(np.float64)
    elif width == 1:
        flat = np.frombuffer(raw, np.uint8).astype(np.float64) - 128
    elif width == 3:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        flat = ((parts[:, 2] << 24 | parts[:, 1] << 16 | parts[:, 0] << 8) >> 8).astype(np.float64)
    else:
        flat = np.frombuffer(raw, f"<i{width}").astype(np.float64)
    return (flat / full).reshape(-1, header.channels).T


def encode(samples: np.ndarray, subtype: str) -> bytes:
    """The bytes of (channels, frames)."""
    code, width, full = KINDS[subtype]
    flat = samples.T.ravel()
    if code == 3:
        return flat.astype(f"<f{width}").tobytes()
    whole = np.clip(np.rint(flat * full), -full, full - 1).astype(np.int64)
    if width == 1:
        return (whole + 128).astype(np.uint8).tobytes()
    return whole.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def header_bytes(rate: int, channels: int, subtype: str, frames: int) -> bytes:
    """What stands before the samples; sizes above 4 GB say so by their largest value."""
    code, width, _ = KINDS[subtype]
    size = frames * channels * width
    form = struct.pack("<HHIIHH", code, channels, rate, rate * channels * width, channels * width, 8 * width)
    return b"RIFF" + struct.pack("<I", min(36 + size + size % 2, 0xFFFFFFFF)) + b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", min(size, 0xFFFFFFFF))


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


@dataclass
class Range(InputPartition):
    """The bytes from lo on and before hi of a file."""

    path: str
    size: int
    lo: int
    hi: int


class WaveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.step = int(options.get("partitionbytes", PARTITION_BYTES))
        self.block = int(options.get("blockframes", BLOCK_FRAMES))

    def partitions(self) -> list[Range]:
        """Names and sizes only; headers are read by the tasks."""
        system, folder = _place(self.folder)
        found = system.get_file_info(pafs.FileSelector(folder, recursive=True)) if system.get_file_info(folder).type == pafs.FileType.Directory else [system.get_file_info(folder)]
        out = []
        for info in sorted(found, key=lambda i: i.path):
            hidden = any(part[:1] in "._" for part in posixpath.relpath(info.path, folder).split("/") if part != ".")
            if info.type == pafs.FileType.File and info.path.lower().endswith(_ENDINGS) and not hidden:
                out += [Range(info.path, info.size, lo, min(info.size, lo + self.step)) for lo in range(0, max(info.size, 1), self.step)]
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.float64()))]
        row = lambda *values: pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)
        system, _ = _place(self.folder)
        with system.open_input_file(part.path) as file:
            head = read_header(file, part.size)
            if head is None:
                if not part.lo:
                    yield row(part.path, None, None, None, None, None, None)
                return
            first, last = (min(head.frames, max(0, -(-(x - head.at) // head.width))) for x in (part.lo, part.hi))
            last = head.frames if part.hi >= part.size else last
            for start in range(first, last, self.block):
                n = min(self.block, last - start)
                file.seek(head.at + start * head.width)
                samples = decode(file.read(n * head.width), head)
                yield row(part.path, head.rate, head.channels, head.subtype, head.frames, start, list(samples))
            if not head.frames and not part.lo:
                yield row(part.path, head.rate, head.channels, head.subtype, 0, 0, [[]] * head.channels)


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has written: (temporary name, name)."""

    files: list[tuple[str, str]] = field(default_factory=list)


class WaveWriter(DataSourceWriter):
    """Rows (path, channels, frames, start, samples), each file's together and in order."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.folder, self.rate, self.subtype = options["path"], int(options.get("rate", 44_100)), options.get("subtype", "PCM_16")
        if self.subtype not in KINDS:
            raise ValueError(f"unknown subtype {self.subtype}")
        self.overwrite, self.job = overwrite, uuid.uuid4().hex[:12]

    def _temporary(self, folder: str) -> str:
        return f"{folder}/_temporary/{self.job}"

    def write(self, rows: Iterator) -> Written:
        system, folder = _place(self.folder)
        done, name, stream, at, channels = Written(), None, None, 0, 0
        width = KINDS[self.subtype][1]

        def silence(n: int) -> None:
            empty = encode(np.zeros((channels, min(max(n, 0), BLOCK_FRAMES))), self.subtype)
            while n > 0:
                stream.write(empty[: min(n, BLOCK_FRAMES) * channels * width])
                n -= BLOCK_FRAMES

        def close(frames: int) -> None:
            silence(frames - at)
            stream.write(b"\0" * (frames * channels * width % 2))
            stream.close()

        frames = 0
        try:
            for row in rows:
                if row.path != name:
                    if stream:
                        close(frames)
                    if posixpath.isabs(row.path) or ".." in row.path.split("/"):
                        raise ValueError(f"{row.path} is not a name below the folder")
                    name, at, channels, frames = row.path, 0, row.channels, row.frames
                    held = f"{self._temporary(folder)}/{uuid.uuid4().hex}/{name}"
                    system.create_dir(posixpath.dirname(held), recursive=True)
                    stream = system.open_output_stream(held)
                    done.files.append((held, f"{folder}/{name}"))
                    stream.write(header_bytes(self.rate, channels, self.subtype, frames))
                samples = np.array([list(c) for c in row.samples], np.float64).reshape(channels, -1)[:, max(0, at - row.start) :]
                silence(row.start - at)
                stream.write(encode(samples, self.subtype))
                at = max(at, row.start) + samples.shape[1]
            if stream:
                close(frames)
        except BaseException:
            if stream and not stream.closed:
                stream.close()
            for held, _ in done.files:
                system.delete_file(held)
            raise
        return done

    def commit(self, messages: list[Written]) -> None:
        """Every file gets its name by a rename; what stood there before goes with it."""
        system, folder = _place(self.folder)
        files = [f for m in messages if m for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("the blocks of a file came from several tasks: use write_wave")
        for held, name in files:
            system.create_dir(posixpath.dirname(name), recursive=True)
            system.move(held, name)
        self._clear(system, folder)

    def abort(self, messages: list[Written]) -> None:
        self._clear(*_place(self.folder))

    def _clear(self, system: pafs.FileSystem, folder: str) -> None:
        if system.get_file_info(self._temporary(folder)).type == pafs.FileType.Directory:
            system.delete_dir(self._temporary(folder))
        parent = posixpath.dirname(self._temporary(folder))
        if system.get_file_info(parent).type == pafs.FileType.Directory and not system.get_file_info(pafs.FileSelector(parent)):
            system.delete_dir(parent)


class WaveSource(DataSource):
    """spark.read.format("wave") and df.write.format("wave")."""

    @classmethod
    def name(cls) -> str:
        return "wave"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WaveReader:
        return WaveReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> WaveWriter:
        return WaveWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def read_wave(spark, folder: str, partition_bytes: int = PARTITION_BYTES, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """Blocks of samples of every WAVE file below folder."""
    spark.dataSource.register(WaveSource)
    return spark.read.format("wave").option("partitionBytes", partition_bytes).option("blockFrames", block_frames).load(folder)


def write_wave(blocks: DataFrame, folder: str, rate: int = 44_100, subtype: str = "PCM_16", guard: bool = False) -> None:
    """Writes blocks (path, start, samples: an array a channel) as files below folder.

    guard scales a file whose peak is above full scale so that it peaks at GUARDED, where it would clip else.
    """
    spark = blocks.sparkSession
    spark.dataSource.register(WaveSource)
    loudest = F.array_max(F.transform("samples", lambda c: F.array_max(F.transform(c, lambda x: F.abs(x)))))
    whole = blocks.groupBy("path").agg(F.max(F.size("samples")).alias("channels"), F.max(F.col("start") + F.size(F.col("samples")[0])).alias("frames"), F.max(loudest).alias("peak"))
    out = blocks.select("path", F.col("start").cast("long").alias("start"), "samples").join(whole, "path")
    if guard:
        out = out.withColumn("samples", F.when(F.col("peak") > 1, F.transform("samples", lambda c: F.transform(c, lambda x: x / F.col("peak") * GUARDED))).otherwise(F.col("samples")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = out.select("path", F.col("channels").cast("int").alias("channels"), F.col("frames").cast("long").alias("frames"), "start", "samples").repartition(n, "path").sortWithinPartitions("path", "start")
    rows.write.format("wave").option("rate", rate).option("subtype", subtype).mode("append").save(folder)
