"""Structural check of MPEG audio (MP3) in pieces: one file of any size is walked by as many tasks as it has pieces.

A stream is a chain: each frame's header gives its length, and so the next frame's place. Where a piece's first frame starts is only
known when the piece before has been walked, so every piece is walked from all places at its beginning where a frame of the stream may
start (chains from different places soon meet and are walked once). That gives a small table a piece, from entry to exit; the tables of
a file are then followed from its first frame to its end.

What comes before and behind the audio (ID3v2; ID3v1, Lyrics3 and APE tags) is measured first. Problems, by rank:
`UNRECOGNISED FORMAT`, `BAD ID3v2 TAG`, `BAD LYRICS3v1 TAG`, `BAD LYRICS3v2 TAG`, `BAD APE TAG`, `BAD STARTING SYNC`, `CRC ERROR @ 0m 00s`,
`LOST SYNC @ 0m 00s` (if the stream goes on within RESYNC bytes), `LOST SYNC @ END OF FILE`, `TRUNCATED`, or an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.signal import let
from ..sources.containers import big, cut, has
from ..tables import in_batches
from .integrity import frame_size

PIECE = 1 << 20
RESYNC = 1 << 16
#: No frame is longer: layer I at 448 kbit/s and 32 kHz, layer II at 384 kbit/s, low rates of layer III.
LONGEST = 2_884
#: What frames of one stream have in common: sync, version, layer and sample rate.
SAME = 0xFFFE0C00
_HERTZ = {3: (44_100, 48_000, 32_000), 2: (22_050, 24_000, 16_000), 0: (11_025, 12_000, 8_000)}


def rate_of(head: int) -> int:
    return _HERTZ[head >> 19 & 3][head >> 10 & 3]


def samples_of(head: int) -> int:
    """Samples of a frame with this header."""
    layer, first = 4 - (head >> 17 & 3), head >> 19 & 3 == 3
    return 384 if layer == 1 else 1152 if layer == 2 or first else 576


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        c = byte << 8
        for _ in range(8):
            c = c << 1 ^ (0x8005 if c & 0x8000 else 0)
        out.append(c & 0xFFFF)
    return out


_CRC = _crc_table()


@lru_cache(maxsize=4096)
def measured(head: int) -> tuple[int, int, bool]:
    """(bytes, samples, whether a checksum follows) of a frame with this header; bytes are 0 if it is none. Streams repeat a few headers."""
    size = frame_size(head)
    return size, samples_of(head) if size else 0, not head >> 16 & 1 and head >> 17 & 3 == 1


def crc_holds(frame: bytes) -> bool:
    """Whether a protected layer III frame's checksum is that of its header's last two bytes and its side information."""
    head = int.from_bytes(frame[:4], "big")
    if head >> 16 & 1 or head >> 17 & 3 != 1:
        return True
    side = {(True, False): 32, (True, True): 17, (False, False): 17, (False, True): 9}[head >> 19 & 3 == 3, head >> 6 & 3 == 3]
    if len(frame) < 6 + side:
        return True
    crc = 0xFFFF
    for byte in frame[2:4] + frame[6 : 6 + side]:
        crc = (crc << 8 ^ _CRC[crc >> 8 ^ byte]) & 0xFFFF
    return crc == int.from_bytes(frame[4:6], "big")


def plausible(window: bytes) -> list[tuple[int, int]]:
    """(place, header) of everything in window that reads as a frame's header."""
    raw = np.frombuffer(window, np.uint8)
    at = np.flatnonzero((raw[:-3] == 0xFF) & (raw[1:-2] >= 0xE0)) if len(raw) > 3 else []
    heads = [(int(p), int.from_bytes(window[p : p + 4], "big")) for p in at]
    return [(p, h) for p, h in heads if measured(h)[0]]


def syncs(window: bytes) -> bool:
    """Whether two headers of one stream are in the window."""
    found = plausible(window)
    return any(p >= found[0][0] + 4 and h & SAME == found[0][1] & SAME for p, h in found[1:])


def lyrics(data: bytes, end: int) -> tuple[int, str]:
    """(bytes, problem) of the Lyrics3 tag that ends at a place: version 1 begins within 5100 bytes, version 2 states its length."""
    mark = data[max(0, end - 9) : end]
    if mark == b"LYRICSEND":
        start = max(0, end - 5100)
        begin = data.find(b"LYRICSBEGIN", start, end)
        return (end - begin, "") if begin >= 0 else (0, "BAD LYRICS3v1 TAG")
    stated = data[end - 15 : end - 9] if mark == b"LYRICS200" and end >= 15 else b""
    if stated.isdigit() and int(stated) and end >= 15 + int(stated):
        begin = end - 15 - int(stated)
        return (int(stated) + 15, "") if data[begin : begin + 11] == b"LYRICSBEGIN" else (0, "BAD LYRICS3v2 TAG")
    return 0, ""


def audio_bounds(data: bytes) -> tuple[int, int, str | None, int | None]:
    """(begin, end, problem of the tags, header at begin if one is there) of the audio between the tags."""
    begin, end, problem = 0, len(data), ""
    if data[:3] == b"ID3" and len(data) >= 10:
        if 0xFF in data[3:5] or max(data[6:10]) >= 0x80:
            problem = "BAD ID3v2 TAG"
        else:
            size = sum(x << 7 * k for x, k in zip(data[6:10], (3, 2, 1, 0)))
            begin = size + (20 if data[3] == 4 and data[5] & 0x10 else 10)
    said = []
    if data[-128:-125] == b"TAG":
        end -= 128
        size, wrong = lyrics(data, end)
        end -= size
        said.append(wrong)
    footer = data[end - 32 : end] if end >= 32 else b""
    if footer[:8] == b"APETAGEX":
        size, flags = int.from_bytes(footer[12:16], "little"), int.from_bytes(footer[20:24], "little")
        if 32 <= size <= len(data):
            end -= size + (32 if flags >> 31 else 0)
            size, wrong = lyrics(data, end)
            end -= size
            said.insert(0, wrong)
        else:
            said.append("BAD APE TAG")
    head = int.from_bytes(data[begin : begin + 4], "big") if begin + 4 <= end else 0
    return begin, max(0, end), problem or next((x for x in said if x), None), head if head and frame_size(head) else None


_BOUNDS = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("tag_problem", T.StringType()), T.StructField("first", T.LongType())])


@F.pandas_udf(_BOUNDS)
def bounds(data: pd.Series) -> pd.DataFrame:
    found = pd.DataFrame([audio_bounds(bytes(d) if d is not None else b"") for d in data], columns=_BOUNDS.names, dtype=object)
    return found.astype({"begin": "int64", "end": "int64", "first": "Int64"})


def walk_piece(data: bytes, lo: int, hi: int, end: int, first: int, start: int) -> list[dict]:
    """Where the chains that enter data (the bytes from lo on, beyond hi as far as a frame or a resynchronisation may look) leave it.

    Chains may enter at the LONGEST first places, or only at start if that lies in the piece. A chain ends at hi or behind it, or with a problem.
    """
    visited: dict[int, tuple] = {}
    entries = [start] if lo <= start < hi else [lo + p for p, h in plausible(data[: LONGEST + 3]) if h & SAME == first & SAME and lo + p < hi]
    for entry in entries:
        chain, at = [], entry
        while at not in visited:
            head = int.from_bytes(data[at - lo : at - lo + 4], "big") if at + 4 <= end else 0
            size, samples, protected = measured(head)
            if at >= end:
                visited[at] = (0, 0, at, "" if at == end else "TRUNCATED", 0)
            elif at + 4 > end:
                visited[at] = (0, 0, at, "TRUNCATED", 0)
            elif not size or head & SAME != first & SAME:
                # Everything that reads as a header counts as heard until the stream is found again.
                found = plausible(data[at - lo : min(end, at + 1 + RESYNC) - lo])
                match = next((i for i, (p, h) in enumerate(found) if p and h & SAME == first & SAME), None)
                heard = sum(samples_of(h) for _, h in found[: match + 1]) if match is not None else 0
                visited[at] = (0, 0, at, "LOST SYNC @ END OF FILE" if match is None else "LOST SYNC", heard)
            elif at >= hi:  # a frame of the next piece
                visited[at] = (0, 0, at, None, 0)
            elif protected and not crc_holds(data[at - lo : min(at + size, end) - lo]):
                visited[at] = (0, 0, at, "CRC ERROR", samples)
            else:
                chain.append((at, samples))
                at += size
        for place, samples in reversed(chain):
            frames, heard, *rest = visited[at]
            visited[place] = (frames + 1, heard + samples, *rest)
            at = place
    return [dict(zip(_ENTRY, (e, *visited[e]))) for e in entries]


_ENTRY = ("entry", "frames", "samples", "exit", "problem", "extra")
_TABLE = T.ArrayType(T.StructType([T.StructField(n, T.StringType() if n == "problem" else T.LongType()) for n in _ENTRY]))
_ARROW_TABLE = pa.list_(pa.struct([(n, pa.string() if n == "problem" else pa.int64()) for n in _ENTRY]))


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece's table instead of its bytes; for a file that does not begin with a frame, whether its window syncs."""
    for batch in batches:
        rows = list(zip(*(batch[c].to_pylist() for c in ("bytes", "lo", "hi", "end", "first", "begin"))))
        tables = [walk_piece(*row) if row[4] is not None else [] for row in rows]
        synced = [row[4] is None and syncs(row[0]) for row in rows]
        kept = batch.drop_columns(["lo", "hi", "bytes"])
        yield kept.append_column("table", pa.array(tables, _ARROW_TABLE)).append_column("synced", pa.array(synced, pa.bool_()))


def mp3_check(files: DataFrame, key: str, content: str = "content", piece: int = PIECE) -> DataFrame:
    """(key, ok, problem, frames, seconds, stated): the frames that were walked, their time, and the count that an information frame at
    the start states (Xing, Info or VBRI; null without one)."""
    if piece < LONGEST:
        raise ValueError(f"a piece needs {LONGEST} bytes, so that no frame goes over a whole one")
    data, begin, end, first = F.col(content), F.col("begin"), F.col("end"), F.col("first")
    size, zero, none = F.lit(piece).cast("long"), F.lit(0).cast("long"), F.lit(None).cast("string")
    # One pass for all files: a filter by the bounds would have them measured once more for it.
    known = in_batches(files).select(key, content, bounds(content).alias("_b")).select(key, content, "_b.*")
    known = known.withColumn("stated", F.when(first.isNotNull(), _stated(data, begin, first)))
    last = F.when(first.isNull(), zero).otherwise(F.floor((end - 1 - begin) / size))
    nth = known.select(key, content, "begin", "end", "tag_problem", "first", "stated", F.explode(F.sequence(zero, last)).alias("nth"))
    lo = begin + F.col("nth") * size
    cuts = F.when(first.isNull(), cut(data, begin, F.least(end - begin, F.lit(RESYNC)))).otherwise(cut(data, lo, size + RESYNC + LONGEST + 8))
    pieces = nth.select(key, "nth", "begin", "end", "tag_problem", "first", "stated", lo.alias("lo"), F.least(lo + size, end).alias("hi"), F.coalesce(cuts, F.lit(b"")).alias("bytes"))
    # The bytes are cut before this step and stay behind in it: rows that wait for a function of columns would hold their file's content.
    walked = pieces.mapInArrow(_walked, pieces.drop("lo", "hi", "bytes").schema.add("table", _TABLE).add("synced", T.BooleanType()))
    # A row a piece with a few entries is what a file's pieces come together with.
    of_file = [F.any_value(c).alias(c) for c in ("begin", "end", "tag_problem", "first", "stated", "synced")]
    walked = walked.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("nth", "table"))).alias("tables"), *of_file)
    followed = F.aggregate("tables", F.struct(begin.alias("at"), zero.alias("frames"), zero.alias("samples"), none.alias("problem"), zero.alias("extra")), _follow)
    rate, timed = _rate(first), F.col("_end.problem").isin("LOST SYNC", "CRC ERROR")
    second = F.floor((F.col("_end.samples") + F.col("_end.extra")) / rate)
    at = F.format_string("%s @ %dm %02ds", F.col("_end.problem"), F.floor(second / 60), second % 60)
    early = F.when(begin + 4 > end, F.coalesce("tag_problem", F.when(begin < end, "TRUNCATED").otherwise("UNRECOGNISED FORMAT")))
    early = early.when(~F.col("synced"), F.coalesce("tag_problem", F.lit("UNRECOGNISED FORMAT"))).when(begin > 0, "BAD ID3v2 TAG").otherwise("BAD STARTING SYNC")
    problem = F.when(first.isNull(), early).when(timed, at).otherwise(F.coalesce("_end.problem", F.lit("")))
    seconds = F.when(first.isNull(), 0.0).otherwise(F.col("_end.samples") / rate)
    return walked.withColumn("_end", followed).select(key, (problem == "").alias("ok"), problem.alias("problem"), F.col("_end.frames").alias("frames"), seconds.alias("seconds"), "stated")


def _follow(acc: Column, piece: Column) -> Column:
    """The chain that left the piece before, through this one; a chain with a problem stays where it is."""
    step = F.try_element_at(F.filter(piece["table"], lambda r: r["entry"] == acc["at"]), F.lit(1))

    def further(r: Column) -> Column:
        lost = F.struct(acc["at"].alias("at"), acc["frames"].alias("frames"), acc["samples"].alias("samples"), F.lit("LOST SYNC @ END OF FILE").alias("problem"), F.lit(0).cast("long").alias("extra"))
        on = F.struct(r["exit"].alias("at"), (acc["frames"] + r["frames"]).alias("frames"), (acc["samples"] + r["samples"]).alias("samples"), r["problem"].alias("problem"), r["extra"].alias("extra"))
        # No frame of the stream starts where the piece before has left it: lost.
        return F.when(r.isNull(), lost).otherwise(on)

    return F.when(acc["problem"].isNotNull(), acc).otherwise(let(step, further))


def _rate(head: Column) -> Column:
    """The sample rate of a header, as `rate_of` reads it."""
    version, slot = F.shiftright(head, 19).bitwiseAND(3), F.shiftright(head, 10).bitwiseAND(3)
    rates = F.create_map(*[F.lit(x) for v, hertz in _HERTZ.items() for k, h in enumerate(hertz) for x in (v * 4 + k, h)])
    return F.element_at(rates, (version * 4 + slot).cast("int"))


def _stated(data: Column, at: Column, head: Column) -> Column:
    """The frame count of an information frame at a place."""
    mono, first = F.shiftright(head, 6).bitwiseAND(3) == 3, F.shiftright(head, 19).bitwiseAND(3) == 3
    info = at + 4 + F.when(first, F.when(mono, 17).otherwise(32)).otherwise(F.when(mono, 9).otherwise(17))
    xing = F.hex(cut(data, info, 4)).isin("58696E67", "496E666F") & has(big(cut(data, info + 4, 4)), 1)
    return F.when(xing, big(cut(data, info + 8, 4))).when(F.hex(cut(data, at + 36, 4)) == "56425249", big(cut(data, at + 50, 4)))
