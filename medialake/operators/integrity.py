"""Integrity decisions, incremental filters, and a structural walk over MP3 frames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merge_status(mode: str, fast_ok: Column, deep: Column) -> Column:
    """ok, minor, suspect or failed from the fast check (true, false, unknown) and the deep check's status."""
    failed = F.coalesce(~fast_ok, F.lit(False))
    deep = F.coalesce(F.nullif(deep, F.lit("")), F.lit("failed"))
    if mode == "fast":
        return F.when(failed, "suspect").otherwise("ok")
    if mode == "deep":
        return deep
    return F.when(failed & (deep == "ok"), "suspect").when(failed & (deep == "minor"), "minor").when(failed, "failed").otherwise(deep)


def within_slack(expected: Column, found: Column, slack: float = 0.5) -> Column:
    return F.abs(expected - found) <= slack


def sniffed(head: Column) -> Column:
    """The format that the first bytes show: wav, flac, id3, mp3, ogg or unknown."""
    h = F.upper(F.hex(F.substring(head, 1, 12)))
    return (
        F.when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57415645"), "wav").when(h.startswith("664C6143"), "flac")
        .when(h.startswith("494433"), "id3").when(h.startswith("4F676753"), "ogg").when(h.rlike("^FF[EF]"), "mp3").otherwise("unknown")
    )


def outcome_after_fix(status: Column, fixable: Column, fixed_ok: Column) -> Column:
    """What an integrity run plans for a file: fixed, quarantine, or leave."""
    return F.when(status == "ok", "leave").when(fixable & fixed_ok, "fixed").when(status == "failed", "quarantine").otherwise("leave")


def prescan(df: DataFrame, length: Column, frames: Column) -> DataFrame:
    """df with reason: why a file cannot be read, null for usable ones; one pass, nothing is dropped."""
    return df.withColumn("reason", F.when(length.isNull(), "unreadable").when(length == 0, "empty").when(frames == 0, "no_frames"))


def unprocessed(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items that no row of done settles."""
    return items.join(done.select(*keys).distinct(), keys, "left_anti")


def songs_not_all_tagged(stems: DataFrame, song: str, tagged: Column) -> DataFrame:
    """Songs with a stem that is not tagged yet."""
    return stems.groupBy(song).agg(F.every(F.coalesce(tagged, F.lit(False))).alias("all")).where("not all").select(song)


def missing_categories(expected: tuple[str, ...], written: Column, seconds: Column, least: float) -> tuple[Column, Column]:
    """(missing, verdict): categories not written, and short, incomplete, both or null."""
    missing = F.array_except(F.array(*map(F.lit, expected)), written)
    short, incomplete = seconds < least, F.size(missing) > 0
    return missing, F.when(short & incomplete, "both").when(short, "short").when(incomplete, "incomplete")


def fast_check(ext: Column, mp3_problem: Column, flac_bits: Column) -> tuple[Column, Column]:
    """(ok, detail) of the fast check by format: the frame walk's problem for mp3, more than 24 bits for flac; others pass as n/a."""
    ext = F.lower(F.regexp_replace(ext, r"^\.", ""))
    deep = F.format_string("FLAC bit depth %d unsupported (max 24)", flac_bits.cast("int"))
    problem = F.when(ext.isin("mp3", "mp2", "mp1"), F.coalesce(mp3_problem, F.lit(""))).when(ext.isin("flac", "fla"), F.when(flac_bits > 24, deep).otherwise("")).otherwise("")
    return problem == "", F.when(ext.isin("mp3", "mp2", "mp1", "flac", "fla"), problem).otherwise("n/a")


def frame_audit(expected: Column, counted: Column) -> Column:
    """What a stream's frame count says beside the count that its information frame states (that frame itself is not counted)."""
    return F.when(expected.isNull(), "no count stated").when(expected == counted, "ok").when(expected == counted + 1, "one frame short").otherwise("frame count differs")


# MPEG audio bit rates (kbit/s) by version and layer, and sample rates by version.
_RATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_HERTZ = {3: (44_100, 48_000, 32_000), 2: (22_050, 24_000, 16_000), 0: (11_025, 12_000, 8_000)}


def frame_size(head: int) -> int:
    """Bytes of the frame with this header; 0 if it is none."""
    version, layer, rate, hertz, pad = head >> 19 & 3, 4 - (head >> 17 & 3), head >> 12 & 15, head >> 10 & 3, head >> 9 & 1
    if head >> 21 != 0x7FF or layer == 4 or version == 1 or rate in (0, 15) or hertz == 3:
        return 0
    bits, per_second = _RATES[1 if version == 3 else 2, layer][rate] * 1000, _HERTZ[version][hertz]
    if layer == 1:
        return (12 * bits // per_second + pad) * 4
    return (72 if layer == 3 and version != 3 else 144) * bits // per_second + pad


def stated_frames(frame: bytes) -> int | None:
    """The frame count that an information frame (Xing or Info) states; None for any other frame."""
    mono, first = frame[3] >> 6 == 3, frame[1] >> 3 & 3 == 3
    at = 4 + ((17 if mono else 32) if first else (9 if mono else 17))
    if frame[at : at + 4] not in (b"Xing", b"Info") or not int.from_bytes(frame[at + 4 : at + 8], "big") & 1:
        return None
    return int.from_bytes(frame[at + 8 : at + 12], "big")


def mp3_frames(data: bytes) -> tuple[int, str, int | None]:
    """(frames, problem, stated): frames of layers I to III from the first sync on; LOST SYNC, TRUNCATED, NO FRAMES or no problem; and the
    count that an information frame at the start states."""
    at = 0
    if data[:3] == b"ID3" and len(data) >= 10:
        at = 10 + (data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9])
    end = len(data) - 128 if data[-128:-125] == b"TAG" else len(data)
    n, stated = 0, None
    while at + 4 <= end:
        size = frame_size(int.from_bytes(data[at : at + 4], "big"))
        if not size:
            return n, "LOST SYNC", stated
        if at + size > end:
            return n, "TRUNCATED", stated
        if not n:
            stated = stated_frames(data[at : at + size])
        at, n = at + size, n + 1
    return n, "" if n else "NO FRAMES", stated


_WALK = T.StructType([T.StructField("frames", T.IntegerType()), T.StructField("problem", T.StringType()), T.StructField("stated", T.IntegerType())])


@F.pandas_udf(_WALK)
def mp3_walk(data: pd.Series) -> pd.DataFrame:
    """Frames, problem and stated frames of each file's bytes."""
    walked = pd.DataFrame([mp3_frames(bytes(d) if d is not None else b"") for d in data], columns=["frames", "problem", "stated"])
    return walked.astype({"stated": "Int32"})
