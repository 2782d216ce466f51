"""File names, tags and keys as Column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names that the formats and the tagging convention define.
KEYS = ("C", "Am", "Db / C#", "Bbm / A#m", "D", "Bm", "Eb / D#", "Cm", "E", "Dbm / C#m", "F", "Dm", "Gb / F#", "Ebm / D#m", "G", "Em",
        "Ab / G#", "Fm", "A", "Gbm / F#m", "Bb / A#", "Gm", "B", "Abm / G#m")
GENDERS = ("female", "male")
REVERBS = ("dry", "wet")
ACAPELLA_WORDS = ("acapella", "aca", "vocals", "vocal", "lead", "bgv", "backing vocals", "backing vocal")
INSTRUMENTAL_WORDS = ("instrumental", "inst", "karaoke")
ACRONYMS = ("BPM", "DJ", "FX", "MP3", "EDM")
LOSSY = ("mp3", "ogg", "opus", "aac")
CONSTANT_RATES = (320, 256, 192, 128)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def split_slash(c: Column) -> tuple[Column, Column]:
    """What stands before and after the first slash, trimmed; the second is empty without one."""
    at = F.instr(c, "/")
    return F.when(at > 0, F.trim(F.substring(c, F.lit(1), at - 1))).otherwise(F.trim(c)), F.when(at > 0, F.trim(F.substring(c, at + 1, F.length(c)))).otherwise(F.lit(""))


def one_of(c: Column, values: tuple[str, ...]) -> Column:
    """The lower-cased value if it is of the closed set, else null."""
    low = F.lower(F.trim(c))
    return F.when(low.isin(*values), low)


def parse_sdr(c: Column) -> Column:
    """A number with an optional dB; anything else is null."""
    return F.trim(F.regexp_replace(c, "(?i)db", "")).try_cast("double")


def normalize_key(c: Column) -> Column:
    """The short name of a key given by its short name, a spelled pair or one of the pair; exact case first, then any case."""
    spaced = F.regexp_replace(F.trim(c), r"\s*/\s*", " / ")
    exact = {alias: _short(k) for k in KEYS for alias in (k, *k.split(" / "))}
    folded: dict[str, str] = {}
    for k in KEYS:
        for alias in (_short(k), k, *k.split(" / ")):
            folded.setdefault(alias.lower(), _short(k))
    return F.coalesce(_lookup(spaced, exact), _lookup(F.lower(spaced), folded))


def _short(key: str) -> str:
    return key.split(" / ")[0]


def _lookup(c: Column, values: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c)


def key_display(short: Column) -> Column:
    return F.coalesce(_lookup(F.trim(short), {_short(k): k for k in KEYS}), F.trim(short))


def key_chart_label(display: Column) -> Column:
    """Enharmonic spellings under each other."""
    return F.regexp_replace(F.trim(display), r"\s*/\s*", "\n")


def treated_as_vocal(stem: Column) -> Column:
    return stem.rlike("(?i)vocal|acapella|vox|vocoder")


def ignore(c: Column, parentheses: bool = True, brackets: bool = True, spaces: bool = True, keywords: tuple[str, ...] = ()) -> Column:
    """Drop what the rules ignore: (...), [...], keywords in any case; then collapse spaces."""
    if parentheses:
        c = F.regexp_replace(c, r"\([^)]*\)", " ")
    if brackets:
        c = F.regexp_replace(c, r"\[[^\]]*\]", " ")
    for k in keywords:
        c = F.regexp_replace(c, "(?i)" + re.escape(k), " ")
    return F.trim(F.regexp_replace(c, r"\s+", " ")) if spaces else c


@F.pandas_udf(T.StringType())
def _folded(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition and case folding, which Spark has no function for."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).casefold())


def normalize_tag(c: Column, **rules) -> Column:
    """Comparable form of a tag in any script: ignored parts gone, decomposed, case folded, & spelled out, all but letters, digits
    and _ to single spaces (so accents go and their letters stay)."""
    c = F.replace(_folded(ignore(c, **rules)), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}_]+", " "))


_ROLE_TAIL = r"(?i)(\s*\((?:[^)]*\b)?(?:original song|original|acapella|vocals?|lead|bgv|instrumental|inst|karaoke)(?: [^)]*)?\))+\s*$"


def strip_role_suffix(c: Column) -> Column:
    """Without the role parentheses at the end, however many."""
    return F.trim(F.regexp_replace(c, _ROLE_TAIL, ""))


def strip_bracket_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(\s*\[[^\]]+\])+\s*$", ""))


def filename_tags(stem: Column) -> tuple[Column, Column]:
    """(artist, title) of "[..] - Artist - Title (role)"; no artist without a separator."""
    core = strip_role_suffix(strip_bracket_tags(F.regexp_replace(stem, r"^\s*\[[^\]]*\]\s*-\s*", "")))
    at = F.instr(core, " - ")
    return F.when(at > 0, F.trim(F.substring(core, F.lit(1), at - 1))).otherwise(""), F.when(at > 0, F.trim(F.substring(core, at + 3, F.length(core)))).otherwise(core)


def tempo(stem: Column) -> Column:
    """The first two- or three-digit number before "bpm", as text; empty without one."""
    return F.regexp_extract(stem, r"(?i)\b(\d{2,3})\s*bpm\b", 1)


def key_in_name(stem: Column) -> Column:
    return F.regexp_extract(stem, r"(?i)\b([A-G](?:#m|b)?(?:m|min|maj|major|minor)?)\b", 1)


def role_kind(role: Column) -> Column:
    """The role that a parenthesised remark names: whole words first, then parts of words."""
    role = F.lower(F.trim(role))
    whole = lambda words: role.rlike(f"(^| )({'|'.join(words)})$")
    part = lambda words: role.rlike("|".join(words))
    return (
        F.when(role.isin("original song", "original"), "original")
        .when(whole(ACAPELLA_WORDS), "acapella").when(whole(INSTRUMENTAL_WORDS), "instrumental")
        .when(part(ACAPELLA_WORDS), "acapella").when(part(INSTRUMENTAL_WORDS), "instrumental")
    )


def classify_role(stem: Column) -> Column:
    """original, acapella, instrumental or null, from a file's stem."""
    low, core = F.lower(stem), F.lower(strip_bracket_tags(stem))
    remark = F.nullif(F.regexp_extract(core, r"\(([^)]+)\)\s*$", 1), F.lit(""))
    ends = lambda words: core.rlike(rf"\((?:{'|'.join(words)})\)|(?:{'|'.join(words)})$")
    return F.coalesce(
        F.when(low.contains("(original song)") | low.contains("(original)"), "original"),
        role_kind(remark),
        F.when(ends(ACAPELLA_WORDS) | core.rlike("acapella|acappella|a capella"), "acapella"),
        F.when(ends(INSTRUMENTAL_WORDS) | core.contains("instrumental"), "instrumental"),
    )


def vocals_only(stem: Column) -> Column:
    return stem.rlike(r"(?i)acapella|\bvocals?\b") & ~stem.rlike(r"(?i)instrumental|\bbeat\b")


def instrumental_only(stem: Column) -> Column:
    return stem.rlike(r"(?i)instrumental|karaoke|\bbeat\b") & ~stem.rlike(r"(?i)acapella|\bvocals?\b")


def song_key(stem: Column, category: Column) -> Column:
    """The stem without its category as prefix or suffix behind _, - or a space."""
    cat = F.lower(category)
    low = F.lower(stem)
    sized = F.length(category)
    lead = low.startswith(cat) & F.substring(stem, sized + 1, F.lit(1)).isin("_", "-", " ")
    trail = low.endswith(cat) & F.substring(stem, F.length(stem) - sized, F.lit(1)).isin("_", "-", " ")
    bare = F.when(lead, F.substring(stem, sized + 2, F.length(stem))).when(trail, F.substring(stem, F.lit(1), F.length(stem) - sized - 1)).otherwise(stem)
    return F.lower(F.trim(bare))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def safe_folder(c: Column) -> Column:
    """Without characters that file systems reject, and without trailing dots and spaces."""
    return F.regexp_replace(F.trim(F.regexp_replace(c, r'[<>:"/\\|?*]', "")), r"[. ]+$", "")


def balanced_root(name: Column) -> Column:
    return F.when(name.endswith("_BALANCED"), name).otherwise(F.concat(name, F.lit("_BALANCED")))


def clock(seconds: Column) -> Column:
    """m:ss of whole seconds."""
    s = F.floor(seconds).cast("long")
    return F.concat((s - s % 60).__truediv__(60).cast("long").cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def hours_clock(seconds: Column) -> Column:
    """1h02m03s, or 2m03s below an hour."""
    s = F.floor(seconds).cast("long")
    h, m = F.floor(s / 3600).cast("string"), F.floor(s % 3600 / 60).cast("string")
    sec = F.lpad((s % 60).cast("string"), 2, "0")
    return F.when(s >= 3600, F.concat(h, F.lit("h"), F.lpad(m, 2, "0"), F.lit("m"), sec, F.lit("s"))).otherwise(F.concat(m, F.lit("m"), sec, F.lit("s")))


def sized(n: Column) -> Column:
    """Bytes in the largest unit that leaves at least one: B, MB, GB, TB with two decimals."""
    unit = lambda power, name: F.concat(F.format_string("%.2f", n / F.lit(float(1 << power))), F.lit(" " + name))
    return F.when(n >= 1 << 40, unit(40, "TB")).when(n >= 1 << 30, unit(30, "GB")).when(n >= 1 << 20, unit(20, "MB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def strictness_threshold(strictness: Column) -> Column:
    """0..100 to 0.55..1.0."""
    return 0.55 + F.least(F.greatest(strictness, F.lit(0)), F.lit(100)) / 100 * 0.45


def compression_of(verdict: Column, ext: Column) -> Column:
    lossy = F.lower(F.regexp_replace(ext, r"^\.", "")).isin(*LOSSY)
    return F.when(lossy | verdict.isin("WARNING", "SUSPICIOUS", "FAKE_CERTAIN"), "lossy").when(verdict == "AUTHENTIC", "lossless")


def lossy_suffix(stem: Column, kbps: Column) -> Column:
    """The stem with _mp3-<rate>, -vbr for other rates, bare when unknown; unchanged when it already has one."""
    tail = F.when(kbps.isNull(), "_mp3").when(kbps.isin(*CONSTANT_RATES), F.concat(F.lit("_mp3-"), kbps.cast("string"))).otherwise("_mp3-vbr")
    return F.when(stem.rlike(r"(?i)_mp3(-\w+)?$"), stem).otherwise(F.concat(stem, tail))


def genre_label(label: Column) -> tuple[Column, Column]:
    parts = F.split(label, "---")
    return parts[0], F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))


def combined_tag(first: Column, second: Column) -> Column:
    """first/second, or the one that is there."""
    return F.concat_ws("/", blank_to_null(first), blank_to_null(second))


def stem_mode(label: Column, aliases: dict[str, str], default: str) -> Column:
    return F.coalesce(_lookup(label, aliases), F.lit(default))
