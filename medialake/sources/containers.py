"""Tags and stream parameters out of the bytes of audio containers.

A container is a list of records that state their own length (chunks, blocks, atoms). `layout` follows the outermost ones in a column
expression: a fold whose state is the next record's place and the records found, so only headers of the content are looked at.
Records that do not fit, or that would not move on, end the walk; cut and looping sizes cannot do harm. Most files have fewer records
than STEPS; the fold goes on for as many as the bytes can hold where there are more. Stream parameters are bit fields of these records,
in expressions too.

Tags are nested deeper. The regions that hold them are cut out by place, so that only these, and not the audio, go to the Python
helper that lists their fields; texts are decoded by expressions again. Tags are a map of the container's own names to all values in
order: ID3 frames (`TIT2`, `TXXX:desc`, `COMM`, `UFID:owner`), RIFF INFO chunks, Vorbis comments in upper case, MP4 items
(`----:mean:name` for one's own). Null and unreadable contents give an empty map and null parameters. Compressed and encrypted ID3
frames are left out; frames that the older three-letter names have get the newer names.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Steps of the first fold; files that it does not finish go on for STEPS in all.
FIRST_STEPS, STEPS = 8, 64
_SPANS = "array<struct<name:string,at:bigint,size:bigint>>"
# Frames of ID3v2.2 and what later versions call them.
OLD_FRAMES = {
    "TT1": "TIT1", "TT2": "TIT2", "TT3": "TIT3", "TP1": "TPE1", "TP2": "TPE2", "TP3": "TPE3", "TP4": "TPE4", "TAL": "TALB", "TCO": "TCON", "TCM": "TCOM", "TYE": "TYER",
    "TRK": "TRCK", "TPA": "TPOS", "TBP": "TBPM", "TKE": "TKEY", "TRC": "TSRC", "TPB": "TPUB", "TXX": "TXXX", "COM": "COMM", "UFI": "UFID",
}
# Sample kinds of WAVE format codes by bits, and of AIFF-C compression types.
WAVE_KINDS = {(1, 8): "PCM_U8", (1, 16): "PCM_16", (1, 24): "PCM_24", (1, 32): "PCM_32", (3, 32): "FLOAT", (3, 64): "DOUBLE", (6, 8): "ALAW", (7, 8): "ULAW"}
AIFF_KINDS = {"fl32": "FLOAT", "FL32": "FLOAT", "fl64": "DOUBLE", "FL64": "DOUBLE", "alaw": "ALAW", "ulaw": "ULAW"}


def cut(data: Column, at: Column | int, n: Column | int) -> Column:
    """n bytes of data from place at on."""
    at, n = (F.lit(x) if isinstance(x, int) else x for x in (at, n))
    return F.substring(data, (at + 1).try_cast("int"), n.try_cast("int"))


def big(data: Column) -> Column:
    """The number that these bytes are, highest byte first."""
    return F.conv(F.hex(data), 16, 10).try_cast("long")


def little(data: Column, at: Column, n: int) -> Column:
    """The number that the n bytes at a place are, lowest byte first."""
    return big(F.concat(*[cut(data, at + i, 1) for i in range(n - 1, -1, -1)]))


def synchsafe(data: Column) -> Column:
    """Four bytes of seven bits each."""
    x = big(data)
    return F.shiftright(x.bitwiseAND(0x7F000000), 3) + F.shiftright(x.bitwiseAND(0x7F0000), 2) + F.shiftright(x.bitwiseAND(0x7F00), 1) + x.bitwiseAND(0x7F)


def has(flags: Column, mask: int) -> Column:
    return F.coalesce(flags.bitwiseAND(mask) != 0, F.lit(False))


def latin(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def utf8(data: Column) -> Column:
    """UTF-8; bytes that are none become U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


def utf16(data: Column, big_endian: Column) -> Column:
    """UTF-16; halves of pairs that stand alone become U+FFFD, a last odd byte is dropped."""
    h = F.hex(data)
    whole = F.substring(h, F.lit(1), (F.floor(F.length(h) / 4) * 4).cast("int"))
    spaced = F.when(big_endian, F.regexp_replace(whole, "(..)(..)", "$1$2 ")).otherwise(F.regexp_replace(whole, "(..)(..)", "$2$1 "))
    paired = F.regexp_replace(F.regexp_replace(spaced, "(D[89AB].. )(?!D[C-F])", "FFFD "), "(?<!D[89AB].. )D[C-F].. ", "FFFD ")
    return F.decode(F.unhex(F.regexp_replace(paired, " ", "")), "UTF-16BE")


def named(spans: Column, name: str) -> Column:
    """The first record of that name; null where there is none."""
    return F.try_element_at(F.filter(spans, lambda s: s["name"] == name), F.lit(1))


def _walk_step(data: Column, kind: Column, stop: Column):
    """One record further: chunks of wav (sizes lowest byte first) and aiff, padded to even lengths; metadata blocks of flac, of which
    the last says so; atoms of mp4, whose size comes first and counts the header (1: 64 bits follow, 0: to the end)."""

    def header(at: Column) -> Column:
        flac, mp4 = kind == "flac", kind == "mp4"
        first, short = big(cut(data, at, 1)), big(cut(data, at, 4))
        head = F.when(flac, 4).when(mp4, F.when(short == 1, 16).otherwise(8)).otherwise(8)
        whole = F.when(short == 1, big(cut(data, at + 8, 8))).when(short == 0, stop - at).otherwise(short)
        size = F.when(flac, big(cut(data, at + 1, 3))).when(mp4, whole - head).when(kind == "wav", little(data, at + 4, 4)).otherwise(big(cut(data, at + 4, 4)))
        name = F.when(flac, first.bitwiseAND(0x7F).cast("string")).when(mp4, latin(cut(data, at + 4, 4))).otherwise(latin(cut(data, at, 4)))
        return F.struct(name.alias("name"), (at + head).cast("long").alias("at"), size.cast("long").alias("size"), (flac & (first >= 0x80)).alias("last"))

    def step(acc: Column, _: Column) -> Column:
        def taken(r: Column) -> Column:
            inside = (r["at"] + r["size"] <= stop) | (r["name"].isin("data", "SSND") & kind.isin("wav", "aiff"))  # audio may be cut short
            fits = F.coalesce((r["at"] <= stop) & (r["size"] >= 0) & inside & (r["name"] != ""), F.lit(False))
            padding = F.when(kind.isin("wav", "aiff"), r["size"] % 2).otherwise(0)
            one = F.struct(r["name"].alias("name"), r["at"].alias("at"), F.least(r["size"], stop - r["at"]).alias("size"))
            after = F.when(r["last"], stop).otherwise(r["at"] + r["size"] + padding)
            return F.when(fits, F.struct(after.alias("at"), F.concat(acc["found"], F.array(one)).alias("found"))).otherwise(F.struct(stop.alias("at"), acc["found"].alias("found")))

        return F.when(acc["at"] < stop, F.transform(F.array(header(acc["at"])), taken)[0]).otherwise(acc)

    return step


def layout(files: DataFrame, content: str = "content") -> DataFrame:
    """files with `container` (wav, aiff, flac, ogg, mp4, mpeg or null), `head` (bytes of a leading ID3v2 tag), `bytes` and `records`:
    chunks of wav and aiff, metadata blocks of flac, outermost atoms of mp4."""
    data = F.col(content)
    magic = lambda at, n: F.hex(cut(data, at, n))
    head = F.when(magic(0, 3) == "494433", 10 + synchsafe(cut(data, 6, 4)))
    zero = F.lit(0).cast("long")
    out = files.withColumn("head", F.coalesce(head, zero)).withColumn("bytes", F.coalesce(F.length(data), zero).cast("long"))
    at = F.col("head")
    # A WAVE file may carry a tag in front of it, as a FLAC or MPEG file does.
    wave = (magic(at, 4) == "52494646") & (magic(at + 8, 4) == "57415645")
    kind = (
        F.when(wave, "wav").when((magic(0, 4) == "464F524D") & magic(8, 4).isin("41494646", "41494643"), "aiff").when(magic(at, 4) == "664C6143", "flac")
        .when(magic(0, 4) == "4F676753", "ogg").when(magic(4, 4) == "66747970", "mp4").when((at > 0) | magic(0, 2).rlike("^FF[EF]"), "mpeg")
    )
    start = F.when(F.col("container") == "wav", at + 12).when(F.col("container") == "aiff", 12).when(F.col("container") == "flac", at + 4).when(F.col("container") == "mp4", 0)
    out = out.withColumn("container", kind).withColumn("_start", start.cast("long"))
    step = _walk_step(data, F.col("container"), F.col("bytes"))
    begin = F.struct(F.col("_start").alias("at"), F.array().cast(_SPANS).alias("found"))
    out = out.withColumn("_few", F.when(F.col("_start").isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(FIRST_STEPS)), begin, step)))
    further = F.aggregate(F.sequence(F.lit(FIRST_STEPS + 1), F.lit(STEPS)), F.col("_few"), step)
    out = out.withColumn("_walk", F.when(F.col("_few.at") < F.col("bytes"), further).otherwise(F.col("_few")))
    more = F.sequence(F.lit(1).cast("long"), F.floor((F.col("bytes") - F.col("_walk.at")) / 4) + 1)
    longer = F.aggregate(F.when(F.col("_walk.at") < F.col("bytes"), more).otherwise(F.array().cast("array<bigint>")), F.col("_walk"), step)
    found = F.when(F.col("_walk.at") < F.col("bytes"), longer["found"]).otherwise(F.col("_walk.found"))
    return out.withColumn("records", F.coalesce(found, F.array().cast(_SPANS))).drop("_start", "_few", "_walk")


def _number(b: bytes) -> int:
    return int.from_bytes(b, "big")


def _seven(b: bytes) -> int:
    return sum((x & 127) << 7 * i for i, x in enumerate(reversed(b)))


def id3_fields(tag: bytes):
    """(name, charset, raw) of the frames of an ID3v2 tag; raw of texts is without the encoding's byte."""
    if len(tag) < 10 or tag[:3] != b"ID3" or tag[3] not in (2, 3, 4) or len(tag) < 10 + _seven(tag[6:10]):
        return
    major, flags, body = tag[3], tag[5], tag[10 : 10 + _seven(tag[6:10])]
    if major < 4 and flags & 0x80:
        body = body.replace(b"\xff\x00", b"\xff")
    at = 0
    if flags & 0x40 and major > 2:
        at = _seven(body[:4]) if major == 4 else 4 + _number(body[:4])
    letters, head = (3, 6) if major == 2 else (4, 10)
    while at + head <= len(body) and body[at : at + letters].isalnum() and body[at : at + letters].isupper():
        name, size = body[at : at + letters].decode("ascii"), body[at + letters : at + 2 * letters]
        size = _seven(size) if major == 4 else _number(size)
        form, raw = body[at + 9] if major > 2 else 0, body[at + head : at + head + size]
        if len(raw) < size:
            return
        at += head + size
        if form & (0x0C if major == 4 else 0xC0):
            continue
        raw = raw[bool(form & 0x40) + 4 * (form & 1) if major == 4 else bool(form & 0x20) :]
        if major == 4 and (flags & 0x80 or form & 2):
            raw = raw.replace(b"\xff\x00", b"\xff")
        name = OLD_FRAMES.get(name, name) if major == 2 else name
        if name == "UFID":
            owner, _, value = raw.partition(b"\0")
            yield "UFID:" + owner.decode("latin-1"), "utf8", value
        elif raw and name[0] == "T" or name == "COMM":
            charset = dict(enumerate(("latin", "utf16", "utf16be", "utf8"))).get(raw[0] if raw else 9)
            yield name, charset, raw[4:] if name == "COMM" else raw[1:]


def id3v1_fields(tail: bytes):
    """The fixed fields of the last 128 bytes."""
    if len(tail) == 128 and tail[:3] == b"TAG":
        for name, at, n in (("TIT2", 3, 30), ("TPE1", 33, 30), ("TALB", 63, 30), ("TDRC", 93, 4), ("COMM", 97, 28)):
            yield name, "fixed", tail[at : at + n].split(b"\0")[0].rstrip()


def info_fields(chunk: bytes):
    """The chunks of a RIFF LIST of the kind INFO."""
    at = 4
    while chunk[:4] == b"INFO" and at + 8 <= len(chunk):
        size = int.from_bytes(chunk[at + 4 : at + 8], "little")
        yield chunk[at : at + 4].decode("latin-1"), "fixed8", chunk[at + 8 : at + 8 + size].split(b"\0")[0].strip()
        at += 8 + size + size % 2


def vorbis_fields(block: bytes):
    """The comments of a block; none unless all that it counts are there."""
    small = lambda at: int.from_bytes(block[at : at + 4], "little") if at + 4 <= len(block) else len(block)
    at, out = 4 + small(0), []
    for _ in range(count := min(small(at), len(block) // 4)):
        at += 4
        size = small(at)
        text = block[at + 4 : at + 4 + size]
        if len(text) < size or at + 4 > len(block):
            return
        at += size
        name, equals, value = text.partition(b"=")
        if equals:
            out.append((name.decode("utf-8", "replace").upper(), "fixed8", value))
    yield from out if count else ()


def ogg_comments(data: bytes) -> bytes:
    """The comment block of an Ogg stream: its second packet, which may go over several pages."""
    at, packet, page = 0, b"", 0
    while data[at : at + 4] == b"OggS" and at + 27 <= len(data):
        table = data[at + 27 : at + 27 + data[at + 26]]
        body = at + 27 + len(table)
        if page:
            packet += data[body : body + sum(table)]
            if any(x < 255 for x in table):
                break
        at, page = body + sum(table), page + 1
    return packet[7:] if packet[:7] == b"\x03vorbis" else packet[8:] if packet[:8] == b"OpusTags" else b""


def atoms(data: bytes, at: int = 0):
    """(name, body) of the atoms in data."""
    while at + 8 <= len(data):
        size, head = _number(data[at : at + 4]), 8
        if size == 1:
            size, head = _number(data[at + 8 : at + 16]), 16
        size = size or len(data) - at
        if size < head or at + size > len(data):
            return
        yield data[at + 4 : at + 8].decode("latin-1"), data[at + head : at + size]
        at += size


def mp4_fields(moov: bytes):
    """The items of moov.udta.meta.ilst."""
    ilst = dict(atoms(dict(atoms(dict(atoms(moov)).get("udta", b""))).get("meta", b""), 4)).get("ilst", b"")
    for name, item in atoms(ilst):
        parts = list(atoms(item))
        if name == "----":
            named_ = dict(parts)
            name = "----:" + ":".join(named_.get(k, b"")[4:].decode("utf-8", "replace") for k in ("mean", "name"))
        for part, body in parts:
            kind = _number(body[:4])
            if part != "data" or len(body) < 8 or kind in (13, 14):
                continue
            if name in ("trkn", "disk"):
                nth, of = _number(body[10:12]), _number(body[12:14])
                yield name, "fixed8", (f"{nth}/{of}" if of else str(nth)).encode()
            else:
                yield name, "fixed8", body[8:] if kind == 1 or name.startswith("----") else str(_number(body[8:])).encode()


_FIELDS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("charset", T.StringType()), T.StructField("raw", T.BinaryType())]))


@F.pandas_udf(_FIELDS)
def tag_fields(id3: pd.Series, v1: pd.Series, lists: pd.Series, vorbis: pd.Series, ogg: pd.Series, moov: pd.Series) -> pd.Series:
    """The fields of each file's regions."""

    def one(id3, v1, lists, vorbis, ogg, moov):
        found = list(id3_fields(bytes(id3 or b"")))
        for chunk in lists if lists is not None else ():
            found += info_fields(bytes(chunk))
        return found + list(vorbis_fields(bytes(vorbis or b""))) + list(vorbis_fields(ogg_comments(bytes(ogg or b"")))) + list(mp4_fields(bytes(moov or b""))) or list(id3v1_fields(bytes(v1 or b"")))

    return pd.Series([[{"name": n, "charset": c, "raw": r} for n, c, r in one(*row)] for row in zip(id3, v1, lists, vorbis, ogg, moov)], dtype=object)


def _decoded(field: Column) -> Column:
    """The texts of a field: ID3 texts are split at their zeros."""
    raw, charset = field["raw"], field["charset"]
    marked = F.hex(cut(raw, 0, 2)) == "FFFE"
    text = F.when(charset == "latin", latin(raw)).when(charset == "utf16", utf16(raw, ~marked)).when(charset == "utf16be", utf16(raw, F.lit(True))).when(charset == "fixed", latin(raw)).otherwise(utf8(raw))
    return F.split(F.regexp_replace(text, "\\x{FEFF}", ""), "\\x00")


def with_tags(files: DataFrame, content: str = "content", tags: str = "tags") -> DataFrame:
    """files with a map of each container's tag names to all of their values in order."""
    data, kind, records = F.col(content), F.col("container"), F.col("records")
    body = lambda span: cut(data, span["at"], span["size"])
    chunk = F.coalesce(named(records, "id3 "), named(records, "ID3 "))
    regions = [
        F.when(F.col("head") > 0, cut(data, 0, F.col("head"))).when(chunk.isNotNull() & kind.isin("wav", "aiff"), body(chunk)), F.when(kind == "mpeg", cut(data, F.greatest(F.lit(0), F.col("bytes") - 128), 128)),
        F.when(kind == "wav", F.transform(F.filter(records, lambda s: s["name"] == "LIST"), body)), F.when(kind == "flac", body(named(records, "4"))),
        F.when(kind == "ogg", data), F.when(kind == "mp4", body(named(records, "moov"))),
    ]
    # The regions are worked out before the helper, so that the content itself stays behind.
    known = layout(files, content).select(*files.columns, *[r.alias(f"_region{i}") for i, r in enumerate(regions)])
    known = known.withColumn("_fields", tag_fields(*[F.col(f"_region{i}") for i in range(len(regions))]))
    known = known.withColumn("_texts", F.transform("_fields", lambda f: F.struct(f["name"].alias("name"), _decoded(f).alias("parts"))))
    # TXXX names its field before the value, COMM describes it.
    own = lambda e: e["name"].isin("TXXX", "COMM")
    name = lambda e: F.when(e["name"] == "TXXX", F.concat(F.lit("TXXX:"), e["parts"][0])).otherwise(e["name"])
    value = lambda e: F.filter(F.when(own(e), F.slice(e["parts"], 2, F.size(e["parts"]))).otherwise(e["parts"]), lambda v: v != "")
    known = known.withColumn("_texts", F.filter(F.transform("_texts", lambda e: F.struct(name(e).alias("name"), value(e).alias("values"))), lambda e: F.size(e["values"]) > 0))
    names = F.coalesce(F.array_distinct(F.transform("_texts", lambda e: e["name"])), F.array().cast("array<string>"))
    values = F.transform("_names", lambda n: F.flatten(F.transform(F.filter("_texts", lambda e: e["name"] == n), lambda e: e["values"])))
    return known.withColumn("_names", names).select(*files.columns, F.map_from_arrays("_names", values).alias(tags))


def first_values(tags: Column) -> Column:
    """A map of all values to one of the first that is not blank."""
    return F.transform_values(tags, lambda _, v: F.try_element_at(F.filter(v, lambda x: F.trim(x) != ""), F.lit(1)))


# Bit rates (kbit/s) and sample rates of MPEG audio, layer III, as far as a duration needs them; slots 1 to 14.
_KBITS = {3: (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
_HERTZ = {3: (44_100, 48_000, 32_000), 2: (22_050, 24_000, 16_000), 0: (11_025, 12_000, 8_000)}


def _stream(rate: Column, channels: Column, frames: Column, kind: Column) -> Column:
    return F.struct(rate.cast("long").alias("rate"), channels.cast("long").alias("channels"), frames.cast("long").alias("frames"), kind.cast("string").alias("subtype"))


def _listed(table: tuple[int, ...], index: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, table)), index.cast("int"))


def _mpeg(data: Column, at: Column, size: Column) -> Column:
    """Parameters of an MPEG layer III stream: the count that an information frame (Xing, Info or VBRI) states, else the bytes at the
    first frame's bit rate."""
    x = big(cut(data, at, 4))
    version, slot, hertz = F.shiftright(x, 19).bitwiseAND(3), F.shiftright(x, 12).bitwiseAND(15), F.shiftright(x, 10).bitwiseAND(3)
    first, mono = version == 3, F.shiftright(x, 6).bitwiseAND(3) == 3
    rate = F.when(first, _listed(_HERTZ[3], hertz + 1)).when(version == 2, _listed(_HERTZ[2], hertz + 1)).when(version == 0, _listed(_HERTZ[0], hertz + 1))
    kbits = F.when(slot > 0, F.when(first, _listed(_KBITS[3], slot)).otherwise(_listed(_KBITS[2], slot)))
    info = at + 4 + F.when(first, F.when(mono, 17).otherwise(32)).otherwise(F.when(mono, 9).otherwise(17))
    stated = F.when(F.hex(cut(data, info, 4)).isin("58696E67", "496E666F") & has(big(cut(data, info + 4, 4)), 1), big(cut(data, info + 8, 4)))
    stated = stated.when(F.hex(cut(data, at + 36, 4)) == "56425249", big(cut(data, at + 50, 4)))
    frames = F.coalesce(stated * F.when(first, 1152).otherwise(576), F.floor((size - at) * 8.0 * rate / (kbits * 1000)))
    layer3 = (F.shiftright(x, 21) == 0x7FF) & (F.shiftright(x, 17).bitwiseAND(3) == 1)
    return F.when(layer3 & rate.isNotNull(), _stream(rate, F.when(mono, 1).otherwise(2), frames, F.lit("FLOAT")))


def _wave(data: Column, form: Column, sound: Column) -> Column:
    at = form["at"]
    plain = little(data, at, 2)
    code = F.when((plain == 0xFFFE) & (form["size"] >= 26), little(data, at + 24, 2)).otherwise(plain)
    kinds = F.create_map(*[F.lit(x) for (c, b), kind in WAVE_KINDS.items() for x in (f"{c}/{b}", kind)])
    align = little(data, at + 12, 2)
    found = _stream(little(data, at + 4, 4), little(data, at + 2, 2), F.when(align > 0, F.floor(sound["size"] / align)), F.try_element_at(kinds, F.concat_ws("/", code, little(data, at + 14, 2))))
    return F.when(form["size"] >= 16, found)


def _aiff(data: Column, common: Column) -> Column:
    at = common["at"]
    bits, exponent = big(cut(data, at + 6, 2)), big(cut(data, at + 8, 2))
    # An 80-bit float: 15 bits of exponent, 64 of mantissa, read in two halves.
    rate = big(cut(data, at + 10, 4)) * F.pow(F.lit(2.0), exponent - 16414) + big(cut(data, at + 14, 4)) * F.pow(F.lit(2.0), exponent - 16446)
    kinds = F.create_map(*[F.lit(x) for kv in AIFF_KINDS.items() for x in kv])
    pcm = F.when(bits <= 8, "PCM_S8").otherwise(F.concat(F.lit("PCM_"), (F.ceil(bits / 8) * 8).cast("string")))
    kind = F.coalesce(F.when(common["size"] >= 22, F.try_element_at(kinds, latin(cut(data, at + 18, 4)))), pcm)
    return F.when(common["size"] >= 18, _stream(F.when(exponent.between(16383, 16414), rate), big(cut(data, at, 2)), big(cut(data, at + 2, 4)), kind))


def _flac(data: Column, info: Column) -> Column:
    x = big(cut(data, info["at"] + 10, 4))  # 20 bits of rate, 3 of channels, 5 of bits, then 36 of samples
    total = x.bitwiseAND(15) * F.lit(2**32) + big(cut(data, info["at"] + 14, 4))
    bits = F.shiftright(x, 4).bitwiseAND(31) + 1
    return F.when(info["size"] >= 34, _stream(F.shiftright(x, 12), F.shiftright(x, 9).bitwiseAND(7) + 1, F.when(total > 0, total), F.concat(F.lit("PCM_"), bits.cast("string"))))


#: Frames beyond two hours at 48 kHz are not believed.
MOST_FRAMES = 48_000 * 7_200
_PARAMETERS = ("container", "rate", "channels", "frames", "subtype", "seconds")


def with_stream(files: DataFrame, content: str = "content") -> DataFrame:
    """files with container, rate, channels, frames, subtype and seconds out of the headers; null where they say nothing."""
    data, kind, records = F.col(content), F.col("container"), F.col("records")
    kept = [c for c in files.columns if c not in _PARAMETERS]
    known = layout(files.select(*kept), content)
    known = known.withColumns({"_form": F.coalesce(named(records, "fmt "), named(records, "COMM"), named(records, "0")), "_sound": named(records, "data")})
    found = F.when(kind == "wav", _wave(data, F.col("_form"), F.col("_sound"))).when(kind == "aiff", _aiff(data, F.col("_form"))).when(kind == "flac", _flac(data, F.col("_form")))
    known = known.withColumn("_stream", found.when(kind == "mpeg", _mpeg(data, F.col("head"), F.col("bytes"))))
    frames, rate = (F.when(F.col(f"_stream.{c}").between(1, most), F.col(f"_stream.{c}")) for c, most in (("frames", MOST_FRAMES), ("rate", 2**32)))
    known = known.select(*kept, "container", rate.alias("rate"), F.col("_stream.channels").alias("channels"), frames.alias("frames"), F.col("_stream.subtype").alias("subtype"))
    return known.withColumn("seconds", F.col("frames") / F.col("rate"))
