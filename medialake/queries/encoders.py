"""Bytes of small audio files, put together by the container standards: what the container queries read back.

These stand in for a folder of files and share nothing with the reader in sources/containers.py.
"""

from __future__ import annotations

import struct
from functools import lru_cache

_CHARSETS = [("latin-1", b"", b"\0"), ("utf-16-le", b"\xff\xfe", b"\0\0"), ("utf-16-be", b"", b"\0\0"), ("utf-8", b"", b"\0")]


def sevens(n: int) -> bytes:
    return bytes(n >> 7 * k & 127 for k in (3, 2, 1, 0))


def spread(body: bytes) -> bytes:
    """Unsynchronised: a zero behind each FF."""
    return body.replace(b"\xff", b"\xff\0")


def text(encoding: int, *values: str, lead: bytes = b"") -> bytes:
    charset, mark, zero = _CHARSETS[encoding]
    return bytes([encoding]) + lead + zero.join(mark + v.encode(charset) for v in values)


def frame(major: int, name: str, body: bytes, unsynchronised: bool = False) -> bytes:
    body = spread(body) if unsynchronised else body
    size = len(body).to_bytes(3, "big") if major == 2 else len(body).to_bytes(4, "big") if major == 3 else sevens(len(body))
    return name.encode() + size + (b"" if major == 2 else b"\0\2" if unsynchronised else b"\0\0") + body


def id3(major: int, frames: list[bytes], flags: int = 0) -> bytes:
    body = b"".join(frames) + bytes(20)
    body = spread(body) if flags & 0x80 and major < 4 else body
    return b"ID3" + bytes([major, 0, flags]) + sevens(len(body)) + body


def id3v1(title: str, artist: str, year: str) -> bytes:
    return b"TAG" + title.encode("latin-1").ljust(30, b"\0") + artist.encode("latin-1").ljust(30, b"\0") + bytes(30) + year.encode() + bytes(30) + b"\xff"


def chunk(name: str, body: bytes, order: str = "little") -> bytes:
    return name.encode() + len(body).to_bytes(4, order) + body + bytes(len(body) % 2)


def wave(*chunks: bytes) -> bytes:
    return chunk("RIFF", b"WAVE" + b"".join(chunks))


def aiff(kind: str, *chunks: bytes) -> bytes:
    return chunk("FORM", kind.encode() + b"".join(chunks), "big")


def info(**values: str) -> bytes:
    return chunk("LIST", b"INFO" + b"".join(chunk(k, v.encode() + b"\0") for k, v in values.items()))


def wave_format(code: int, channels: int, rate: int, bits: int, extensible: bool = False) -> bytes:
    width = channels * bits // 8
    head = struct.pack("<HHIIHH", 0xFFFE if extensible else code, channels, rate, rate * width, width, bits)
    return chunk("fmt ", head + struct.pack("<HHIH", 22, bits, 3, code) + bytes.fromhex("000000001000800000AA00389B71") if extensible else head)


def extended(rate: int) -> bytes:
    """A whole number as an 80-bit float."""
    top = rate.bit_length() - 1
    return struct.pack(">HQ", 16383 + top, rate << (63 - top))


def comments(pairs: list[tuple[str, str]]) -> bytes:
    listed = [f"{k}={v}".encode() for k, v in pairs]
    return struct.pack("<I", 4) + b"made" + struct.pack("<I", len(listed)) + b"".join(struct.pack("<I", len(x)) + x for x in listed)


def flac(rate: int, channels: int, bits: int, samples: int, *blocks: tuple[int, bytes]) -> bytes:
    packed = rate << 44 | (channels - 1) << 41 | (bits - 1) << 36 | samples
    every = [(0, struct.pack(">HH", 4096, 4096) + bytes(6) + packed.to_bytes(8, "big") + bytes(16)), *blocks]
    return b"fLaC" + b"".join(bytes([kind | 128 * (i == len(every) - 1)]) + len(body).to_bytes(3, "big") + body for i, (kind, body) in enumerate(every)) + b"\xff\xf8"


def ogg(first: bytes, packet: bytes) -> bytes:
    """The first packet on a page of its own, the second cut over pages of 255 bytes and a last one."""
    page = lambda flags, table, body: b"OggS\0" + bytes([flags]) + bytes(20) + bytes([len(table)]) + bytes(table) + body
    n = len(packet) // 255
    middle = b"".join(page(1, [255], packet[255 * i : 255 * i + 255]) for i in range(n))
    return page(2, [len(first)], first) + middle + page(1, [len(packet) - 255 * n], packet[255 * n :]) + page(0, [4], b"\5vor")


def atom(name: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return (len(body) + 8).to_bytes(4, "big") + name.encode("latin-1") + body


def item(name: str, value: bytes, kind: int = 1) -> bytes:
    return atom(name, atom("data", kind.to_bytes(4, "big"), bytes(4), value))


def own_item(name: str, value: str) -> bytes:
    return atom("----", atom("mean", bytes(4), b"com.apple.iTunes"), atom("name", bytes(4), name.encode()), atom("data", b"\0\0\0\1", bytes(4), value.encode()))


def mp4(*items: bytes) -> bytes:
    tags = atom("udta", atom("meta", bytes(4), atom("hdlr", bytes(12)), atom("ilst", *items)))
    return atom("ftyp", b"M4A ", bytes(4)) + atom("free", bytes(9)) + atom("moov", atom("mvhd", bytes(20)), tags)


#: The forms in which a tagged file is made, and their endings.
TAGGED = {
    "id3v2.3 latin": ".mp3", "id3v2.3 utf-16": ".mp3", "id3v2.4": ".mp3", "id3v2.4 unsynchronised": ".mp3", "id3v2.2": ".mp3", "wav info": ".wav", "wav id3": ".wav", "aiff": ".aiff",
    "flac": ".flac", "ogg": ".ogg", "opus": ".opus", "mp4": ".m4a", "id3v1": ".mp3", "cut": ".mp3", "looping": ".m4a", "empty": ".flac",
}


def tagged(form: str, title: str, artist: str, wide: str, genre: str, mood: str, key: str | None) -> bytes:
    """A file of that form; key C goes where older taggers put it."""

    def frames(major: int, encoding: int, unsynchronised: bool = False) -> list[bytes]:
        names = ("TT2", "TP1", "TCO", "COM", "TXX", "TKE") if major == 2 else ("TIT2", "TPE1", "TCON", "COMM", "TXXX", "TKEY")
        one = lambda name, body: frame(major, name, body, unsynchronised)
        own = [one(names[5], text(encoding, key))] if key == "Am" else [one(names[4], text(encoding, "KEY", key))] if key else []
        return [
            one(names[0], text(encoding, title)), one(names[1], text(encoding, wide if encoding else artist, "second")), one(names[2], text(encoding, genre)),
            one(names[3], text(encoding, "", "a note", lead=b"eng")), one(names[4], text(encoding, "MOOD", mood)), *own,
        ]

    vorbis = comments([("title", title), ("Artist", wide), ("ARTIST", "second"), ("GENRE", genre), ("mood", mood), ("INITIALKEY" if key == "Am" else "KEY", key or "")])
    silence = chunk("data", bytes(7))
    if form == "wav info":
        return wave(wave_format(1, 2, 44_100, 16), silence, info(INAM=title, IART=wide, IGNR=genre))
    if form == "mp4":
        keys = [own_item("initialkey" if key == "Am" else "KEY", key)] if key else []
        return mp4(item("\xa9nam", title.encode()), item("\xa9ART", wide.encode()), item("\xa9gen", genre.encode()), item("trkn", bytes.fromhex("0000000300090000"), 0), own_item("MOOD", mood), *keys)
    return {
        "id3v2.3 latin": lambda: id3(3, frames(3, 0)), "id3v2.3 utf-16": lambda: id3(3, frames(3, 1)), "id3v2.4": lambda: id3(4, frames(4, 3)),
        "id3v2.4 unsynchronised": lambda: id3(4, frames(4, 1, True), 0x80), "id3v2.2": lambda: id3(2, frames(2, 2)), "wav id3": lambda: wave(silence, chunk("id3 ", id3(3, frames(3, 0), 0x80))),
        "aiff": lambda: aiff("AIFF", chunk("ID3 ", id3(4, frames(4, 2)), "big")), "flac": lambda: flac(44_100, 2, 16, 100, (4, vorbis)),
        "ogg": lambda: ogg(b"\1vorbis", b"\3vorbis" + vorbis + b"\1"), "opus": lambda: ogg(b"OpusHead", b"OpusTags" + vorbis),
        "id3v1": lambda: b"\xff\xfb\x90\0" + bytes(30) + id3v1("a title", "an artist", "1999"), "cut": lambda: id3(3, frames(3, 0))[:60],
        "looping": lambda: atom("ftyp", b"M4A ") + b"\0\0\0\0moov" + b"\0\0\0\0udta" + b"\0\0\0\2meta", "empty": lambda: b"",
    }[form]()


#: The forms in which a stream is made.
STREAMS = ("wav 16", "wav 24 extensible", "wav float", "wav 8 cut", "aiff", "aifc", "flac", "xing", "vbri", "constant", "nothing")


def stream(form: str, title: str, n: int, channels: int) -> bytes:
    """A file whose header tells of n frames (n thousand, n million in aiff and flac)."""
    silence = lambda width: chunk("data", bytes(n * channels * width))
    common = lambda bits, rate, rest=b"": chunk("COMM", struct.pack(">HIH", channels, n * 1000, bits) + extended(rate) + rest, "big")
    named, first = id3(3, [frame(3, "TIT2", text(0, title))]), b"\xff\xfb\x90\0" + bytes(32)
    return {
        "wav 16": lambda: wave(wave_format(1, channels, 44_100, 16), silence(2)),
        "wav 24 extensible": lambda: named + wave(chunk("JUNK", bytes(27)), info(INAM="fmt "), wave_format(1, channels, 96_000, 24, True), silence(3)),
        "wav float": lambda: wave(wave_format(3, channels, 48_000, 32), chunk("fact", bytes(4)), silence(4)),
        "wav 8 cut": lambda: wave(wave_format(1, channels, 22_050, 8)) + b"data" + struct.pack("<I", 4_000_000) + bytes(n * channels),
        "aiff": lambda: aiff("AIFF", common(24, 44_100), chunk("SSND", bytes(8), "big")), "aifc": lambda: aiff("AIFC", common(32, 192_000, b"fl32\0\0")),
        "flac": lambda: flac(88_200, channels, 20, n * 1_000_000, (1, bytes(40))), "xing": lambda: named + first + b"Xing" + struct.pack(">II", 1, n) + bytes(373),
        "vbri": lambda: first + b"VBRI" + bytes(10) + struct.pack(">I", n) + bytes(363), "constant": lambda: b"\xff\xf3\x84\x40" + bytes(n * 100), "nothing": lambda: bytes(40),
    }[form]()


@lru_cache(maxsize=1024)
def mpeg_frame(body: bytes = b"", protected: bool = False, wrong: bool = False) -> bytes:
    """A frame of 417 bytes (MPEG 1, layer III, 128 kbit/s, 44.1 kHz, stereo), with a checksum of its side information if protected."""
    head, side = (b"\xff\xfa\x90\0" if protected else b"\xff\xfb\x90\0"), bytes(range(32))
    if not protected:
        return (head + (body or bytes(32))).ljust(417, b"\0")
    crc = 0xFFFF
    for bit in "".join(f"{b:08b}" for b in head[2:] + side):
        crc = (crc << 1) ^ (0x8005 if (crc >> 15) ^ int(bit) else 0)
        crc &= 0xFFFF
    return (head + (crc ^ wrong).to_bytes(2, "big") + side).ljust(417, b"\0")


#: The forms in which an MPEG stream is made.
MPEGS = ("whole", "checksum", "gap", "tail", "short tag", "cut", "tails", "none")


def mpeg(form: str, n: int) -> bytes:
    """A stream of n frames, whole or with a fault around its middle."""
    frames, half = [mpeg_frame()] * n, n // 2
    ape = b"APETAGEX" + struct.pack("<IIII", 2000, 40, 0, 0) + bytes(8)
    lyrics = b"LYRICSBEGIN" + b"la" * 20
    return {
        "whole": lambda: id3(4, [frame(4, "TIT2", text(3, "t"))]) + mpeg_frame(bytes(32) + b"Info" + struct.pack(">II", 1, n - 1)) + b"".join(frames[1:]) + id3v1("t", "a", "1999"),
        "checksum": lambda: b"".join(mpeg_frame(protected=True, wrong=i == half) for i in range(n)),
        "gap": lambda: b"".join(frames[: half + 1]) + bytes(100) + b"".join([mpeg_frame()] * 9), "tail": lambda: b"".join(frames) + bytes(50),
        "short tag": lambda: id3(3, [])[:-6] + bytes(16) + b"".join(frames) + b"".join(frames), "cut": lambda: b"".join(frames)[:-20],
        "tails": lambda: b"".join(frames) + bytes(8) + ape + lyrics + f"{len(lyrics):06d}".encode() + b"LYRICS200" + id3v1("t", "a", "1999"), "none": lambda: bytes(100),
    }[form]()
