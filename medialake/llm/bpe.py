"""Byte-level BPE encoding and decoding with a contiguous rank array.

The vocabulary is read from a public tokenizer file, whose path is a parameter; nothing is trained. A word's parts are held
as one array of boundaries with, beside each boundary, the rank of the pair that starts there. The smallest rank is looked
for by a scan, the boundary between its two parts is deleted, and only the ranks of the two neighbouring pairs are
refreshed, until no pair has a rank. Words are short, so a scan costs less than a heap; a word longer than LONG_WORD bytes is
merged with a heap over the same arrays, which gives the same ids in n log n.

Encoding equals the tokenizers library's with special tokens of a text recognised and none added; truncation and padding are
unused. Decoding concatenates the bytes of the ids and reads them as UTF-8, invalid bytes becoming U+FFFD.

Defined cases: null text reads as empty, and empty text has no ids; texts are taken whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import textkernel as K
from .common import in_batches, table

VOCABULARY = "byte_bpe_50k.json"
LONG_WORD = 256
#: Entries of a worker's cache of encoded chunks: a bound on memory, not on what is encoded.
CACHED = 150_000
#: Letters and numbers that regex knows from a newer Unicode version than the tokenizers library does, which
#: takes them for neither.
NEWER = """
0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A
11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20
18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2
1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
#: How the byte-level scheme cuts a text into words; PINNED with the library's letters and numbers.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NEW = "[" + "".join("-".join(f"\\U{end:0>8}" for end in span.split("-")) for span in NEWER.split()) + "]"
PINNED = r"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{L}--NEW]+| ?[\p{N}--NEW]+| ?[[^\s\p{L}\p{N}]||NEW]+|\s+(?!\S)|\s+".replace("NEW", _NEW)
_NONE = (1 << 60, -1)


def _printable_bytes() -> dict[str, int]:
    """The byte that each character of a token stands for: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merge_ranks(parts: list[int], pair) -> list[int]:
    """The parts (token ids) after all merges; pair(a << 32 | b) gives (rank, merged id) or None.

    Entry i of the arrays is the part that starts at boundary i and the merge of the parts on both sides of boundary i + 1:
    deleting entry i + 1 deletes that boundary.
    """
    merges = [pair(a << 32 | b, _NONE) for a, b in zip(parts, parts[1:])]
    while merges:
        least = min(merges)
        if least is _NONE:
            break
        i = merges.index(least)
        parts[i] = least[1]
        del parts[i + 1], merges[i]
        if i < len(merges):
            merges[i] = pair(parts[i] << 32 | parts[i + 1], _NONE)
        if i:
            merges[i - 1] = pair(parts[i - 1] << 32 | parts[i], _NONE)
    return parts


def merge_long(parts: list[int], pair) -> list[int]:
    """As merge_ranks, for a long word: the next merge comes from a heap, leftmost first among equals."""
    n = len(parts)
    after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

    def push(i: int) -> None:
        if i >= 0 and after[i] < n and (found := pair(parts[i] << 32 | parts[after[i]], _NONE)) is not _NONE:
            heapq.heappush(heap, (found[0], i, parts[i], parts[after[i]], found[1]))

    for i in range(n):
        push(i)
    while heap:
        _, i, a, b, merged = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= n or parts[j] != b:
            continue
        parts[i], parts[j], after[i] = merged, -1, after[j]
        if after[j] < n:
            before[after[j]] = i
        push(i)
        push(before[i])
    return [p for p in parts if p >= 0]


class Codec:
    """Encodes and decodes whole texts; keeps the ids of the chunks it has met, up to CACHED of them."""

    def __init__(self, vocabulary: dict) -> None:
        model = vocabulary["model"]
        of = _printable_bytes()
        self.special = {t["content"]: t["id"] for t in vocabulary["added_tokens"]}
        self.ids = {bytes(of[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        token = model["vocab"]
        self.pair = {token[a] << 32 | token[b]: (r, token[a + b]) for r, (a, b) in enumerate(pairs)}.get
        self.bytes = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.digits = {i: str(i) for i in self.bytes}
        self.singles = [self.ids[bytes([b])] for b in range(256)]
        self.words, self.pinned, self.newer = regex.compile(WORDS), regex.compile(PINNED, regex.V1), regex.compile(_NEW)
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.chunks: dict[str, tuple[int, ...]] = {}  # by what follows the one space that starts the chunk

    def word(self, word: str) -> list[int]:
        singles, raw = self.singles, word.encode()
        return (merge_ranks if len(raw) <= LONG_WORD else merge_long)([singles[b] for b in raw], self.pair)

    def stretch(self, text: str) -> tuple[int, ...]:
        """The ids of a text that starts and ends where a word does."""
        words = (self.pinned if not text.isascii() and self.newer.search(text) else self.words).findall(text)
        if len(words) == 1:
            return tuple(self.word(words[0]))
        known = self.chunks.get
        return tuple([i for w in words for i in (w[0] == " " and known(w[1:]) or self.word(w))])

    def plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens.

        A word boundary stands before every single space between two other characters, so the stretches between such spaces
        are encoded one by one, each a look-up after its first time; stretches joined by other white space stay together.
        """
        pieces = text.split(" ")
        first, rest = pieces[0], pieces[1:]
        if rest and (not first or first[-1].isspace()):
            return self._joined(pieces)
        found = list(map(self.chunks.get, rest))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    piece = rest[k]
                    if not piece or piece[0].isspace() or piece[-1].isspace():
                        return self._joined(pieces)
                    found[k] = ids = self.chunks.get(piece) or self.stretch(" " + piece)
                    if len(self.chunks) < CACHED and len(piece) < 64:
                        self.chunks[piece] = ids
        return [*self.stretch(first), *chain.from_iterable(found)]

    def _joined(self, pieces: list[str]) -> list[int]:
        out, hold = [], [pieces[0]]
        for before, piece in zip(pieces, pieces[1:]):
            if before and not before[-1].isspace() and piece and not piece[0].isspace():
                out.extend(self.stretch("".join(hold)))
                hold = []
            hold.append(" " + piece)
        return [*out, *self.stretch("".join(hold))]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if not self.marks or not any(s in text for s in self.special):
            return self.plain(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            if m.start() > at:
                out += self.plain(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + (self.plain(text[at:]) if at < len(text) else [])

    def decode(self, ids) -> str:
        of = self.bytes
        return b"".join(map(of.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def _codec(vocabulary: str) -> Codec:
    return Codec(json.loads(vocabulary))


def read_vocabulary(path: str | None = None) -> str:
    """The tokenizer file as text; without a path, the installed public one. Read on the driver (about 1.5 MB) and broadcast."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as f:
        return f.read()


def _mapped(docs: DataFrame, keep: list[str], schema: str, vocabulary: str | None, row) -> DataFrame:
    """docs' columns keep with those that row(codec, text) returns, in batches of bounded bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    fields = docs.select(*keep).schema
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    kinds = [types[c.split(" ", 1)[1]] for c in schema.split(", ")]

    def run(batches):
        codec = _codec(shared.value)
        for piece in K.blocks(batches, "text"):
            rows = [row(codec, t or "") for t in piece.column(piece.schema.get_field_index("text")).to_pylist()]
            new = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([piece.column(piece.schema.get_field_index(c)) for c in keep] + new, keep + names)

    old = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return in_batches(docs).select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{old}, {schema}" if old else schema)


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text."""
    return _mapped(docs, ["doc_id"], "ids array<int>", vocabulary, lambda codec, text: (codec.encode(text),))


def decode(tokens: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    shared = tokens.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches):
        codec = _codec(shared.value)
        for batch in batches:
            texts = [codec.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _digest(codec: Codec, text: str) -> tuple[int, str, str]:
    ids = codec.encode(text)
    listed = ",".join(map(codec.digits.__getitem__, ids))
    return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes every whole text and decodes its ids in one pass."""
    return _mapped(docs, ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string", vocabulary, _digest)


def op2_bpe(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"))
