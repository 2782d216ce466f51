import hashlib
import json
import random

import pytest

from medialake.llm import bpe

ALPHABET = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "é", "日本", "😀", "1", "23", "<|endoftext|>", "!", "zzzzz", "²", "<|", "\r\n", "\x00"]
ALPHABET += ["\x1c", "\x1f", "\x85", "\u3000", "\ua7f1", "\U000323b0", "\U00016ff4", "\U0001e6c0", "\u0301", "\u00a0"]


@pytest.fixture(scope="module")
def library():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_equals_the_library(library, spark, sf):
    codec = bpe.Codec(json.loads(bpe.read_vocabulary()))
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(3_000)] + ["a" * 3_000, "ab" * 700 + " " + "\n" * 300, "", " ", " x "]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == ids and codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_character_is_cut_as_the_library_does(library):
    codec = bpe.Codec(json.loads(bpe.read_vocabulary()))
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(every), 5_000):
        text = "".join(f"a{c}1{c}!{c} {c}" for c in every[at : at + 5_000])
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_edge_rows(edge_docs, no_docs):
    rows = bpe.round_trip(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    got = {r.doc_id: r for r in rows}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[1].n_tokens == 0 and got[1].ids_sha256 == empty and got[2].decoded_sha256 == empty
    assert got[4].decoded_sha256 == hashlib.sha256(b"Hello world").hexdigest()
    assert bpe.round_trip(no_docs).count() == 0


def test_encode_then_decode_is_a_round_trip(edge_docs):
    texts = {(r.doc_id, r.text or "") for r in edge_docs.collect()}
    assert {(r.doc_id, r.text) for r in bpe.decode(bpe.encode(edge_docs)).collect()} == texts


def test_long_words_merge_alike():
    codec = bpe.Codec(json.loads(bpe.read_vocabulary()))
    rng = random.Random(2)
    for _ in range(50):
        raw = "".join(rng.choice("abcethn") for _ in range(rng.randint(2, 200))).encode()
        parts = [codec.singles[b] for b in raw]
        assert bpe.merge_ranks(list(parts), codec.pair) == bpe.merge_long(list(parts), codec.pair)


def test_ids_of_more_than_sixteen_bits():
    """A pair's key holds whatever ids a vocabulary has: (1, 65536 + 2) and (2, 2) are different pairs."""
    from medialake.llm.bpe import merge_long, merge_ranks

    pairs = {1 << 32 | 65_538: (0, 7), 2 << 32 | 2: (1, 9)}
    for merge in (merge_ranks, merge_long):
        assert merge([1, 65_538], pairs.get) in ([7], (7,)) and merge([2, 2], pairs.get) in ([9], (9,)) and merge([1, 2], pairs.get) == [1, 2]
