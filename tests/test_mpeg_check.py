"""The MPEG walk in pieces against a walk of whole files."""

import random

import pytest

from medialake.operators import mpeg_check as M
from medialake.operators.integrity import mp3_frames
from medialake.queries import encoders as E


def check(spark, contents, piece=M.PIECE):
    df = spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in enumerate(contents)], "id int, content binary")
    return {r.id: (r.problem, r.frames) for r in M.mp3_check(df, "id", piece=piece).collect()}


def layer3(rate, pad):
    """A frame of MPEG 1 layer III at 44.1 kHz with one of several bit rates."""
    head = 0xFFFB0000 | rate << 12 | pad << 9
    size = M.frame_size(head)
    return head.to_bytes(4, "big") + bytes(size - 4)


@pytest.mark.parametrize("piece", [2_884, 5_000, 1 << 20])
def test_pieces_make_no_difference(spark, piece):
    """Variable bit rates, headers inside frames that are none, cuts and junk: frames as a walk from the start finds them."""
    rng = random.Random(piece)
    files = []
    for k in range(40):
        frames = [layer3(rng.randint(1, 14), rng.randint(0, 1)) for _ in range(rng.randint(1, 60))]
        frames = [f if rng.random() < 0.7 else f[:20] + b"\xff\xfb\x90\x00" + f[24:] for f in frames]
        data = b"".join(frames)
        files.append((data, data[: len(data) - rng.randint(1, 40)], data + bytes(rng.randint(4, 60)))[k % 3])
    for i, (problem, frames) in check(spark, files, piece).items():
        n, said, _ = mp3_frames(files[i])
        assert problem == {"": "", "TRUNCATED": "TRUNCATED", "LOST SYNC": "LOST SYNC @ END OF FILE"}[said]
        assert frames == n + (said == "TRUNCATED" and problem == "TRUNCATED" and frames > n)


def test_faults(spark):
    good, guarded, bad = E.mpeg_frame(), E.mpeg_frame(protected=True), E.mpeg_frame(protected=True, wrong=True)
    other = (0xFFF3 << 16 | 0x8440).to_bytes(4, "big") + bytes(188)
    got = check(spark, [
        None, b"", b"\xff", good, good * 3, guarded * 3, guarded * 200 + bad, good * 100 + b"x" * 500 + good * 2, good * 2 + other * 3, b"ID3\4\0\0\x80\0\0\0" + good, bytes(9) + good * 2,
        E.id3(4, []) + good * 2, E.id3(4, []) + bytes(30) + good * 2, b"\xff\xfb\x90\0" + bytes(10),
    ])
    assert got == {
        0: ("UNRECOGNISED FORMAT", 0), 1: ("UNRECOGNISED FORMAT", 0), 2: ("TRUNCATED", 0), 3: ("", 1), 4: ("", 3), 5: ("", 3), 6: ("CRC ERROR @ 0m 05s", 200), 7: ("LOST SYNC @ 0m 02s", 100),
        8: ("LOST SYNC @ END OF FILE", 2), 9: ("BAD ID3v2 TAG", 0), 10: ("BAD STARTING SYNC", 0), 11: ("", 2), 12: ("BAD ID3v2 TAG", 0), 13: ("TRUNCATED", 1),
    }


def test_tails(spark):
    good, v1 = E.mpeg_frame() * 2, E.id3v1("t", "a", "1999")
    old = b"LYRICSBEGIN" + b"words" * 9 + b"LYRICSEND"
    got = check(spark, [good + v1, good + old + v1, good + b"lost words LYRICSEND" + v1, good + b"000099LYRICS200" + v1, good + b"APETAGEX" + b"\0" * 24])
    assert {k: v[0] for k, v in got.items()} == {0: "", 1: "", 2: "LOST SYNC @ END OF FILE", 3: "LOST SYNC @ END OF FILE", 4: "LOST SYNC @ END OF FILE"}
    with pytest.raises(ValueError):
        check(spark, [good], 100)
