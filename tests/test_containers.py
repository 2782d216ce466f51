"""Tags and stream parameters from bytes: cut, looping and odd inputs."""

import pytest
from pyspark.sql import functions as F

from medialake.queries import encoders as E
from medialake.sources import containers as C


def read(spark, contents):
    df = spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in enumerate(contents)], "id int, content binary")
    return {r.id: r.tags for r in C.with_tags(df).collect()}


def probe(spark, contents):
    df = spark.createDataFrame([(i, None if c is None else bytearray(c), 1) for i, c in enumerate(contents)], "id int, content binary, rate int")
    return [(r.container, r.rate, r.channels, r.frames, r.subtype) for r in C.with_stream(df).orderBy("id").collect()]


def whole(form):
    return E.tagged(form, "a title", "an artist é", "Жé😀ÿ", "house", "calm", "Am")


@pytest.mark.parametrize("form", ["id3v2.3 utf-16", "flac", "mp4", "ogg", "wav info"])
def test_every_cut_is_read_without_harm(spark, form):
    """A file cut anywhere gives its tags or fewer, never other ones."""
    data = whole(form)
    full = read(spark, [data])[0]
    assert full
    for tags in read(spark, [data[:n] for n in range(0, len(data), 7)]).values():
        for name, values in tags.items():
            assert values == full[name] or form == "wav info"


def test_sizes_that_lie(spark):
    loop = E.atom("ftyp", b"M4A ") + b"\0\0\0\0moov" + b"\0\0\0\4udta"
    many = b"fLaC" + b"\x04" + b"\xff\xff\xff" + b"x"
    counted = E.flac(44_100, 2, 16, 9, (4, b"\4\0\0\0made\xff\xff\xff\x7f"))
    assert set(map(str, read(spark, [loop, many, counted, b"ID3\4\0\0\x7f\x7f\x7f\x7f", b"RIFF\xff\xff\xff\xffWAVELIST\xff\xff\xff\xffINFO", None, b"", b"\xff"]).values())) == {"{}"}


def test_halves_of_pairs_and_odd_bytes(spark):
    frame = lambda raw: E.id3(3, [E.frame(3, "TIT2", b"\1\xff\xfe" + raw)])
    lone, odd, good = "a".encode("utf-16-le") + b"\x00\xd8" + "b".encode("utf-16-le"), "ab".encode("utf-16-le") + b"\0", "a😀b".encode("utf-16-le")
    tags = read(spark, [frame(lone), frame(odd), frame(good), E.id3(3, [E.frame(3, "TIT2", b"\3a\xffb")]), E.id3(3, [E.frame(3, "TIT2", b"\7abc")])])
    assert [t.get("TIT2") for t in tags.values()] == [["a�b"], ["ab"], ["a😀b"], ["a�b"], ["\7abc".strip("\7")]]


def test_more_records_than_a_fold_has_steps(spark):
    data = E.wave(*[E.chunk("junk", bytes(2))] * 200, E.wave_format(1, 2, 48_000, 16), E.chunk("data", bytes(400)), E.info(INAM="late"))
    assert probe(spark, [data]) == [("wav", 48_000, 2, 100, "PCM_16")]
    assert read(spark, [data])[0] == {"INAM": ["late"]}


def test_streams_that_say_nothing(spark):
    none = (None,) * 4
    long = E.flac(44_100, 2, 16, C.MOST_FRAMES + 1)
    got = probe(spark, [None, b"", b"RIFF", E.wave(), long, E.aiff("AIFF"), b"\xff\xfb\xf0\0" + bytes(50), E.wave(E.wave_format(1, 0, 0, 16), E.chunk("data", b"ab"))])
    assert got == [(None, *none), (None, *none), (None, *none), ("wav", *none), ("flac", 44_100, 2, None, "PCM_16"), ("aiff", *none), ("mpeg", 44_100, 2, None, "FLOAT"), ("wav", None, 0, None, "PCM_16")]


def test_tags_and_owner_frames(spark):
    tag = E.id3(4, [E.frame(4, "TXXX", E.text(3, "MOOD", "a", "b")), E.frame(4, "TXXX", E.text(3, "MOOD", "c")), E.frame(4, "UFID", b"me\0id"), E.frame(4, "TIT2", b""), E.frame(4, "APIC", b"\0image")])
    packed = E.id3(4, [b"TIT2" + E.sevens(3) + b"\0\x08" + b"\3ab", E.frame(4, "TPE1", E.text(3, "x"))])
    tags = read(spark, [tag, packed, tag[:10]])
    assert tags == {0: {"TXXX:MOOD": ["a", "b", "c"], "UFID:me": ["id"]}, 1: {"TPE1": ["x"]}, 2: {}}


def test_the_probe_needs_no_python(spark):
    df = spark.createDataFrame([(1, bytearray(b"x"))], "id int, content binary")
    plan = C.with_stream(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert C.with_stream(df.select("id", "content", F.lit(1).alias("records"), F.lit(2).alias("head"))).count() == 1


def test_tags_of_one_vorbis_name_keep_their_values(spark):
    from medialake.sources.sinks import vorbis_tags

    df = spark.sql("SELECT map('TDRC', array('1999', ' '), 'TYER', array('2001'), 'x~y', array('v'), 'ключ', array('k'), '_=_', array('e'), 'empty', array('', NULL), 'UFID:me', array('i')) AS tags, map('a', array('b')) AS none")
    got = df.select(vorbis_tags(F.col("tags")).alias("t"), vorbis_tags(F.expr("map_filter(none, (k, v) -> false)")).alias("n")).first()
    assert got.t == {"DATE": ["1999", "2001"], "X_Y": ["v"], "UFID:me": ["i"]}
    assert got.n == {}


def test_walks_of_any_number_of_records(spark):
    """The first fold takes few steps; records beyond it, and beyond STEPS, are found too."""
    counts = [0, 1, C.FIRST_STEPS, C.FIRST_STEPS + 1, C.STEPS, C.STEPS + 1, 150]
    files = spark.createDataFrame([(n, bytearray(E.wave(*[E.chunk(f"c{i:03d}", bytes(i % 3)) for i in range(n)]))) for n in counts], "id int, content binary")
    got = {r.id: [x.name for x in r.records] for r in C.layout(files).collect()}
    assert got == {n: [f"c{i:03d}" for i in range(n)] for n in counts}
