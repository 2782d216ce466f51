"""What shows only beyond the small tables: long numbers, hot keys, large groups."""

import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from medialake.functions.signal import residual
from medialake.operators import clusters, linkage
from medialake.operators.mpeg_check import mp3_check
from medialake.queries import containers, encoders, renaming


def test_sequence_goes_on_after_numbers_of_five_digits(spark, tmp_path):
    spark.range(1, 6).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(9_990, 12_350).selectExpr("id AS c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for name in ("part", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = con.execute(renaming.SQL["rnm16_sequence"]).fetchall()
    assert sorted(map(tuple, renaming.rnm16_sequence(spark, str(tmp_path)).collect())) == sorted(want)
    assert "song_12348" in {name for _, name in want}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_mpeg_pieces_come_together_without_a_python_call_a_file(spark):
    df = spark.createDataFrame([(i, bytearray(encoders.mpeg("gap", 40))) for i in range(3)], "id long, content binary")
    got = mp3_check(df, "id", piece=4096)
    assert "FlatMapGroups" not in _plan(got)
    assert {(r.problem, r.frames, r.ok) for r in got.collect()} == {("LOST SYNC @ 0m 00s", 21, False)}


def test_mpeg_files_are_read_and_measured_once(spark, tmp_path):
    """A filter by a function's result has that function run once more for it; and rows with a whole file's content wait for no function a piece."""
    forms = ("whole", "gap", "short tag", "none")
    spark.createDataFrame([(i, bytearray(encoders.mpeg(forms[i % 4], 40))) for i in range(8)], "id long, content binary").write.parquet(f"{tmp_path}/files")
    got = mp3_check(spark.read.parquet(f"{tmp_path}/files"), "id", piece=4096)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("FileScan"), plan.count("ArrowEvalPython [bounds"), plan.count("ArrowEvalPython")) == (1, 1, 1)
    want = {0: ("", 40), 1: ("LOST SYNC @ 0m 00s", 21), 2: ("BAD ID3v2 TAG", 0), 3: ("UNRECOGNISED FORMAT", 0)}
    assert sorted((r.id, r.problem, r.frames) for r in got.collect()) == [(i, *want[i % 4]) for i in range(8)]


def test_mpeg_files_go_to_python_and_back_in_batches_of_few_bytes(spark):
    most = 8 << 20

    @F.pandas_udf("long")
    def rows(content: pd.Series) -> pd.Series:
        return pd.Series([len(content)] * len(content))

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    mp3_check(spark.createDataFrame([(1, bytearray(9))], "id long, content binary"), "id")
    asked = spark.range(0, 40, 1, 1).select(F.unhex(F.repeat(F.lit("00"), 1 << 20)).alias("content")).select(rows("content").alias("n"))
    assert 1 <= max(r.n for r in asked.collect()) <= most >> 20
    form, n = pd.Series(["whole", "checksum", "tail"] * 700), pd.Series([50, 30, 41] * 700)
    made = list(containers._mpeg.func(iter([(form, n), (form[:3], n[:3])])))
    assert [x for part in made for x in part] == [encoders.mpeg(f, k) for f, k in [*zip(form, n), *zip(form[:3], n[:3])]]
    assert len(made) > 1 and max(sum(map(len, part)) for part in made) < most + 30_000


def test_small_tables_of_much_work_a_row_are_spread_over_the_cores(spark, sf):
    """The files made of parts are the input of src09 to src14, snk12 and int03: one small table, and each row runs through Python."""
    for made in (containers.tagged_files(spark, sf), containers.probed_files(spark, sf)):
        used = made.select(F.input_file_name().alias("f")).distinct().count()
        assert used >= 2 * spark.sparkContext.defaultParallelism


def test_pairs_of_a_hot_key_go_to_many_tasks(spark, monkeypatch):
    """One name that all rows have, next to others: pairs as a join gives them, none twice, no task with most of them."""
    monkeypatch.setattr(linkage, "BLOCK_ROWS", 20)
    monkeypatch.setattr(linkage, "TASK_PAIRS", 2_000)
    side = lambda low: spark.range(low, 400, 2).selectExpr("id", "'x' AS artist", "CASE WHEN id % 20 < 18 THEN 'hot' ELSE concat('t', id DIV 20) END AS title")
    left, right = side(0), side(1)
    want = {(r.ref, r.partner) for r in left.selectExpr("id AS ref", "artist", "title").join(right.selectExpr("id AS partner", "artist", "title"), ["artist", "title"]).collect()}
    got = linkage.candidates(left, right, 1.0)
    per_task = [len(rows) for rows in got.rdd.glom().collect()]
    pairs = [(r.ref, r.partner) for r in got.collect()]
    assert len(pairs) == len(want) > 30_000 and set(pairs) == want
    assert max(per_task) < len(pairs) / 3
    fuzzy = [(r.ref, r.partner) for r in linkage.candidates(left, right, 0.8).collect()]
    assert len(fuzzy) == len(set(fuzzy)) == 200 * 200  # all share the artist


def test_blocks_of_a_group_give_the_residual_of_all_pairs(spark, monkeypatch):
    """Several lengths, numbers that are none, copies at the very threshold and wild magnitudes, in blocks of a few rows."""
    monkeypatch.setattr(clusters, "BLOCK", 7)
    rng = random.Random(3)
    rows = [("g", i, [rng.gauss(0, 1) for _ in range(rng.choice((12, 12, 9)))]) for i in range(60)] + [("h", 100 + i, [10.0 ** (i * 12 - 170)] * 8) for i in range(30)]
    rows += [("g", 200, [1.0, None] + [0.0] * 10), ("g", 201, [float("nan")] * 12), ("g", 202, [float("inf")] * 12), ("g", 203, None), ("g", 204, [0.0] * 12), ("g", 205, [0.0] * 9), (None, 206, [0.0] * 9)]
    rows += [("t", 300, [1.0] * 4), ("t", 301, [-0.3] * 4), ("t", 302, [1.0 - 1.3] * 4), ("t", 303, [1.0] * 4)]
    df = spark.createDataFrame(rows, "g string, k long, v array<double>")
    a, b = df.select("g", F.col("k").alias("a"), F.col("v").alias("va")), df.select("g", F.col("k").alias("b"), F.col("v").alias("vb"))
    for threshold in (1.3, 0.9):
        want = {(r.a, r.b) for r in a.join(b, "g").where((F.col("a") < F.col("b")) & (residual(F.col("va"), F.col("vb")) < threshold)).select("a", "b").collect()}
        got = [(r.a, r.b) for r in clusters.residual_edges(df, "g", "k", "v", threshold).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
        if threshold < 1:
            continue
        parts = lambda edges: {(r.node, r.component) for r in clusters.components(edges).collect()}
        links = clusters.residual_links(df, "g", "k", "v", threshold)
        assert parts(links) == parts(spark.createDataFrame(sorted(want), "a long, b long"))
        assert links.count() < len(want)
