"""Signals that go over many rows (SIG-9, SIG-12, SIG-17): the vectors of a label, one after the other, are one song."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks as B
from .fixtures import load

_RATE, _REACH = 100, 4


def songs(spark, sf) -> DataFrame:
    """(song, start, samples): a stretch of 64 samples a vector; a vec_id that is missing leaves silence."""
    e = load(spark, sf, "embeddings")
    return e.select((F.col("vec_id") % 10).alias("song"), (F.floor(F.col("vec_id") / 10) * 64).alias("start"), F.col("embedding").cast("array<double>").alias("samples"))


def _moved(df: DataFrame, by) -> DataFrame:
    return df.withColumn("start", F.col("start") + by).where("start >= 0")


def sig17_power_frames(spark, sf):
    power = B.power_spectrum(songs(spark, sf), ["song"], 32, 16, block=112)
    return power.select("song", "frame", F.posexplode("values").alias("bin", "power")).withColumn("power", F.round("power", 6))


def sig17_log_mel(spark, sf):
    mel = B.log_mel(songs(spark, sf), ["song"], 1000, 32, 16, 6, block=112)
    return mel.select("song", "frame", F.posexplode("values").alias("band", "level")).withColumn("level", F.round("level", 6))


def sig09_block_delays(spark, sf):
    """Each song against a copy of half the level that is shifted; the last song's copy is too short to tell."""
    song = songs(spark, sf)
    copy = _moved(song, F.col("song") * 97 % 700 - 350).withColumn("samples", F.transform("samples", lambda x: x / 2)).where("song < 9 or start < 64")
    return B.delays(song, copy, ["song"], _RATE, _REACH, block=256)


def sig12_alignment_plan(spark, sf):
    """The stems of each song: an instrumental that lags, an acapella that is early; one song lacks a stem, one is done."""
    song = songs(spark, sf).withColumnRenamed("song", "folder")
    early = _moved(song, -(F.col("folder") * 31)).withColumn("samples", F.when(F.col("start") < 1600, F.transform("samples", lambda x: x / 100)).otherwise(F.col("samples")))
    roles = [("original", song), ("instrumental", _moved(song, F.col("folder") * 13)), ("acapella", early.where("folder <> 7"))]
    every = roles[0][1].limit(0).withColumn("role", F.lit(""))
    for name, df in roles:
        every = every.unionByName(df.withColumn("role", F.lit(name)))
    done = song.where("folder = 8").select("folder").distinct()
    plan = B.alignment_plan(every, done, "folder", "role", _RATE, _REACH, 18.0, block=256)
    return plan.withColumns({c: F.round(c, 6) for c in ("shift", "onset_original", "onset_acapella")})


def sig12_aligned_stems(spark, sf):
    """Sums of the moved stems by place: the plan applied to the blocks."""
    song = songs(spark, sf).withColumnRenamed("song", "folder")
    stems = song.withColumn("role", F.lit("acapella"))
    plan = song.groupBy("folder").agg(F.max(F.col("start") + 64).alias("n")).select("folder", F.lit("aligned").alias("status"), F.lit("acapella").alias("role"),
        F.greatest(F.lit(0), F.col("folder") * 50 - 200).alias("pad"), F.greatest(F.lit(0), 200 - F.col("folder") * 50).alias("trim"), (F.col("n") - 30).alias("target"))
    moved = B.aligned(stems, plan, "folder", "role").select("folder", "start", F.posexplode("samples").alias("i", "x"))
    place = F.col("start") + F.col("i")
    return moved.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.max(place).alias("last"), F.round(F.sum("x"), 6).alias("total"), F.round(F.sum(F.col("x") * (place % 101)), 4).alias("weighted"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("sig")}

_SONGS = "SELECT vec_id % 10 AS song, vec_id // 10 * 64 + i AS pos, CAST(embedding[i + 1] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings)"
_SPECTRUM = f"""WITH s AS ({_SONGS}), f AS (
    SELECT s.song, k.frame, pos - k.frame * 16 + 16 AS t, x * (0.5 - 0.5 * cos(2 * pi() * (pos - k.frame * 16 + 16) / 31)) AS x
    FROM s JOIN (SELECT song, max(pos) + 1 AS n FROM s GROUP BY song) e ON e.song = s.song
      JOIN (SELECT unnest(range(100000)) AS frame) k ON k.frame BETWEEN (pos - 15) // 16 AND (pos + 16) // 16 AND k.frame >= 0 AND k.frame <= ceil(e.n / 16.0)
    WHERE pos - k.frame * 16 + 16 BETWEEN 0 AND 31
  ), p AS (SELECT song, frame, bin, pow(sum(x * cos(2 * pi() * bin * t / 32)), 2) + pow(sum(x * sin(2 * pi() * bin * t / 32)), 2) AS power FROM f, (SELECT unnest(range(17)) AS bin) b GROUP BY ALL)"""
_PAIRED = """n AS (SELECT r.key, least(r.n, q.n, 1800) AS n FROM (SELECT key, max(pos) + 1 AS n FROM r GROUP BY key) r JOIN (SELECT key, max(pos) + 1 AS n FROM q GROUP BY key) q ON r.key = q.key),
  rc AS (SELECT r.* FROM r JOIN n ON n.key = r.key AND r.pos < n.n AND n.n >= 100), qc AS (SELECT q.* FROM q JOIN n ON n.key = q.key AND q.pos < n.n AND n.n >= 100),
  pk AS (SELECT a.key, a.m * b.m AS m FROM (SELECT key, max(abs(x)) AS m FROM rc GROUP BY key) a JOIN (SELECT key, max(abs(x)) AS m FROM qc GROUP BY key) b ON a.key = b.key),
  c AS (SELECT rc.key, rc.pos - qc.pos AS lag, round(sum(rc.x * qc.x) / any_value(pk.m), 9) AS v FROM rc JOIN qc ON rc.key = qc.key AND rc.pos - qc.pos BETWEEN -400 AND 400 JOIN pk ON pk.key = rc.key GROUP BY ALL),
  lags AS (SELECT n.key, coalesce(arg_max(lag, (v, -lag)), 0) AS lag FROM n LEFT JOIN c ON c.key = n.key GROUP BY n.key)"""
_STEMS = f"""s AS ({_SONGS}), st AS (SELECT song AS folder, 'original' AS role, pos, x FROM s UNION ALL SELECT song, 'instrumental', pos + song * 13, x FROM s WHERE pos // 64 * 64 + song * 13 >= 0
    UNION ALL SELECT song, 'acapella', pos - song * 31, CASE WHEN pos // 64 * 64 - song * 31 < 1600 THEN x / 100 ELSE x END FROM s WHERE song <> 7 AND pos // 64 * 64 - song * 31 >= 0)"""
SQL = {
    "sig17_power_frames": f"{_SPECTRUM} SELECT song, frame, bin, round(power, 6) AS power FROM p",
    "sig17_log_mel": f"""{_SPECTRUM}, e AS (SELECT band, band * 500 / 7.0 AS l, (band + 1) * 500 / 7.0 AS m, (band + 2) * 500 / 7.0 AS r FROM (SELECT unnest(range(6)) AS band)),
      w AS (SELECT band, bin, greatest(0, least((bin * 31.25 - l) / (m - l), (r - bin * 31.25) / (r - m))) * 2 / (r - l) AS w FROM e, (SELECT unnest(range(17)) AS bin) b)
      SELECT song, frame, band, round(log10(1 + 10000 * sum(power * w)), 6) AS level FROM p JOIN w ON w.bin = p.bin GROUP BY ALL""",
    "sig09_block_delays": f"""WITH s AS ({_SONGS}), r AS (SELECT song AS key, pos, x FROM s),
      q AS (SELECT song AS key, pos + song * 97 % 700 - 350 AS pos, x / 2 AS x FROM s WHERE pos // 64 * 64 + song * 97 % 700 - 350 >= 0 AND (song < 9 OR pos // 64 * 64 + song * 97 % 700 - 350 < 64)),
      {_PAIRED} SELECT key AS song, lag FROM lags""",
    "sig12_alignment_plan": f"""WITH {_STEMS}, o AS (SELECT folder, array_to_string(list_filter(['instrumental', 'acapella', 'original'], lambda x: NOT list_contains(list(DISTINCT role), x)), ', ') AS missing FROM st GROUP BY folder),
      k AS (SELECT folder, missing, CASE WHEN missing <> '' THEN 'missing' WHEN folder = 8 THEN 'skipped' ELSE 'aligned' END AS status FROM o),
      r AS (SELECT {{'f': st.folder, 'r': t.role}} AS key, pos, x FROM st JOIN (VALUES ('instrumental'), ('acapella')) t(role) ON st.role = 'original' WHERE pos < 2200),
      q AS (SELECT {{'f': folder, 'r': role}} AS key, pos, x FROM st WHERE role <> 'original' AND pos < 2200), {_PAIRED},
      cl AS (SELECT folder, role, pos, x, least((max(pos) OVER (PARTITION BY folder, role)) + 1, 1800) AS n FROM st WHERE role <> 'instrumental'),
      fr AS (SELECT folder, role, frame, sqrt(sum(x * x) / 2048) AS rms FROM cl, (SELECT unnest(range(8)) AS frame) f WHERE pos < n AND n >= 25 AND frame <= n // 512 AND pos BETWEEN frame * 512 - 1024 AND frame * 512 + 1023 GROUP BY ALL),
      b AS (SELECT folder, role, greatest(0.18 * max(rms), 0.35 * quantile_cont(rms, 0.85)) AS bar FROM fr GROUP BY ALL),
      ons AS (SELECT fr.folder, fr.role, min(frame) * 512 / 100.0 AS onset FROM fr JOIN b ON b.folder = fr.folder AND b.role = fr.role AND rms >= bar GROUP BY ALL),
      t AS (SELECT folder, max(pos) + 1 AS target FROM st WHERE role = 'original' GROUP BY folder),
      g AS (SELECT key.f AS folder, key.r AS role, greatest(lag, 0) AS pad, greatest(-lag, 0) AS trim, round(lag / 100.0, 6) AS shift, target, round(coalesce(oo.onset, 0), 6) AS onset_original, round(coalesce(oa.onset, 0), 6) AS onset_acapella
        FROM lags JOIN t ON t.folder = key.f LEFT JOIN ons oo ON oo.folder = key.f AND oo.role = 'original' LEFT JOIN ons oa ON oa.folder = key.f AND oa.role = 'acapella')
      SELECT k.folder, status, missing, role, pad, trim, shift, target, onset_original, onset_acapella FROM k LEFT JOIN g ON g.folder = k.folder AND status = 'aligned'""",
    "sig12_aligned_stems": f"""WITH s AS ({_SONGS}), e AS (SELECT song, max(pos) + 1 - 30 AS target FROM s GROUP BY song), m AS (SELECT s.song, pos + s.song * 50 - 200 AS place, x, target FROM s JOIN e ON e.song = s.song)
      SELECT song AS folder, count(*) AS n, max(place) AS last, round(sum(x), 6) AS total, round(sum(x * (place % 101)), 4) AS weighted FROM m WHERE place >= 0 AND place < target GROUP BY song""",
}
