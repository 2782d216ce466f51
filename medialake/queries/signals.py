"""Signal measures on arrays (SIG) and the silence floor (FLT-6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signal as G
from ..operators.facets import mix_down, overlap_add
from .fixtures import load


def _signals(spark, sf):
    return load(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.when(F.round(x.cast("double"), 4) == 0, 0.0).otherwise(F.round(x.cast("double"), 4))).alias("v"))


def _pairs(spark, sf):
    a = _signals(spark, sf)
    b = a.select((F.col("vec_id") - 10).alias("vec_id"), F.col("v").alias("w"))
    return a.join(b, "vec_id")


def sig01_si_sdr(spark, sf):
    mixed = F.zip_with("v", "w", lambda x, y: x + 0.1 * y)
    return _pairs(spark, sf).select("vec_id", F.round(G.si_sdr(G.centred(F.col("v")), G.centred(mixed)), 4).alias("db"))


def _lengths(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("int").alias("n"))


def _listed(spark, sf, starts):
    return _lengths(spark, sf).select("doc_id", F.posexplode(starts(F.col("n")))).select("doc_id", F.col("pos").alias("k"), F.col("col").alias("start"))


def sig02_windows(spark, sf):
    w = _lengths(spark, sf).select("doc_id", F.explode(G.windows(F.col("n"), 500, 300)).alias("w"))
    return w.select("doc_id", "w.start", "w.end")


def sig03_chunks(spark, sf):
    return _listed(spark, sf, lambda n: G.chunks(n, 400))


def sig04_even_starts(spark, sf):
    return _listed(spark, sf, lambda n: G.even_starts(n, 400))


def sig05_patch_starts(spark, sf):
    return _listed(spark, sf, G.patch_starts)


def sig06_linspace_starts(spark, sf):
    return _listed(spark, sf, lambda n: G.linspace_starts(n, 300, 4))


def sig07_whole_chunks(spark, sf):
    return _listed(spark, sf, lambda n: G.whole_chunks(n, 350))


def sig08_overlap_add(spark, sf):
    """Segments of 24 at steps of 16, each with its own gain in place of a model's output."""
    starts = _signals(spark, sf).select("vec_id", "v", F.explode(F.array(*[F.lit(16 * k) for k in range(4)])).alias("start"))
    parts = starts.select("vec_id", "start", F.transform(F.slice("v", F.col("start") + 1, F.lit(24)), lambda x: x * (1 + F.col("start") / 16)).alias("v"))
    return overlap_add(parts, "vec_id", "start", "v", 24, 8).withColumn("y", F.round("y", 4))


def sig09_delay(spark, sf):
    return _pairs(spark, sf).select("vec_id", G.delay("v", "w").alias("lag"))


def sig10_onset(spark, sf):
    return _signals(spark, sf).select("vec_id", G.onset(F.transform("v", lambda x, i: F.when(i < F.col("vec_id") % 40, F.lit(0.0)).otherwise(x)), 8).alias("frame"))


def sig11_shift_and_fit(spark, sf):
    by = (F.col("vec_id") % 7 - 3).cast("int")
    moved = G.fitted(G.shifted(F.col("v"), by, dead=1), F.lit(60))
    return _signals(spark, sf).select("vec_id", F.posexplode(moved).alias("idx", "x"))


def sig12_alignment(spark, sf):
    """Each pair's later signal moved by its delay and cut to the reference's length."""
    lagged = _pairs(spark, sf).withColumn("lag", G.delay("v", "w"))
    aligned = G.fitted(G.shifted(F.col("w"), -F.col("lag")), F.size("v"))
    return lagged.select("vec_id", "lag", F.round(G.rms(aligned), 6).alias("rms"))


def sig13_gain(spark, sf):
    loud = F.transform("v", lambda x: x * 4)
    return _signals(spark, sf).select("vec_id", F.round(G.peak(G.normalised_peak(loud)), 6).alias("peak"), F.array_max(G.quantised(loud, 16)).alias("top"), F.array_min(G.quantised(loud, 16)).alias("low"))


def sig14_resample(spark, sf):
    out = _signals(spark, sf).select("vec_id", F.posexplode(G.resampled(F.col("v"), 32_000, 48_000)).alias("idx", "y"))
    return out.withColumn("y", F.round("y", 5))


def sig15_collapsed_shares(spark, sf):
    e = load(spark, sf, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 2).alias("e"))
    maps = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "e"))).alias("m"))  # an entry a source
    shares = G.collapsed_shares(F.col("m"), {"click": "vocals", "view": "bass"}, ("vocals", "bass"), "other")
    return maps.select("user_id", F.explode(shares).alias("source", "share")).withColumn("share", F.round("share", 6))


def sig16_instrumental(spark, sf):
    rest = F.zip_with("v", "w", lambda x, y: x - y)
    return _pairs(spark, sf).select("vec_id", F.posexplode(rest).alias("idx", "x")).withColumn("x", F.round("x", 4))


def sig20_peak_bins(spark, sf):
    return _signals(spark, sf).select("vec_id", F.posexplode(G.peak_bins(F.col("v"), 10)).alias("bin", "peak"))


def sig21_mixer(spark, sf):
    """Tracks of a label with mute, solo and gain: any solo silences the others."""
    t = _signals(spark, sf).withColumns({"solo": F.col("vec_id") % 11 == 0, "mute": F.col("vec_id") % 3 == 0, "gain": (F.col("vec_id") % 4 + 1) / 4.0})
    solos = t.groupBy("label").agg(F.bool_or("solo").alias("any_solo"))
    heard = t.join(solos, "label").where(F.when(F.col("any_solo"), F.col("solo")).otherwise(~F.col("mute")))
    mixed = mix_down(heard.withColumn("v", F.transform("v", lambda x: x * F.col("gain") * 0.5)), "label", "v")
    return mixed.withColumn("total", F.round("total", 7))


def flt06_silence(spark, sf):
    quiet = F.transform("v", lambda x: F.when(F.col("vec_id") % 9 == 0, x * 1e-5).otherwise(x))
    level = G.rms(quiet)
    return _signals(spark, sf).select("vec_id", F.when(level >= G.SILENCE, F.round(level, 6)).otherwise(0.0).alias("weight"))


QUERIES = {k: v for k, v in globals().items() if k.startswith(("sig", "flt0"))}

_S = "SELECT vec_id, label, list_transform(embedding, lambda x: CASE WHEN round(CAST(x AS DOUBLE), 4) = 0 THEN 0.0 ELSE round(CAST(x AS DOUBLE), 4) END) AS v FROM embeddings"
_P = f"SELECT a.vec_id, a.v, b.v AS w FROM ({_S}) a JOIN ({_S}) b ON b.vec_id = a.vec_id + 10"
_L = "SELECT doc_id, CAST(n_chars AS INT) AS n FROM documents"
SQL = {
    "sig01_si_sdr": f"""WITH x AS (SELECT vec_id, unnest(v) AS a, unnest(v) + 0.1 * unnest(w) AS b FROM ({_P})), c AS (SELECT vec_id, a - avg(a) OVER (PARTITION BY vec_id) AS r, b - avg(b) OVER (PARTITION BY vec_id) AS e FROM x),
      d AS (SELECT vec_id, sum(r * r) AS rr, sum(r * e) AS re, sum(e * e) AS ee FROM c GROUP BY 1)
      SELECT vec_id, round(10 * log10((re * re / rr + 1e-7) / (greatest(ee - re * re / rr, 0) + 1e-7)), 4) AS db FROM d""",
    "sig02_windows": f"""WITH w AS (SELECT doc_id, n, unnest(range(0, CAST(greatest(ceil((n - 500) / 300.0), 0) AS BIGINT) + 1)) * 300 AS s FROM ({_L}) WHERE n > 0)
      SELECT doc_id, CAST(s AS INT) AS start, CAST(least(s + 500, n) AS INT) AS end FROM w WHERE s = 0 OR (least(s + 500, n) - s >= 125 AND s < n)""",
    "sig03_chunks": f"""WITH k AS (SELECT doc_id, n, greatest(floor((n - 400) / 200.0) + 1, 1) AS k FROM ({_L})), c AS (SELECT doc_id, CAST(k + CASE WHEN (k - 1) * 200 + 400 < n THEN 1 ELSE 0 END AS BIGINT) AS k FROM k)
      SELECT doc_id, CAST(i AS INT) AS k, CAST(i * 200 AS INT) AS start FROM (SELECT doc_id, unnest(range(0, k)) AS i FROM c)""",
    "sig04_even_starts": f"SELECT doc_id, CAST(i AS INT) AS k, CAST(floor(i * (greatest(n - 400, 0) / 2.0)) AS INT) AS start FROM ({_L}), (SELECT unnest(range(0, 3)) AS i)",
    "sig05_patch_starts": f"SELECT doc_id, CAST(i AS INT) AS k, CAST(i * 62 AS INT) AS start FROM (SELECT doc_id, unnest(range(0, greatest(CAST(floor((n - 128) / 62.0) AS BIGINT), 1))) AS i FROM ({_L}))",
    "sig06_linspace_starts": f"SELECT doc_id, CAST(i AS INT) AS k, CAST(floor(i * greatest(n - 300, 0) / 3.0) AS INT) AS start FROM ({_L}), (SELECT unnest(range(0, 4)) AS i)",
    "sig07_whole_chunks": f"SELECT doc_id, CAST(i AS INT) AS k, CAST(i * 350 AS INT) AS start FROM (SELECT doc_id, unnest(range(0, n // 350)) AS i FROM ({_L}))",
    "sig08_overlap_add": f"""WITH p AS (SELECT vec_id, s, (1 + s / 16.0) AS g, v[s + 1:s + 24] AS v FROM ({_S}), (SELECT unnest([0, 16, 32, 48]) AS s)),
      x AS (SELECT vec_id, s, g * unnest(v) AS x, unnest(range(0, len(v))) AS i FROM p), w AS (SELECT *, CASE WHEN i >= 16 THEN (23 - i) / 7.0 WHEN i < 8 THEN i / 7.0 ELSE 1.0 END AS w FROM x)
      SELECT vec_id, CAST(s + i AS INT) AS idx, round(sum(x * w) / greatest(sum(w), 1e-8), 4) AS y FROM w GROUP BY 1, 2""",
    "sig09_delay": f"""WITH p AS (SELECT vec_id, v, w FROM ({_P})), l AS (SELECT vec_id, lag, list_sum(list_transform(range(greatest(1, 1 - lag), least(64, 64 - lag) + 1), lambda i: v[i] * w[i + lag])) AS c
      FROM p, (SELECT unnest(range(-63, 64)) AS lag)), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC) AS k FROM l) SELECT vec_id, CAST(lag AS INT) AS lag FROM r WHERE k = 1""",
    "sig10_onset": f"""WITH x AS (SELECT vec_id, i // 8 AS f, CASE WHEN i < vec_id % 40 THEN 0.0 ELSE x END AS x FROM (SELECT vec_id, unnest(v) AS x, unnest(range(0, 64)) AS i FROM ({_S}))),
      r AS (SELECT vec_id, f, sqrt(avg(x * x)) AS l FROM x GROUP BY 1, 2), b AS (SELECT vec_id, greatest(0.18 * max(l), 0.35 * quantile_cont(l, 0.85)) AS bar FROM r GROUP BY 1)
      SELECT vec_id, CAST(min(f) AS INT) AS frame FROM r JOIN b USING (vec_id) WHERE l >= bar AND bar > 0 GROUP BY 1""",
    "sig11_shift_and_fit": f"""WITH s AS (SELECT vec_id, v, CASE WHEN abs(vec_id % 7 - 3) <= 1 THEN 0 ELSE vec_id % 7 - 3 END AS d FROM ({_S}))
      SELECT vec_id, CAST(i AS INT) AS idx, CASE WHEN i - d < 0 OR i - d >= 64 THEN 0.0 ELSE v[i - d + 1] END AS x FROM s, (SELECT unnest(range(0, 60)) AS i)""",
    "sig13_gain": f"""WITH x AS (SELECT vec_id, unnest(v) * 4 AS x FROM ({_S})) SELECT vec_id, round(least(max(abs(x)), power(10, -0.05)), 6) AS peak, CAST(max(least(greatest(round_even(x * 32768, 0), -32768), 32767)) AS INT) AS top,
      CAST(min(least(greatest(round_even(x * 32768, 0), -32768), 32767)) AS INT) AS low FROM x GROUP BY 1""",
    "sig14_resample": f"""WITH m AS (SELECT unnest(range(-30, 31)) AS m), j AS (SELECT unnest(range(0, 26)) AS j),
      h AS (SELECT m, CASE WHEN m = 0 THEN 1.0 ELSE sin(pi() * m / 3) / (pi() * m / 3) END * sum(power(6.25 * (1 - m * m / 900.0), j) / power(CAST(factorial(CAST(j AS INT)) AS DOUBLE), 2)) AS h FROM m, j GROUP BY m),
      t AS (SELECT m, 2 * h / (SELECT sum(h) FROM h) AS h FROM h), x AS (SELECT vec_id, unnest(v) AS x, unnest(range(0, 64)) AS k FROM ({_S})), o AS (SELECT unnest(range(0, 43)) AS n)
      SELECT vec_id, CAST(n AS INT) AS idx, round(sum(x * h), 5) AS y FROM o JOIN t ON true JOIN x ON n * 3 - k * 2 = m GROUP BY 1, 2""",
    "sig15_collapsed_shares": """WITH e AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'vocals' WHEN 'view' THEN 'bass' ELSE 'other' END AS s, round(sum(value), 2) AS e FROM events GROUP BY user_id, event_type)
      SELECT user_id, source, round(coalesce(sum(e) FILTER (s = source), 0) / (sum(e) + 1e-12), 6) AS share FROM e, (VALUES ('vocals'), ('bass'), ('other')) t(source) GROUP BY 1, 2""",
    "sig16_instrumental": f"SELECT vec_id, CAST(i AS INT) AS idx, round(x, 4) AS x FROM (SELECT vec_id, unnest(v) - unnest(w) AS x, unnest(range(0, 64)) AS i FROM ({_P}))",
    "sig20_peak_bins": f"SELECT vec_id, CAST(i * 10 // 64 AS INT) AS bin, max(abs(x)) AS peak FROM (SELECT vec_id, unnest(v) AS x, unnest(range(0, 64)) AS i FROM ({_S})) GROUP BY 1, 2",
    "sig21_mixer": f"""WITH t AS (SELECT *, bool_or(vec_id % 11 = 0) OVER (PARTITION BY label) AS s FROM ({_S})), x AS (SELECT label, unnest(v) * ((vec_id % 4 + 1) / 4.0) * 0.5 AS x, unnest(range(0, 64)) AS i
      FROM t WHERE CASE WHEN s THEN vec_id % 11 = 0 ELSE vec_id % 3 <> 0 END) SELECT label, CAST(i AS INT) AS idx, round(sum(x), 7) AS total FROM x GROUP BY 1, 2""",
    "flt06_silence": f"""WITH x AS (SELECT vec_id, unnest(v) * CASE WHEN vec_id % 9 = 0 THEN 1e-5 ELSE 1 END AS x FROM ({_S})), r AS (SELECT vec_id, sqrt(avg(x * x)) AS r FROM x GROUP BY 1)
      SELECT vec_id, CASE WHEN r >= 1e-4 THEN round(r, 6) ELSE 0 END AS weight FROM r""",
}
