"""WAVE files written and read back (SRC-15, SNK-13): the vectors of a label are one song, each vector a stretch of it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.wave import read_wave, write_wave
from ..tables import shared_folder
from .fixtures import load


def _songs(spark, sf) -> DataFrame:
    """Two channels a song, the second in reverse within each stretch; a vec_id that is missing leaves silence."""
    e = load(spark, sf, "embeddings").select("vec_id", F.expr("transform(embedding, x -> CAST(x AS DOUBLE))").alias("v"))
    return e.select(F.expr("concat('song_', vec_id % 10, '/stem.wav')").alias("path"), F.floor(F.col("vec_id") / 10).alias("nth"), "v").select("path", (F.col("nth") * 64).alias("start"), F.array("v", F.reverse("v")).alias("samples"))


def _written(spark, sf, **how) -> DataFrame:
    folder = f"{shared_folder(spark)}/waves-{uuid.uuid4().hex[:12]}"
    write_wave(_songs(spark, sf), folder, **how)
    return read_wave(spark, folder).withColumn("song", F.regexp_extract("path", r"(song_\d+)/stem\.wav$", 1))


def snk13_wave_files(spark, sf):
    """The files of two kinds of sample: what their headers say, and the frames that are there."""
    kinds = [_written(spark, sf, rate=rate, subtype=kind) for rate, kind in ((44_100, "PCM_16"), (96_000, "PCM_24"))]
    every = kinds[0].unionByName(kinds[1])
    return every.groupBy("song", "rate", "channels", "subtype", "frames").agg(F.sum(F.size(F.col("samples")[0])).alias("n_samples"))


def src15_wave_samples(spark, sf):
    """Sums of the whole values of each channel, plain and by place, read from the files in blocks."""
    whole = F.expr("transform(samples, (c, k) -> struct(k AS channel, transform(c, (x, i) -> struct(CAST(x * 32768 AS BIGINT) AS value, (start + i) % 97 AS place)) AS values))")
    each = _written(spark, sf).select("song", F.explode(whole).alias("c")).select("song", "c.channel", F.explode("c.values").alias("s"))
    return each.groupBy("song", "channel").agg(F.count(F.lit(1)).alias("frames"), F.sum("s.value").alias("total"), F.sum(F.col("s.value") * F.col("s.place")).alias("weighted"), F.max("s.value").alias("top"), F.min("s.value").alias("low"))


QUERIES = {k: v for k, v in globals().items() if k.startswith(("src", "snk"))}

_FRAMES = "SELECT concat('song_', vec_id % 10) AS song, (max(vec_id // 10) + 1) * 64 AS frames FROM embeddings GROUP BY 1"
SQL = {
    "snk13_wave_files": f"""SELECT song, rate, 2 AS channels, subtype, frames, frames AS n_samples
      FROM ({_FRAMES}) CROSS JOIN (VALUES (44100, 'PCM_16'), (96000, 'PCM_24')) k(rate, subtype)""",
    "src15_wave_samples": f"""WITH v AS (SELECT concat('song_', vec_id % 10) AS song, vec_id // 10 * 64 AS start, unnest(range(64)) AS i, embedding FROM embeddings), w AS (
        SELECT song, k AS channel, start + i AS pos, CAST(greatest(-32768, least(32767, round_even(CAST(embedding[CASE k WHEN 0 THEN i + 1 ELSE 64 - i END] AS DOUBLE) * 32768, 0))) AS BIGINT) AS value
        FROM v CROSS JOIN (VALUES (0), (1)) c(k))
      SELECT w.song, channel, any_value(f.frames) AS frames, CAST(sum(value) AS BIGINT) AS total, CAST(sum(value * (pos % 97)) AS BIGINT) AS weighted,
        greatest(max(value), CASE WHEN any_value(f.frames) > count(*) THEN 0 ELSE -32768 END) AS top, least(min(value), CASE WHEN any_value(f.frames) > count(*) THEN 0 ELSE 32767 END) AS low
      FROM w JOIN ({_FRAMES}) f ON f.song = w.song GROUP BY w.song, channel""",
}
