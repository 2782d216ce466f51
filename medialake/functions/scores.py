"""Score vectors after a model: softmax, top-k, thresholds, margins; all on arrays, inside one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(v: Column) -> Column:
    """Stable softmax of an array of doubles."""
    top = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def ranked(v: Column, labels: Column) -> Column:
    """array<struct<score, idx, label>> from the best down; among equals the smaller index first."""
    rows = F.transform(v, lambda x, i: F.struct((-x).alias("neg"), i.alias("idx"), F.element_at(labels, i + 1).alias("label")))
    return F.transform(F.array_sort(rows), lambda r: F.struct((-r["neg"]).alias("score"), r["idx"].alias("idx"), r["label"].alias("label")))


def top_k(v: Column, labels: Column, k: int, threshold: float) -> Column:
    """struct<label, score, second, top, above, silent>: the k best of at least threshold (the first in any case), the labels at or
    above it, the runner-up's score; an all-zero vector is silent and has no label."""
    r = ranked(v, labels)
    silent = (F.size(v) == 0) | (F.array_max(v) <= 0)
    best = F.slice(r, 1, max(1, k))
    cut = F.filter(best, lambda x, i: (i == 0) | (x["score"] >= threshold))
    text = F.array().cast("array<string>")
    return F.struct(
        F.when(silent, "").otherwise(r[0]["label"]).alias("label"), F.when(silent, 0.0).otherwise(r[0]["score"]).alias("score"),
        F.when(silent, 0.0).otherwise(F.coalesce(F.try_element_at(r, F.lit(2))["score"], F.lit(0.0))).alias("second"),
        F.when(silent, text).otherwise(F.transform(cut, lambda x: x["label"])).alias("top"),
        F.when(silent, text).otherwise(F.transform(F.filter(r, lambda x: x["score"] >= threshold), lambda x: x["label"])).alias("above"), silent.alias("silent"),
    )


def pair_confidence(v: Column, places: int | None = None) -> Column:
    """p1 / (p1 + p2) of the two best, of values rounded to `places` first if given."""
    s = F.reverse(F.array_sort(v))
    p1, p2 = s[0], F.coalesce(F.try_element_at(s, F.lit(2)), F.lit(0.0))
    if places is not None:
        p1, p2 = F.bround(p1, places), F.bround(p2, places)
    return F.when(p1 + p2 > 0, p1 / (p1 + p2)).otherwise(0.0)


def renormalised(v: Column) -> Column:
    """Clipped at 1e-12 and scaled to sum to 1."""
    c = F.transform(v, lambda x: F.greatest(x, F.lit(1e-12)))
    return F.transform(c, lambda x: x / F.aggregate(c, F.lit(0.0), lambda a, b: a + b))


def demoted(r: Column, label: str = "Speech", gap: float = 0.2) -> Column:
    """The best entry of a ranking, or the runner-up when the best is `label` by no more than gap."""
    close = (r[0]["label"] == label) & (F.size(r) > 1) & (r[0]["score"] - F.try_element_at(r, F.lit(2))["score"] <= gap)
    return F.when(close, F.try_element_at(r, F.lit(2))).otherwise(r[0])


def category_decision(energies: Column, categories: tuple[str, ...], mapping: dict[str, str], fallback: str, threshold: float, margin: float) -> Column:
    """struct<action, category, share, margin, reason> from a map of source energies: shares are summed by category; too low a share
    or too small a lead is skipped, with its reason. Among equals the earlier category leads."""
    entries = F.map_entries(energies)
    total = F.aggregate(entries, F.lit(0.0), lambda a, e: a + e["value"]) + 1e-12
    of = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]) if mapping else F.create_map().cast("map<string,string>")
    share = lambda c: F.aggregate(F.filter(entries, lambda e: F.coalesce(F.try_element_at(of, e["key"]), F.lit(fallback)) == c), F.lit(0.0), lambda a, e: a + e["value"]) / total
    r = ranked(F.array(*[share(c) for c in categories]), F.array(*map(F.lit, categories)))
    lead = r[0]["score"] - F.coalesce(F.try_element_at(r, F.lit(2))["score"], F.lit(0.0))
    low, close = r[0]["score"] < threshold, lead < margin
    reason = F.when(low & close, "both").when(low, "confidence").when(close, "margin")
    return F.struct(F.when(reason.isNotNull(), "skip").otherwise(r[0]["label"]).alias("action"), r[0]["label"].alias("category"), r[0]["score"].alias("share"), lead.alias("margin"), reason.alias("reason"))


def decision(label: Column, category: Column, score: Column, second: Column, threshold: float = 0.4, margin: float = 0.2) -> Column:
    low, close = score < threshold, score - second < margin
    return (
        F.when(F.coalesce(F.trim(label), F.lit("")) == "", "skip_silence").when(F.coalesce(category, F.lit("")) == "", "skip_unmap")
        .when(low & close, "skip_both").when(low, "skip_confidence").when(close, "skip_margin").otherwise("apply")
    )


# Keys in the order of the key model's classes, by the wheel of fifths, minor before major.
WHEEL = ("Abm", "B", "Ebm", "Gb", "Bbm", "Db", "Fm", "Ab", "Cm", "Eb", "Gm", "Bb", "Dm", "F", "Am", "C", "Em", "G", "Bm", "D", "Gbm", "A", "Dbm", "E")


def key_of_logits(v: Column) -> Column:
    """struct<key, probability>."""
    p = softmax(v)
    at = F.array_position(p, F.array_max(p))
    return F.struct(F.element_at(F.array(*map(F.lit, WHEEL)), at.cast("int")).alias("key"), F.array_max(p).alias("probability"))
