"""Near-duplicate groups and leader clustering."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..components import connected_components
from ..functions.near_keys import keys_column
from ..functions.signal import peak
from ..tables import spread, staged
from .linkage import with_similarity


#: Rows of a group in one block, about; a task compares two blocks at a time.
BLOCK = 1_024


def _alike(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of a and of b (as many columns) whose residual is below the threshold, as `residual` computes it: by a matrix
    product first, and sum by sum where that is too near the threshold to tell."""
    width = a.shape[1]
    with np.errstate(all="ignore"):
        na, nb = (a * a).sum(axis=1)[:, None], (b * b).sum(axis=1)[None, :]
        limit = np.maximum(np.maximum(na, nb), width * 1e-24) * threshold**2
        over = na + nb - 2 * (a @ b.T) - limit
        slack = 1e-9 * (na + nb + limit)
        open_a, open_b = np.nonzero(~(np.abs(over) > slack) | ~np.isfinite(slack))
        found = over < 0
        step = max(1, 4_000_000 // width)
        for k in range(0, len(open_a), step):
            x, y = a[open_a[k : k + step]], b[open_b[k : k + step]]
            rms = lambda v: np.sqrt(np.cumsum(v * v, axis=1)[:, -1] / width)  # noqa: E731  one after the other, as a fold adds them
            found[open_a[k : k + step], open_b[k : k + step]] = rms(x - y) / np.maximum(np.maximum(rms(x), rms(y)), 1e-12) < threshold
    return np.nonzero(found)


def _by_length(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length: the places of the vectors that have it, and these as rows; null elements are NaN."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == n)
        out[int(n)] = at, vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), int(n))
    return out


def _stars(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the first place of each component of the graph of the pairs of n places to its others."""
    first = np.arange(n)
    while True:
        least = np.minimum(first[a], first[b])
        after = first.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if (after == first).all():
            others = np.flatnonzero(first != np.arange(n))
            return first[others], others
        first = after


def _linked(df: DataFrame, group: str, key: str, vector: str, threshold: float, stars: bool) -> DataFrame:
    """(a, b), a < b: pairs of a group below the threshold; or, per two blocks, stars that join the same rows."""
    rows = df.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).where("g is not null and k is not null and v is not null")
    blocks = rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n"))
    placed = rows.join(blocks, "g").withColumn("own", F.pmod(F.xxhash64("k"), "n")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    placed = placed.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "k", "v")
    kind = rows.schema["k"].dataType.simpleString()

    def compare(where, table):
        i, j = where[1].as_py(), where[2].as_py()
        table = table.sort_by("k").combine_chunks()
        keys, own = table["k"].to_numpy(), table["own"].to_numpy()
        vectors = table["v"].combine_chunks()
        sides = [np.flatnonzero(own == x) for x in (i, j)]
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        parts = [_by_length(vectors.take(pa.array(side))) for side in sides]
        for m, (at_a, a) in parts[0].items():
            for n, (at_b, b) in parts[1].items():
                width = min(m, n)
                fit_a, fit_b = (np.isfinite(x[:, :width]).all(axis=1) for x in (a, b))  # nothing is near what is not a number
                x, y = _alike(np.ascontiguousarray(a[fit_a, :width]), np.ascontiguousarray(b[fit_b, :width]), threshold)
                x, y = sides[0][at_a[fit_a]][x], sides[1][at_b[fit_b]][y]
                # Within one block both orders of a pair come up; rows are sorted by key.
                kept = (x < y) & (keys[x] != keys[y]) if i == j else np.ones(len(x), bool)
                ends.append((np.minimum(x, y)[kept], np.maximum(x, y)[kept]))
        a, b = (np.concatenate([e[side] for e in ends]) if ends else np.zeros(0, int) for side in (0, 1))
        if stars:
            a, b = _stars(a, b, len(keys))
        k = table["k"]
        return pa.table({"a": k.take(pa.array(a)), "b": k.take(pa.array(b))})

    return spread(placed, "g", "i", "j").groupBy("g", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}")


def residual_edges(df: DataFrame, group: str, key: str, vector: str, threshold: float = 0.05) -> DataFrame:
    """(a, b) of the pairs of a group whose residual is below the threshold. The residual says which pairs are alike only when both
    are at hand, so a group's pairs are compared, block by block; groups are the stems of one song."""
    return _linked(df, group, key, vector, threshold, False)


def residual_links(df: DataFrame, group: str, key: str, vector: str, threshold: float = 0.05) -> DataFrame:
    """(a, b) with the components that all pairs below the threshold have: each two blocks give no more links than they have rows."""
    return _linked(df, group, key, vector, threshold, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): connected components, named by their smallest node, by contraction; a node linked only to itself is its own."""
    parts = connected_components(edges)
    alone = edges.where("a = b").select(F.col("a").alias("node")).distinct().join(parts, "node", "left_anti")
    return parts.unionByName(alone.select("node", F.col("node").alias("component")))


def keep_one(df: DataFrame, edges: DataFrame, key: str, vector: str) -> DataFrame:
    """df with component and kept: of a component the member with the lowest peak stays, the smallest key among equals; members
    without values are kept, since nothing is known of them."""
    parts = components(edges).withColumnRenamed("node", key)
    placed = df.join(parts, key, "left").withColumn("component", F.coalesce("component", key))
    usable = F.size(vector) > 0
    best = placed.where(usable).groupBy("component").agg(F.min_by(key, F.struct(peak(F.col(vector)), key)).alias("best"))
    return placed.join(best, "component", "left").withColumn("kept", ~usable | (F.col("best") == F.col(key))).drop("best")


def _near_names(names: DataFrame, threshold: float) -> DataFrame:
    """(late, early, other): distinct names of a title head where the earlier one, if it leads, may take the later one; other says
    that their titles differ. Both fields share a key that their similarity implies, so a common artist or title alone joins nothing."""
    named = names.withColumn("head", F.substring("title", 1, 3))

    def side(later: bool) -> DataFrame:
        keyed = named.withColumns({"ka": keys_column("artist", threshold, later), "kt": keys_column("title", threshold, later)})
        return keyed.withColumn("ka", F.explode("ka")).withColumn("kt", F.explode("kt"))

    early = side(False).select(F.col("id").alias("early"), F.col("artist").alias("ab"), F.col("title").alias("tb"), "head", "ka", "kt")
    late = side(True).select(F.col("id").alias("late"), F.col("artist").alias("aa"), F.col("title").alias("ta"), "head", "ka", "kt")
    same_title = F.col("ta") == F.col("tb")
    pairs = late.join(early, ["head", "ka", "kt"]).where((F.col("early") < F.col("late")) & (same_title | ((F.col("aa") != "") & (F.col("ta") != ""))))
    pairs = pairs.select("late", "early", "aa", "ab", "ta", "tb").distinct()
    scored = with_similarity(with_similarity(pairs, "aa", "ab", "sa"), "ta", "tb", "st").where(F.least("sa", "st") >= threshold)
    return scored.select("late", "early", (~same_title).alias("other"))


def leader_groups(tracks: DataFrame, threshold: float) -> DataFrame:
    """(id, leader): in order, a track joins the first leader whose artist and title are similar enough, else it leads itself.

    A track with a leader of its own title prefers those; one without artist or title has only those. Leaders have the same first
    three letters of the title. A name leads when no earlier leader is near it: in rounds, names with no undecided earlier name
    near them lead, and names near a leader follow. Each round decides the first undecided name at least; a chain of names that
    are each near the next alone takes rounds in proportion to its length. Nulls count as empty, repeated rows come out repeated.
    """
    tracks = tracks.select("id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("artist", "title")])
    # Equal names need one comparison: the first track of each name stands for it.
    firsts = staged(tracks.groupBy("artist", "title").agg(F.min("id").alias("id")), "leaders-names")
    near = staged(_near_names(firsts, threshold), "leaders-near")
    open_, followers = near.select("late", "early"), []
    leaders = firsts.select("id").join(near.select(F.col("late").alias("id")), "id", "left_anti")
    while open_.limit(1).count():
        follow = staged(open_.join(leaders.select(F.col("id").alias("early")), "early", "left_semi").select("late").distinct(), "leaders-follow")
        followers.append(follow)
        rest = open_.join(follow, "late", "left_anti")
        left = staged(rest.join(follow.select(F.col("late").alias("early")), "early", "left_anti"), "leaders-open")
        leaders = staged(rest.select("late").distinct().join(left.select("late"), "late", "left_anti").select(F.col("late").alias("id")), "leaders-new")
        open_ = left
    following = reduce(DataFrame.unionByName, followers) if followers else near.select("late").limit(0)
    ruled = near.join(following.select(F.col("late").alias("early")), "early", "left_anti")  # earlier names that lead
    best = ruled.groupBy(F.col("late").alias("id")).agg(F.min(F.struct("other", "early"))["early"].alias("leader"))
    named = firsts.join(best, "id", "left").select("artist", "title", F.coalesce("leader", "id").alias("leader"))
    return tracks.join(named, ["artist", "title"]).select("id", "leader")


def group_names(groups: DataFrame, tracks: DataFrame, name: Column) -> DataFrame:
    """(leader, name, size): the leader's display name, with [n] for groups of more than two."""
    sizes = groups.groupBy("leader").agg(F.count(F.lit(1)).alias("size"))
    named = sizes.join(tracks.select(F.col("id").alias("leader"), name.alias("name")), "leader")
    return named.withColumn("name", F.when(F.col("size") > 2, F.concat("name", F.lit(" ["), F.col("size").cast("string"), F.lit("]"))).otherwise(F.col("name")))
