"""Record linkage between two collections of tracks, and the joins of a stem library.

Tracks have id, artist and title in normal form. Candidates are a union of equi-joins on blocking keys, made as one join on
exploded (kind, key) entries; scores are computed once for every distinct pair of names; the one-to-one assignment takes, in
rounds, every pair that is the best of both its ends, and whole blocks of equal scores by rank, which equals taking pairs one by
one from the best down.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.near_keys import keys_column
from ..tables import staged

NEAR_EXACT = 0.995


def stored(df: DataFrame) -> DataFrame:
    return staged(df, "linkage")


def block_keys(fuzzy: bool) -> Column:
    """Array of kind:key entries of a track."""
    keys = [F.concat(F.lit("x:"), "artist", F.lit("\t"), "title"), F.concat(F.lit("t:"), "title"), F.when(F.col("artist") != "", F.concat(F.lit("a:"), "artist"))]
    if fuzzy:
        keys += [F.when(F.col("title") != "", F.concat(F.lit("h:"), F.substring("title", 1, 3))), F.concat(F.lit("p:"), F.substring("title", 1, 6))]
    return F.filter(F.array(*keys), lambda k: k.isNotNull())


#: Rows of a key on either side of one block of pairs, and pairs that a task is meant to make.
BLOCK_ROWS = 1_000
TASK_PAIRS = 4_000_000
MOST_TASKS = 20_000


def candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(ref, partner) pairs that share a blocking key. Near-exact thresholds need only the exact key.

    The pairs of a key are as many as the product of its rows on both sides. They are made in blocks of BLOCK_ROWS a side, which go to
    as many tasks as the pairs need, so a hot key is no task's alone. A pair is made at the least key that both have: pairs are shuffled
    nowhere.
    """
    keys = F.array(F.concat("artist", F.lit("\t"), "title")) if threshold >= NEAR_EXACT else block_keys(True)

    def keyed(df: DataFrame, end: str) -> DataFrame:
        sets = df.select(F.col("id").alias(end), F.explode(keys).alias("key")).groupBy(end).agg(F.collect_set("key").alias(f"keys_{end}"))
        return stored(sets.withColumn("key", F.explode(f"keys_{end}")))

    a, b = keyed(left, "ref"), keyed(right, "partner")
    sizes = a.groupBy("key").agg(F.count(F.lit(1)).alias("na")).join(b.groupBy("key").agg(F.count(F.lit(1)).alias("nb")), "key")
    pairs = sizes.agg(F.sum(F.col("na").cast("double") * F.col("nb"))).first()[0] or 0.0
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, int(pairs / TASK_PAIRS) + 1))
    over = lambda n: F.ceil(F.col(n) / BLOCK_ROWS)
    hot = F.broadcast(sizes.where(F.greatest("na", "nb") > BLOCK_ROWS).select("key", over("na").alias("ca"), over("nb").alias("cb")))  # no more than one for each BLOCK_ROWS rows

    def blocks(df: DataFrame, end: str, own: str, others: str) -> DataFrame:
        mine, theirs = ("i", "j") if own == "ca" else ("j", "i")
        placed = df.join(hot, "key", "left").withColumn(mine, F.pmod(F.xxhash64(end), F.coalesce(own, F.lit(1).cast("long"))))
        placed = placed.withColumn(theirs, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(others, F.lit(1).cast("long")) - 1)))
        return placed.drop("ca", "cb").repartition(tasks, "key", "i", "j")

    met = blocks(a, "ref", "ca", "cb").join(blocks(b, "partner", "cb", "ca"), ["key", "i", "j"])
    first = (F.size("keys_ref") == 1) | (F.size("keys_partner") == 1) | (F.col("key") == F.array_min(F.array_intersect("keys_ref", "keys_partner")))
    return met.where(first).select("ref", "partner")


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def with_similarity(pairs: DataFrame, a: str, b: str, out: str, empty: float = 1.0) -> DataFrame:
    """pairs with the similarity of two text columns: `empty` if both are empty, 0 if one is, 1 if equal; only the other
    distinct value pairs reach the Python matcher."""
    settled = F.when((F.col(a) == "") & (F.col(b) == ""), empty).when((F.col(a) == "") | (F.col(b) == ""), 0.0).when(F.col(a) == F.col(b), 1.0)
    open_ = pairs.where(settled.isNull()).select(a, b).distinct()
    scored = open_.withColumn("_s", _ratio(a, b))
    return pairs.join(scored, [a, b], "left").withColumn(out, F.coalesce(settled, F.col("_s"))).drop("_s")


def score_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(ref, partner, score): the smaller of the artists' and the titles' similarity. Pairs that the lengths rule out at the
    threshold go before the matcher: twice the shorter text is the most that two texts have in common."""
    near = lambda a, b: 2 * F.least(F.length(a), F.length(b)) >= threshold * (F.length(a) + F.length(b)) - 1e-9
    named = pairs.join(left.select(F.col("id").alias("ref"), F.col("artist").alias("aa"), F.col("title").alias("ta")), "ref")
    named = named.join(right.select(F.col("id").alias("partner"), F.col("artist").alias("ab"), F.col("title").alias("tb")), "partner")
    named = named.where(near("aa", "ab") & near("ta", "tb"))
    both = with_similarity(with_similarity(named, "aa", "ab", "sa"), "ta", "tb", "st")
    return both.select("ref", "partner", F.least("sa", "st").alias("score"))


def _tied_blocks(left: DataFrame) -> DataFrame:
    """(ref, partner, score) that greedy assignment takes in blocks of equal best scores: where every reference of a block has
    the same best partners and each of these the same best references, the n-th reference takes the n-th partner."""
    alike = lambda end: F.sum(F.xxhash64(end).cast("decimal(38,0)"))  # noqa: E731  of a set of ids, in any order
    tops = left.join(left.groupBy("ref").agg(F.max("score").alias("sr")), "ref").join(left.groupBy("partner").agg(F.max("score").alias("sp")), "partner")
    tops = stored(tops.where("score = sr or score = sp"))
    refs = tops.where("score = sr").groupBy("ref").agg(alike("partner").alias("hr"), F.count(F.lit(1)).alias("nr"), F.min(F.col("sr") == F.col("sp")).alias("okr"))
    partners = tops.where("score = sp").groupBy("partner").agg(alike("ref").alias("hp"), F.count(F.lit(1)).alias("np"), F.min(F.col("sr") == F.col("sp")).alias("okp"))
    both = stored(tops.where("sr = sp").join(refs.where("okr"), "ref").join(partners.where("okp"), "partner"))
    same = lambda end, *other: both.groupBy(end).agg(*[F.min(c).alias(c) for c in other], F.count(F.lit(1)).alias("n"), F.max("score").alias("score"), (F.min(other[0]) == F.max(other[0])).alias("same"))
    # A block is named by the two sets; all edges of its nodes must be whole, so the counts are held against the sets' sizes.
    r = same("ref", "hp", "np", "hr", "nr").where("same and n = nr")
    p = same("partner", "hr", "nr", "hp", "np").where("same and n = np")
    nth = lambda df, end: df.select(end, "score", "hr", "hp", F.row_number().over(W.partitionBy("score", "hr", "hp").orderBy(end)).alias("nth"), F.count(F.lit(1)).over(W.partitionBy("score", "hr", "hp")).alias("k"), "nr", "np")
    # Whole blocks only: as many references as a partner of it has, and as many partners as a reference has.
    a, b = nth(r, "ref").where("k = np"), nth(p, "partner").where("k = nr").drop("k", "nr", "np")
    return stored(a.join(b, ["score", "hr", "hp", "nth"]).select("ref", "partner", "score"))


def assign_greedily(scored: DataFrame) -> DataFrame:
    """The one-to-one pairs that greedy assignment by (score desc, ref, partner) takes; rounds go on until no edge is left."""
    order = F.struct((-F.col("score")).alias("worse"), "ref", "partner")
    left, taken = stored(scored.select("ref", "partner", "score").dropna().distinct()), []
    while left.limit(1).count():
        # Aggregations, not windows: the best edge of a node is combined on the map side.
        best_ref = left.groupBy("ref").agg(F.min(order).alias("r"))
        best_partner = left.groupBy("partner").agg(F.min(order).alias("p"))
        won = best_ref.join(best_partner, F.col("r") == F.col("p")).select("ref", "partner", (-F.col("r.worse")).alias("score"))
        won = stored(won.unionByName(_tied_blocks(left)).distinct())
        taken.append(won)
        left = stored(left.join(won.select("ref"), "ref", "left_anti").join(won.select("partner"), "partner", "left_anti"))
    return reduce(DataFrame.unionByName, taken) if taken else left


def assign_exact(left: DataFrame, right: DataFrame) -> DataFrame:
    """At strictness 100 greedy assignment pairs the n-th reference of a name with its n-th partner."""
    name = F.concat("artist", F.lit("\t"), "title")
    nth = lambda df, out: df.select(F.col("id").alias(out), name.alias("name"), F.row_number().over(W.partitionBy(name).orderBy("id")).alias("n"))
    return nth(left, "ref").join(nth(right, "partner"), ["name", "n"]).select("ref", "partner", F.lit(1.0).alias("score"))


def find_pairs(left: DataFrame, right: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matched, left alone, right alone)."""
    if threshold >= NEAR_EXACT:
        matched = assign_exact(left, right)
    else:
        matched = assign_greedily(score_pairs(candidates(left, right, threshold), left, right, threshold).where(F.col("score") >= threshold))
    return matched, left.join(matched.select(F.col("ref").alias("id")), "id", "left_anti"), right.join(matched.select(F.col("partner").alias("id")), "id", "left_anti")


def folder_similarity(pairs: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """As with_similarity with empty names at 0, and a containment boost: a name of 8 characters or more that makes up at least 0.55
    of the longer one counts 0.92 at least."""
    small, large = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    inside = F.when(F.length(a) <= F.length(b), F.col(b).contains(F.col(a))).otherwise(F.col(a).contains(F.col(b)))
    boosted = F.when((small >= 8) & inside & (small >= 0.55 * large), F.greatest(F.col(out), F.lit(0.92))).otherwise(F.col(out))
    return with_similarity(pairs, a, b, out, empty=0.0).withColumn(out, boosted)


def best_match(files: DataFrame, folders: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(name, folder, score): the most similar folder of each distinct file name, the first by order among equals.

    Names meet the folders with which they share a key that the threshold implies. At low thresholds that is the length alone, so
    the folders are meant to be a stated list; a boosted pair has 0.709 of both lengths in common, so no lower key is needed.
    Null and empty names match nothing.
    """
    implied = min(threshold, 2 * 0.55 / 1.55 - 1e-6)
    names = files.select("name").where("name <> ''").distinct().withColumn("key", F.explode(keys_column("name", implied, True)))
    listed = folders.select("folder", "ord").where("folder <> ''").withColumn("key", F.explode(keys_column("folder", implied, False)))
    scored = folder_similarity(names.join(listed, "key").drop("key").distinct(), "name", "folder", "score")
    best = scored.where(F.col("score") >= threshold).groupBy("name").agg(F.min_by(F.struct("folder", "score"), F.struct((-F.col("score")).alias("s"), "ord")).alias("b"))
    return best.select("name", "b.folder", "b.score")


def winners(df: DataFrame, group: str, score: str, key: str) -> DataFrame:
    """df with outcome: the best score of a group wins, by the smallest key among equals; the others are rejected."""
    best = df.groupBy(group).agg(F.min_by(key, F.struct((-F.col(score)).alias("s"), key)).alias("_best"))
    return df.join(best, group).withColumn("outcome", F.when(F.col(key) == F.col("_best"), "winner").otherwise("rejected")).drop("_best")


def complete_sets(df: DataFrame, song: str, category: str, categories: tuple[str, ...]) -> DataFrame:
    """Songs present in every category."""
    n = df.where(F.col(category).isin(*categories)).groupBy(song).agg(F.countDistinct(category).alias("k"))
    return n.where(F.col("k") == len(categories)).select(song)


def category_files(files: DataFrame, folder: str, stem: str, categories: tuple[str, ...]) -> DataFrame:
    """(folder, category, stem): the best file of each category: named so, ending so, with (category), or holding the word; then
    the shortest, then the first by name."""
    low = F.lower(stem)
    rank = lambda c: F.when(low == c, 0).when(low.endswith(c), 1).when(low.contains(f"({c})"), 2).when(low.contains(c), 3)
    ranks = F.array(*[F.when(low.contains(c), F.struct(F.lit(c).alias("category"), rank(c).alias("rank"))) for c in categories])
    hits = files.select(F.col(folder).alias("folder"), F.col(stem).alias("stem"), F.explode(F.filter(ranks, lambda r: r.isNotNull())).alias("r"))
    return hits.groupBy("folder", F.col("r.category").alias("category")).agg(F.min(F.struct("r.rank", F.length("stem").alias("n"), "stem")).alias("m")).select("folder", "category", "m.stem")


def two_file_roles(files: DataFrame, folder: str, keyword: Column) -> DataFrame:
    """Of folders with exactly two files (id, bytes): the one with the keyword is vocal and the other instrumental; with none or
    both, the larger is instrumental, by the smaller id among equals."""
    f = files.select(F.col(folder).alias("folder"), "id", "bytes", keyword.cast("int").alias("kw"))
    two = f.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.sum("kw").alias("kws"), F.max_by("id", F.struct("bytes", (-F.col("id")).alias("i"))).alias("large"), F.min("id").alias("one"), F.max("id").alias("two"), F.max_by("id", "kw").alias("named"))
    two = two.where("n = 2").withColumn("instrumental", F.when(F.col("kws") == 1, F.col("one") + F.col("two") - F.col("named")).otherwise(F.col("large")))
    return two.select("folder", "instrumental", (F.col("one") + F.col("two") - F.col("instrumental")).alias("vocal"))
