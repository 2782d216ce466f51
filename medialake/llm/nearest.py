"""Approximate nearest neighbours by largest inner product: a hierarchical navigable small-world graph per shard, shards merged.

Vectors are dealt to shards by a hash of their components, so equal vectors meet in one shard and are one node of its graph with a
list of ids. Largest inner product becomes nearest on a sphere by one more component, sqrt(longest^2 - |x|^2), which is 0 for a
query. Nodes are inserted in blocks, those of high layers first; a block is searched in the graph so far and within itself, and each
node keeps the links that no nearer link already covers, then the nearest others while it has room. A node's links are a row of a
flat array, 2 * LINKS wide in the lowest layer and LINKS above. The arrays are the index: a table of one row per shard and
dimension in the shared folder. Every usable row is indexed; nothing is sampled.

Each distinct query vector is sent to every shard, where a beam of BEAM nodes looks for it; what it finds is scored in double
precision on the original vectors (components added up from the first to the last), and a window merges the shards. Rows a shard:
SHARD_ROWS or 8 * sqrt(rows) if that is more, at most MOST_ROWS, so shards grow in number and in size alike and one fits a task.

Only the TOP + 1 smallest ids of equal vectors can be among anyone's TOP nearest, as ties go to smaller ids. So of vectors that more
rows share the other rows are left out as candidates (they still ask), which loses no answer; slices of the ids are ranked first, so
a vector of a third of all rows is never gathered.

Recall is measured against brute force by `recall`; tests ask for 0.95.

Defined cases: null, empty and zero vectors, and such as hold null or components that are not finite, take no part, nor do rows
without vec_id; a vec_id that repeats stands for the smallest of its vectors; vectors of different dimension never meet; other columns
are not read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkernel as K
from .common import discard, staged, streamed, table

TOP = 20
LINKS = 16
BUILD_BEAM = 64
BEAM = 192
SHARD_ROWS = 4096
MOST_ROWS = 1 << 20
QUERY_ROWS = 1 << 15
QUERY_BLOCK = 512
SALTS = 64

_INDEX = "shard long, width int, ids array<long>, owners array<int>, vectors array<double>, layers array<int>, links array<int>"


class Graph:
    """Layers of links over the nodes 0 .. n-1; layer l holds the first layers[l] of them."""

    def __init__(self, points: np.ndarray, layers: list[int], links: list[np.ndarray] | None = None) -> None:
        longest = np.sqrt((points**2).sum(1).max())
        rest = np.sqrt(np.maximum(0, longest**2 - (points**2).sum(1)))
        self.points = (np.column_stack([points, rest]) / longest).astype(np.float32)
        self.layers = layers
        self.links = links or [np.full((n, 2 * LINKS if l == 0 else LINKS), -1, np.int32) for l, n in enumerate(layers)]
        if not links:
            self._insert_all()

    def _insert_all(self) -> None:
        start, n = 0, len(self.points)
        while start < n:
            stop = min(n, start + max(64, min(start, QUERY_BLOCK)))
            self._insert(start, stop)
            start = stop

    def _insert(self, start: int, stop: int) -> None:
        block = self.points[start:stop]
        entry = np.zeros(stop - start, np.int64)
        mates = block @ block.T
        np.fill_diagonal(mates, -np.inf)
        for layer in range(len(self.layers) - 1, -1, -1):
            inside = min(stop, self.layers[layer]) - start  # of this block, its first nodes are in the layer
            if start:
                rest = slice(max(0, inside), None)
                if inside < len(block):
                    entry[rest] = self.beam(layer, block[rest], entry[rest], 1, 1)[0][:, 0]
            if inside <= 0:
                continue
            found, near = np.zeros((inside, 0), np.int64), np.zeros((inside, 0), np.float32)
            if start:
                found, near = self.beam(layer, block[:inside], entry[:inside], BUILD_BEAM, 4)
                entry[:inside] = found[:, 0]
            if inside > 1:
                own = mates[:inside, :inside]
                width = min(inside - 1, BUILD_BEAM)
                best = np.argpartition(-own, width - 1, axis=1)[:, :width]
                found = np.concatenate([found, best + start], axis=1)
                near = np.concatenate([near, np.take_along_axis(own, best, 1)], axis=1)
            if not found.shape[1]:
                continue
            by = np.argsort(-near, axis=1, kind="stable")[:, :BUILD_BEAM]
            chosen = self._chosen(np.take_along_axis(found, by, 1), np.take_along_axis(near, by, 1), LINKS)
            self.links[layer][start : start + inside, : chosen.shape[1]] = chosen
            self._link_back(layer, start, chosen)

    def _chosen(self, found: np.ndarray, near: np.ndarray, room: int) -> np.ndarray:
        """Of candidates in descending nearness (-1: none) those that no nearer chosen one covers, then the nearest others."""
        valid = found >= 0
        vectors = self.points[np.maximum(found, 0)]
        between = vectors @ vectors.transpose(0, 2, 1)
        alive, taken = valid.copy(), np.zeros_like(valid)
        for c in range(found.shape[1]):
            take = alive[:, c] & (taken.sum(1) < room) if c >= room else alive[:, c].copy()
            taken[:, c] = take
            alive &= ~(take[:, None] & (between[:, c, :] >= near))
        by = np.argsort(np.where(taken, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :room]
        return np.take_along_axis(np.where(valid, found, -1), by, 1)

    def _link_back(self, layer: int, start: int, chosen: np.ndarray) -> None:
        """Each chosen node links back to the new one; where its row is full, the row is chosen anew."""
        links = self.links[layer]
        room = links.shape[1]
        new, at = np.nonzero(chosen >= 0)
        target = chosen[new, at].astype(np.int64)
        new = new + start
        present = (links[target] == new[:, None]).any(1)
        target, new = target[~present], new[~present]
        near = np.einsum("ij,ij->i", self.points[target], self.points[new])
        by = np.lexsort((-near, target))
        target, new, near = target[by], new[by], near[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        degree = (links[nodes] >= 0).sum(1)
        nth = np.arange(len(target)) - np.repeat(first, count)
        which = np.repeat(np.arange(len(nodes)), count)
        fits = (degree + count <= room)[which]
        links[target[fits], degree[which[fits]] + nth[fits]] = new[fits]
        full = np.flatnonzero(degree + count > room)
        for lo in range(0, len(full), 1024):
            some = full[lo : lo + 1024]
            place = np.full(len(nodes), -1)
            place[some] = np.arange(len(some))
            mine = (place[which] >= 0) & (nth < room)
            found = np.full((len(some), 2 * room), -1, np.int64)
            found[:, :room] = links[nodes[some]]
            found[place[which[mine]], room + nth[mine]] = new[mine]
            score = np.einsum("ij,ikj->ik", self.points[nodes[some]], self.points[np.maximum(found, 0)])
            score[found < 0] = -np.inf
            order = np.argsort(-score, axis=1, kind="stable")
            links[nodes[some]] = self._chosen(np.take_along_axis(found, order, 1), np.take_along_axis(score, order, 1), room)

    def beam(self, layer: int, asked: np.ndarray, entry: np.ndarray, width: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, nearness) of each asked point, nearest first (-1: none): the best width seen, step of them expanded at a time."""
        links, points = self.links[layer], self.points
        m = len(asked)
        nodes, near = np.full((m, width), -1, np.int64), np.full((m, width), -np.inf, np.float32)
        nodes[:, 0] = entry
        near[:, 0] = np.einsum("ij,ij->i", points[entry], asked)
        spent = nodes < 0
        seen = np.full(m * len(points), -1, np.int32)  # and by which of a round's steps
        seen[np.arange(m) * len(points) + entry] = 0
        going = np.arange(m)
        while len(going):
            waiting = ~spent[going]
            going = going[waiting.any(1)]
            if not len(going):
                break
            waiting = ~spent[going]
            pick = np.argsort(~waiting, axis=1, kind="stable")[:, :step]
            real = np.take_along_axis(waiting, pick, 1)
            rows = np.repeat(going, real.sum(1))
            expand = nodes[going][:, :][np.arange(len(going))[:, None], pick][real]
            spent[rows, pick[real]] = True
            fresh = links[expand]
            ok = fresh >= 0
            owner = np.repeat(rows, ok.sum(1))
            fresh = fresh[ok].astype(np.int64)
            key = owner * len(points) + fresh
            unseen = seen[key] < 0
            key, owner, fresh = key[unseen], owner[unseen], fresh[unseen]
            turn = np.arange(len(key), dtype=np.int32)
            seen[key] = turn
            once = seen[key] == turn
            owner, fresh = owner[once], fresh[once]
            score = np.einsum("ij,ij->i", points[fresh], asked[owner])
            better = score > near[owner, -1]
            owner, fresh, score = owner[better], fresh[better], score[better]
            if not len(owner):
                continue
            by = np.argsort(owner, kind="stable")
            owner, fresh, score = owner[by], fresh[by], score[by]
            some, first, count = np.unique(owner, return_index=True, return_counts=True)
            place = np.repeat(np.arange(len(some)), count)
            nth = np.arange(len(owner)) - np.repeat(first, count)
            wide = int(count.max())
            all_nodes, all_near, all_spent = (np.concatenate([old[some], np.full((len(some), wide), none, old.dtype)], axis=1) for old, none in ((nodes, -1), (near, -np.inf), (spent, True)))
            all_nodes[place, width + nth], all_near[place, width + nth], all_spent[place, width + nth] = fresh, score, False
            by = np.argsort(-all_near, axis=1, kind="stable")[:, :width]
            nodes[some], near[some], spent[some] = (np.take_along_axis(x, by, 1) for x in (all_nodes, all_near, all_spent))
        return nodes, near

    def search(self, asked: np.ndarray, width: int) -> np.ndarray:
        """The nodes that a beam of that width finds for each asked vector (-1: none)."""
        asked = np.column_stack([asked, np.zeros(len(asked))])
        asked = (asked / np.sqrt((asked**2).sum(1, keepdims=True))).astype(np.float32)
        entry = np.zeros(len(asked), np.int64)
        for layer in range(len(self.layers) - 1, 0, -1):
            entry = self.beam(layer, asked, entry, 1, 1)[0][:, 0]
        return self.beam(0, asked, entry, width, 4)[0]


def layer_sizes(keys: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(order of the nodes, nodes of each layer): each layer holds a LINKS-th of the one below, by a hash of the key."""
    draw = (K.mix(keys.view(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2**53
    level = np.floor(-np.log(np.maximum(draw, 1e-15)) / math.log(LINKS)).astype(np.int64)
    order = np.argsort(-level, kind="stable")
    return order, [int((level >= l).sum()) for l in range(int(level.max(initial=0)) + 1)]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, added up from the first component to the last."""
    return reduce(lambda total, c: total + a[:, c] * b[:, c], range(a.shape[1]), np.zeros(len(a)))


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v, h1, h2): one row for each vec_id that has a usable vector, with two hashes of its components."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.where(F.col(vec_id).isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    again = staged(rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id"), "nearest-again")
    rows = rows.join(again, "vec_id", "left_anti").unionByName(rows.join(again, "vec_id").groupBy("vec_id").agg(F.min("v").alias("v")))
    return rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), F.reverse("v"))})


def candidates(rows: DataFrame, top: int = TOP) -> DataFrame:
    """rows without those that share their vector with more than top rows of smaller id."""
    hot = staged(rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > top + 1).select("h1", "h2"), "nearest-hot")
    first = lambda df, *by: df.withColumn("nth", F.row_number().over(W.partitionBy(*by).orderBy("vec_id"))).where(F.col("nth") <= top + 1).drop("nth")
    salted = rows.join(hot, ["h1", "h2"]).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    few = first(first(salted, "h1", "h2", "salt"), "h1", "h2").drop("salt")
    return rows.join(hot, ["h1", "h2"], "left_anti").unionByName(few.select(*rows.columns))


def build_index(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The graphs of rows (vec_id, v, h1, h2), one row per shard and dimension, written to the shared folder."""
    n = rows.count()
    shards = max(1, math.ceil(n / min(MOST_ROWS, max(shard_rows, 8 * math.isqrt(n)))))

    def build(rows: pa.Table) -> pa.Table:
        shard, ids, h1, h2 = (rows.column(c).to_numpy() for c in ("shard", "vec_id", "h1", "h2"))
        lists = rows.column("v").combine_chunks()
        sizes = np.diff(np.asarray(lists.offsets))
        begin, flat = np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py(), np.asarray(lists.flatten()).astype(np.float64)
        out = []
        for width in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == width)
            mine = mine[np.lexsort((ids[mine], h2[mine], h1[mine]))]
            new = np.concatenate([[True], (np.diff(h1[mine]) != 0) | (np.diff(h2[mine]) != 0)])
            order, layers = layer_sizes(h1[mine[new]])
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            points = flat[begin[mine[new]][order][:, None] + np.arange(width)]
            graph = Graph(points, layers)
            out.append({"shard": int(shard[0]), "width": width, "ids": ids[mine], "owners": rank[np.cumsum(new) - 1], "vectors": points.ravel(), "layers": layers, "links": np.concatenate([x.ravel() for x in graph.links])})
        kinds = [("shard", pa.int64()), ("width", pa.int32()), ("ids", pa.list_(pa.int64())), ("owners", pa.list_(pa.int32())), ("vectors", pa.list_(pa.float64())), ("layers", pa.list_(pa.int32())), ("links", pa.list_(pa.int32()))]
        return pa.table({c: pa.array([r[c] for r in out], kind) for c, kind in kinds})

    dealt = rows.withColumn("shard", F.pmod("h1", F.lit(shards)))
    return staged(dealt.groupBy("shard").applyInArrow(build, _INDEX), "nearest-index")


class Shard:
    """A shard's graph with the ids of its nodes."""

    def __init__(self, row: dict) -> None:
        self.width, layers = row["width"].as_py(), row["layers"].as_py()
        self.ids, owners, vectors, flat = (np.asarray(row[c].values) for c in ("ids", "owners", "vectors", "links"))
        self.vectors = vectors.reshape(-1, self.width)
        links, at = [], 0
        for l, n in enumerate(layers):
            wide = 2 * LINKS if l == 0 else LINKS
            links.append(flat[at : at + n * wide].reshape(n, wide))
            at += n * wide
        self.graph = Graph(self.vectors, layers, links)
        by = np.lexsort((self.ids, owners))  # each node's ids together, smallest first
        self.ids = self.ids[by]
        self.at = np.searchsorted(owners[by], np.arange(len(self.vectors) + 1))

    def nearest(self, asked: np.ndarray, top: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(asked row, id, score) of the top nearest that the graph has for each asked vector."""
        found = self.graph.search(asked, max(beam, top))
        row, at = np.nonzero(found >= 0)
        node = found[row, at]
        score = products(self.vectors[node], asked[row])
        count = self.at[node + 1] - self.at[node]
        row, score = np.repeat(row, count), np.repeat(score, count)
        ids = self.ids[np.repeat(self.at[node] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
        by = np.lexsort((ids, -score, row))
        row, ids, score = row[by], ids[by], score[by]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < top
        return row[keep], ids[keep], score[keep]


def search(index: DataFrame, asking: DataFrame, top: int = TOP, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the top nearest candidates of every row of asking (vec_id, v, h1, h2) but itself."""
    vectors = staged(asking.groupBy("h1", "h2").agg(F.first("v").alias("v")), "nearest-asked")
    parts = max(1, math.ceil(vectors.count() / QUERY_ROWS))
    schema = "h1 long, h2 long, vec_id long, score double"
    place = (F.col("shard") * parts + F.col("part")).alias("place")
    shards = index.select("shard").distinct().agg(F.collect_set("shard").alias("shards"))  # as many as there are tasks
    held = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(place, "width", "ids", "owners", "vectors", "layers", "links")
    listed = sorted(shards.first()[0])
    asked = vectors.select("h1", "h2", "v", F.pmod("h2", F.lit(parts)).alias("part"), F.explode(F.array(*map(F.lit, listed)) if listed else F.array().cast("array<long>")).alias("shard")).select(place, "h1", "h2", "v")

    def run(pieces):
        at, graphs = None, {}
        for key, side, batch in pieces:
            if key != at:
                at, graphs = key, {}
            if side == 0:
                for i in range(len(batch)):
                    shard = Shard({c: batch.column(c)[i] for c in batch.schema.names})
                    graphs[shard.width] = shard
                continue
            lists = batch.column(batch.schema.get_field_index("v"))
            sizes = np.diff(np.asarray(lists.offsets))
            begin, flat = np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py(), np.asarray(lists.flatten()).astype(np.float64)
            for width in np.unique(sizes).tolist():
                if width not in graphs:
                    continue
                mine = np.flatnonzero(sizes == width)
                step = max(1, min(QUERY_BLOCK, (64 << 20) // len(graphs[width].vectors)))  # the marks of what a block has seen
                for lo in range(0, len(mine), step):
                    some = mine[lo : lo + step]
                    row, ids, score = graphs[width].nearest(flat[begin[some][:, None] + np.arange(width)], top + 1, beam)
                    h1, h2 = (batch.column(c).take(pa.array(some[row])) for c in ("h1", "h2"))
                    yield pa.RecordBatch.from_arrays([h1, h2, pa.array(ids), pa.array(score)], ["h1", "h2", "vec_id", "score"])

    order = W.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id")
    best = streamed(held, asked, "place", run, schema).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= top + 1)
    best = staged(best.groupBy("h1", "h2").agg(F.collect_list(F.struct((-F.col("score")).alias("low"), "vec_id")).alias("best")), "nearest-best")
    mine = asking.select(F.col("vec_id").alias("query_id"), "h1", "h2").join(best, ["h1", "h2"])
    others = F.slice(F.array_sort(F.filter("best", lambda b: b["vec_id"] != F.col("query_id"))), 1, top)
    listed = mine.select("query_id", F.posexplode(others).alias("at", "b"))
    return listed.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.low")).alias("score"))


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of truth's (query_id, vec_id) pairs that are found."""
    return found.join(truth, ["query_id", "vec_id"], "left_semi").count() / max(1, truth.count())


def nearest(vectors: DataFrame, queries_by: int = 20, top: int = TOP, beam: int = BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Searches for every row whose vec_id is divisible by queries_by among all rows; the index is written, searched and deleted."""
    rows = usable(vectors)
    index = build_index(candidates(rows, top), shard_rows)
    out = staged(search(index, rows.where(F.col("vec_id") % queries_by == 0), top, beam), "nearest-found")
    discard(index)
    return out


def op12_nearest(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"))
