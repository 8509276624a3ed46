"""Approximate nearest neighbours by inner product over robust-pruned graphs.

Distinct vectors are dealt to shards of bounded size by a hash. A shard's vectors form a directed graph: a greedy search from a fixed
entry proposes neighbours for each, and relaxed distance pruning keeps those that no kept one stands for. Every query walks
every shard's graph with a beam, and the results of the shards are merged. One more coordinate makes all vectors
equally long, so that the largest inner product is the smallest distance.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapline.session import settle

SHARD = 8_192  # expected vectors of a shard
QUERY_BLOCK = 4_096  # expected queries that search a copy of a shard together
DEGREE, SLACK = 32, 16  # neighbours after pruning; further ones a node takes before it is pruned again
BUILD_BEAM, SEARCH_BEAM, RELAXATION = 64, 160, 1.2
_BATCH, _EXPAND, _FIRST = 256, 4, 512


class Graph:
    """Vectors of one shard and their neighbours; the last row of each array stands for "none"."""

    def __init__(self, vectors: np.ndarray, neighbours: np.ndarray | None = None) -> None:
        count = len(vectors)
        lengths = np.einsum("ij,ij->i", vectors, vectors)
        reach = float(lengths.max(initial=0.0))
        extra = np.sqrt(np.maximum(reach - lengths, 0))
        self.points = np.zeros((count + 1, vectors.shape[1] + 1), np.float32)
        self.points[:-1, :-1], self.points[:-1, -1] = vectors, extra
        self.squares = np.full(count + 1, np.inf, np.float32)
        self.squares[:-1] = np.einsum("ij,ij->i", self.points[:-1], self.points[:-1])
        centre = self.points[:-1].mean(axis=0) if count else self.points[0]
        self.entry = int(np.argmin(self.squares[:-1] - 2 * self.points[:-1] @ centre)) if count else 0
        self.edges = np.full((count + 1, DEGREE + SLACK), count, np.int32)
        if neighbours is not None:
            self.edges[:-1] = neighbours

    def _distances(self, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Squared distances without the queries' own squares, which do not change the order."""
        return self.squares[ids] - 2 * np.matmul(self.points[ids], queries[:, :, None])[:, :, 0]

    def search(self, queries: np.ndarray, beam: int, entries: Sequence[int]) -> np.ndarray:
        """The ``beam`` nearest nodes found for each query, nearest first; walks all queries in step."""
        none, rows = len(self.points) - 1, np.arange(len(queries))
        ids = np.full((len(queries), beam), none, np.int32)
        far = np.full(ids.shape, np.inf, np.float32)
        done = np.ones(ids.shape, bool)
        seen = np.zeros((len(queries), none + 1), bool)
        seen[:, none] = True
        start = np.unique(np.array(entries, np.int32))[:beam]
        ids[:, : len(start)], done[:, : len(start)], seen[:, start] = start, False, True
        far[:, : len(start)] = self._distances(ids[:, : len(start)], queries)
        while True:
            waiting = np.where(done, np.inf, far)
            active = rows[np.isfinite(waiting.min(axis=1))]
            if not len(active):
                break
            waiting = waiting[active]
            picked = np.argpartition(waiting, _EXPAND - 1, axis=1)[:, :_EXPAND] if beam > _EXPAND else np.argsort(waiting, axis=1)
            usable = np.isfinite(np.take_along_axis(waiting, picked, axis=1))
            nodes = np.where(usable, np.take_along_axis(ids[active], picked, axis=1), none)
            done[active[:, None], picked] = True
            new = np.sort(self.edges[nodes].reshape(len(active), -1), axis=1)
            again = seen[active[:, None], new]
            again[:, 1:] |= new[:, 1:] == new[:, :-1]
            new[again] = none
            seen[active[:, None], new] = True
            width = int((new != none).sum(axis=1).max(initial=0))
            if not width:
                continue
            new = np.sort(new, axis=1)[:, :width]
            all_ids = np.concatenate([ids[active], new], axis=1)
            all_far = np.concatenate([far[active], self._distances(new, queries[active])], axis=1)
            all_done = np.concatenate([done[active], new == none], axis=1)
            best = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
            ids[active], far[active], done[active] = (np.take_along_axis(a, best, axis=1) for a in (all_ids, all_far, all_done))
        return np.take_along_axis(ids, np.argsort(far, axis=1, kind="stable"), axis=1)

    def _prune(self, nodes: np.ndarray, candidates: np.ndarray) -> None:
        """Give each node the nearest candidates that are not much nearer to one it already has."""
        none = len(self.points) - 1
        candidates = np.sort(np.where(candidates == nodes[:, None], none, candidates), axis=1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = none
        points = self.points[candidates]
        own = self._distances(candidates, self.points[nodes]) + self.squares[nodes][:, None]
        squares = np.where(candidates == none, 0, self.squares[candidates])
        between = squares[:, :, None] + squares[:, None, :] - 2 * np.matmul(points, points.transpose(0, 2, 1))
        alive, rows = candidates != none, np.arange(len(nodes))
        kept = np.full((len(nodes), DEGREE + SLACK), none, np.int32)
        for place in range(DEGREE):
            if not alive.any():
                break
            pick = np.argmin(np.where(alive, own, np.inf), axis=1)
            some = alive[rows, pick]
            kept[some, place] = candidates[rows, pick][some]
            alive &= (RELAXATION**2 * between[rows, pick] > own) & some[:, None]
            alive[rows, pick] = False
        self.edges[nodes] = kept

    def _link_back(self, nodes: np.ndarray) -> None:
        """Make every neighbour of ``nodes`` a neighbour the other way too; nodes with too many are pruned."""
        none = len(self.points) - 1
        ends = self.edges[nodes]
        source, target = np.repeat(nodes, ends.shape[1])[ends.ravel() != none], ends.ravel()[ends.ravel() != none]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        firsts = np.searchsorted(target, target)
        slot = (self.edges[target] != none).sum(axis=1) + np.arange(len(target)) - firsts
        fits = slot < DEGREE + SLACK
        # Edges of a node lie in its first slots, so the next free one is their number.
        self.edges[target[fits], slot[fits]] = source[fits]
        for node in np.unique(target[~fits]):
            more = source[(lo := np.searchsorted(target, node)) : np.searchsorted(target, node, "right")]
            self._prune(np.array([node]), np.concatenate([self.edges[node], more])[None, :])

    def build(self, seed: int = 11) -> Graph:
        """Insert the vectors in random order: the first against each other, the rest by searching what is there."""
        count = len(self.points) - 1
        order = np.random.default_rng(seed).permutation(count).astype(np.int32)
        order = np.concatenate([[self.entry], order[order != self.entry]]).astype(np.int32) if count else order
        first = order[:_FIRST]
        for at in range(0, len(first), _BATCH // 4):
            part = first[at : at + _BATCH // 4]
            self._prune(part, np.tile(first, (len(part), 1)))
        for at in range(len(first), count, _BATCH):
            part = order[at : at + _BATCH]
            found = self.search(self.points[part], BUILD_BEAM, [self.entry])
            near = np.tile(part, (len(part), 1))  # vectors that come in together see each other
            mutual = np.argpartition(self._distances(near, self.points[part]), min(DEGREE, len(part) - 1), axis=1)[:, :DEGREE]
            self._prune(part, np.concatenate([found, np.take_along_axis(near, mutual, axis=1)], axis=1))
            self._link_back(part)
        return self


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


_INDEX = "dim int, shard int, class_id bigint, ids array<bigint>, vector array<double>, neighbours array<int>"
_FOUND = "query bigint, vec_id bigint, score double"


def _build(table: pa.Table) -> pa.Table:
    graph = Graph(_matrix(table["vector"])).build()
    lists = pa.ListArray.from_arrays(
        np.arange(0, graph.edges[:-1].size + 1, graph.edges.shape[1], dtype=np.int32), graph.edges[:-1].ravel()
    )
    return table.append_column("neighbours", lists)


def _searcher(k: int, beam: int):
    def search(index: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        if len(index) and len(queries):
            vectors, asked = _matrix(index["vector"]), _matrix(queries["vector"])
            graph = Graph(vectors, _matrix(index["neighbours"]))
            wanted = max(beam, k + 1)
            ids = index["ids"].to_pylist()
            names = queries["query"].to_pylist()
            for at in range(0, len(asked), _BATCH):
                part = asked[at : at + _BATCH]
                padded = np.concatenate([part, np.zeros((len(part), 1))], axis=1).astype(np.float32)
                near = graph.search(padded, wanted, [graph.entry])
                for row, nodes in enumerate(near):
                    nodes = nodes[nodes < len(vectors)]
                    scores = vectors[nodes] @ part[row]
                    best = sorted((-s, i) for s, n in zip(scores.tolist(), nodes.tolist()) for i in ids[n])[: k + 1]
                    found[0] += [names[at + row]] * len(best)
                    found[1] += [i for _, i in best]
                    found[2] += [-s for s, _ in best]
        return pa.table({
            "query": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64()),
        })

    return search


def usable(vector: str) -> Column:
    """Vectors that take part: not null, not zero, all components finite."""
    infinite = F.lit(float("inf"))
    broken = F.exists(vector, lambda x: F.isnull(x) | F.isnan(x) | (F.abs(x) == infinite))
    return F.coalesce(F.col(vector).isNotNull() & ~broken & F.exists(vector, lambda x: x != 0), F.lit(False))


def build_index(vectors: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding", shard: int = SHARD) -> DataFrame:
    """Stored graphs of all usable vectors; equal vectors are one node that names its ``k + 1`` smallest ids."""
    rows = vectors.filter(usable(vector) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")
    ).distinct()
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).filter(F.col("place") <= k + 1)
    classes = settle(
        ranked.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(
            F.size("vector").alias("dim"), F.col("ids")[0].alias("class_id"), "ids", "vector"
        )
    )
    shards = max(1, math.ceil(classes.count() / shard))
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("class_id"), F.lit(shards)).cast("int"))
    ordered = dealt.select("dim", "shard", "class_id", "ids", "vector").repartition(shards, "dim", "shard")
    return settle(ordered.groupBy("dim", "shard").applyInArrow(_build, _INDEX))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
    shard: int = SHARD, beam: int = SEARCH_BEAM,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``k`` nearest rows found for every row where ``is_query`` holds.

    Nearness is the largest inner product in double precision, ties go to the smaller id, and a row is no neighbour of
    its own. Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without id. Vectors are compared
    with those of equal length. Rows that repeat id and vector are one row. Fewer than ``k`` candidates: all of them.
    """
    index = build_index(vectors, k, vec_id, vector, shard)
    asked = vectors.filter(is_query & usable(vector) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("bigint").alias("query_id"), F.col(vector).cast("array<double>").alias("vector")
    ).distinct()
    links = settle(asked.join(index.select("class_id", "vector"), "vector").select("query_id", "class_id"))
    distinct = links.select(F.col("class_id").alias("query")).distinct()
    queries = settle(index.join(distinct, F.col("class_id") == F.col("query")).select("query", "dim", "vector"))
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    spread = queries.select(
        "query", "dim", "vector", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
    )
    copies = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dim", "shard", "block"]
    found = copies.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(_searcher(k, beam), _FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    lists = best.groupBy("query").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))), lambda s: F.struct(s["vec_id"], s["score"])).alias("best")
    )
    own = F.filter("best", lambda s: s["vec_id"] != F.col("query_id"))
    final = links.join(lists, F.col("class_id") == F.col("query")).select("query_id", F.posexplode(F.slice(own, 1, k)).alias("place", "hit"))
    return final.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
