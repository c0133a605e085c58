"""Exact top-k inner products by dual-tree search over cover trees.

Vectors become integers floor(SCALE * x). Data and queries are dealt to blocks
by a hash; every query block meets every data block (a stated query set against
all rows, in blocks). Where two blocks meet, both get a cover tree: a node
covers its points within its radius, its children are points more than half the
radius apart that cover the rest within half the radius, and single points that
have no company gather in leaves. Pairs of nodes are visited best bound first.
With centres a and b and radii r and s no inner product across them exceeds
a.b + r|b| + s|a| + rs, so a pair whose bound is below the worst kth score of its
query group is dropped with all beneath it. Once queries are at a leaf, each is
bounded by itself (r = 0): a child of a data node stays only if some query's own
kth score is within its reach. Ties at the kth score are never dropped.

Every query block meets its first data block before the others; the kth scores
found there go with the queries to the other blocks, so that these start with a
bound. The k best of all blocks are merged. `pruned` counts the products that
bounds made needless: most of them where vectors have near ones, none where they
point in all directions of many dimensions.

A query has a row with rank 1..k (fewer if there are fewer candidates); ties go
to the smaller id. Candidates with the query's own id don't count. Vectors that
are null, empty or hold null or non-finite components take no part; null ids
neither. Shorter vectors count as if padded with zeros. Repeated rows are
candidates each. Components must keep inner products within 64 bits. An empty
table gives an empty result; columns other than key and vector are not read. Ids
must be integers.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import cut

SCALE, K, EVERY = 256, 5, 50
DATA_BLOCK, QUERY_BLOCK, LEAF = 8192, 8192, 64


class CoverTree:
    """Nodes as arrays: centre (a row), radius, children (none in a leaf), rows below."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.points = points
        self.squares = np.einsum("ij,ij->i", points, points)
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray] = []
        self.leaf = leaf
        if len(points):
            self._grow(0, np.arange(len(points)))

    def distances(self, centre: int, rows: np.ndarray) -> np.ndarray:
        d = self.squares[rows] + self.squares[centre] - 2.0 * (self.points[rows] @ self.points[centre])
        return np.sqrt(np.maximum(d, 0.0))

    def _grow(self, centre: int, rows: np.ndarray) -> int:
        far = self.distances(centre, rows)
        node, radius = len(self.centre), float(far.max())
        self.centre.append(centre)
        self.radius.append(radius * (1 + 1e-9) + 1e-6)
        self.children.append([])
        self.rows.append(rows)
        if len(rows) > self.leaf // 8 and radius > 0:
            head, open_, parts = centre, rows, []
            while len(open_):
                near = self.distances(head, open_) <= radius / 2
                near |= open_ == head
                parts.append((head, open_[near]))
                open_ = open_[~near]
                if len(open_):
                    head = int(open_[0])
            # single points gather in leaves of their own, else there would be a node for each
            self.children[node] += [self._grow(head, own) for head, own in parts if len(own) > 1]
            lone = [own for _, own in parts if len(own) == 1]
            loose = np.concatenate(lone) if lone else np.empty(0, np.int64)
            for i in range(0, len(loose), self.leaf):
                self.children[node].append(self._grow_leaf(loose[i : i + self.leaf]))
        return node

    def _grow_leaf(self, rows: np.ndarray) -> int:
        centre = int(rows[0])
        self.centre.append(centre)
        self.radius.append(float(self.distances(centre, rows).max()) * (1 + 1e-9) + 1e-6)
        self.children.append([])
        self.rows.append(rows)
        return len(self.centre) - 1


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int = K, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query row, id, score) of each query's k best, ties to smaller ids, and the number of products that were not needed.

    floors: a kth score that each query has elsewhere; what is below it is left out.
    """
    left, right = CoverTree(queries), CoverTree(data)
    none = np.iinfo(np.int64).min
    best_score = np.full((len(queries), k), none)
    best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
    floor = np.full(len(queries), none) if floors is None else floors
    norm_q, norm_d = np.sqrt(left.squares), np.sqrt(right.squares)
    centre, radius = np.array(right.centre, np.int64), np.array(right.radius)
    pruned, slack = 0, 1e-3  # bounds are doubles

    def kth(rows: np.ndarray) -> np.ndarray:
        return np.maximum(best_score[rows, k - 1], floor[rows])

    def bounds(q: int, kids: np.ndarray) -> np.ndarray:
        """Of a query node against data nodes."""
        a, r = left.centre[q], left.radius[q]
        return data[centre[kids]] @ queries[a] + r * norm_d[centre[kids]] + radius[kids] * (norm_q[a] + r)

    heap = [(-float(bounds(0, np.array([0]))[0]), 0, 0)] if len(queries) and len(data) else []
    while heap:
        top, q, d = heapq.heappop(heap)
        rows = left.rows[q]
        if -top * (1 + 1e-9) + slack < kth(rows).min():
            pruned += len(rows) * len(right.rows[d])
            continue
        below_q, below_d = left.children[q], right.children[d]
        if below_q and (not below_d or left.radius[q] > right.radius[d]):
            for x in below_q:
                heapq.heappush(heap, (-float(bounds(x, np.array([d]))[0]), x, d))
            continue
        if below_d:
            kids = np.array(below_d)
            if below_q:
                tops, alive = bounds(q, kids), np.ones(len(kids), bool)
            else:  # a bound for each query of the leaf
                each = queries[rows] @ data[centre[kids]].T + radius[kids] * norm_q[rows][:, None]
                alive, tops = (each * (1 + 1e-9) + slack >= kth(rows)[:, None]).any(axis=0), each.max(axis=0)
            pruned += len(rows) * sum(len(right.rows[c]) for c in kids[~alive])
            for c, t in zip(kids[alive].tolist(), tops[alive].tolist(), strict=True):
                heapq.heappush(heap, (-t, q, c))
            continue
        own = right.rows[d]
        score = exact_products(queries[rows], data[own])
        score[query_ids[rows][:, None] == ids[own][None, :]] = none
        every = np.concatenate([best_score[rows], score], axis=1)
        named = np.concatenate([best_id[rows], np.broadcast_to(ids[own], score.shape)], axis=1)
        named = np.where(every == none, np.iinfo(np.int64).max, named)
        order = np.lexsort((named, -np.maximum(every, none + 1)), axis=1)[:, :k]
        best_score[rows], best_id[rows] = np.take_along_axis(every, order, 1), np.take_along_axis(named, order, 1)
    at, rank = np.nonzero((best_score > none) & (best_score >= floor[:, None]))
    return at, best_id[at, rank], best_score[at, rank], pruned


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows, padded with zeros."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def candidates(df: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, vec_id, score: k per query and block at most, among them the k best of all; group, block and pruned tell where."""
    kind = df.schema[key].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{key} must be an integer, not {kind}")
    x = F.col("v").cast("array<double>")
    sound = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")).where("id is not null and size(v) > 0").where(sound)
    rows = rows.select("id", F.transform(x, lambda y: F.floor(y * scale)).alias("v"), is_query.alias("q"))
    n = rows.agg(F.count("*").alias("n"), F.count_if("q").alias("q")).first()
    blocks, groups = max(1, -(-n["n"] // DATA_BLOCK)), max(1, -(-n["q"] // QUERY_BLOCK))
    deal = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    data = rows.select("id", "v", deal(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")).toDF("id", "v", "block", "group")
    asked = rows.where("q").select("id", "v", deal(groups).alias("group"))

    def meet(key_: tuple[pa.Scalar, ...], a: pa.Table, b: pa.Table) -> pa.Table:
        queries, points = matrix(a.column("v")), matrix(b.column("v"))
        width = max(queries.shape[1], points.shape[1])
        queries, points = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (queries, points))
        own, floors = a.column("id").to_numpy(), a.column("floor").to_numpy(zero_copy_only=False)
        at, ids, score, pruned = search(queries, own, points, b.column("id").to_numpy(), k, floors)
        same = [np.full(len(at), v) for v in (key_[0].as_py(), key_[1].as_py(), pruned)]
        return pa.table({"query_id": own[at], "vec_id": ids, "score": score, "group": pa.array(same[0], pa.int32()), "block": pa.array(same[1], pa.int32()), "pruned": pa.array(same[2], pa.int64())})

    out = "query_id bigint, vec_id bigint, score bigint, group int, block int, pruned bigint"
    met = lambda queries, points: queries.groupBy("group", "block").cogroup(points.groupBy("group", "block")).applyInArrow(meet, out)
    low = F.lit(np.iinfo(np.int64).min).cast("bigint")
    first = met(asked.select("*", F.lit(0).alias("block"), low.alias("floor")), data.where("block = 0"))
    if blocks == 1:
        return first
    first = cut(first, "top_k")  # read twice: for its rows, and for the bounds they give
    known = first.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).select("id", "least")
    bounded = asked.toDF("id", "v", "group").join(known, "id", "left").select("id", "v", "group", F.coalesce("least", low).alias("floor"), F.explode(F.sequence(F.lit(1), F.lit(blocks - 1))).alias("block"))
    return first.unionByName(met(bounded, data.where("block > 0")))


def top_k(df: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a boolean column over the ids, named id."""
    met = candidates(df, is_query, key, vector, k, scale)
    # a query named by several rows is one query: its answers are told apart by candidate
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
