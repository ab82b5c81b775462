"""Exact top-k by inner product with KD-trees, one for each shard of the vectors.

Vectors are dealt into shards of bounded size by a hash of their ids. In each shard a KD-tree halves the vectors at
the median of the widest component; every node has a tight bounding box. For a query, the box gives an upper bound of
the inner product (per component the better of the two faces); nodes are visited best bound first, and the search of a
shard ends when the best bound is below the k-th score known so far. That k-th score is carried on: first each block
of queries searches one shard, then its k-th scores go along to all other shards, where most boxes fall below them.

Queries come in blocks of bounded size, so a task holds one shard and one block. Scores are exact: components are
whole numbers, summed in float64 while every sum stays below 2^53 and as Python integers beyond.

Cases: null vectors and vectors with a null, NaN or infinite component take no part, nor do null ids; ties go to the
smaller id; vectors are compared with vectors of their own length only; fewer than k candidates are all returned;
equal vectors count each; repeated rows with one id count once; empty tables give empty results.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearcharge.llm.common import materialise

SHARD_ROWS, BLOCK_ROWS, LEAF = 16_384, 2_048, 128


def whole_components(table: DataFrame, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, v: floor(scale * component) as doubles, for vectors that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = table.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad))
    # floor of a double is a bigint in SQL; beyond its range the double is whole already
    floored = F.transform("v", lambda x: F.when(F.abs(x * scale) < 2.0**52, F.floor(x * scale).cast("double")).otherwise(x * scale))
    return rows.select("id", floored.alias("v"), F.size("v").alias("dims")).dropDuplicates(["id"])


class Tree:
    """KD-tree of the rows of one shard: nodes as (first row, last row), boxes, children."""

    def __init__(self, vectors: np.ndarray):
        self.order = np.arange(len(vectors))
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        low, high = [], []
        todo = [(0, len(vectors), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            here = len(self.spans)
            if parent >= 0:
                kids = self.children[parent] or (0, 0)
                self.children[parent] = (here, kids[1]) if side == 0 else (kids[0], here)
            rows = vectors[self.order[a:b]]
            lo, hi = rows.min(axis=0), rows.max(axis=0)
            self.spans.append((a, b))
            self.children.append(None)
            low.append(lo)
            high.append(hi)
            if b - a > LEAF and (hi > lo).any():
                widest, middle = int((hi - lo).argmax()), (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(rows[:, widest], middle, kind="introselect")]
                todo += [(a + middle, b, here, 1), (a, a + middle, here, 0)]
        self.low, self.high = np.array(low), np.array(high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of the inner product of each query with the vectors of each node."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def search(tree: Tree, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> tuple[list, list, list]:
    """Up to k hits of each query that may still be among its best: query ids, ids, scores."""
    own = tree.order
    ids, vectors = ids[own], vectors[own]
    exact = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, vectors.shape[1]) < 2.0**52
    bounds = tree.bounds(queries)
    out: tuple[list, list, list] = ([], [], [])
    for q in range(len(queries)):
        best: list[tuple[int, int]] = []  # (score, -id), worst first
        least, bound = kth[q], bounds[q]
        heap = [(-bound[0], 0)]
        while heap:
            top, node = heapq.heappop(heap)
            if exact and -top < least:
                break
            kids = tree.children[node]
            if kids:
                for child in kids:
                    if not exact or bound[child] >= least:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            a, b = tree.spans[node]
            scores = vectors[a:b] @ queries[q] if exact else np.array([sum(int(x) * int(y) for x, y in zip(v, queries[q], strict=True)) for v in vectors[a:b]], object)
            hits = np.flatnonzero((scores >= least) & (ids[a:b] != query_ids[q]))
            for h in hits:
                entry = (int(scores[h]), -int(ids[a + h]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == k and best[0][0] > least:
                least = best[0][0]
        for score, minus in best:
            out[0].append(int(query_ids[q]))
            out[1].append(-minus)
            out[2].append(score)
    return out


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if rows else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1) if rows else np.empty((0, 0))


def _search_groups(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Both sides have dims, shard, block; each group is one shard with one block of queries."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            v = _matrix(left.column("v"), left.num_rows)
            kth = np.array([float("-inf") if x is None else float(x) for x in right.column("kth").to_pylist()])
            found = search(Tree(v), left.column("id").to_numpy(), v, right.column("id").to_numpy(), _matrix(right.column("v"), right.num_rows), kth, k)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.int64())})

    keys = ["dims", "shard", "block"]
    return vectors.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(one, "query_id bigint, vec_id bigint, score bigint")


def best_of(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each query, in order: an array of at most k, merged inside tasks first."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def exact_top_k(table: DataFrame, is_query, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query row. `is_query`: a condition on column id."""
    rows = materialise(whole_components(table, scale, key, vector), "vectors")
    total, asked = rows.count(), rows.filter(is_query).count()
    shards, blocks = max(4, -(-total // SHARD_ROWS)), max(1, -(-asked // BLOCK_ROWS))
    place = lambda seed, n: F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(n)).cast("int")
    vectors = rows.select("id", "v", "dims", place(1, shards).alias("shard"))
    queries = rows.filter(is_query).select("id", "v", "dims", place(2, blocks).alias("block"))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    # First each block searches one shard, then the others with the k-th scores found.
    home = F.pmod(F.col("block"), F.lit(shards))
    spread = vectors.select("*", every_block.alias("block"))
    first = materialise(_search_groups(spread.filter(F.col("shard") == home), queries.select("*", home.alias("shard"), F.lit(None).cast("bigint").alias("kth")), k), "hits-first")
    reached = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("least")).alias("kth"))
    carried = materialise(queries.join(reached, "id", "left"), "queries-carried")
    others = carried.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).filter(F.col("shard") != home)
    second = _search_groups(spread.filter(F.col("shard") != home), others, k)
    return best_of(first.unionByName(second), k).select("query_id", F.col("rank").cast(T.IntegerType()).alias("rank"), "vec_id", "score")
