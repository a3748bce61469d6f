"""Exact top-k inner products: a ball tree per shard, searched by branch and bound."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.shared import stored

SHARD_ROWS = 2048
BLOCK_QUERIES = 4096
LEAF = 64
FOUND = "query bigint, query_id bigint, vec_id bigint, score double"


def usable(vector: Column) -> Column:
    """Whether a vector is there and every component is a finite number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The ``k`` candidates of highest inner product for each query: ``query_id, rank, vec_id, score``.

    Both sides are ``(vec_id bigint, vector array<double>)``. A query's own vec_id is no
    candidate, ties go to the smaller vec_id, a query with fewer candidates gets all.
    Rows without vec_id, and vectors that are NULL or hold a NULL or non-finite
    component, take no part; vectors meet only those of their length. Queries that
    repeat id and vector count once, repeated candidate rows each. Components should be
    integers for scores to be exact. An empty side gives no rows.

    Candidates are dealt evenly over shards. A shard's ball tree bounds the product of
    a query with all below a node by ``q . centre + |q| radius``; nodes are taken by
    falling bound until it is below the k-th score so far. Each query first meets one
    shard, and takes its k-th score there to all others, so most of them are pruned and
    return little. Of equal vectors a tree keeps the k + 1 smallest ids: no other can be
    in a result.
    """
    fine = F.col("vec_id").isNotNull() & usable(F.col("vector"))
    rows = candidates.filter(fine).select("vec_id", "vector")
    asked = queries.filter(fine).select(F.col("vec_id").alias("query_id"), "vector").distinct()
    asked = stored(asked.withColumn("query", F.monotonically_increasing_id()), "queries")
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    dealt = stored(rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))), "vectors")
    placed = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    everywhere = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint")))
    in_blocks = dealt.withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    )
    none = F.lit(float("-inf"))
    home = placed.withColumn("shard", F.pmod(F.xxhash64("query", F.lit(1)), F.lit(shards))).withColumn("bound", none)
    first = _met(home, in_blocks, k).groupBy("query").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    bounds = stored(first.filter(F.col("n") >= k).select("query", F.col("least").alias("bound")), "bounds")
    known = placed.join(bounds, "query", "left").withColumn("bound", F.coalesce("bound", none))
    found = _met(known.withColumn("shard", everywhere), in_blocks, k)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.col("score").cast("bigint").alias("score"))


def _met(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """What each query finds in the shards it is sent to, at least as good as its bound."""

    def searched(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple] = []
        sides = [(_matrices(vectors, "vec_id"), _matrices(asked, "query"))] if len(vectors) and len(asked) else []
        for by_size, queries_by_size in sides:
            bound = dict(zip(asked.column("query").to_pylist(), asked.column("bound").to_pylist()))
            names = dict(zip(asked.column("query").to_pylist(), asked.column("query_id").to_pylist()))
            for size, (numbers, matrix) in queries_by_size.items():
                if size in by_size:
                    tree = BallTree(*by_size[size], k + 1)
                    for number, vector in zip(numbers.tolist(), matrix):
                        own = names[number]
                        best = tree.search(vector, k, own, bound[number])
                        found += [(number, own, vec_id, score) for score, vec_id in best]
        columns = list(zip(*found)) or [[], [], [], []]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["query", "query_id", "vec_id", "score"])

    keys = ["shard", "block"]
    return candidates.groupBy(keys).cogroup(queries.groupBy(keys)).applyInArrow(searched, FOUND)


def _matrices(table: pa.Table, name: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors by length of the vector."""
    lists = table.column("vector").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    values, ids = lists.flatten().to_numpy(), table.column(name).to_numpy()
    owners = np.repeat(sizes, sizes)
    return {int(n): (ids[sizes == n], values[owners == n].reshape(-1, n) if n else np.zeros((int((sizes == n).sum()), 0))) for n in np.unique(sizes)}


class BallTree:
    """Points in balls, halved along their widest spread down to leaves."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, copies: int):
        order = np.argsort(ids, kind="stable")
        ids, points = ids[order], points[order]
        _, same = np.unique(points, axis=0, return_inverse=True)
        by_kind = np.argsort(same, kind="stable")
        starts = np.searchsorted(same[by_kind], np.arange(same.max() + 1))
        nth = np.arange(len(ids)) - starts[same[by_kind]]
        # a query's own id may be repeated, so every distinct id among the first is counted
        kept = by_kind[nth < copies] if len(np.unique(ids)) == len(ids) else by_kind
        self.ids, self.points = ids[kept], points[kept]
        self.centres, self.radii, self.children, self.rows = [], [], [], []
        waiting = [np.arange(len(self.ids))]
        links: list[tuple[int, int] | None] = [None]
        while waiting:
            rows, link = waiting.pop(), links.pop()
            node = len(self.rows)
            if link:
                self.children[link[0]][link[1]] = node
            own = self.points[rows]
            centre = own.mean(0)
            self.centres.append(centre)
            self.radii.append(float(np.sqrt(((own - centre) ** 2).sum(1).max())))
            self.children.append([-1, -1])
            spread = own.max(0) - own.min(0) if own.shape[1] else np.zeros(1)
            if len(rows) <= LEAF or not spread.max():
                self.rows.append(rows)
                continue
            self.rows.append(None)
            half = np.argsort(own[:, spread.argmax()], kind="stable")
            for side, part in enumerate((half[: len(half) // 2], half[len(half) // 2 :])):
                waiting.append(rows[part])
                links.append((node, side))
        self.centres = np.array(self.centres)

    def search(self, query: np.ndarray, k: int, own: int, bound: float) -> list[tuple[float, int]]:
        """The best ``(score, id)`` that reach ``bound``, the query's own id left out."""
        length = float(np.sqrt(query @ query))
        # rounding of the bound must not cut off a node that holds an equal score
        limits = self.centres @ query + length * np.array(self.radii)
        limits += 1e-9 * (np.abs(limits) + length * (1 + np.abs(self.centres).sum(1)))
        best: list[tuple[float, int]] = []  # worst first: (score, -id)
        heap = [(-limits[0], 0)]
        while heap:
            limit, node = heapq.heappop(heap)
            if -limit < bound:
                break
            rows = self.rows[node]
            if rows is None:
                for child in self.children[node]:
                    if limits[child] >= bound:
                        heapq.heappush(heap, (-limits[child], child))
                continue
            scores = self.points[rows] @ query
            for i in np.flatnonzero(scores >= bound).tolist():
                entry = (float(scores[i]), -int(self.ids[rows[i]]))
                if entry[1] == -own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
                if len(best) == k:
                    bound = max(bound, best[0][0])
        return [(score, -number) for score, number in sorted(best, reverse=True)]
