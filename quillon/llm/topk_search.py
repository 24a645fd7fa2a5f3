"""Exact top-k inner products by KD-trees, one for each shard.

Vectors are dealt over shards by id. A shard's tree splits at the median of its widest dimension and keeps
a tight bounding box, and the smallest id, of every node. A query's best possible score in a box bounds
the node; the traversal is best-first and carries the kth score found so far from leaf to leaf, so it ends
at the first node that cannot improve on it. Every shard sees every query, in blocks; the shards' k best
meet in one exchange by query.

Defined results: a vector that is null or holds null or non-finite components takes no part; vectors of
different lengths are not compared; an empty vector scores 0 with other empty ones; a row whose id is null
takes no part; rows with one id are one item, which is never its own neighbour and scores by its best
vectors; scores are exact integers and stop at the limits of a long; ties go to the smaller id; an empty
table gives an empty table; columns other than the id and the vector are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import shuffle_width

K = 5
LEAF = 256
#: Most rows of one shard, on average; a task holds one shard at a time.
SHARD_ROWS = 1 << 16
#: Rows for which a further task is worth its start.
LEAST_ROWS = 4096
#: Queries that are held at one time.
BLOCK = 1024
_LONG = (-(1 << 63), (1 << 63) - 1)


class KDTree:
    """points: int64 array, n x d; ids: int64."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        self.size = int(np.abs(points.astype(np.float64)).max(initial=0.0))
        nodes: list[tuple] = []  # start, end, left, right
        boxes: list[tuple] = []

        def grow(start: int, end: int) -> int:
            mine = len(nodes)
            part = points[order[start:end]]
            low, high = part.min(axis=0), part.max(axis=0)
            nodes.append((start, end, -1, -1))
            boxes.append((low, high, ids[order[start:end]].min()))
            wide = high.astype(np.float64) - low if points.shape[1] else np.zeros(1)
            if end - start > leaf and wide.max() > 0:
                mid = (start + end) // 2
                axis = int(np.argmax(wide))
                order[start:end] = order[start:end][np.argpartition(part[:, axis], mid - start, kind="introselect")]
                nodes[mine] = (start, end, grow(start, mid), grow(mid, end))
            return mine

        grow(0, len(ids))
        self.points, self.ids, self.nodes = points[order], ids[order], nodes
        self.low, self.high = (np.array([b[k] for b in boxes]) for k in (0, 1))
        self.least_id = [int(b[2]) for b in boxes]
        _, times = np.unique(ids, return_counts=True)
        self.times = int(times.max())

    def _kind(self, queries: np.ndarray):
        """A number type in which all sums of products are exact."""
        most = self.size * float(np.abs(queries.astype(np.float64)).max(initial=0.0)) * max(1, queries.shape[1])
        return np.float64 if most < 2**52 else np.int64 if most < 2**61 else object

    def search(self, queries: np.ndarray, own: np.ndarray, k: int = K) -> list[list[tuple[int, int]]]:
        """For each query the k best (score, id) of other ids, best first, ties by smaller id."""
        kind = self._kind(queries)
        q, points = queries.astype(kind), self.points.astype(kind)
        # the largest inner product with any point of a node's box
        bounds = np.maximum(q, 0) @ self.high.astype(kind).T + np.minimum(q, 0) @ self.low.astype(kind).T
        return [self._one(q[i], int(own[i]), bounds[i], points, k) for i in range(len(q))]

    def _one(self, q, own: int, bounds, points, k: int) -> list[tuple[int, int]]:
        need = (k + 1) * self.times  # enough rows for k other ids
        scores, ids = points[:0] @ q, self.ids[:0]
        heap = [(-bounds[0], 0)]
        kth, kth_id = None, None
        while heap:
            bound, node = heapq.heappop(heap)
            if kth is not None and (-bound < kth or (-bound == kth and self.least_id[node] > kth_id)):
                if -bound < kth:
                    break
                continue
            start, end, left, right = self.nodes[node]
            if left >= 0:
                heapq.heappush(heap, (-bounds[left], left))
                heapq.heappush(heap, (-bounds[right], right))
                continue
            s, own_ids = points[start:end] @ q, self.ids[start:end]
            if kth is not None:
                good = s >= kth
                s, own_ids = s[good], own_ids[good]
            if not len(s):
                continue
            scores, ids = np.concatenate([scores, s]), np.concatenate([ids, own_ids])
            if len(ids) > need:
                best = np.lexsort((ids, -scores))[:need]
                scores, ids = scores[best], ids[best]
            if len(ids) == need:
                worst = np.lexsort((ids, -scores))[-1]
                kth, kth_id = scores[worst], ids[worst]
        found: dict[int, int] = {}
        for at in np.lexsort((ids, -scores)):
            name = int(ids[at])
            if name != own and name not in found:
                found[name] = min(max(int(scores[at]), _LONG[0]), _LONG[1])
                if len(found) == k:
                    break
        return [(s, i) for i, s in found.items()]


def quantised(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id and v = floor(256 * x) of every component, for the vectors that take part."""
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    whole = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).filter(whole)
    return usable.select(F.col(key).cast("long").alias("vec_id"), F.transform(wide, lambda x: F.floor(x * 256.0)).alias("v"))


def search(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, shard_rows: int = SHARD_ROWS, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row where is_query(vec_id) holds."""
    spark = vectors.sparkSession
    n = vectors.count()
    shards = max(1, -(-n // shard_rows), min(shuffle_width(spark), -(-n // LEAST_ROWS)))
    table = quantised(vectors, key, vector).withColumn("d", F.size("v"))
    dealt = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    rows = table.select("d", dealt.alias("shard"), F.lit(0).alias("is_query"), "vec_id", "v")
    asked = table.filter(is_query).select("d", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("is_query"), "vec_id", "v")

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        place, tree = None, None
        for batch in batches:
            d, shard, kind, ids = (batch.column(j).to_numpy(zero_copy_only=False) for j in range(4))
            lists = batch.column(4)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(d)])
            cuts = np.flatnonzero(np.diff(d) | np.diff(shard) | np.diff(kind)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                if a == b:
                    continue
                if (d[a], shard[a]) != place:
                    place, tree, held = (d[a], shard[a]), None, []
                points = flat[offsets[a] : offsets[b]].reshape(b - a, d[a])
                if kind[a] == 0:
                    held.append((points, ids[a:b]))
                    continue
                if tree is None and held:
                    tree = KDTree(np.concatenate([p for p, _ in held]), np.concatenate([i for _, i in held]), leaf)
                    held = []
                if tree is None:
                    continue
                for at in range(0, b - a, BLOCK):
                    who = ids[a:b][at : at + BLOCK]
                    found = tree.search(points[at : at + BLOCK], who, k)
                    triples = [(q, i, s) for q, best in zip(who.tolist(), found, strict=True) for s, i in best]
                    yield pa.RecordBatch.from_arrays([pa.array([t[j] for t in triples], pa.int64()) for j in range(3)], names=["query_id", "vec_id", "score"])

    together = rows.unionAll(asked).repartition(shards, "d", "shard").sortWithinPartitions("d", "shard", "is_query")
    near = together.mapInArrow(run, "query_id long, vec_id long, score long").repartition("query_id")
    best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""
