"""Exact top-k search by inner product, with a ball tree per shard and branch and bound.

A node holds the centre c and radius r of its vectors, so no vector in it has an inner
product with q above q.c + |q| r.  A query takes the nodes of a tree by that bound, the
highest first, and stops when the bound falls below its current k-th score.  Shards share
that score in rounds: every query first searches the shard that holds its own vector, then
one in FIRST of the others, then the rest, each round from the k-th score of all before, so
that later shards open only nodes that can still change the result.

Components become floor(scale * x) (doubles of 2^53 and more are whole as they are) and
scores are integers: dot products are taken in doubles where they are exact, else in Python
integers, kept within a long.

Defined cases: null ids, null vectors and vectors with null or non-finite components take
no part; vectors of different lengths are no candidates of each other; ties go to the
smaller id; rows that repeat an id are candidates each, but not of queries with that id,
and a query id that repeats is searched for once, with one of its vectors; a query without
candidates has no rows; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table
from .vectors import QUERY_BLOCK, SHARD_ARROW, SHARD_ROWS, SHARD_SCHEMA, clean, dealt, gathered, met, rows_batch

LEAF_ROWS = 128
#: One of so many shards is searched before the others.
FIRST = 8
EXACT = 2.0**53


class BallTree:
    def __init__(self, ids: np.ndarray, vecs: np.ndarray, nodes: np.ndarray | None = None, balls: np.ndarray | None = None):
        """nodes: first row, last row + 1, left child, right child (-1: leaf); balls: centre and radius."""
        self.ids, self.vecs = ids, vecs
        if nodes is None:
            self._build()
        else:
            self.nodes, self.balls = nodes, balls
        self.largest = float(np.abs(vecs).max(initial=0.0))

    def _build(self) -> None:
        order, nodes, balls = np.arange(len(self.ids)), [], []

        def grow(lo: int, hi: int) -> int:
            part = self.vecs[order[lo:hi]]
            centre = part.mean(axis=0)
            away = part - centre
            distance = np.sqrt((away * away).sum(axis=1))
            me = len(nodes)
            nodes.append([lo, hi, -1, -1])
            balls.append(np.append(centre, distance.max(initial=0.0)))
            if hi - lo > LEAF_ROWS and distance.max() > 0:
                a = part[distance.argmax()]
                b = part[((part - a) ** 2).sum(axis=1).argmax()]
                side = part @ (a - b)
                order[lo:hi] = order[lo:hi][np.argsort(side, kind="stable")]
                mid = (lo + hi) // 2
                nodes[me][2] = grow(lo, mid)
                nodes[me][3] = grow(mid, hi)
            return me

        if len(order):
            grow(0, len(order))
        self.ids, self.vecs = self.ids[order], self.vecs[order]
        self.nodes = np.array(nodes, np.int64).reshape(-1, 4)
        self.balls = np.array(balls).reshape(len(nodes), -1)

    def _scores(self, lo: int, hi: int, q: np.ndarray) -> list[int]:
        part = self.vecs[lo:hi]
        if self.largest * float(np.abs(q).max(initial=0.0)) * max(1, len(q)) < EXACT:
            return (part @ q).astype(np.int64).tolist()
        wide = [int(x) for x in q]
        top = 2**63 - 1
        return [max(-top - 1, min(top, sum(int(a) * b for a, b in zip(row, wide)))) for row in part.tolist()]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The upper bound of each query's inner products in each node, rounded up."""
        norm = np.sqrt((queries * queries).sum(axis=1))[:, None]
        size = np.sqrt((self.balls[:, :-1] ** 2).sum(axis=1)) + self.balls[:, -1]
        return queries @ self.balls[:, :-1].T + norm * self.balls[:, -1] + 1e-9 * (1.0 + norm * size)

    def search(self, query_id: int, q: np.ndarray, bound: np.ndarray, k: int, kth: float = -np.inf) -> list[tuple[int, int]]:
        """(score, id) of the at most k best with a score of kth or more, best first."""
        if not len(self.nodes):
            return []
        best: list[tuple[int, int]] = []  # (score, -id), a heap with the worst on top
        todo = [(-bound[0], 0)]
        while todo and -todo[0][0] >= kth:
            _, node = heapq.heappop(todo)
            lo, hi, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    if bound[child] >= kth:
                        heapq.heappush(todo, (-bound[child], child))
                continue
            for score, i in zip(self._scores(lo, hi, q), self.ids[lo:hi].tolist()):
                if score < kth or i == query_id:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (score, -i))
                elif (score, -i) > best[0]:
                    heapq.heapreplace(best, (score, -i))
                else:
                    continue
                if len(best) == k:
                    kth = max(kth, best[0][0])
        return [(s, -i) for s, i in sorted(best, reverse=True)]

    def packed(self) -> bytes:
        return np.int64(len(self.nodes)).tobytes() + self.nodes.tobytes() + self.balls.astype(np.float64).tobytes()

    @classmethod
    def unpacked(cls, ids: bytes, vecs: bytes, extra: bytes, dim: int) -> "BallTree":
        n = int(np.frombuffer(extra, np.int64, 1)[0])
        nodes = np.frombuffer(extra, np.int64, 4 * n, 8).reshape(n, 4)
        balls = np.frombuffer(extra, np.float64, n * (dim + 1), 8 + 32 * n).reshape(n, dim + 1)
        i = np.frombuffer(ids, np.int64)
        return cls(i, np.frombuffer(vecs, np.float64).reshape(len(i), dim), nodes, balls)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by every."""
    v = clean(vectors, id_col, vec_col)
    v = v.select("id", F.transform("vec", lambda x: F.when(F.abs(x * F.lit(scale)) < EXACT, F.floor(x * F.lit(scale)).cast("double")).otherwise(x * F.lit(scale))).alias("vec"))

    def build(batches):
        """A row per shard, and a row per shard's queries with what the shard itself gives them."""
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for j, (ids, vecs) in enumerate(gathered(batches, 2 * SHARD_ROWS)):
            shard, dim = part << 24 | j, vecs.shape[1]
            tree = BallTree(ids, vecs)
            rows = [(shard, "shard", dim, tree.ids.tobytes(), tree.vecs.tobytes(), tree.packed())]
            mine = np.flatnonzero(ids % every == 0)
            for i, b in zip(mine, tree.bounds(vecs[mine]) if len(mine) else ()):
                hits = tree.search(int(ids[i]), vecs[i], b, k)
                start = float(hits[-1][0]) if len(hits) == k else -np.inf
                rows.append((shard, "query", dim, ids[i : i + 1].tobytes(), vecs[i].tobytes(), np.array([start, float(shard)]).tobytes() + np.array(hits, np.int64).tobytes()))
            yield rows_batch(rows, SHARD_ARROW)

    built = staged(dealt(v, v.count()).mapInArrow(build, SHARD_SCHEMA), "ball-trees")
    shards, queries = built.where("kind = 'shard'"), built.where("kind = 'query'")
    # an id that repeats is searched for with one of its vectors
    queries = queries.groupBy("ids").agg(F.min(F.struct("vecs", "shard", "kind", "dim", "extra")).alias("q")).select("q.shard", "q.kind", "q.dim", "ids", "q.vecs", "q.extra")

    def pack(batches):
        """Query rows into blocks; extra: start score and home shard of each."""
        held: dict[int, list] = {}
        for b in batches:
            for row in b.to_pylist():
                rows = held.setdefault(row["dim"], [])
                rows.append(row)
                if len(rows) == QUERY_BLOCK:
                    yield rows_batch([block(held.pop(row["dim"]))], SHARD_ARROW)
        for rows in held.values():
            if rows:
                yield rows_batch([block(rows)], SHARD_ARROW)

    def block(rows):
        return (0, "block", rows[0]["dim"], b"".join(r["ids"] for r in rows), b"".join(r["vecs"] for r in rows), b"".join(r["extra"][:16] for r in rows))

    def search(shard, dim, s, b):
        tree = BallTree.unpacked(s["ids"], s["vecs"], s["extra"], dim)
        ids = np.frombuffer(b["ids"], np.int64)
        vecs = np.frombuffer(b["vecs"], np.float64).reshape(len(ids), dim)
        start = np.frombuffer(b["extra"], np.float64).reshape(len(ids), 2)
        return [(int(q), i, s) for q, x, bound, (kth, home) in zip(ids, vecs, tree.bounds(vecs), start) if home != shard for s, i in tree.search(int(q), x, bound, k, kth)]

    hits = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def at_home(batches):
        for b in batches:
            rows = []
            for ids, extra in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = np.frombuffer(extra, np.int64, offset=16).reshape(-1, 2).tolist()
                rows += [(int(np.frombuffer(ids, np.int64)[0]), i, s) for s, i in found]
            yield rows_batch(rows, hits)

    def raised(batches):
        """Query rows with a better k-th score, which is null if there are less than k hits."""
        for b in batches:
            kth, extra = b.column("kth").to_pylist(), b.column("extra").to_pylist()
            better = [e if s is None else np.array([max(float(s), np.frombuffer(e, np.float64, 1)[0])]).tobytes() + e[8:] for s, e in zip(kth, extra)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in SHARD_ARROW.names[:-1]), pa.array(better, pa.binary())], schema=SHARD_ARROW)

    def id_of(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(np.frombuffer(x, np.int64)[0]) for x in b.column("ids").to_pylist()], pa.int64()), *b.columns], names=["qid", *b.schema.names])

    schema = "query_id long, vec_id long, score long"
    n = max(1, queries.count() // QUERY_BLOCK)
    in_blocks = lambda q: q.repartition(n).mapInArrow(pack, SHARD_SCHEMA)
    early = F.pmod(F.xxhash64("shard"), F.lit(FIRST)) == 0
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    some = met(shards.where(early), in_blocks(queries), search, schema, hits).unionByName(queries.select("ids", "extra").mapInArrow(at_home, schema))
    some = staged(some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "first-hits")
    kth = some.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("kth"))
    known = queries.mapInArrow(id_of, f"qid long, {SHARD_SCHEMA}")
    known = known.join(kth, known["qid"] == kth["query_id"], "left").select(*SHARD_ARROW.names, "kth").mapInArrow(raised, SHARD_SCHEMA)
    found = met(shards.where(~early), in_blocks(known), search, schema, hits).unionByName(some)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
