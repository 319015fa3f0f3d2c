"""Approximate nearest neighbours with a permutation index.

A vector is represented by its nearest pivots in order.  Each pivot has an inverted file
of the vectors that hold it among their nearest, with its place in their order.  A query
reads the files of its own nearest pivots and adds up the footrule distance (the sum of
differences of places; a pivot that only one side holds counts as at the end).  The best by
footrule are reranked by Euclidean distance on the original vectors.

Each distinct vector is indexed once, with the smallest of its ids (no more than k of them
and the query's own can be needed), so copies take no places among the candidates; vectors are
told apart by two 64-bit hashes.  The pivots are a bounded sample: of the SAMPLE distinct
vectors with the smallest hashes the first PIVOTS that keep some distance to each other, so
that a crowd of near copies does not fill the places.  A shard reranks a share of its vectors
in order of footrule, with all that tie with the last one, and goes on by as many until that
changes nothing, so recall does not depend on the number of shards or on crowds.

Defined cases: null ids, and vectors that are null, zero or hold null or non-finite
components, take no part; vectors of different lengths are no candidates of each other, and
lengths of which no pivot was drawn are searched in full; ties go to the smaller id; rows
that repeat an id are candidates each, but not of queries with that id; a query id that
repeats is searched for once, with the smallest of its vectors; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table
from .vectors import HIT_ARROW, QUERY_BLOCK, SHARD_ARROW, SHARD_ROWS, SHARD_SCHEMA, clean, dealt, gathered, met, rows_batch

PIVOTS = 256
PLACES = 64
#: Distinct vectors of which the pivots are chosen, and their least distance as a part of the median one.
SAMPLE, APART = 4 * PIVOTS, 0.5
#: Share of a shard's vectors that is reranked at a time, and the least number of them.
SHARE, LEAST = 0.15, 400


def nearest_pivots(vecs: np.ndarray, pivots: np.ndarray, places: int) -> np.ndarray:
    """The numbers of each vector's nearest pivots, nearest first."""
    d = (pivots * pivots).sum(axis=1) - 2.0 * (vecs @ pivots.T)
    return np.argsort(d, axis=1, kind="stable")[:, :places].astype(np.int32)


def inverted_files(near: np.ndarray, n_pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first posting of each pivot, rows, places), postings ordered by pivot."""
    n, places = near.shape
    flat = near.ravel()
    order = np.argsort(flat, kind="stable")
    first = np.searchsorted(flat[order], np.arange(n_pivots + 1))
    return first.astype(np.int64), (order // places).astype(np.int32), (order % places).astype(np.int16)


def footrule(files: tuple[np.ndarray, np.ndarray, np.ndarray], near_query: np.ndarray, n: int) -> np.ndarray:
    """Footrule distance of a query to each of n vectors, from the files of its pivots."""
    first, rows, places = files
    end = len(near_query)
    total = np.full(n, end * (end + 1), np.int32)
    for i, p in enumerate(near_query.tolist()):
        a, b = first[p], first[p + 1]
        j = places[a:b].astype(np.int32)
        total[rows[a:b]] += np.abs(j - i) - (end - i) - (end - j)
    return total


def apart(sample: np.ndarray, n: int) -> np.ndarray:
    """n of the sample: the first ones that keep some distance to all taken before, then the first others."""
    some = sample[:64]
    away = np.sqrt(((some[:, None] - some[None]) ** 2).sum(axis=2))[np.triu_indices(len(some), 1)]
    least = APART * float(np.median(away)) if len(away) else 0.0
    nearest_taken, taken = np.full(len(sample), np.inf), []
    for i, x in enumerate(sample):
        if len(taken) < n and nearest_taken[i] > least:
            taken.append(i)
            nearest_taken = np.minimum(nearest_taken, np.sqrt(((sample - x) ** 2).sum(axis=1)))
    others = np.setdiff1d(np.arange(len(sample)), taken)
    return sample[np.append(taken, others[: n - len(taken)]).astype(np.int64)]


def distinct_vectors(v: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(h1, h2, vec) for each distinct vector of v, and (h1, h2, ids): its k + 1 smallest ids, in order, each as often as it is there but k times at most."""
    keyed = v.select(F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"), "id", "vec")
    order = Window.partitionBy("h1", "h2").orderBy("id")
    first = keyed.groupBy("h1", "h2", "id").agg(F.count(F.lit(1)).alias("n")).withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    ids = first.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("some"))
    ids = ids.select("h1", "h2", F.flatten(F.transform("some", lambda x: F.array_repeat(x["id"], F.least(x["n"], F.lit(k)).cast("int")))).alias("ids"))
    return keyed.groupBy("h1", "h2").agg(F.first("vec").alias("vec")), ids


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, n_pivots: int = PIVOTS, places: int = PLACES, share: float = SHARE, least: int = LEAST, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) for the rows whose id is divisible by every."""
    v = clean(vectors, id_col, vec_col, drop_zero=True)
    distinct, copies = distinct_vectors(v, k)
    copies = staged(copies, "copies")
    few = copies.select("h1", "h2").orderBy("h1", "h2").limit(max(SAMPLE, n_pivots))
    drawn = distinct.join(F.broadcast(few), ["h1", "h2"], "left_semi")  # SAMPLE rows
    sample: dict[int, list] = {}
    for row in sorted(drawn.collect(), key=lambda r: (r["h1"], r["h2"])):
        sample.setdefault(len(row["vec"]), []).append(row["vec"])
    pivots = {d: apart(np.array(x), n_pivots) for d, x in sample.items()}

    def build(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        lists: list[pa.Array] = []

        def numbered():
            n = 0
            for b in batches:
                lists.append(b.column(1))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, n + b.num_rows)), b.column(0)], ["id", "vec"])
                n += b.num_rows

        for j, (at, vecs) in enumerate(gathered(numbered(), 2 * SHARD_ROWS)):
            dim = vecs.shape[1]
            p = pivots.get(dim)
            near = nearest_pivots(vecs, p, places) if p is not None else np.zeros((len(at), 0), np.int32)
            mine = pa.chunked_array(lists).take(pa.array(at)).combine_chunks()
            first = np.append(0, np.cumsum(mine.value_lengths().to_numpy())).astype(np.int32)
            ids = mine.flatten().to_numpy().astype(np.int64)
            yield rows_batch([(part << 24 | j, "shard", dim, ids.tobytes(), vecs.tobytes(), first.tobytes() + near.astype(np.int16).tobytes())], SHARD_ARROW)

    def pack(batches):
        for ids, vecs in gathered(batches, QUERY_BLOCK):
            yield rows_batch([(0, "block", vecs.shape[1], ids.tobytes(), vecs.tobytes(), b"")], SHARD_ARROW)

    def search(shard, dim, s, b):
        ids, qids = np.frombuffer(s["ids"], np.int64), np.frombuffer(b["ids"], np.int64)
        n_vecs = len(s["vecs"]) // (8 * dim) if dim else 0
        vecs = np.frombuffer(s["vecs"], np.float64).reshape(n_vecs, dim)
        first = np.frombuffer(s["extra"], np.int32, n_vecs + 1)
        owner = np.repeat(np.arange(n_vecs), np.diff(first))
        queries = np.frombuffer(b["vecs"], np.float64).reshape(len(qids), dim)
        p = pivots.get(dim)
        n = min(n_vecs, max(least, int(np.ceil(share * n_vecs))))
        if p is not None:
            near = np.frombuffer(s["extra"], np.int16, offset=4 * (n_vecs + 1)).reshape(n_vecs, -1)
            files, near_queries = inverted_files(near.astype(np.int32), len(p)), nearest_pivots(queries, p, places)
        rows = []
        for i, (q, x) in enumerate(zip(qids.tolist(), queries)):
            low, own = ids[first[:-1]].copy(), {}  # the smallest id of each vector that is not the query's
            for m in np.unique(owner[ids == q]).tolist():
                own[m] = [y for y in ids[first[m] : first[m + 1]].tolist() if y != q]
                low[m] = own[m][0] if own[m] else q
            order, score = np.arange(n_vecs), None
            if p is not None and n < n_vecs:
                score = footrule(files, near_queries[i], n_vecs)
                order = np.lexsort((low, score))
                score = score[order]
            best, to = (np.zeros(0, np.int64), np.zeros(0)), 0
            while to < n_vecs:
                upto = min(n_vecs, to + n) if score is not None else n_vecs
                if upto < n_vecs:
                    upto = int(np.searchsorted(score, score[upto - 1], "right"))
                at = order[to:upto]
                at = at[low[at] != q]
                away = vecs[at] - x
                at, distance = np.append(best[0], at), np.append(best[1], np.sqrt((away * away).sum(axis=1)))
                top = np.lexsort((low[at], distance))[:k]
                same = to > 0 and len(best[0]) == k and np.array_equal(at[top], best[0])
                best, to = (at[top], distance[top]), upto
                if same:
                    break
            hits = [(d, y) for m, d in zip(best[0].tolist(), best[1].tolist()) for y in (own[m] if m in own else ids[first[m] : first[m + 1]].tolist())]
            rows += [(q, y, d) for d, y in sorted(hits)[:k]]
        return rows

    dealt_out = dealt(distinct.join(copies, ["h1", "h2"]).select("vec", "ids"), copies.count())
    built = staged(dealt_out.mapInArrow(build, SHARD_SCHEMA), "permutation-index")
    q = v.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("vec").alias("vec"))
    blocks = q.repartition(max(1, q.count() // QUERY_BLOCK)).mapInArrow(pack, SHARD_SCHEMA)
    found = met(built, blocks, search, "query_id long, vec_id long, score double", HIT_ARROW)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
