"""Vectors in blocks: cleaning, sharding, and joining query blocks with shards.

A shard is the vectors of one partition and one dimension, at most about SHARD_ROWS of
them, dealt out round-robin, so that no value or id can make one shard large.  Queries are
gathered into blocks, and every block meets every shard once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_ROWS = 8192
QUERY_BLOCK = 2048

SHARD_SCHEMA = "shard long, kind string, dim int, ids binary, vecs binary, extra binary"


def clean(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", drop_zero: bool = False) -> DataFrame:
    """(id, vec as doubles) of the rows with an id and a vector of finite components."""
    v = vectors.select(vectors[f"`{id_col}`"].cast("long").alias("id"), vectors[f"`{vec_col}`"].cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    v = v.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & F.coalesce(fine, F.lit(False)))
    return v.where(F.exists("vec", lambda x: x != 0)) if drop_zero else v


def dealt(v: DataFrame, n: int) -> DataFrame:
    """v over as many partitions as it has shards."""
    return v.repartition(max(1, -(-n // SHARD_ROWS)))


def gathered(batches: Iterator[pa.RecordBatch], at_most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) in groups of one dimension and at most so many rows."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    sizes: dict[int, int] = {}
    for b in batches:
        if not b.num_rows:
            continue
        vec = b.column(1)
        lengths = np.diff(vec.offsets.to_numpy())
        flat = vec.flatten().to_numpy(zero_copy_only=False)
        ids = b.column(0).to_numpy(zero_copy_only=False)
        start = np.cumsum(lengths) - lengths
        for d in np.unique(lengths).tolist():
            mine = np.flatnonzero(lengths == d)
            rows = flat[(start[mine][:, None] + np.arange(d)).astype(np.int64)]
            for a in range(0, len(mine), at_most):
                part = (ids[mine[a : a + at_most]], rows[a : a + at_most])
                if sizes.get(d, 0) + len(part[0]) > at_most:
                    yield tuple(map(np.concatenate, zip(*held.pop(d))))
                    sizes[d] = 0
                held.setdefault(d, []).append(part)
                sizes[d] = sizes.get(d, 0) + len(part[0])
    for parts in held.values():
        if parts:
            yield tuple(map(np.concatenate, zip(*parts)))


def rows_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


SHARD_ARROW = pa.schema([("shard", pa.int64()), ("kind", pa.string()), ("dim", pa.int32()), ("ids", pa.binary()), ("vecs", pa.binary()), ("extra", pa.binary())])
HIT_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def met(shards: DataFrame, blocks: DataFrame, search: Callable, out_schema: str, out_arrow: pa.Schema) -> DataFrame:
    """search(shard row, block row) for every query block and every shard of its dimension."""
    s = shards.select("shard", "dim", F.struct("ids", "vecs", "extra").alias("s"))
    b = blocks.select("dim", F.struct("ids", "vecs", "extra").alias("b"))
    every = shards.select("dim", "shard").groupBy("dim").agg(F.collect_list("shard").alias("at"))  # one number per SHARD_ROWS vectors
    pairs = b.join(every, "dim").select("b", "dim", F.explode("at").alias("shard"))
    joined = pairs.join(s, ["shard", "dim"]).select("shard", "dim", "s", "b")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                s, b = (row.column(i)[0].as_py() for i in (2, 3))
                yield rows_batch(search(row.column(0)[0].as_py(), row.column(1)[0].as_py(), s, b), out_arrow)

    return joined.mapInArrow(run, out_schema)
