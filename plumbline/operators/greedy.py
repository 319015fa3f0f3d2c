"""Anchored windows: the first event opens a window, later ones within it belong to it.

They are not session windows: the window does not move with the events in it.  Whether an
event opens a window depends on the window before, so keys are folded in order.  A sorted
Arrow stream per key keeps one anchor in memory, whatever the length of the key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: No key equals it, null included.
_NO_KEY = object()


def anchored(df: DataFrame, key: str, seconds: str, order: str, width: float, flag: str = "opens", members: str | None = None) -> DataFrame:
    """df with a flag: true if no window of width (end not included) was open for the key when the row came.

    seconds and order are the columns of time and of arrival.  members names a column for the
    row's number within its window, from 1.  Rows are sorted within their partition by key,
    so no key is held in memory.
    """
    names = list(df.columns)
    at_key, at_time = names.index(key), names.index(seconds)
    micros = int(round(width * 1_000_000))

    def run(batches):
        last, anchor, held = _NO_KEY, 0, 0  # the key, window start and rows in the window where the last batch ended
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            code = b.column(at_key).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            t = np.rint(np.nan_to_num(b.column(at_time).to_numpy(zero_copy_only=False).astype(np.float64)) * 1_000_000).astype(np.int64)
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            ends = np.append(first[1:], m)
            # the keys one after another on one line, further apart than the width, so that one search serves all
            span = t[ends - 1] - t[first]
            line = t - np.repeat(t[first] - np.cumsum(np.append(0, span[:-1] + micros + 1)), ends - first)
            jump = np.searchsorted(line, line + micros)
            opens = np.zeros(m, bool)
            at, stop = first.copy(), ends
            if b.column(at_key)[0].as_py() == last:
                at[0] = np.searchsorted(t[: ends[0]], anchor + micros)
            while len(at):
                inside = at < stop
                at, stop = at[inside], stop[inside]
                opens[at] = True
                at = jump[at]
            start = np.maximum.accumulate(np.where(opens, np.arange(m), -1))
            carried = start < np.repeat(first, ends - first)
            number = np.where(carried, held + 1 + np.arange(m), np.arange(m) - start + 1)
            last, held = b.column(at_key)[m - 1].as_py(), int(number[-1])
            if not carried[-1]:
                anchor = int(t[start[-1]])
            out = [*(b.column(i) for i in range(len(names))), pa.array(opens)]
            if members:
                out.append(pa.array(number.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(out, [*names, flag, *([members] if members else [])])

    extra = [T.StructField(flag, T.BooleanType())] + ([T.StructField(members, T.IntegerType())] if members else [])
    schema = T.StructType([*df.schema.fields, *extra])
    return df.repartition(F.col(key)).sortWithinPartitions(key, seconds, order).mapInArrow(run, schema)


def anchored_fold(df: DataFrame, key: str, seconds: str, order: str, width: float) -> DataFrame:
    """(key, time, order) of the rows that open a window, by an aggregate over each key's array.

    For keys with a bounded number of rows: it stays in the JVM but holds a key's rows in memory.
    """
    rows = F.sort_array(F.collect_list(F.struct(F.col(seconds).cast("double").alias("t"), F.col(order).cast("long").alias("o"))))
    zero = F.struct(F.lit(None).cast("double").alias("anchor"), F.array().cast("array<struct<t:double,o:long>>").alias("kept"))

    def step(acc, x):
        opens = acc["anchor"].isNull() | (x["t"] - acc["anchor"] >= width)
        return F.when(opens, F.struct(x["t"].alias("anchor"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)

    return df.groupBy(key).agg(F.aggregate(rows, zero, step)["kept"].alias("kept")).select(key, F.explode("kept").alias("k")).select(key, F.col("k.t").alias(seconds), F.col("k.o").alias(order))
