"""Running sums and row frames in a total order, without a task that holds all rows.

Rows are cut into slices of equal width of the order column; what lies before a slice comes
from one row per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICES = 256


def _number(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    return F.unix_micros(c).cast("double") if isinstance(df.schema[name].dataType, T.TimestampType) else c.cast("double")


def cumulative(df: DataFrame, order: str, amounts: dict[str, Column], slices: int = SLICES) -> DataFrame:
    """df with, for each name, the sum of the column over all rows up to and with this one; order is a number or a time, nulls first."""
    v = _number(df, order)
    ends = df.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))  # one row
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * slices), F.lit(slices - 1))).otherwise(0)
    d = df.crossJoin(F.broadcast(ends)).withColumn("_slice", F.when(v.isNull(), -1).otherwise(at))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # slices + 1 rows at most
    base = d.groupBy("_slice").agg(*[F.sum(c).alias(n) for n, c in amounts.items()])
    base = base.select("_slice", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_base_{n}") for n in amounts])
    w = Window.partitionBy("_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({n: F.sum(c).over(w) for n, c in amounts.items()}).join(F.broadcast(base), "_slice")
    return d.withColumns({n: F.col(n) + F.col(f"_base_{n}") for n in amounts}).drop("_slice", "_lo", "_hi", *[f"_base_{n}" for n in amounts])


def in_blocks(df: DataFrame, order: str, before: int, block: int = 10_000) -> DataFrame:
    """df with _n (its number in order), _block and _lead: frames of up to so many rows before lie within a block.

    Each row also leads the next block (_lead), which drops such rows when its frames are done.
    """
    size = max(before, block)
    d = cumulative(df, order, {"_n": F.lit(1)})
    own = F.floor((F.col("_n") - 1) / size)
    copies = F.array(F.struct(own.alias("b"), F.lit(False).alias("l")), F.struct((own + 1).alias("b"), F.lit(True).alias("l")))
    near_end = F.pmod(F.col("_n") - 1, F.lit(size)) >= size - before
    return d.withColumn("_c", F.explode(F.when(near_end, copies).otherwise(F.slice(copies, 1, 1)))).withColumns({"_block": F.col("_c.b"), "_lead": F.col("_c.l")}).drop("_c")
