"""Profile of a table: one aggregation pass, one row per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIGH_NULL, HIGH_CARDINALITY, LOW_VARIANCE = 0.5, 0.5, 0.01


def inferred_type(df: DataFrame, name: str) -> list[Column]:
    """Counts of values by the kind of their text, for string columns."""
    c = F.col(name)
    number = c.try_cast("double").isNotNull()
    whole = c.rlike(r"^[+-]?\d+$")
    return [F.count_if(c.isNotNull() & c.isin("true", "false", "True", "False")).alias("b"), F.count_if(whole).alias("i"), F.count_if(number & ~whole).alias("f"), F.count(c).alias("n")]


def profile(df: DataFrame, exact_distinct: bool = False) -> DataFrame:
    """(field, kind, n, n_null, null_rate, n_distinct, cardinality, min, max, mean, std, len_min, len_max, len_mean, flags).

    All columns are measured in one pass; distinct counts are approximate; exact
    ones expand rows by column.
    """
    numeric = (T.NumericType,)
    aggs, kinds = [F.count(F.lit(1)).alias("_n")], {}
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        text = isinstance(f.dataType, T.StringType)
        number = isinstance(f.dataType, numeric)
        kinds[i] = "bool" if isinstance(f.dataType, T.BooleanType) else "int" if isinstance(f.dataType, T.IntegralType) else "float" if number else "string" if text else f.dataType.simpleString()
        v = c.cast("double") if number else F.lit(None).cast("double")
        length = F.length(c) if text else F.lit(None).cast("int")
        simple = not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        distinct = (F.count_distinct(c) if exact_distinct else F.approx_count_distinct(c)) if simple else F.lit(None).cast("long")
        typed = F.struct(*inferred_type(df, f"`{f.name}`")) if text else F.lit(None).cast("struct<b:bigint,i:bigint,f:bigint,n:bigint>")
        aggs.append(F.struct(
            F.count_if(c.isNull()).alias("n_null"), distinct.alias("n_distinct"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
            F.min(length).alias("len_min"), F.max(length).alias("len_max"), F.avg(length).alias("len_mean"), typed.alias("typed"),
        ).alias(f"_{i}"))
    one = df.agg(*aggs)
    rows = one.select("_n", F.explode(F.array(*[F.struct(F.lit(f.name).alias("field"), F.lit(kinds[i]).alias("declared"), F.col(f"_{i}").alias("s")) for i, f in enumerate(df.schema.fields)])).alias("r"))
    r = rows.select(F.col("r.field").alias("field"), F.col("r.declared").alias("declared"), F.col("_n").alias("n"), "r.s.*")
    t = F.col("typed")
    kind = (
        F.when(F.col("declared") != "string", F.col("declared")).when(t["n"] == 0, "unknown").when(t["b"] == t["n"], "bool").when(t["i"] == t["n"], "int")
        .when(t["i"] + t["f"] == t["n"], "float").when(t["b"] + t["i"] + t["f"] == 0, "string").otherwise("mixed")
    )
    r = r.withColumn("kind", kind).withColumn("null_rate", F.when(F.col("n") > 0, F.col("n_null") / F.col("n")).otherwise(0.0))
    r = r.withColumn("cardinality", F.when(F.col("n") > F.col("n_null"), F.col("n_distinct") / (F.col("n") - F.col("n_null"))).otherwise(0.0))
    flags = F.array_compact(F.array(
        F.when(F.col("null_rate") > HIGH_NULL, "HIGH_NULL"), F.when((F.col("n_distinct") == 1), "CONSTANT_FIELD"), F.when(F.col("cardinality") > HIGH_CARDINALITY, "HIGH_CARDINALITY"),
        F.when((F.abs("mean") > 0) & (F.col("std") / F.abs("mean") < LOW_VARIANCE), "LOW_VARIANCE"), F.when(F.col("kind") == "mixed", "MIXED_TYPE"),
    ))
    return r.select("field", "kind", "n", "n_null", "null_rate", "n_distinct", "cardinality", "min", "max", "mean", "std", "len_min", "len_max", "len_mean", flags.alias("flags"))


def quality_flags(p: DataFrame) -> DataFrame:
    """(flag) as text, one row each, for a report."""
    return p.select("field", F.explode("flags").alias("flag")).select(F.concat_ws(": ", "flag", "field").alias("flag"))


def overall_null_rate(p: DataFrame) -> DataFrame:
    return p.agg((F.sum("n_null") / F.sum("n")).alias("null_rate"))


def report(p: DataFrame) -> str:
    lines = [f"{'field':<28} {'kind':<8} {'nulls':>8} {'distinct':>10}  flags"]
    lines += [f"{r['field']:<28} {r['kind']:<8} {r['null_rate']:>8.2%} {r['n_distinct'] if r['n_distinct'] is not None else '-':>10}  {', '.join(r['flags'])}" for r in p.collect()]  # a row per column
    return "\n".join(lines)
