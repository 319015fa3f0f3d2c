"""Sources behind one interface: a batch or streaming DataFrame of raw records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import cumulative


def parquet(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if max_rows is None else df.limit(max_rows)


def instants(df: DataFrame) -> DataFrame:
    """Timestamps without a zone become instants in the session's zone, which windows and watermarks need."""
    return df.withColumns({f.name: F.col(f"`{f.name}`").cast("timestamp") for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)})


def star(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return instants(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def kafka_stream(spark: SparkSession, servers: str, topics: str, starting: str = "latest", max_per_trigger: int | None = None) -> DataFrame:
    """One or more comma-separated topics.  Needs the Kafka connector on the class path."""
    r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("startingOffsets", starting)
    return (r.option("maxOffsetsPerTrigger", max_per_trigger) if max_per_trigger else r).load()


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).load(path)


def rate_stream(spark: SparkSession, per_second: int) -> DataFrame:
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load()


def parsed(messages: DataFrame, schema: T.StructType, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON values as columns; malformed ones keep their text in _malformed and nulls elsewhere."""
    wide = T.StructType([*schema.fields, T.StructField("_malformed", T.StringType())])
    text = F.col(value).cast("string")
    p = messages.select(*keep, F.from_json(text, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"}).alias("_j"))
    return p.select(*keep, "_j.*")


def split_malformed(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good records, malformed texts): the ingest guard."""
    return p.where("_malformed IS NULL").drop("_malformed"), p.where("_malformed IS NOT NULL").select("_malformed")


def routed(messages: DataFrame, topics: dict[str, str], topic: str = "topic") -> DataFrame:
    """Adds entity_type by topic; "unknown" for others."""
    kind: Column = F.lit("unknown")
    for name, entity in topics.items():
        kind = F.when(F.col(topic) == name, entity).otherwise(kind)
    return messages.withColumn("entity_type", kind)


def json_paths(value: Column, paths: dict[str, str]) -> list[Column]:
    return [F.get_json_object(value.cast("string"), p).alias(n) for n, p in paths.items()]


def message_json(df: DataFrame) -> Column:
    """A record as JSON text, NaN as "NaN"."""
    from ..functions.scalars import serialised

    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return F.to_json(F.struct(*[(F.when(F.isnan(c), serialised(F.col(c))).otherwise(F.col(c).cast("string")) if c in floats else F.col(c)).alias(c) for c in df.columns]))


def replayed(df: DataFrame, seed: int | None = None) -> DataFrame:
    """The records in a random order that reruns repeat; for streams use file_stream with files_per_trigger."""
    return df if seed is None else df.orderBy(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns]))


def paced(spark: SparkSession, records: DataFrame, order: str, per_second: int, seed: int | None = None) -> DataFrame:
    """A stream of the records, so many a second, in order or in a random order that reruns repeat.

    Records are numbered from 0 and joined with the numbers that the rate source counts up, so
    the pace is the source's and no task holds them all.  Adds arrived, the time of the number.
    """
    at = records if seed is None else records.withColumn("_order", F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in records.columns]))
    numbered = cumulative(at, order if seed is None else "_order", {"_n": F.lit(1)}).withColumn("_n", F.col("_n") - 1)
    ticks = rate_stream(spark, per_second).select(F.col("timestamp").alias("arrived"), F.col("value").alias("_n"))
    return ticks.join(numbered.drop("_order"), "_n").drop("_n")


def deduplicated(stream: DataFrame, ts: str, keys: list[str], late: str = "24 hours") -> DataFrame:
    """Streaming ingest guard: one record per key within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
