"""Spark session with the settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "plumbline", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    b = b.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    # the JVM does not compile methods of over 8000 bytes, which many checks in one stage come to; past that Spark splits them
    b = b.config("spark.sql.codegen.hugeMethodLimit", "8000")
    b = b.config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
