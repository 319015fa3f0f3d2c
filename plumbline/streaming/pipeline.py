"""The streaming pipeline: parse, check, keep findings, quality events; sinks and metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.finding import Check, findings

REQUIRED = ("rule_id",)


def checked(stream: DataFrame, checks: Sequence[Check], keep: Sequence[str]) -> DataFrame:
    """Findings of a stream or a batch alike: stateless checks need no state."""
    return findings(stream, checks, keep)


def windowed_quality(stream: DataFrame, ts: str, bad: Column, late: str = "60 seconds", width: str = "5 minutes", slide: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Counts of events and bad events per event-time window, given out when the watermark has passed it."""
    win = F.window(ts, width, slide) if slide else F.window(ts, width)
    g = stream.withWatermark(ts, late).groupBy(win.alias("w"), *by).agg(F.count(F.lit(1)).alias("events"), F.count_if(bad).alias("violations"))
    return g.select(F.col("w.start").alias("window_start"), *by, "events", "violations", (F.col("violations") / F.col("events")).alias("rate"))


def to_parquet(stream: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = (), once: bool = False) -> StreamingQuery:
    w = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    w = w.partitionBy(*partition_by) if partition_by else w
    return (w.trigger(availableNow=True) if once else w).start()


def to_kafka(stream: DataFrame, servers: str, topic: str, checkpoint: str, key: str | None = None) -> StreamingQuery:
    out = stream.select(*([F.col(key).cast("string").alias("key")] if key else []), F.to_json(F.struct("*")).alias("value"))
    return out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).outputMode("append").start()


def to_jdbc(stream: DataFrame, url: str, name: str, checkpoint: str, properties: dict[str, str] | None = None) -> StreamingQuery:
    """Each micro-batch is appended by the executors; nothing is collected."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.jdbc(url, name, mode="append", properties=properties or {})

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def in_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def valid_findings(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with all required fields, the others)."""
    ok = F.lit(True)
    for c in REQUIRED:
        ok = ok & F.col(c).isNotNull()
    return found.where(ok), found.where(~ok)


class FindingStore:
    """Findings as a Parquet table partitioned by rule, with the queries of a store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.schema = spark, path, None

    def append(self, found: DataFrame) -> None:
        good, _ = valid_findings(found)
        good.write.mode("append").partitionBy("rule_id").parquet(self.path)
        self.schema = good.schema

    def read(self) -> DataFrame:
        reader = self.spark.read if self.schema is None else self.spark.read.schema(self.schema)  # a store without rows tells no schema
        return reader.parquet(self.path)

    def read_run(self, run: str) -> DataFrame:
        """The findings that were appended with this mark in their column run; none if there were none."""
        return self.read().where(F.col("run") == run)

    def query(self, limit: int = 1000, **where: str) -> DataFrame:
        d = self.read()
        for k, v in where.items():
            d = d.where(F.col(k) == v)
        return d.limit(limit)

    def count(self) -> int:
        return self.read().count()

    def summary(self) -> DataFrame:
        from ..operators.reports import summary

        return summary(self.read())


class Metrics(StreamingQueryListener):
    """Counters of all queries of a session, from their progress: rows in, batches, milliseconds, rows too late."""

    def __init__(self):
        self.totals: dict[str, dict[str, float]] = {}
        self.durations: dict[str, list[float]] = {}
        self.errors: list[str] = []

    def onQueryStarted(self, event) -> None:
        self.totals[str(event.runId)] = {"rows": 0, "batches": 0, "late": 0}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        t = self.totals.setdefault(str(p.runId), {"rows": 0, "batches": 0, "late": 0})
        t["rows"] += p.numInputRows
        t["batches"] += 1
        t["late"] += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        d = self.durations.setdefault(str(p.runId), [])
        d.append(float(p.batchDuration))
        del d[:-1000]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.errors.append(event.exception)

    def exposition(self) -> str:
        """Prometheus text of the totals."""
        lines = []
        for name in ("rows", "batches", "late"):
            lines.append(f"# TYPE plumbline_{name}_total counter")
            lines += [f'plumbline_{name}_total{{run="{run}"}} {t[name]:g}' for run, t in self.totals.items()]
        return "\n".join(lines) + "\n"


def run_to_end(query: StreamingQuery) -> None:
    """Waits for a query that was started to take what is there, and stops it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()
