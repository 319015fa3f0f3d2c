"""Queries that run as streams to their end and give what they wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import taxi_checks
from ..operators.finding import findings
from ..sources.readers import file_stream, instants, star
from ..streaming import pipeline, stateful
from .cross_record import CONFIDENCE, MOVES, SEVERITY, _anchors
from .fixtures import EVENTS
from .base import query

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _folder(spark) -> str:
    """A new folder in the place that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _events(spark, sf_dir) -> DataFrame:
    """The events table as a stream of its files; a pattern, as a stream does not take the path of a single file."""
    return instants(file_stream(spark, f"{sf_dir}/event[s].parquet", spark.read.parquet(f"{sf_dir}/events.parquet").schema))


def _written(spark, stream: DataFrame, timers: bool = False) -> DataFrame:
    """What the stream writes until its source is read.

    timers: its state expires by the clock.  Such a query would go on with batches without
    data for ever, so they are switched off while it starts.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before, out = spark.conf.get(name), _folder(spark)
    spark.conf.set(name, str(not timers).lower())
    try:
        q = pipeline.to_parquet(stream, f"{out}/data", f"{out}/checkpoint", once=True)
    finally:
        spark.conf.set(name, before)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


@query("stream_findings", f"WITH {EVENTS} SELECT event_id, CASE WHEN value > 400 THEN 'OUT_OF_CONTEXTUAL_RANGE' ELSE 'OUT_OF_CONTEXTUAL_RANGE' END AS reason FROM ev WHERE value < 2.5 OR value > 400")
def stream_findings(spark, sf_dir):
    check = taxi_checks.fare_range(F.col("value"), F.lit(2.5), F.lit(400.0))
    return _written(spark, findings(_events(spark, sf_dir), [check], ["event_id"])).select("event_id", "reason")


#: A window is given out when the watermark, the last time less a minute, has passed its end.
@query("stream_quality_windows", "WITH w AS (SELECT CAST(floor(epoch(ts) / 300) AS BIGINT) * 300 AS window_start, count(*) AS events, count(*) FILTER (WHERE value > 60) AS violations FROM events GROUP BY 1) SELECT * FROM w WHERE window_start + 300 <= (SELECT floor(epoch(max(ts))) - 60 FROM events)")
def stream_quality_windows(spark, sf_dir):
    w = pipeline.windowed_quality(_events(spark, sf_dir), "ts", F.col("value") > 60)
    return _written(spark, w).select(F.unix_seconds("window_start").alias("window_start"), "events", "violations")


@query("stream_sliding_windows", "WITH s AS (SELECT unnest(range(5)) AS k), w AS (SELECT (CAST(floor(epoch(ts) / 60) AS BIGINT) - k) * 60 AS window_start, event_type, count(*) AS events, count(*) FILTER (WHERE value > 60) AS violations FROM events, s GROUP BY ALL) SELECT * FROM w WHERE window_start + 300 <= (SELECT floor(epoch(max(ts))) - 60 FROM events)")
def stream_sliding_windows(spark, sf_dir):
    w = pipeline.windowed_quality(_events(spark, sf_dir), "ts", F.col("value") > 60, slide="1 minute", by=["event_type"])
    return _written(spark, w).select(F.unix_seconds("window_start").alias("window_start"), "event_type", "events", "violations")


@query("stream_deduplicated", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, CAST(floor(value) AS BIGINT) FROM events) GROUP BY ALL")
def stream_deduplicated(spark, sf_dir):
    from ..sources.readers import deduplicated

    d = _events(spark, sf_dir).withColumn("v", F.floor("value"))
    out = _written(spark, deduplicated(d, "ts", ["user_id", "event_type", "v"], "90 days"))
    return out.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("stream_motion", f"""WITH {MOVES}, s AS (SELECT *, m / dt * 3.6 AS kmh FROM mv WHERE dt > 0)
  SELECT event_id AS arrival, 'CRS001' AS rule_id, 'HIGH' AS severity FROM s WHERE kmh > 160
  UNION ALL SELECT event_id, 'CRS002', CASE WHEN kmh < 1 THEN 'CRITICAL' WHEN kmh < 20 THEN 'HIGH' ELSE 'MEDIUM' END FROM s WHERE m > 100 AND kmh < 40""")
def stream_motion(spark, sf_dir):
    k = F.col("event_id")
    vehicle = F.when(k % 80 == 0, None).when(k % 80 == 1, "  ").otherwise(F.col("user_id").cast("string"))
    d = _events(spark, sf_dir).select(vehicle.alias("vehicle_id"), k.alias("arrival"), (F.unix_micros("ts") / 1_000_000.0).alias("t"), (F.lit(40.0) + (k * 7919 % 1000) / 1000.0).alias("latitude"), (F.lit(-74.0) + (k * 104729 % 1000) / 1000.0).alias("longitude"))
    d = d.where(F.col("vehicle_id").isNotNull() & (F.trim("vehicle_id") != ""))
    return _written(spark, stateful.motion(d), timers=True).select("arrival", "rule_id", "severity")


@query("stream_duplicates", f"""WITH RECURSIVE {CONFIDENCE}, k AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY us, event_id) AS i FROM cf WHERE confidence > 0.4),
  g AS (SELECT fingerprint, i, event_id, confidence, us AS anchor, true AS opens FROM k WHERE i = 1
    UNION ALL SELECT k.fingerprint, k.i, k.event_id, k.confidence, CASE WHEN k.us - g.anchor >= 10000000 THEN k.us ELSE g.anchor END, k.us - g.anchor >= 10000000 FROM g JOIN k ON k.fingerprint = g.fingerprint AND k.i = g.i + 1)
  SELECT event_id AS arrival, round(confidence, 6) AS confidence, CASE WHEN confidence > 0.7 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM g WHERE opens""")
def stream_duplicates(spark, sf_dir):
    k = F.col("event_id")
    d = _events(spark, sf_dir).where(k % 10 != 0)  # replayed events are never duplicates
    d = d.select(F.md5(F.concat_ws("|", F.col("user_id").cast("string"), "event_type")).alias("fingerprint"), k.alias("arrival"), (F.unix_micros("ts") / 1_000_000.0).alias("t"), F.col("event_type").alias("source"), (k % 4).cast("string").alias("batch"))
    return _written(spark, stateful.duplicates(d), timers=True).select("arrival", F.round("confidence", 6).alias("confidence"), "severity")


@query("stream_alert_suppression", _anchors("event_type || '|' || (user_id % 7)", 300000000, f"{SEVERITY} IN ('MEDIUM', 'HIGH', 'CRITICAL')") + " SELECT event_id AS arrival FROM g WHERE opens")
def stream_alert_suppression(spark, sf_dir):
    k = F.col("event_id")
    d = _events(spark, sf_dir).where((k % 5).isin(1, 2, 3))  # severities of MEDIUM and more
    d = d.select(F.concat_ws("|", "event_type", (F.col("user_id") % 7).cast("string")).alias("alert_key"), k.alias("arrival"), (F.unix_micros("ts") / 1_000_000.0).alias("t"))
    return _written(spark, stateful.suppressed_alerts(d), timers=True).select("arrival")


@query("store_summary", f"WITH fd AS (SELECT event_type AS rule_id, {SEVERITY} AS severity, 'T' AS violation_type FROM events WHERE value > 60 AND event_id % 17 <> 0) SELECT 'rule_id' AS dimension, rule_id AS key, count(*) AS n FROM fd GROUP BY rule_id UNION ALL SELECT 'severity', severity, count(*) FROM fd GROUP BY severity UNION ALL SELECT 'violation_type', violation_type, count(*) FROM fd GROUP BY 2 UNION ALL SELECT 'total', 'total', count(*) FROM fd")
def store_summary(spark, sf_dir):
    from .cross_record import alerting

    k = F.col("event_id")
    found = alerting(spark, sf_dir).join(star(spark, sf_dir, "events").where("value > 60").select("event_id"), "event_id", "left_semi")
    # rows without a rule id are refused by the store
    found = found.select("event_id", F.when(k % 17 != 0, F.col("rule_id")).alias("rule_id"), "severity", F.lit("T").alias("violation_type"))
    store = pipeline.FindingStore(spark, _folder(spark))
    store.append(found)
    return store.summary()
