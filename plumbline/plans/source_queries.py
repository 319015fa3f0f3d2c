"""Queries of sources: parsing, routing, serialisation, injection, replay."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.context import lineage, lineage_defaults
from ..functions.scalars import serialised, surrogate_id
from ..sources import inject as inj
from ..sources import readers
from ..sources.readers import star
from .fixtures import EVENTS, TRIPS, events, trips
from .base import query

MESSAGE = "CASE WHEN event_id % 25 = 0 THEN '{broken' WHEN event_id % 25 = 1 THEN NULL ELSE '{\"k\": ' || event_id || ', \"kind\": \"' || event_type || '\", \"pos\": {\"lat\": ' || (event_id % 90) || '}}' END"


def _messages(spark, sf_dir):
    k = F.col("event_id")
    text = F.concat(F.lit('{"k": '), k.cast("string"), F.lit(', "kind": "'), F.col("event_type"), F.lit('", "pos": {"lat": '), (k % 90).cast("string"), F.lit("}}"))
    return star(spark, sf_dir, "events").select("event_id", F.when(k % 25 == 0, "{broken").when(k % 25 == 1, None).otherwise(text).alias("value"), F.when(k % 3 == 0, "trips").when(k % 3 == 1, "vehicles").otherwise("other").alias("topic"), (k % 8).cast("int").alias("partition"), (k / 8).cast("long").alias("offset"))


@query("json_parse", f"WITH m AS (SELECT event_id, {MESSAGE} AS v FROM events) SELECT event_id, CASE WHEN v IS NOT NULL AND v <> '{{broken' THEN event_id END AS k, CASE WHEN v = '{{broken' THEN v END AS malformed FROM m")
def json_parse(spark, sf_dir):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("kind", T.StringType())])
    p = readers.parsed(_messages(spark, sf_dir), schema, keep=("event_id",))
    return p.select("event_id", "k", F.col("_malformed").alias("malformed"))


@query("json_paths", f"WITH m AS (SELECT event_id, event_type, {MESSAGE} AS v FROM events) SELECT CASE WHEN v IS NOT NULL AND v <> '{{broken' THEN event_type END AS kind, CASE WHEN v IS NOT NULL AND v <> '{{broken' THEN CAST(event_id % 90 AS VARCHAR) END AS lat, count(*) AS n FROM m GROUP BY ALL")
def json_paths(spark, sf_dir):
    m = _messages(spark, sf_dir)
    return m.select(*readers.json_paths(F.col("value"), {"kind": "$.kind", "lat": "$.pos.lat"})).groupBy("kind", "lat").agg(F.count(F.lit(1)).alias("n"))


@query("json_props", "SELECT user_id, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY user_id")
def json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return star(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(k).alias("k"), F.count(F.lit(1)).alias("n"))


@query("topic_routing", "SELECT CASE event_id % 3 WHEN 0 THEN 'nyc_taxi' WHEN 1 THEN 'gtfs' ELSE 'unknown' END AS entity_type, count(*) AS n FROM events GROUP BY 1")
def topic_routing(spark, sf_dir):
    return readers.routed(_messages(spark, sf_dir), {"trips": "nyc_taxi", "vehicles": "gtfs"}).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


@query("surrogate_ids", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 't' || event_id ELSE (event_id % 8) || '-' || CAST(floor(event_id / 8) AS BIGINT) END AS trip_id FROM events")
def surrogate_ids(spark, sf_dir):
    m = _messages(spark, sf_dir)
    own = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("t"), F.col("event_id").cast("string")))
    return m.select("event_id", surrogate_id(own, F.col("partition"), F.floor(F.col("event_id") / 8)).alias("trip_id"))


@query("serialisation", f"WITH {EVENTS} SELECT CASE WHEN value_raw IS NULL THEN NULL WHEN value_raw = 'NaN' THEN 'NaN' WHEN value_raw = 'abc' THEN 'abc' ELSE 'number' END AS v, count(*) AS n FROM ev GROUP BY 1")
def serialisation(spark, sf_dir):
    v = serialised(F.when(F.col("value_raw") == "NaN", F.lit("NaN")).otherwise(F.col("value_raw")))
    v = F.when(v.isin("NaN", "abc") | v.isNull(), v).otherwise("number")
    return events(spark, sf_dir).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n"))


@query("message_json", "SELECT event_id, '{\"event_id\":' || event_id || ',\"v\":\"' || CASE WHEN event_id % 50 = 1 THEN 'NaN' ELSE CAST(CAST(event_id % 7 AS DOUBLE) AS VARCHAR) END || '\"}' AS message FROM events")
def message_json(spark, sf_dir):
    d = star(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 50 == 1, F.lit(float("nan"))).otherwise((F.col("event_id") % 7).cast("double")).alias("v"))
    return d.select("event_id", readers.message_json(d).alias("message"))


KIND = "(CASE WHEN n % 100 < 5 THEN ['fare_negative', 'fare_outlier', 'location_invalid', 'duration_negative', 'duration_outlier', 'timestamp_future', 'speed_outlier', 'duplicate'][CAST(floor(n / 100) AS BIGINT) % 8 + 1] END)"
SPREAD = "(CAST(n * 7919 % 1000 AS DOUBLE) / CAST(1000.0 AS DOUBLE))"
INJECTED = f"""i0 AS (SELECT *, {KIND} AS kind FROM trips), ij AS (SELECT n, kind AS anomaly_type,
  CASE kind WHEN 'fare_negative' THEN round_even(-50.0 + {SPREAD} * 47.5, 2) WHEN 'fare_outlier' THEN round_even(500.0 + {SPREAD} * 1500.0, 2) ELSE fare END AS fare,
  CASE kind WHEN 'location_invalid' THEN 9999 + n * 104729 % 90001 ELSE pu END AS location, CASE kind WHEN 'speed_outlier' THEN 100.0 ELSE distance END AS distance,
  CASE kind WHEN 'duration_negative' THEN pickup - INTERVAL 30 MINUTE WHEN 'duration_outlier' THEN pickup + INTERVAL 30 HOUR WHEN 'speed_outlier' THEN pickup + INTERVAL 30 MINUTE ELSE dropoff END AS dropoff,
  CASE kind WHEN 'duration_negative' THEN pickup + INTERVAL 1 HOUR WHEN 'timestamp_future' THEN TIMESTAMP '2024-01-08 00:00:00' ELSE pickup END AS pickup,
  unnest(range(1, CASE WHEN kind = 'duplicate' THEN 3 ELSE 2 END)) AS copy FROM i0)"""


@query("injection", f"WITH {TRIPS}, {INJECTED} SELECT anomaly_type, count(*) AS n, round(sum(fare), 2) AS fare, CAST(sum(location) AS BIGINT) AS location, round(sum(distance), 2) AS distance, CAST(sum(CAST((epoch_us(dropoff) - epoch_us(pickup)) / 1000000 AS BIGINT)) AS BIGINT) AS seconds FROM ij GROUP BY 1")
def injection(spark, sf_dir):
    t = trips(spark, sf_dir).withColumns({"total": F.col("fare"), "location": F.col("pu")})
    d = inj.inject(t, "n")
    s = ((F.unix_micros("dropoff") - F.unix_micros("pickup")) / 1_000_000).cast("long")
    return d.groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("fare"), 2).alias("fare"), F.sum("location").cast("long").alias("location"), F.round(F.sum("distance"), 2).alias("distance"), F.sum(s).alias("seconds"))


@query("degrading", "SELECT how, count(*) FILTER (WHERE hit) AS n, round(sum(CASE WHEN NOT hit THEN value WHEN how = 'multiply' THEN value * 10 WHEN how = 'shift' THEN value + 10 WHEN how = 'replace' THEN 10 WHEN how = 'noise' THEN value + (CAST(event_id * 7919 % 2001 AS DOUBLE) / 1000.0 - 1.0) * 10 END), 1) AS total FROM (SELECT *, (event_id * 31 + 7) % 100 < 5 AS hit FROM events), (VALUES ('null'), ('multiply'), ('shift'), ('noise'), ('replace')) h(how) GROUP BY how")
def degrading(spark, sf_dir):
    out = None
    for how in ("null", "multiply", "shift", "noise", "replace"):
        d = inj.degrade(star(spark, sf_dir, "events"), "value", "event_id", how)
        row = d.agg(F.count_if("degraded").alias("n"), F.round(F.sum("value"), 1).alias("total")).select(F.lit(how).alias("how"), "n", "total")
        out = row if out is None else out.unionByName(row)
    return out


@query("lineage_added", "SELECT 'replay_001' AS source_id, 'replay' AS source_type, true AS is_replay, CAST(event_id % 4 AS VARCHAR) AS batch_id, count(*) AS n, max(event_id) AS last FROM events GROUP BY ALL")
def lineage_added(spark, sf_dir):
    e = star(spark, sf_dir, "events")
    e = e.withColumn("_lineage", lineage_defaults(lineage("replay_001", "replay", True, F.col("event_id") % 4, F.col("event_id"), F.col("event_id"))))
    return e.groupBy("_lineage.source_id", "_lineage.source_type", "_lineage.is_replay", "_lineage.batch_id").agg(F.count(F.lit(1)).alias("n"), F.max("_lineage.kafka_offset").alias("last"))


@query("replay_order", "SELECT event_id, event_type FROM events")
def replay_order(spark, sf_dir):
    return readers.replayed(star(spark, sf_dir, "events").select("event_id", "event_type"), seed=7)


@query("parquet_scan", "SELECT count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01 00:00:00'")
def parquet_scan(spark, sf_dir):
    d = readers.parquet(spark, f"{sf_dir}/lineitem.parquet")
    return d.where(F.col("l_shipdate") < F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))
