"""Schemas of the record kinds: taxi trips, vehicle positions, lineage, findings."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in pairs])


S, D, I, L, B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()

LINEAGE = _fields(
    ("source_id", S), ("source_type", S), ("is_replay", B), ("batch_id", S), ("kafka_offset", L), ("kafka_partition", I),
    ("producer_timestamp", S), ("ingestion_timestamp", S), ("hop_count", I), ("upstream_event_ids", T.ArrayType(S)), ("entity_index", S),
)

#: Raw strings stand where a check tells null, NaN, "NaN" and a wrong type apart.
TAXI = _fields(
    ("trip_id", S), ("VendorID", I), ("tpep_pickup_datetime", S), ("tpep_dropoff_datetime", S), ("passenger_count", D), ("trip_distance", S),
    ("RatecodeID", D), ("store_and_fwd_flag", S), ("PULocationID", S), ("DOLocationID", S), ("payment_type", I), ("fare_amount", S), ("extra", D),
    ("mta_tax", D), ("tip_amount", D), ("tolls_amount", D), ("improvement_surcharge", D), ("total_amount", D), ("congestion_surcharge", D),
    ("airport_fee", D), ("kafka_arrival_ms", D), ("entity_type", S), ("_lineage", LINEAGE),
)

VEHICLE = _fields(
    ("vehicle_id", S), ("label", S), ("latitude", D), ("longitude", D), ("bearing", D), ("speed", D), ("route_id", S), ("trip_id", S),
    ("direction_id", I), ("stop_id", S), ("timestamp", S), ("timestamp_iso", S), ("event_time", S), ("_agency", S), ("_lineage", LINEAGE),
)

FINDING = _fields(
    ("rule_id", S), ("rule_name", S), ("entity_id", S), ("entity_type", S), ("severity", S), ("violation_type", S), ("details", S),
    ("expected", S), ("record_snapshot", S), ("detected_at", T.TimestampType()), ("processing_latency_ms", D), ("entity_index", S),
)
