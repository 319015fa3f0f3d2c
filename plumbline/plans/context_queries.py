"""Queries of contexts, context keys and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import context as ctx
from ..functions.scalars import arrival_latency_ms, fingerprint, haversine_km, haversine_m, joined_key, km_to_mph, parse_time, seconds_between
from ..operators.scoring import feature_columns
from ..sources.readers import star
from .fixtures import EVENTS, TRIPS, context_sql, events, trips
from .base import query

C = context_sql("ts")
ZONES = "zones AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', '{b}')" for i, n, b in ctx.ZONES) + ") z(location_id, zone_name, borough))"
#: A location for an event: mostly one of five known zones, else one that is not mapped.
LOCATION = "(CASE event_id % 6 WHEN 0 THEN 161 WHEN 1 THEN 237 WHEN 2 THEN 132 WHEN 3 THEN 138 WHEN 4 THEN 140 ELSE 200 + user_id % 3 END)"
ZONE_CATEGORY = "(CASE WHEN z.location_id IS NULL THEN 'unknown' WHEN contains(lower(z.zone_name), 'midtown') THEN 'midtown' WHEN contains(lower(z.zone_name), 'airport') THEN 'airport' WHEN z.borough = 'Manhattan' THEN 'manhattan_other' ELSE 'outer' END)"
LOCATED = f"""{ZONES}, loc AS (SELECT event_id, user_id, value, ts, {LOCATION} AS location FROM events),
  le AS (SELECT l.*, coalesce(z.zone_name, 'zone_' || l.location) AS zone_name, coalesce(z.borough, 'unknown') AS borough, {ZONE_CATEGORY} AS zone_category, {C['hour']} AS h, {C['category']} AS b, CASE WHEN {C['weekend']} THEN 'weekend' ELSE 'weekday' END AS w FROM loc l LEFT JOIN zones z ON z.location_id = l.location)"""


def located(spark, sf_dir):
    """Events with a location, its zone, and the time parts of the context."""
    e = star(spark, sf_dir, "events")
    k = F.col("event_id")
    known = F.get(F.array(*[F.lit(i) for i, _, _ in ctx.ZONES]), (k % 6).cast("int"))
    e = e.withColumn("location", F.when(k % 6 == 5, (F.lit(200) + F.col("user_id") % 3).cast("int")).otherwise(known))
    d = ctx.with_zone(e, "location", ctx.zone_table(spark))
    t = ctx.temporal(F.col("ts"))
    return d.withColumn("t", t).withColumns({"h": F.col("t.hour_of_day"), "b": F.col("t.time_category"), "weekend": F.col("t.is_weekend")})


@query("context_external", f"SELECT {C['hour']} AS hour, {C['day']} AS day_of_week, {C['weekend']} AS is_weekend, {C['rush']} AS is_rush_hour, {C['late']} AS is_late_night, strftime(ts, '%Y-%m-%d') IN ({', '.join(repr(d) for d in ctx.us_holidays())}) AS is_holiday, count(*) AS n FROM events GROUP BY ALL")
def context_external(spark, sf_dir):
    e = star(spark, sf_dir, "events").select(ctx.external(F.col("ts"), holidays=ctx.us_holidays()).alias("c"))
    return e.groupBy(*[F.col(f"c.{k}").alias(k) for k in ("hour", "day_of_week", "is_weekend", "is_rush_hour", "is_late_night", "is_holiday")]).agg(F.count(F.lit(1)).alias("n"))


@query("context_temporal", f"SELECT {C['category']} AS time_category, ({C['hour']} BETWEEN 7 AND 10 OR {C['hour']} BETWEEN 16 AND 19) AND {C['day']} < 5 AS is_rush_hour, {C['weekend']} AS is_weekend, count(*) AS n FROM events GROUP BY ALL")
def context_temporal(spark, sf_dir):
    e = star(spark, sf_dir, "events").select(ctx.temporal(F.col("ts")).alias("c"))
    return e.groupBy("c.time_category", "c.is_rush_hour", "c.is_weekend").agg(F.count(F.lit(1)).alias("n"))


@query("context_six_categories", f"SELECT CASE WHEN {C['hour']} BETWEEN 5 AND 6 THEN 'early_morning' WHEN {C['hour']} BETWEEN 7 AND 9 THEN 'morning_rush' WHEN {C['hour']} BETWEEN 10 AND 15 THEN 'midday' WHEN {C['hour']} BETWEEN 16 AND 19 THEN 'evening_rush' WHEN {C['hour']} BETWEEN 20 AND 22 THEN 'evening' ELSE 'late_night' END AS category, count(*) AS n FROM events GROUP BY 1")
def context_six(spark, sf_dir):
    return star(spark, sf_dir, "events").groupBy(ctx.time_category_six(F.hour("ts")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("context_spatial", f"WITH {LOCATED} SELECT location, zone_name, borough, zone_category, count(*) AS n FROM le GROUP BY ALL")
def context_spatial(spark, sf_dir):
    return located(spark, sf_dir).groupBy("location", "zone_name", "borough", "zone_category").agg(F.count(F.lit(1)).alias("n"))


@query("context_keys", f"""WITH {LOCATED}, k AS (
  SELECT 0 AS level, 'hour_' || h || '_' || zone_category || '_' || w AS key, 1.0::DOUBLE AS confidence FROM le UNION ALL SELECT 1, b || '_' || zone_category || '_' || w, 0.9::DOUBLE FROM le
  UNION ALL SELECT 2, b || '_' || borough || '_' || w, 0.8::DOUBLE FROM le UNION ALL SELECT 3, b, 0.7::DOUBLE FROM le UNION ALL SELECT 4, 'global', 0.5::DOUBLE FROM le)
  SELECT level, key, confidence, count(*) AS n FROM k GROUP BY ALL""")
def context_keys(spark, sf_dir):
    d = located(spark, sf_dir)
    keys = ctx.context_keys(F.col("h"), F.col("b"), F.col("zone_category"), F.col("borough"), F.col("weekend"))
    return d.select(F.explode(keys).alias("k")).groupBy("k.level", "k.key", "k.confidence").agg(F.count(F.lit(1)).alias("n"))


@query("context_resolved", f"WITH {LOCATED} SELECT b AS time_category, zone_category, CASE WHEN event_id % 4 = 0 THEN 'unknown' ELSE 'src' || user_id % 3 END AS source_id, event_id % 5 = 0 AS is_replay, 'SILVER' AS contract_tier, count(*) AS n FROM le GROUP BY ALL")
def context_resolved(spark, sf_dir):
    d = located(spark, sf_dir)
    none = F.lit(None).cast("string")
    line = F.struct(F.when(F.col("event_id") % 4 == 0, none).otherwise(F.concat(F.lit("src"), (F.col("user_id") % 3).cast("string"))).alias("source_id"), none.alias("source_type"), (F.col("event_id") % 5 == 0).alias("is_replay"))
    d = d.withColumn("s", ctx.source_context(line, tier=F.lit("SILVER")))
    return d.groupBy(F.col("b").alias("time_category"), "zone_category", "s.source_id", "s.is_replay", "s.contract_tier").agg(F.count(F.lit(1)).alias("n"))


@query("lineage_defaults", "SELECT CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE 'feed' END AS source_id, event_id % 3 <> 0 AND event_id % 2 = 0 AS is_replay, 0 AS hop_count, 0 AS n_upstream, count(*) AS n FROM events GROUP BY ALL")
def lineage_defaults(spark, sf_dir):
    e = star(spark, sf_dir, "events")
    full = ctx.lineage("feed", "file", True, F.lit("b1"), F.col("event_id"), F.col("event_id"))
    line = F.when(F.col("event_id") % 3 != 0, full.withField("is_replay", F.col("event_id") % 2 == 0))
    e = e.select(ctx.lineage_defaults(line).alias("l"))
    return e.groupBy("l.source_id", "l.is_replay", "l.hop_count", F.size("l.upstream_event_ids").alias("n_upstream")).agg(F.count(F.lit(1)).alias("n"))


@query("fingerprints", f"WITH {EVENTS} SELECT event_id, md5(event_id || '|' || coalesce(vehicle, 'None') || '|' || event_type || '|' || coalesce(value_raw, 'None')) AS fp FROM ev")
def fingerprints(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("event_id", fingerprint(F.col("event_id"), F.col("vehicle"), F.col("event_type"), F.col("value_raw")).alias("fp"))


@query("dedup_keys", f"WITH {EVENTS} SELECT coalesce(vehicle, '') || ':' || event_type || ':' || batch AS k, count(*) AS n FROM ev GROUP BY 1 HAVING count(*) > 1")
def dedup_keys(spark, sf_dir):
    return events(spark, sf_dir).groupBy(joined_key(F.col("vehicle"), F.col("event_type"), F.col("batch")).alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("haversine_both", f"""WITH {EVENTS}, a AS (SELECT event_type, pow(sin(radians(latitude - 40.0) / 2), 2) + cos(radians(40.0)) * cos(radians(latitude)) * pow(sin(radians(longitude + 74.0) / 2), 2) AS a FROM ev)
  SELECT event_type, round(avg(2 * 6371000.0 * asin(sqrt(a))), 3) AS metres, round(avg(2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a))), 6) AS km, round(avg(2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a))) * 0.621371, 6) AS miles FROM a GROUP BY 1""")
def haversine_both(spark, sf_dir):
    e = events(spark, sf_dir)
    args = (F.lit(40.0), F.lit(-74.0), F.col("latitude"), F.col("longitude"))
    return e.groupBy("event_type").agg(F.round(F.avg(haversine_m(*args)), 3).alias("metres"), F.round(F.avg(haversine_km(*args)), 6).alias("km"), F.round(km_to_mph(F.avg(haversine_km(*args))), 6).alias("miles"))


@query("time_parsing", f"WITH {EVENTS} SELECT ts_raw IS NULL AS was_null, coalesce(try_cast(replace(ts_raw, 'Z', '') AS TIMESTAMP) IS NOT NULL AND NOT regexp_full_match(ts_raw, '[0-9]+'), false) AS parsed, count(*) AS n FROM ev GROUP BY ALL")
def time_parsing(spark, sf_dir):
    digits = F.coalesce(F.col("ts_raw").rlike("^[0-9]+$"), F.lit(False))
    p = parse_time(F.col("ts_raw")).isNotNull() & ~digits
    return events(spark, sf_dir).groupBy(F.col("ts_raw").isNull().alias("was_null"), p.alias("parsed")).agg(F.count(F.lit(1)).alias("n"))


@query("durations", f"WITH {TRIPS} SELECT flag, CAST(sum(CAST((epoch_us(dropoff) - epoch_us(pickup)) / 1000000 AS BIGINT)) AS BIGINT) AS seconds, count(*) AS n FROM trips GROUP BY flag")
def durations(spark, sf_dir):
    return trips(spark, sf_dir).groupBy("flag").agg(F.sum(seconds_between(F.col("pickup"), F.col("dropoff")).cast("long")).alias("seconds"), F.count(F.lit(1)).alias("n"))


@query("model_features", f"WITH {TRIPS}, c AS (SELECT hour(pickup) AS hour, floor(pu / 10.0) AS pickup_region, round(fare / greatest(distance, 0.01), 4) AS fare_per_mile, fare / greatest(CAST(passengers AS DOUBLE), 1.0) AS fpp, pu = dropoff_zone AS same FROM trips) SELECT CAST(hour AS BIGINT) AS hour, CAST(pickup_region AS BIGINT) AS pickup_region, round(sum(fare_per_mile), 1) AS fare_per_mile, round(sum(fpp), 1) AS fare_per_passenger, count(*) FILTER (WHERE same) AS same_zone, count(*) AS n FROM c GROUP BY ALL")
def model_features(spark, sf_dir):
    zero = F.lit(0.0)
    f = feature_columns(ctx.external(F.col("pickup")), F.col("fare"), F.col("distance"), F.col("passengers").cast("double"), F.col("pu"), F.col("dropoff_zone"), zero, zero, zero, zero)
    d = trips(spark, sf_dir).select(*[c.alias(k) for k, c in f.items()])
    return d.groupBy(F.col("hour").cast("long").alias("hour"), "pickup_region").agg(F.round(F.sum(F.round("fare_per_mile", 4)), 1).alias("fare_per_mile"), F.round(F.sum("fare_per_passenger"), 1).alias("fare_per_passenger"), F.count_if(F.col("same_zone") == 1).alias("same_zone"), F.count(F.lit(1)).alias("n"))


@query("arrival_latency", "SELECT event_type, max(greatest(epoch_us(TIMESTAMP '2024-01-15 00:00:00') - epoch_us(ts), 0)) AS most, count(*) FILTER (WHERE epoch_us(ts) > epoch_us(TIMESTAMP '2024-01-15 00:00:00')) AS n_zero FROM events GROUP BY 1")
def latency(spark, sf_dir):
    now = F.unix_micros(F.lit("2024-01-15 00:00:00").cast("timestamp"))
    ms = arrival_latency_ms(now, F.unix_micros("ts"))
    return star(spark, sf_dir, "events").groupBy("event_type").agg(F.max(ms).alias("most"), F.count_if(F.unix_micros("ts") > now).alias("n_zero"))
