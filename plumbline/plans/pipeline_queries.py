"""The whole pipeline over vehicle events, and conditions on windows with silence between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import integrity, reports, stats
from ..pipeline import Pipeline, summary_rows
from ..sources.readers import star
from .base import query
from .cross_record import MOVES
from .fixtures import EVENTS, EVENTS_AS_OF, TRIPS, counted, counted_sql, events, trips

VALUE = "try_cast(value_raw AS DOUBLE)"
T = "CASE WHEN try_cast(ts_raw AS BIGINT) IS NOT NULL THEN make_timestamp(CAST(ts_raw AS BIGINT) * 1000000) ELSE try_cast(replace(ts_raw, 'Z', '') AS TIMESTAMP) END"

#: Each stage's findings on their own: the records' checks, motion from windows, repeats from a recursion.
PIPELINE_SQL = f"""WITH RECURSIVE {MOVES},
  sx AS (SELECT *, m / dt * 3.6 AS kmh FROM mv WHERE dt > 0), tx AS (SELECT *, CASE WHEN dt > 0 THEN m / 1000.0 / (dt / 3600.0) ELSE 0 END AS kmh FROM mv),
  fp AS (SELECT event_id, ts, md5(coalesce(vehicle, 'None') || '|' || coalesce(ts_raw, 'None')) AS fk FROM ev),
  k AS (SELECT event_id, fk AS key, epoch_us(ts) AS us, row_number() OVER (PARTITION BY fk ORDER BY ts, event_id) AS i FROM fp),
  g AS (SELECT key, i, us AS anchor, true AS opens FROM k WHERE i = 1 UNION ALL SELECT k.key, k.i, CASE WHEN k.us - g.anchor >= 300000001 THEN k.us ELSE g.anchor END, k.us - g.anchor >= 300000001 FROM g JOIN k ON k.key = g.key AND k.i = g.i + 1),
  r AS (
    SELECT 'GTFSSyn001' AS rule_id, 'HIGH' AS severity, 'SYNTAX' AS violation_type FROM ev WHERE vehicle IS NULL OR trim(vehicle) = ''
    UNION ALL SELECT 'GTFSSyn003', 'HIGH', 'SYNTAX' FROM ev WHERE value_raw IS NOT NULL AND ({VALUE} IS NULL OR {VALUE} < 0 OR ({VALUE} > 300 AND value_raw <> 'NaN'))
    UNION ALL SELECT 'GTFSSem001', 'CRITICAL', 'SEMANTIC' FROM ev WHERE {VALUE} > 200 AND value_raw <> 'NaN'
    UNION ALL SELECT 'GTFSSem002', 'MEDIUM', 'SEMANTIC' FROM (SELECT ts_raw, {T} AS t FROM ev) WHERE ts_raw IS NOT NULL AND (t IS NULL OR epoch_us(TIMESTAMP '{EVENTS_AS_OF}') - epoch_us(t) > 300000000)
    UNION ALL SELECT 'CRS001', 'HIGH', 'CROSS_RECORD' FROM sx WHERE kmh > 160
    UNION ALL SELECT 'CRS002', CASE WHEN kmh < 1 THEN 'CRITICAL' WHEN kmh < 20 THEN 'HIGH' ELSE 'MEDIUM' END, 'CROSS_RECORD' FROM sx WHERE m > 100 AND kmh < 40
    UNION ALL SELECT 'GTFSCRS001', CASE WHEN NOT (dt <= 0 AND m > 1000) AND kmh <= 200 THEN 'HIGH' ELSE 'CRITICAL' END, 'CROSS_RECORD' FROM tx WHERE (dt <= 0 AND m > 1000) OR kmh > 120
    UNION ALL SELECT 'GTFSCRS002', 'MEDIUM', 'CROSS_RECORD' FROM g WHERE NOT opens)
  SELECT 'rule_id' AS dimension, rule_id AS key, count(*) AS n FROM r GROUP BY rule_id UNION ALL SELECT 'severity', severity, count(*) FROM r GROUP BY severity
  UNION ALL SELECT 'violation_type', violation_type, count(*) FROM r GROUP BY violation_type UNION ALL SELECT 'total', 'total', count(*) FROM r
  UNION ALL SELECT 'events', 'total', count(*) FROM events UNION ALL SELECT 'stage', 'monitoring', 1"""


@query("pipeline_run", PIPELINE_SQL)
def pipeline_run(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", F.col("vehicle").alias("vehicle_id"), "latitude", "longitude", F.col("value_raw").alias("speed"), F.col("ts_raw").alias("timestamp"), "ts")
    from dataclasses import replace

    from ..pipeline import ENTITIES

    entity = replace(ENTITIES["gtfs"], fingerprint=("vehicle_id", "timestamp"))
    line = Pipeline(spark, entity, F.lit(EVENTS_AS_OF).cast("timestamp"), order="event_id", arrived="ts")
    return summary_rows(line.process(e))


SPARSE = "sp AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, count(*) AS events, count(*) FILTER (WHERE value > 60) AS violations FROM events WHERE event_type = 'error' AND user_id % 11 = 0 GROUP BY 1)"


@query("silent_windows", f"""WITH {SPARSE}, sn AS (SELECT unnest(range((SELECT min(hour) FROM sp), (SELECT max(hour) FROM sp) + 1)) AS hour), w AS (SELECT sn.hour, coalesce(events, 0) AS events, coalesce(violations, 0) AS violations FROM sn LEFT JOIN sp ON sp.hour = sn.hour)
  SELECT hour, 'no_events' AS condition FROM w WHERE events = 0
  UNION ALL SELECT hour, 'no_violations' FROM (SELECT hour, max(violations) OVER (ORDER BY hour ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS most, count(*) OVER (ORDER BY hour ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS n FROM w) WHERE most = 0 AND n = 15""")
def silent_windows(spark, sf_dir):
    e = star(spark, sf_dir, "events").where("event_type = 'error' AND user_id % 11 = 0")
    w = e.groupBy(F.floor(F.unix_seconds("ts") / 3600).alias("hour")).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("value") > 60).alias("violations"))
    return reports.conditions(w, "hour", minutes_per_window=2, names=["no_events", "no_violations"])


@query("sustained_with_gaps", f"""WITH {SPARSE}, h AS (SELECT hour, violations > 0 AS f FROM sp)
  SELECT hour, f AND EXISTS (SELECT 1 FROM h b WHERE b.hour = a.hour - 1 AND b.f) AND EXISTS (SELECT 1 FROM h c WHERE c.hour = a.hour - 2 AND c.f) AS firing FROM h a""")
def sustained_with_gaps(spark, sf_dir):
    e = star(spark, sf_dir, "events").where("event_type = 'error' AND user_id % 11 = 0")
    w = e.groupBy(F.floor(F.unix_seconds("ts") / 3600).alias("hour")).agg(F.count_if(F.col("value") > 60).alias("violations"))
    return reports.sustained(w, F.col("violations") > 0, "hour", 3).select("hour", "firing")


@query("ref001_numbers", counted_sql(TRIPS, ("REF001", "'MEDIUM'", "CASE WHEN NOT (d >= 1 AND d <= 6 AND d = floor(d)) THEN 'FOREIGN_KEY_NOT_FOUND' END")).replace("FROM trips)", "FROM (SELECT *, (n % 17) * CAST(0.5 AS DOUBLE) AS d FROM trips))", 1))
def ref001_numbers(spark, sf_dir):
    t = trips(spark, sf_dir).withColumn("d", F.col("n") % 17 * 0.5)
    return counted(t, [integrity.in_reference_set(F.col("d"), "RatecodeID")])


@query("holidays", "SELECT CAST(day AS VARCHAR) AS day FROM (VALUES ('2024-01-01'), ('2024-01-15'), ('2024-02-19'), ('2024-05-27'), ('2024-06-19'), ('2024-07-04'), ('2024-09-02'), ('2024-10-14'), ('2024-11-28'), ('2024-12-25'), ('2025-01-01'), ('2025-01-20'), ('2025-02-17'), ('2025-05-26'), ('2025-06-19'), ('2025-07-04'), ('2025-09-01'), ('2025-10-13'), ('2025-11-27'), ('2025-12-25'), ('2026-01-01'), ('2026-01-19'), ('2026-02-16'), ('2026-05-25'), ('2026-06-19'), ('2026-07-03'), ('2026-09-07'), ('2026-10-12'), ('2026-11-26'), ('2026-12-25')) v(day)")
def holidays(spark, sf_dir):
    from ..functions.context import is_holiday

    days = spark.range(0, 3 * 366).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    return days.where(is_holiday(F.col("day").cast("timestamp"))).select(F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("stats_rolling_whole", "SELECT event_id, count(value) OVER w AS roll_count, round(CASE WHEN count(value) OVER w >= 20 THEN avg(value) OVER w END * count(value) OVER w, 2) AS roll_total, round(CASE WHEN count(value) OVER w >= 20 THEN quantile_cont(value, 0.9) OVER w END, 6) AS roll_p90 FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)")
def stats_rolling_whole(spark, sf_dir):
    d = stats.rolling_stats(star(spark, sf_dir, "events"), "value", "event_id", rows=50, min_samples=20)
    return d.select("event_id", "roll_count", F.round(F.col("roll_mean") * F.col("roll_count"), 2).alias("roll_total"), F.round("roll_p90", 6).alias("roll_p90"))
