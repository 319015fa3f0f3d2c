"""Queries of motion checks, duplicates, anchored windows and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts, duplicates, greedy, motion
from ..operators.finding import findings
from .fixtures import EVENTS, events
from .base import query

#: Distance to the vehicle's position before, in metres, and seconds and speed, from windows.
MOVES = f"""{EVENTS}, lg AS (SELECT event_id, vehicle, latitude, longitude, ts, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon, lag(ts) OVER w AS pts FROM ev
    WHERE vehicle IS NOT NULL AND trim(vehicle) <> '' WINDOW w AS (PARTITION BY vehicle ORDER BY event_id)),
  mv AS (SELECT *, 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(latitude - plat) / 2), 2) + cos(radians(plat)) * cos(radians(latitude)) * pow(sin(radians(longitude - plon) / 2), 2)))) AS m,
    CAST(epoch_us(ts) - epoch_us(pts) AS DOUBLE) / 1000000.0 AS dt FROM lg WHERE pts IS NOT NULL)"""


@query("crs001_crs002_motion", f"""WITH {MOVES}, s AS (SELECT *, m / dt * 3.6 AS kmh FROM mv WHERE dt > 0)
  SELECT event_id, 'CRS001' AS rule_id, 'HIGH' AS severity FROM s WHERE kmh > 160
  UNION ALL SELECT event_id, 'CRS002', CASE WHEN kmh < 1 THEN 'CRITICAL' WHEN kmh < 20 THEN 'HIGH' ELSE 'MEDIUM' END FROM s WHERE m > 100 AND kmh < 40""")
def motion_query(spark, sf_dir):
    return motion.motion_findings(events(spark, sf_dir), "vehicle", "event_id", motion.motion_checks(), ["event_id"]).select("event_id", "rule_id", "severity")


@query("gtfs_crs001_motion", f"""WITH {MOVES}, s AS (SELECT *, CASE WHEN dt > 0 THEN m / 1000.0 / (dt / 3600.0) ELSE 0 END AS kmh FROM mv)
  SELECT event_id, CASE WHEN dt <= 0 AND m > 1000 THEN 'GPS_TELEPORT' WHEN kmh > 200 THEN 'IMPOSSIBLE_SPEED' ELSE 'EXCEEDS_REASONABLE' END AS reason, CASE WHEN NOT (dt <= 0 AND m > 1000) AND kmh <= 200 THEN 'HIGH' ELSE 'CRITICAL' END AS severity
  FROM s WHERE (dt <= 0 AND m > 1000) OR kmh > 120""")
def transit_motion(spark, sf_dir):
    d = motion.with_previous(events(spark, sf_dir), "vehicle", "event_id")
    return findings(d, [motion.transit_motion_check()], ["event_id"]).select("event_id", "reason", "severity")


@query("recent_jumps", f"""WITH {EVENTS}, lg AS (SELECT event_id, vehicle, ts, latitude, longitude, lag(ts, 1) OVER w AS t1, lag(latitude, 1) OVER w AS a1, lag(longitude, 1) OVER w AS o1, lag(ts, 2) OVER w AS t2, lag(latitude, 2) OVER w AS a2, lag(longitude, 2) OVER w AS o2, lag(ts, 3) OVER w AS t3, lag(latitude, 3) OVER w AS a3, lag(longitude, 3) OVER w AS o3 FROM ev WINDOW w AS (PARTITION BY vehicle ORDER BY event_id)),
  p AS (SELECT event_id, ts, latitude, longitude, unnest([{{'t': t1, 'a': a1, 'o': o1}}, {{'t': t2, 'a': a2, 'o': o2}}, {{'t': t3, 'a': a3, 'o': o3}}]) AS f FROM lg)
  SELECT DISTINCT event_id FROM p WHERE epoch_us(ts) - epoch_us(f.t) BETWEEN 0 AND 3600000000 AND 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(latitude - f.a) / 2), 2) + cos(radians(f.a)) * cos(radians(latitude)) * pow(sin(radians(longitude - f.o) / 2), 2)))) > 400""")
def recent_jumps(spark, sf_dir):
    return motion.recent_jump(events(spark, sf_dir), "vehicle", "event_id", seconds=3600.0).select("event_id")


#: Confidence of each live event, with prior evidence within the hour; simultaneous events in order of arrival.
CONFIDENCE = f"""{EVENTS}, lv AS (SELECT event_id, fingerprint, ts, epoch_us(ts) AS us, event_type AS source, batch FROM ev WHERE NOT is_replay),
  pr AS (SELECT *, count(*) OVER (PARTITION BY fingerprint ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY fingerprint, us) + row_number() OVER (PARTITION BY fingerprint, us ORDER BY event_id) - 1 AS n_prior,
    CAST(us - lag(us) OVER o AS DOUBLE) / 1000000.0 AS dt, lag(source) OVER o AS ps, lag(batch) OVER o AS pb FROM lv WINDOW o AS (PARTITION BY fingerprint ORDER BY us, event_id)),
  cf AS (SELECT event_id, fingerprint, us, n_prior, CASE WHEN n_prior > 0 THEN least(1.0, greatest(0.0, CAST(0.5 AS DOUBLE) * (CASE WHEN dt <= 5 THEN 1.0 ELSE exp(-dt / 300.0) END) + CAST(0.3 AS DOUBLE) * (CASE WHEN ps = source AND pb = batch THEN 1.0 WHEN ps = source THEN 0.5 ELSE 0.0 END) + CAST(0.2 AS DOUBLE) * (CASE WHEN n_prior >= 2 THEN 1.0 ELSE 0.5 END))) ELSE 0.0 END AS confidence FROM pr)"""


def _live(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", "fingerprint", "ts", F.col("event_type").alias("source"), "batch", "is_replay")


@query("crs003_confidence", f"WITH {CONFIDENCE} SELECT event_id, n_prior, round(confidence, 6) AS confidence FROM cf WHERE n_prior > 0")
def crs003_confidence(spark, sf_dir):
    d = duplicates.with_confidence(_live(spark, sf_dir).where("NOT is_replay"), "fingerprint", "ts", "event_id", "source", "batch")
    return d.where("n_prior > 0").select("event_id", "n_prior", F.round("confidence", 6).alias("confidence"))


@query("crs003_duplicates", f"""WITH RECURSIVE {CONFIDENCE}, k AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY us, event_id) AS i FROM cf WHERE confidence > 0.4),
  g AS (SELECT fingerprint, i, event_id, confidence, us AS anchor, true AS opens FROM k WHERE i = 1
    UNION ALL SELECT k.fingerprint, k.i, k.event_id, k.confidence, CASE WHEN k.us - g.anchor >= 10000000 THEN k.us ELSE g.anchor END, k.us - g.anchor >= 10000000 FROM g JOIN k ON k.fingerprint = g.fingerprint AND k.i = g.i + 1)
  SELECT event_id, round(confidence, 6) AS confidence, CASE WHEN confidence > 0.7 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM g WHERE opens""")
def crs003(spark, sf_dir):
    d = duplicates.duplicates(_live(spark, sf_dir), "fingerprint", "ts", "event_id", "source", "batch", "is_replay")
    return d.select("event_id", F.round("confidence", 6).alias("confidence"), "severity")


def _anchors(key: str, width_us: int, keep: str) -> str:
    return f"""WITH RECURSIVE {EVENTS}, k AS (SELECT event_id, {key} AS key, epoch_us(ts) AS us, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS i FROM ev WHERE {keep}),
  g AS (SELECT key, i, event_id, us AS anchor, true AS opens FROM k WHERE i = 1
    UNION ALL SELECT k.key, k.i, k.event_id, CASE WHEN k.us - g.anchor >= {width_us} THEN k.us ELSE g.anchor END, k.us - g.anchor >= {width_us} FROM g JOIN k ON k.key = g.key AND k.i = g.i + 1)"""


@query("gtfs_crs002_repeats", f"{_anchors('fingerprint', 300000001, 'true')} SELECT event_id FROM g WHERE NOT opens")
def repeats(spark, sf_dir):
    return duplicates.repeated_positions(events(spark, sf_dir).select("event_id", "fingerprint", "ts"), "fingerprint", "ts", "event_id").select("event_id")


@query("anchored_windows", f"{_anchors('event_type', 300000000, 'true')} SELECT event_id FROM g WHERE opens")
def anchored_windows(spark, sf_dir):
    d = events(spark, sf_dir).select("event_id", "event_type", (F.unix_micros("ts") / 1_000_000.0).alias("t"))
    return greedy.anchored(d, "event_type", "t", "event_id", 300.0).where("opens").select("event_id")


@query("anchored_fold", f"{_anchors('fingerprint', 86400000000, 'true')} SELECT event_id FROM g WHERE opens")
def anchored_fold(spark, sf_dir):
    d = events(spark, sf_dir).select("event_id", "fingerprint", (F.unix_micros("ts") / 1_000_000.0).alias("t"))
    return greedy.anchored_fold(d, "fingerprint", "t", "event_id", 86_400.0).select("event_id")


SEVERITY = "CASE event_id % 5 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'CRITICAL' ELSE 'ODD' END"


def alerting(spark, sf_dir):
    k = F.col("event_id")
    sev = F.when(k % 5 == 0, "LOW").when(k % 5 == 1, "MEDIUM").when(k % 5 == 2, "HIGH").when(k % 5 == 3, "CRITICAL").otherwise("ODD")
    return events(spark, sf_dir).select("event_id", "ts", F.col("event_type").alias("rule_id"), F.col("user_id").cast("string").alias("entity_id"), F.col("batch").alias("violation_type"), sev.alias("severity"), (k % 100 / 100.0).alias("confidence"))


@query("alert_suppression", _anchors("event_type || chr(31) || (user_id % 7)", 300000000, f"{SEVERITY} IN ('MEDIUM', 'HIGH', 'CRITICAL')") + " SELECT event_id FROM g WHERE opens")
def alert_suppression(spark, sf_dir):
    d = alerting(spark, sf_dir).withColumn("entity_id", (F.col("entity_id").cast("long") % 7).cast("string")).withColumn("violation_type", F.lit("X"))
    return alerts.to_send(d, "ts", "event_id").select("event_id")


@query("alert_routing", f"SELECT {SEVERITY} AS severity, count(*) FILTER (WHERE {SEVERITY} IN ('HIGH', 'CRITICAL')) AS routed, count(*) FILTER (WHERE event_id % 100 / 100.0 > 0.7) AS confident, count(*) AS n FROM events GROUP BY 1")
def alert_routing(spark, sf_dir):
    d = alerting(spark, sf_dir)
    return d.groupBy("severity").agg(F.count_if(alerts.passes_threshold(F.col("severity"), "HIGH")).alias("routed"), F.count_if(alerts.should_route(F.col("confidence"))).alias("confident"), F.count(F.lit(1)).alias("n"))


@query("alert_messages", f"SELECT '[' || {SEVERITY} || '] ' || event_type || ' on ' || user_id || ': ' || (event_id % 4) AS message, CASE {SEVERITY} WHEN 'LOW' THEN '#36a64f' WHEN 'MEDIUM' THEN '#ffcc00' WHEN 'HIGH' THEN '#ff9900' WHEN 'CRITICAL' THEN '#ff0000' ELSE '#808080' END AS colour FROM events")
def alert_messages(spark, sf_dir):
    d = alerting(spark, sf_dir)
    return d.select(alerts.message().alias("message"), alerts.colour(F.col("severity")).alias("colour"))


@query("alert_digest", f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type AS rule_id, {SEVERITY} AS severity, count(*) AS n, count(DISTINCT user_id) AS n_entities FROM events GROUP BY ALL")
def alert_digest(spark, sf_dir):
    return alerts.hourly_digest(alerting(spark, sf_dir), "ts").withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


@query("evidence_counts", f"WITH {EVENTS} SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n_evidence FROM ev")
def evidence_counts(spark, sf_dir):
    return duplicates.evidence_count(events(spark, sf_dir), "event_type", "ts").select("event_id", "n_evidence")
