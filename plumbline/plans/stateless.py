"""Queries of the stateless checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.context import external
from ..functions.scalars import haversine_m, parse_epoch_or_time, parse_time, seconds_between
from ..operators import integrity, taxi_checks, transit_checks
from ..operators.contracts import Contract, FieldContract
from ..sources.readers import star
from .fixtures import EVENTS, EVENTS_AS_OF, FUTURE_AS_OF, TRIPS, context_sql, counted, counted_sql, events, trips
from .base import query

NAN = "({0} = 'NaN')"
SECONDS = "(CAST(epoch_us(dropoff) - epoch_us(pickup) AS DOUBLE) / 1000000.0)"
P = context_sql("pickup")
E = context_sql("ts")


def _days(low: float, high: float) -> tuple[float, float]:
    return low * 86_400, high * 86_400


@query("flagship_trip_findings", counted_sql(
    TRIPS,
    ("SYN001", "'HIGH'", "CASE WHEN fare_raw IS NULL THEN 'NULL' WHEN fare_raw = 'NaN' THEN 'NAN_VALUE' WHEN try_cast(fare_raw AS DOUBLE) IS NULL THEN 'TYPE_MISMATCH' WHEN try_cast(fare_raw AS DOUBLE) < 0 THEN 'NEGATIVE_VALUE' END"),
    ("SEM002", "'HIGH'", f"CASE WHEN {SECONDS} < 60 THEN 'TOO_SHORT' WHEN {SECONDS} > 100 * 86400.0 THEN 'TOO_LONG' END"),
    ("REF001", "'MEDIUM'", "CASE WHEN pu IS NOT NULL AND pu NOT BETWEEN 1 AND 50 THEN 'FOREIGN_KEY_NOT_FOUND' END"),
))
def flagship(spark, sf_dir):
    t = trips(spark, sf_dir)
    checks = [
        taxi_checks.fare_valid(F.col("fare_raw")),
        taxi_checks.duration_sane(seconds_between(F.col("pickup"), F.col("dropoff")), high=100 * 86_400.0),
        integrity.in_reference_set(F.col("pu"), "pu", range(1, 51)),
    ]
    return counted(t, checks)


@query("syn000_completeness", f"""WITH {EVENTS}, m AS (SELECT event_id,
  list_filter([CASE WHEN value_raw IS NULL OR value_raw = 'NaN' THEN 'value_raw' END, CASE WHEN vehicle IS NULL THEN 'vehicle' END, CASE WHEN ts_raw IS NULL THEN 'ts_raw' END], lambda x: x IS NOT NULL) AS f FROM ev)
  SELECT array_to_string(f, ',') AS missing, len(f) AS n_missing, round_even(CAST(1 - len(f) / 3.0 AS DOUBLE), 4) AS completeness, count(*) AS n FROM m WHERE len(f) > 0 GROUP BY ALL""")
def syn000(spark, sf_dir):
    fields = taxi_checks.required(["value_raw", "vehicle", "ts_raw"])
    m = taxi_checks.missing_fields(fields)
    d = events(spark, sf_dir).select(m.alias("f")).where(F.size("f") > 0)
    d = d.select(F.concat_ws(",", "f").alias("missing"), F.size("f").cast("long").alias("n_missing"), F.bround(1 - F.size("f") / 3.0, 4).alias("completeness"))
    return d.groupBy("missing", "n_missing", "completeness").agg(F.count(F.lit(1)).alias("n"))


@query("syn001_fare", counted_sql(EVENTS, ("SYN001", "'HIGH'", "CASE WHEN value_raw IS NULL THEN 'NULL' WHEN value_raw = 'NaN' THEN 'NAN_VALUE' WHEN try_cast(value_raw AS DOUBLE) IS NULL THEN 'TYPE_MISMATCH' WHEN try_cast(value_raw AS DOUBLE) < 0 THEN 'NEGATIVE_VALUE' END")))
def syn001(spark, sf_dir):
    return counted(events(spark, sf_dir), [taxi_checks.fare_valid(F.col("value_raw"))])


@query("syn002_zone", counted_sql(TRIPS, ("SYN002", "'HIGH'", "CASE WHEN pu_raw IS NULL THEN 'NULL' WHEN NOT regexp_full_match(pu_raw, '[+-]?[0-9]+') THEN 'TYPE_MISMATCH' WHEN try_cast(pu_raw AS INTEGER) NOT BETWEEN 1 AND 263 THEN 'OUT_OF_RANGE' END")))
def syn002(spark, sf_dir):
    return counted(trips(spark, sf_dir), [taxi_checks.zone_valid(F.col("pu_raw"))])


@query("syn002_zone_number", counted_sql(TRIPS, ("SYN002", "'HIGH'", "CASE WHEN trunc(CAST(distance * 7.3 AS DOUBLE)) NOT BETWEEN 1 AND 263 THEN 'OUT_OF_RANGE' END")))
def syn002_number(spark, sf_dir):
    return counted(trips(spark, sf_dir).withColumn("z", F.col("distance") * 7.3), [taxi_checks.zone_valid(F.col("z"), is_text=False)])


@query("syn003_future", counted_sql(TRIPS, ("SYN003", "'HIGH'", f"CASE WHEN pickup_raw IS NULL THEN 'NULL' WHEN try_cast(pickup_raw AS TIMESTAMP) IS NULL THEN 'PARSE_ERROR' WHEN epoch(try_cast(pickup_raw AS TIMESTAMP)) > epoch(TIMESTAMP '{FUTURE_AS_OF}') + 300 THEN 'FUTURE_TIMESTAMP' END")))
def syn003(spark, sf_dir):
    return counted(trips(spark, sf_dir), [taxi_checks.not_future(F.col("pickup_raw"), parse_time(F.col("pickup_raw")), F.lit(FUTURE_AS_OF).cast("timestamp"))])


@query("sem001_static", counted_sql(EVENTS, ("SEM001", "'MEDIUM'", f"CASE WHEN value_raw = 'NaN' THEN 'NAN_VALUE' WHEN try_cast(value_raw AS DOUBLE) < 2.5 OR try_cast(value_raw AS DOUBLE) > CAST(500.0 AS DOUBLE) * (CASE WHEN {E['rush']} THEN CAST(1.3 AS DOUBLE) WHEN {E['late']} THEN CAST(0.7 AS DOUBLE) WHEN {E['weekend']} THEN CAST(1.15 AS DOUBLE) ELSE 1.0 END) THEN 'OUT_OF_CONTEXTUAL_RANGE' END")))
def sem001_static(spark, sf_dir):
    low, high = taxi_checks.fare_bounds(external(F.col("ts")), None)
    return counted(events(spark, sf_dir), [taxi_checks.fare_range(F.col("value_raw"), low, high)])


@query("sem001_distance", counted_sql(TRIPS, ("SEM001", "'MEDIUM'", "CASE WHEN fare_raw = 'NaN' THEN 'NAN_VALUE' WHEN try_cast(fare_raw AS DOUBLE) < 2.5 OR try_cast(fare_raw AS DOUBLE) > CAST(30000.0 AS DOUBLE) * (CASE WHEN coalesce(try_cast(nullif(distance_raw, 'NaN') AS DOUBLE), 0) > 20 THEN 1 + (try_cast(distance_raw AS DOUBLE) - 20) * CAST(0.05 AS DOUBLE) ELSE 1.0 END) THEN 'OUT_OF_CONTEXTUAL_RANGE' END")))
def sem001_distance(spark, sf_dir):
    low, high = taxi_checks.fare_bounds(None, F.col("distance_raw"), None, None)
    return counted(trips(spark, sf_dir), [taxi_checks.fare_range(F.col("fare_raw"), low, high / 500.0 * 30000.0)])


@query("sem002_duration", counted_sql(TRIPS, ("SEM002", "'HIGH'", f"CASE WHEN {SECONDS} < 60 * 86400.0 / 24 THEN 'TOO_SHORT' WHEN {SECONDS} > CAST(60 * 86400.0 AS DOUBLE) * (CASE WHEN {P['rush']} THEN CAST(1.5 AS DOUBLE) WHEN {P['weekend']} THEN CAST(1.2 AS DOUBLE) ELSE 1.0 END) THEN 'TOO_LONG' END")))
def sem002(spark, sf_dir):
    s = seconds_between(F.col("pickup"), F.col("dropoff"))
    return counted(trips(spark, sf_dir), [taxi_checks.duration_sane(s, external(F.col("pickup")), low=60 * 86_400.0 / 24, high=60 * 86_400.0)])


@query("sem003_speed", counted_sql(TRIPS, ("SEM003", "'MEDIUM'", f"CASE WHEN distance_raw IS NULL THEN NULL WHEN distance_raw = 'NaN' THEN 'NAN_VALUE' WHEN {SECONDS} >= 60 AND try_cast(distance_raw AS DOUBLE) <= 0 THEN 'ZERO_OR_NEGATIVE_DISTANCE' WHEN {SECONDS} >= 60 AND try_cast(distance_raw AS DOUBLE) / ({SECONDS} / 3600.0 / 4000.0) > CAST(80.0 AS DOUBLE) + (CASE WHEN {P['late']} THEN 15.0 WHEN {P['rush']} THEN -5.0 ELSE 0.0 END) THEN 'EXCEEDS_MAX_SPEED' END")))
def sem003(spark, sf_dir):
    t = trips(spark, sf_dir).withColumn("miles", F.when(F.col("distance_raw").isin("NaN", "0"), F.col("distance_raw")).otherwise((F.col("distance_raw").try_cast("double") * 4000.0).cast("string")))
    s = seconds_between(F.col("pickup"), F.col("dropoff"))
    return counted(t, [taxi_checks.speed_sane(F.col("miles"), s, external(F.col("pickup")))])


@query("fit001_fitness", counted_sql(EVENTS, ("FIT001", "CASE WHEN s < 0.25 THEN 'HIGH' ELSE 'MEDIUM' END", "CASE WHEN s <= 0.5 THEN 'BELOW_FITNESS' END")).replace("FROM ev) SELECT", "FROM (SELECT *, 1 - ((CASE WHEN value_raw IS NULL OR value_raw = 'NaN' THEN 1 ELSE 0 END) + (CASE WHEN vehicle IS NULL THEN 1 ELSE 0 END)) / CAST(2.0 AS DOUBLE) AS s FROM ev)) SELECT"))
def fit001(spark, sf_dir):
    return counted(events(spark, sf_dir), [taxi_checks.fitness(taxi_checks.required(["value_raw", "vehicle"]))])


@query("ref001_default_ranges", counted_sql(TRIPS, ("REF001", "'MEDIUM'", "CASE WHEN pu_raw IS NOT NULL AND NOT coalesce(regexp_full_match(pu_raw, '[+-]?[0-9]+') AND try_cast(pu_raw AS INTEGER) BETWEEN 1 AND 263, false) THEN 'FOREIGN_KEY_NOT_FOUND' END")))
def ref001(spark, sf_dir):
    return counted(trips(spark, sf_dir), [integrity.in_reference_set(F.col("pu_raw"), "PULocationID")])


#: What a format looks like in the oracle's regular expressions.
EMAIL, IPV4 = r"^(?:[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$)", r"^(?:(\d{1,3}\.){3}\d{1,3}$)"


@query("con001_formats", f"""WITH w AS (SELECT url, split_part(split_part(url, '//', 2), '/', 1) AS host, CASE page_id % 3 WHEN 0 THEN 'a' || page_id || '@example.org' WHEN 1 THEN '10.0.' || (page_id % 300) || '.7' ELSE url END AS v FROM pages)
  SELECT 'email' AS format, count(*) AS n FROM w WHERE v IS NOT NULL AND NOT regexp_matches(v, '{EMAIL}')
  UNION ALL SELECT 'ipv4', count(*) FROM w WHERE v IS NOT NULL AND NOT regexp_matches(v, '{IPV4}')
  UNION ALL SELECT 're:https?://', count(*) FROM w WHERE url IS NOT NULL AND NOT regexp_matches(url, '^(?:https?://)')""")
def con001(spark, sf_dir):
    p = star(spark, sf_dir, "pages")
    v = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("a"), F.col("page_id").cast("string"), F.lit("@example.org"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("10.0."), (F.col("page_id") % 300).cast("string"), F.lit(".7"))).otherwise(F.col("url"))
    p = p.select("url", v.alias("v"))
    names = {"email": "v", "ipv4": "v", "re:https?://": "url"}
    one = p.agg(*[F.count(integrity.format_conforms(F.col(c), f).reason).alias(f"_{i}") for i, (f, c) in enumerate(names.items())])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("format"), F.col(f"_{i}").alias("n")) for i, f in enumerate(names)])).alias("r")).select("r.*")


@query("con002_precision", """WITH p AS (SELECT CAST(l_extendedprice * (CASE WHEN l_linenumber % 3 = 0 THEN CAST(0.1 AS DOUBLE) ELSE 1 END) AS DOUBLE) AS v FROM lineitem),
  t AS (SELECT length(rtrim(regexp_extract(CAST(CAST(v AS DECIMAL(38,10)) AS VARCHAR), '\\.(\\d+)$', 1), '0')) AS places FROM p)
  SELECT places, count(*) AS n FROM t WHERE places > 2 GROUP BY places""")
def con002(spark, sf_dir):
    p = star(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") * F.when(F.col("l_linenumber") % 3 == 0, 0.1).otherwise(1.0)).alias("v"))
    c = integrity.precision_conforms(F.col("v"), 2)
    return p.where(c.reason.isNotNull()).groupBy(c.details["places"].cast("long").alias("places")).agg(F.count(F.lit(1)).alias("n"))


@query("con003_enumeration", "WITH r AS (SELECT 'flag' AS field, l_returnflag AS v FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') UNION ALL SELECT 'status', l_linestatus FROM lineitem WHERE l_linestatus NOT IN ('O') UNION ALL SELECT 'event_type', event_type FROM events WHERE event_type NOT IN ('click', 'view', 'error')) SELECT field, v AS value, count(*) AS n FROM r GROUP BY ALL")
def con003(spark, sf_dir):
    line, ev = star(spark, sf_dir, "lineitem"), star(spark, sf_dir, "events")
    parts = [(line, "l_returnflag", "flag", ["A", "N"]), (line, "l_linestatus", "status", ["O"]), (ev, "event_type", "event_type", ["click", "view", "error"])]
    out = None
    for df, c, name, allowed in parts:
        check = integrity.enumeration_conforms(F.col(c), name, allowed)
        rows = df.where(check.reason.isNotNull()).select(F.lit(name).alias("field"), F.col(c).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


@query("tim001_timeliness", counted_sql(EVENTS, ("TIM001", "CASE WHEN d > 3600 THEN 'HIGH' ELSE 'MEDIUM' END", "CASE WHEN NOT is_replay AND d > 300 THEN 'LATE_ARRIVAL' END")).replace("FROM ev) SELECT", f"FROM (SELECT *, CAST(floor(epoch(TIMESTAMP '{EVENTS_AS_OF}')) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) AS d FROM ev)) SELECT"))
def tim001(spark, sf_dir):
    return counted(events(spark, sf_dir), [integrity.timely(F.col("ts"), F.lit(EVENTS_AS_OF).cast("timestamp"), F.col("is_replay"))])


VALUE = "try_cast(value_raw AS DOUBLE)"


@query("gtfs_stateless", counted_sql(
    EVENTS,
    ("GTFSSyn001", "'HIGH'", "CASE WHEN vehicle IS NULL OR trim(vehicle) = '' THEN 'MISSING_OR_EMPTY' END"),
    ("GTFSSyn002", "'CRITICAL'", "CASE WHEN abs(latitude * 2.2) > 90 THEN 'OUT_OF_RANGE' WHEN abs(longitude * 2.44) > 180 THEN 'OUT_OF_RANGE' END"),
    ("GTFSSyn003", "'HIGH'", f"CASE WHEN value_raw IS NULL THEN NULL WHEN {VALUE} IS NULL THEN 'PARSE_ERROR' WHEN {VALUE} < 0 THEN 'NEGATIVE_VALUE' WHEN {VALUE} > 300 AND value_raw <> 'NaN' THEN 'EXCEEDS_MAX' END"),
    ("GTFSSem001", "'CRITICAL'", f"CASE WHEN {VALUE} > 200 AND value_raw <> 'NaN' THEN 'IMPOSSIBLE_FOR_TRANSIT' END"),
    ("GTFSSem002", "'MEDIUM'", f"CASE WHEN ts_raw IS NULL THEN NULL WHEN t IS NULL THEN 'PARSE_ERROR' WHEN epoch_us(TIMESTAMP '{EVENTS_AS_OF}') - epoch_us(t) > 300000000 THEN 'STALE_DATA' END"),
).replace("FROM events)", "FROM events), e2 AS (SELECT *, CASE WHEN try_cast(ts_raw AS BIGINT) IS NOT NULL THEN make_timestamp(CAST(ts_raw AS BIGINT) * 1000000) ELSE try_cast(replace(ts_raw, 'Z', '') AS TIMESTAMP) END AS t FROM ev)", 1).replace("FROM ev UNION", "FROM e2 UNION").replace("FROM ev) SELECT", "FROM e2) SELECT"))
def gtfs(spark, sf_dir):
    e = events(spark, sf_dir)
    return counted(e, [
        transit_checks.vehicle_id_valid(F.col("vehicle")), transit_checks.position_valid(F.col("latitude") * 2.2, F.col("longitude") * 2.44), transit_checks.speed_valid(F.col("value_raw")),
        transit_checks.speed_possible(F.col("value_raw")), transit_checks.not_stale(F.col("ts_raw"), parse_epoch_or_time(F.col("ts_raw")), F.lit(EVENTS_AS_OF)),
    ])


@query("gtfs_position_parse", """WITH e AS (SELECT CASE event_id % 30 WHEN 0 THEN NULL WHEN 1 THEN 'north' WHEN 2 THEN '95.5' WHEN 3 THEN 'NaN' ELSE '40.5' END AS lat, CASE event_id % 45 WHEN 0 THEN NULL WHEN 5 THEN '-190' ELSE '-74.0' END AS lon FROM events),
  r AS (SELECT CASE WHEN lat IS NULL AND lon IS NULL THEN NULL WHEN try_cast(lat AS DOUBLE) IS NULL THEN 'PARSE_ERROR' WHEN isnan(try_cast(lat AS DOUBLE)) OR abs(try_cast(lat AS DOUBLE)) > 90 THEN 'OUT_OF_RANGE' WHEN try_cast(lon AS DOUBLE) IS NULL THEN 'PARSE_ERROR' WHEN abs(try_cast(lon AS DOUBLE)) > 180 THEN 'OUT_OF_RANGE' END AS reason FROM e)
  SELECT 'GTFSSyn002' AS rule_id, 'CRITICAL' AS severity, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason""")
def gtfs_position(spark, sf_dir):
    k = F.col("event_id")
    e = star(spark, sf_dir, "events").select(F.when(k % 30 == 0, None).when(k % 30 == 1, "north").when(k % 30 == 2, "95.5").when(k % 30 == 3, "NaN").otherwise("40.5").alias("lat"), F.when(k % 45 == 0, None).when(k % 45 == 5, "-190").otherwise("-74.0").alias("lon"))
    return counted(e, [transit_checks.position_valid(F.col("lat"), F.col("lon"))])


@query("consumer_pack", counted_sql(
    TRIPS,
    ("cSYN001", "'HIGH'", "CASE WHEN fare - 2000 < 0 THEN 'NEGATIVE_VALUE' END"),
    ("cSYN002", "'MEDIUM'", "CASE WHEN pu NOT BETWEEN 1 AND 263 THEN 'OUT_OF_RANGE' END"),
    ("cSYN003", "'MEDIUM'", "CASE WHEN dropoff_zone NOT BETWEEN 1 AND 263 THEN 'OUT_OF_RANGE' END"),
    ("cSEM001", "'MEDIUM'", "CASE WHEN fare - 2000 > 0 AND distance > 0 AND ((fare - 2000) / distance < 1 OR (fare - 2000) / distance > 50) THEN 'OUT_OF_RANGE' END"),
))
def consumer(spark, sf_dir):
    return counted(trips(spark, sf_dir), taxi_checks.consumer_pack(F.col("fare") - 2000, F.col("pu"), F.col("dropoff_zone"), F.col("distance")))


@query("multi_filter", counted_sql(TRIPS, ("MULTI", "'HIGH'", "CASE WHEN fare - 2000 < 0 OR dropoff_zone < 1 OR dropoff_zone > 263 THEN 'INVALID' END")))
def multi(spark, sf_dir):
    return counted(trips(spark, sf_dir), [taxi_checks.multi_filter(F.col("fare") - 2000, F.col("dropoff_zone"))])


CONTRACT = Contract("trips", fields=(FieldContract("fare_raw", "float", False, 0.0, 60000.0), FieldContract("distance_raw", "float", True, 2.0), FieldContract("pu_raw", "int", False), FieldContract("flag", allowed_values=("A", "N"))))


@query("field_contract", counted_sql(
    TRIPS,
    ("FIELD_fare_raw", "'MEDIUM'", "CASE WHEN fare_raw IS NULL THEN 'NULL' WHEN try_cast(fare_raw AS DOUBLE) IS NULL THEN 'TYPE_MISMATCH' WHEN try_cast(fare_raw AS DOUBLE) < 0 THEN 'BELOW_MINIMUM' WHEN try_cast(fare_raw AS DOUBLE) > 60000 AND fare_raw <> 'NaN' THEN 'ABOVE_MAXIMUM' END"),
    ("FIELD_distance_raw", "'MEDIUM'", "CASE WHEN try_cast(distance_raw AS DOUBLE) < 2 THEN 'BELOW_MINIMUM' END"),
    ("FIELD_pu_raw", "'MEDIUM'", "CASE WHEN pu_raw IS NULL THEN 'NULL' WHEN NOT regexp_full_match(pu_raw, '[+-]?[0-9]+') THEN 'TYPE_MISMATCH' END"),
    ("FIELD_flag", "'MEDIUM'", "CASE WHEN flag NOT IN ('A', 'N') THEN 'NOT_ALLOWED' END"),
))
def field_contract(spark, sf_dir):
    return counted(trips(spark, sf_dir), CONTRACT.field_checks())


@query("design_pack", counted_sql(
    TRIPS,
    ("V2-PAX", "'MEDIUM'", "CASE WHEN passengers NOT BETWEEN 1 AND 6 THEN 'OUT_OF_RANGE' END"),
    ("V2-MINFARE", "'MEDIUM'", "CASE WHEN fare / 1000 < 2.5 THEN 'BELOW_MINIMUM' END"),
    ("V2-PERMILE", "'MEDIUM'", "CASE WHEN distance > 0 AND (fare / 1000 / distance < 2 OR fare / 1000 / distance > 50) THEN 'OUT_OF_RANGE' END"),
    ("V2-DIST", "'MEDIUM'", "CASE WHEN distance < CAST(30.0 AS DOUBLE) * CAST(0.8 AS DOUBLE) THEN 'SHORTER_THAN_STRAIGHT_LINE' END"),
))
def design(spark, sf_dir):
    return counted(trips(spark, sf_dir), taxi_checks.design_pack(F.col("fare") / 1000, F.col("passengers"), F.col("distance"), F.lit(30.0)))


@query("finding_rows", f"""WITH {EVENTS} SELECT event_id, 'SYN001' AS rule_id, CASE WHEN value_raw IS NULL THEN 'NULL' WHEN value_raw = 'NaN' THEN 'NAN_VALUE' WHEN value_raw = 'abc' THEN 'TYPE_MISMATCH' ELSE 'NEGATIVE_VALUE' END AS reason,
  CASE WHEN value_raw IS NULL THEN '{{}}' WHEN try_cast(value_raw AS DOUBLE) < 0 THEN 'negative' ELSE '{{"value":"' || value_raw || '"}}' END AS details
  FROM ev WHERE value_raw IS NULL OR value_raw = 'NaN' OR value_raw = 'abc' OR try_cast(value_raw AS DOUBLE) < 0""")
def finding_rows(spark, sf_dir):
    from ..operators.finding import findings

    f = findings(events(spark, sf_dir), [taxi_checks.fare_valid(F.col("value_raw"))], keep=["event_id"], snapshot=["event_id", "value_raw"])
    return f.select("event_id", "rule_id", "reason", F.when(F.col("reason") == "NEGATIVE_VALUE", "negative").otherwise(F.col("details")).alias("details"))


@query("straight_line", "SELECT event_id % 10 AS g, round(sum(2 * 6371000.0 * asin(sqrt(pow(sin(radians(CAST((event_id * 7919 % 1000) AS DOUBLE) / 1000.0) / 2), 2) + cos(radians(40.0)) * cos(radians(40.0 + CAST((event_id * 7919 % 1000) AS DOUBLE) / 1000.0)) * pow(sin(radians(CAST((event_id * 104729 % 1000) AS DOUBLE) / 1000.0) / 2), 2)))), 2) AS metres, count(*) AS n FROM events GROUP BY 1")
def straight_line(spark, sf_dir):
    e = events(spark, sf_dir)
    m = haversine_m(F.lit(40.0), F.lit(-74.0), F.col("latitude"), F.col("longitude"))
    return e.groupBy((F.col("event_id") % 10).alias("g")).agg(F.round(F.sum(m), 2).alias("metres"), F.count(F.lit(1)).alias("n"))
