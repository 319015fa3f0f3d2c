"""The star-schema tables seen as trips, vehicle positions and events, in Spark and in SQL.

The tables are clean, so nulls, NaN, wrong types and bad values are put in by arithmetic on
keys, alike on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.finding import Check, findings
from ..sources.readers import star

#: Reference times of checks against a clock.
FUTURE_AS_OF, EVENTS_AS_OF = "2001-06-01 00:00:00", "2024-01-30 00:00:00"
DRIFT_SPLIT = "2024-01-16 00:00:00"


def _made(df: DataFrame, columns: dict) -> DataFrame:
    """df with columns that stand for stored ones: made once a row, where plain projections would be repeated in every use."""
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_made")).select(*df.columns, "_made.*")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders = star(spark, sf_dir, "lineitem"), star(spark, sf_dir, "orders")
    j = line.join(orders, line.l_orderkey == orders.o_orderkey)
    n = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    text = lambda c: F.col(c).cast("string")
    j = j.select(
        n.cast("long").alias("n"), F.concat_ws("-", text("l_orderkey"), text("l_linenumber")).alias("trip_id"), F.col("o_orderdate").alias("pickup"), F.col("l_shipdate").alias("dropoff"),
        F.col("l_extendedprice").alias("fare"), F.col("l_quantity").alias("distance"), F.col("l_suppkey").alias("pu"), F.col("l_partkey").alias("dropoff_zone"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("o_custkey").alias("custkey"), F.col("l_linenumber").alias("passengers"),
    )
    k = F.col("n")
    return _made(j, {
        "fare_raw": F.when(k % 50 == 0, None).when(k % 50 == 1, "NaN").when(k % 50 == 2, "-5.5").when(k % 50 == 3, "abc").otherwise(text("fare")),
        "distance_raw": F.when(k % 40 == 0, "NaN").when(k % 40 == 1, "0").when(k % 40 == 2, None).otherwise(text("distance")),
        "pu_raw": F.when(k % 60 == 0, None).when(k % 60 == 1, "x").when(k % 60 == 2, "12.5").otherwise((F.col("pu") % 400).cast("string")),
        "pickup_raw": F.when(k % 70 == 0, None).when(k % 70 == 1, "soon").otherwise(F.date_format("pickup", "yyyy-MM-dd HH:mm:ss")),
    })


TRIPS = """trips AS (
  SELECT *, CASE n % 50 WHEN 0 THEN NULL WHEN 1 THEN 'NaN' WHEN 2 THEN '-5.5' WHEN 3 THEN 'abc' ELSE CAST(fare AS VARCHAR) END AS fare_raw,
    CASE n % 40 WHEN 0 THEN 'NaN' WHEN 1 THEN '0' WHEN 2 THEN NULL ELSE CAST(distance AS VARCHAR) END AS distance_raw,
    CASE n % 60 WHEN 0 THEN NULL WHEN 1 THEN 'x' WHEN 2 THEN '12.5' ELSE CAST(pu % 400 AS VARCHAR) END AS pu_raw,
    CASE n % 70 WHEN 0 THEN NULL WHEN 1 THEN 'soon' ELSE strftime(pickup, '%Y-%m-%d %H:%M:%S') END AS pickup_raw
  FROM (SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS n, l_orderkey || '-' || l_linenumber AS trip_id, o_orderdate AS pickup, l_shipdate AS dropoff,
    l_extendedprice AS fare, l_quantity AS distance, l_suppkey AS pu, l_partkey AS dropoff_zone, l_returnflag AS flag, l_linestatus AS status, o_custkey AS custkey, l_linenumber AS passengers
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = star(spark, sf_dir, "events")
    k = F.col("event_id")
    return _made(e, {
        "value_raw": F.when(k % 50 == 0, None).when(k % 50 == 1, "NaN").when(k % 50 == 2, (-F.col("value")).cast("string")).when(k % 50 == 3, "abc").otherwise(F.col("value").cast("string")),
        "vehicle": F.when(k % 80 == 0, None).when(k % 80 == 1, "  ").otherwise(F.col("user_id").cast("string")),
        "latitude": F.lit(40.0) + (k * 7919 % 1000) / 1000.0, "longitude": F.lit(-74.0) + (k * 104729 % 1000) / 1000.0,
        "ts_raw": F.when(k % 90 == 0, None).when(k % 90 == 1, "never").when(k % 90 == 2, F.unix_seconds("ts").cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        "fingerprint": F.md5(F.concat_ws("|", F.col("user_id").cast("string"), "event_type")),
        "batch": (k % 4).cast("string"), "is_replay": k % 10 == 0,
    })


EVENTS = """ev AS (
  SELECT *, CASE event_id % 50 WHEN 0 THEN NULL WHEN 1 THEN 'NaN' WHEN 2 THEN CAST(-value AS VARCHAR) WHEN 3 THEN 'abc' ELSE CAST(value AS VARCHAR) END AS value_raw,
    CASE event_id % 80 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE CAST(user_id AS VARCHAR) END AS vehicle,
    CAST(40.0 AS DOUBLE) + CAST(event_id * 7919 % 1000 AS DOUBLE) / CAST(1000.0 AS DOUBLE) AS latitude,
    CAST(-74.0 AS DOUBLE) + CAST(event_id * 104729 % 1000 AS DOUBLE) / CAST(1000.0 AS DOUBLE) AS longitude,
    CASE event_id % 90 WHEN 0 THEN NULL WHEN 1 THEN 'never' WHEN 2 THEN CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS ts_raw,
    md5(user_id || '|' || event_type) AS fingerprint, CAST(event_id % 4 AS VARCHAR) AS batch, event_id % 10 = 0 AS is_replay
  FROM events)"""


def counted(df: DataFrame, checks: list[Check]) -> DataFrame:
    """(rule_id, severity, reason, n)."""
    return findings(df, checks, details=False).groupBy("rule_id", "severity", "reason").agg(F.count(F.lit(1)).alias("n"))


def counted_sql(source: str, *rules: tuple[str, str, str]) -> str:
    """The same from CASE expressions: source is "name AS (...)"; rules are (rule id, severity, reason) in SQL."""
    name = source.split(" ", 1)[0]
    parts = [f"SELECT '{rule}' AS rule_id, {severity} AS severity, {reason} AS reason FROM {name}" for rule, severity, reason in rules]
    return f"WITH {source}, r AS ({' UNION ALL '.join(parts)}) SELECT rule_id, severity, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL"


#: Python's and Spark's weekday with Monday 0, rush hours and so on, in SQL, for a timestamp column.
def context_sql(ts: str) -> dict[str, str]:
    hour, day = f"hour({ts})", f"(isodow({ts}) - 1)"
    return {
        "hour": hour, "day": day, "weekend": f"({day} >= 5)", "late": f"({hour} >= 22 OR {hour} < 5)",
        "rush": f"(({hour} BETWEEN 7 AND 9 OR {hour} BETWEEN 17 AND 19) AND {day} < 5)",
        "category": f"(CASE WHEN {hour} BETWEEN 6 AND 11 THEN 'morning' WHEN {hour} BETWEEN 12 AND 17 THEN 'afternoon' WHEN {hour} BETWEEN 18 AND 21 THEN 'evening' ELSE 'night' END)",
    }
