"""Anomaly injection into trips, for tests of detectors: a pure function of a row number.

Which rows, of which kind and by how much follows from arithmetic on the row number, so any
engine can restate it and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["fare_negative", "fare_outlier", "location_invalid", "duration_negative", "duration_outlier", "timestamp_future", "speed_outlier", "duplicate"]


def kind_of(n: Column, percent: int) -> Column:
    """The anomaly of row n, or null: percent rows of a hundred, kinds in turn."""
    which = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.pmod(F.floor(n / 100), F.lit(len(KINDS))) + 1).cast("int"))
    return F.when(F.pmod(n, F.lit(100)) < percent, which)


def inject(trips: DataFrame, n: str, percent: int = 5, as_of: str = "2024-01-01 00:00:00", outlier_hours: int = 30, is_replay: bool = False) -> DataFrame:
    """trips (pickup, dropoff, fare, total, distance, location) with anomalies, the column anomaly_type, and duplicates as second rows."""
    k, spread = kind_of(F.col(n), percent), F.pmod(F.col(n) * 7919, F.lit(1000)) / 1000.0
    d = trips.withColumn("anomaly_type", k)
    k = F.col("anomaly_type")
    low, high = F.bround(F.lit(-50.0) + spread * 47.5, 2), F.bround(F.lit(500.0) + spread * 1500.0, 2)
    hours = lambda c, h: (c.cast("timestamp") + F.expr(f"INTERVAL {h} HOURS"))
    d = d.withColumns({
        "fare": F.when(k == "fare_negative", low).when(k == "fare_outlier", high).otherwise(F.col("fare")),
        "total": F.when(k == "fare_negative", F.col("total") + low).when(k == "fare_outlier", high).otherwise(F.col("total")),
        "location": F.when(k == "location_invalid", F.lit(9999) + F.pmod(F.col(n) * 104729, F.lit(90001))).otherwise(F.col("location")),
        "distance": F.when(k == "speed_outlier", 100.0).otherwise(F.col("distance")),
        "dropoff": F.when(k == "duration_negative", F.col("pickup") - F.expr("INTERVAL 30 MINUTES")).when(k == "duration_outlier", hours(F.col("pickup"), outlier_hours)).when(k == "speed_outlier", F.col("pickup") + F.expr("INTERVAL 30 MINUTES")).otherwise(F.col("dropoff")),
        "pickup": F.when(k == "duration_negative", hours(F.col("pickup"), 1)).when(k == "timestamp_future", F.lit(as_of).cast("timestamp") + F.expr("INTERVAL 7 DAYS")).otherwise(F.col("pickup")),
    })
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("anomaly_type") == "duplicate", 2).otherwise(1))))
    return d.withColumn("is_replay", F.lit(is_replay))


def degrade(df: DataFrame, column: str, n: str, how: str, percent: int = 5, amount: float = 10.0) -> DataFrame:
    """A numeric column made worse in percent rows of a hundred: null, multiply, shift, noise, replace."""
    hit = F.pmod(F.col(n) * 31 + 7, F.lit(100)) < percent
    c = F.col(column)
    noise = F.pmod(F.col(n) * 7919, F.lit(2001)) / 1000.0 - 1.0
    worse = {"null": F.lit(None).cast("double"), "multiply": c * amount, "shift": c + amount, "noise": c + noise * amount, "replace": F.lit(amount)}
    if how not in worse:
        raise ValueError(f"unknown way: {how}")
    return df.withColumn(column, F.when(hit, worse[how]).otherwise(c)).withColumn("degraded", hit)
