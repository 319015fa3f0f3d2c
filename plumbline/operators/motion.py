"""Checks of a vehicle's position against its position before, in order of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import haversine_km, haversine_m
from .finding import Check, findings, first_of

MAX_KMH = 160.0
JUMP_METRES, JUMP_KMH = 100.0, 40.0


def with_previous(df: DataFrame, vehicle: str, order: str, lat: str = "latitude", lon: str = "longitude", ts: str = "ts") -> DataFrame:
    """Adds prev_lat, prev_lon, prev_ts, seq; rows without a vehicle or a whole position are left out."""
    w = Window.partitionBy(vehicle).orderBy(order)
    usable = F.col(vehicle).isNotNull() & (F.trim(F.col(vehicle).cast("string")) != "") & F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(ts).isNotNull()
    return df.where(usable).withColumns({"prev_lat": F.lag(lat).over(w), "prev_lon": F.lag(lon).over(w), "prev_ts": F.lag(ts).over(w), "seq": F.row_number().over(w) - 1})


def motion_checks(lat: str = "latitude", lon: str = "longitude", ts: str = "ts") -> list[Check]:
    """CRS001 (speed that cannot be) and CRS002 (jumps), of rows made by with_previous."""
    metres = haversine_m(F.col("prev_lat"), F.col("prev_lon"), F.col(lat), F.col(lon))
    dt = (F.unix_micros(ts) - F.unix_micros("prev_ts")) / F.lit(1_000_000.0)
    kmh = F.try_divide(metres, dt) * 3.6  # null where no time has passed
    moved = F.col("prev_ts").isNotNull() & (dt > 0)
    jump = moved & (metres > JUMP_METRES) & (kmh < JUMP_KMH)
    severity = F.when(kmh < 1, "CRITICAL").when(kmh < 20, "HIGH").otherwise("MEDIUM")
    numbers = {"distance_m": F.bround(metres, 1), "speed_kmh": F.bround(kmh, 1), "seconds": dt}
    return [
        Check("CRS001", "Speed between positions is possible", "HIGH", "CROSS_RECORD", F.when(moved & (kmh > MAX_KMH), "IMPOSSIBLE_SPEED"), details=numbers),
        Check("CRS002", "Position does not jump", "MEDIUM", "CROSS_RECORD", F.when(jump, "POSITION_JUMP"), severity_of=severity, details=numbers),
    ]


def transit_motion_check(lat: str = "latitude", lon: str = "longitude", ts: str = "ts", strict_reference: bool = False) -> Check:
    """GTFSCRS001.  strict_reference also flags any repeated time, however short the way."""
    km = haversine_km(F.col("prev_lat"), F.col("prev_lon"), F.col(lat), F.col(lon))
    dt = (F.unix_micros(ts) - F.unix_micros("prev_ts")) / F.lit(1_000_000.0)
    had = F.col("prev_ts").isNotNull()
    still = had & (dt <= 0)
    kmh = F.when(dt > 0, F.try_divide(km, dt / 3600.0)).otherwise(F.lit(9999.0 if strict_reference else 0.0))
    reason = first_of((still & (km > 1), "GPS_TELEPORT"), (had & (kmh > 200), "IMPOSSIBLE_SPEED"), (had & (kmh > 120), "EXCEEDS_REASONABLE"))
    severity = F.when(reason == "EXCEEDS_REASONABLE", "HIGH").otherwise("CRITICAL")
    return Check("GTFSCRS001", "Vehicle moves at a possible speed", "CRITICAL", "CROSS_RECORD", reason, severity_of=severity, details={"km": F.bround(km, 3), "kmh": F.bround(kmh, 1)})


def motion_findings(df: DataFrame, vehicle: str, order: str, checks: list[Check], keep: list[str], **columns: str) -> DataFrame:
    return findings(with_previous(df, vehicle, order, **columns), checks, keep)


def recent_jump(df: DataFrame, vehicle: str, order: str, lat: str = "latitude", lon: str = "longitude", ts: str = "ts", fixes: int = 3, seconds: float = 30.0, metres: float = 400.0) -> DataFrame:
    """Rows that lie over metres from any of the last few fixes within seconds."""
    w = Window.partitionBy(vehicle).orderBy(order).rowsBetween(-fixes, -1)
    past = F.collect_list(F.struct(F.col(lat).alias("a"), F.col(lon).alias("o"), F.unix_micros(ts).alias("t"))).over(w)
    far = F.exists("_past", lambda p: ((F.unix_micros(F.col(ts)) - p["t"]).between(0, int(seconds * 1_000_000))) & (haversine_m(p["a"], p["o"], F.col(lat), F.col(lon)) > metres))
    return df.withColumn("_past", past).where(far).drop("_past")
