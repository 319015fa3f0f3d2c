"""Stateless checks of vehicle positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import as_double, is_nan
from .finding import Check, first_of

MAX_KMH, IMPOSSIBLE_KMH, STALE_SECONDS = 300.0, 200.0, 300


def vehicle_id_valid(vehicle: Column, rule_id: str = "GTFSSyn001") -> Check:
    return Check(rule_id, "Vehicle id is set", "HIGH", "SYNTAX", F.when(vehicle.isNull() | (F.trim(vehicle.cast("string")) == ""), "MISSING_OR_EMPTY"))


def position_valid(lat: Column, lon: Column, nan_passes: bool = False, rule_id: str = "GTFSSyn002") -> Check:
    """Latitude first.  Only if both are null there is nothing to check."""

    def bad(c: Column, most: float) -> list[tuple[Column, str]]:
        d = as_double(c)
        out = (F.abs(d) > most) & ~F.isnan(d)
        return [(d.isNull(), "PARSE_ERROR"), (out if nan_passes else out | F.isnan(d), "OUT_OF_RANGE")]

    reason = first_of((lat.isNull() & lon.isNull(), None), *bad(lat, 90.0), *bad(lon, 180.0))
    return Check(rule_id, "Position is on the globe", "CRITICAL", "SYNTAX", reason)


def speed_valid(speed: Column, rule_id: str = "GTFSSyn003") -> Check:
    d = as_double(speed)
    reason = first_of((speed.isNull(), None), (d.isNull(), "PARSE_ERROR"), (d < 0, "NEGATIVE_VALUE"), ((d > MAX_KMH) & ~is_nan(speed), "EXCEEDS_MAX"))
    return Check(rule_id, "Speed is in range", "HIGH", "SYNTAX", reason)


def speed_possible(speed: Column, rule_id: str = "GTFSSem001") -> Check:
    return Check(rule_id, "Speed is possible for transit", "CRITICAL", "SEMANTIC", F.when((as_double(speed) > IMPOSSIBLE_KMH) & ~is_nan(speed), "IMPOSSIBLE_FOR_TRANSIT"))


def not_stale(raw: Column, ts: Column, as_of: Column, most: int = STALE_SECONDS, rule_id: str = "GTFSSem002") -> Check:
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts)) / F.lit(1_000_000.0)
    reason = first_of((raw.isNull(), None), (ts.isNull(), "PARSE_ERROR"), (age > most, "STALE_DATA"))
    return Check(rule_id, "Position is recent", "MEDIUM", "SEMANTIC", reason, details={"age_seconds": age})
