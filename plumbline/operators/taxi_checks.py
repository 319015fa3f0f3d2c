"""Stateless checks of trip records: completeness, validity, plausibility, fitness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import as_double, is_missing, is_nan
from .finding import Check, first_of

MIN_FARE, MAX_FARE = 2.5, 500.0
MIN_SECONDS, MAX_SECONDS = 60.0, 86_400.0
MAX_MPH = 80.0
FIRST_ZONE, LAST_ZONE = 1, 263
FUTURE_SECONDS = 300


def missing_fields(fields: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(is_missing(c), F.lit(n)) for n, c in fields.items()]))


def completeness(fields: dict[str, Column], rule_id: str = "SYN000") -> Check:
    missing = missing_fields(fields)
    score = F.bround(1 - F.size(missing) / F.lit(float(len(fields))), 4)
    return Check(rule_id, "Completeness", "MEDIUM", "SYNTAX_SYN000", F.when(F.size(missing) > 0, "NULL"), details={"missing_fields": missing, "completeness": score})


def fare_valid(fare: Column, rule_id: str = "SYN001") -> Check:
    """fare as it came, so that a null, NaN and a wrong type differ."""
    reason = first_of((fare.isNull(), "NULL"), (is_nan(fare), "NAN_VALUE"), (as_double(fare).isNull(), "TYPE_MISMATCH"), (as_double(fare) < 0, "NEGATIVE_VALUE"))
    return Check(rule_id, "Fare amount is valid", "HIGH", "SYNTACTIC", reason, details={"value": fare.cast("string")})


def zone_valid(location: Column, is_text: bool = True, rule_id: str = "SYN002") -> Check:
    """Text must be a whole number; a number is cut toward zero."""
    number = location.cast("string").try_cast("int") if is_text else F.when(F.isnan(location.cast("double")), None).otherwise(location.try_cast("int"))
    reason = first_of((location.isNull(), "NULL"), (number.isNull(), "TYPE_MISMATCH"), (~number.between(FIRST_ZONE, LAST_ZONE), "OUT_OF_RANGE"))
    return Check(rule_id, "Pickup location is valid", "HIGH", "SYNTACTIC", reason, details={"value": location.cast("string")})


def not_future(raw: Column, ts: Column, as_of: Column, tolerance: int = FUTURE_SECONDS, rule_id: str = "SYN003") -> Check:
    ahead = F.unix_micros(ts) - F.unix_micros(as_of.cast("timestamp")) - F.lit(tolerance * 1_000_000)
    reason = first_of((raw.isNull(), "NULL"), (ts.isNull(), "PARSE_ERROR"), (ahead > 0, "FUTURE_TIMESTAMP"))
    return Check(rule_id, "Timestamp is not in the future", "HIGH", "SYNTACTIC", reason, details={"offset_seconds": (ahead / F.lit(1_000_000)).cast("long")})


def fare_bounds(context: Column | None, distance: Column | None, p10: Column | None = None, p90: Column | None = None) -> tuple[Column, Column]:
    """Lower and upper bound, from statistics if there are any, then one adjustment for the time and one for distance."""
    low = F.coalesce(p10, F.lit(MIN_FARE)) if p10 is not None else F.lit(MIN_FARE)
    high = F.coalesce(2 * p90, F.lit(MAX_FARE)) if p90 is not None else F.lit(MAX_FARE)
    if context is not None:
        holiday, rush, late, weekend = (context[k] for k in ("is_holiday", "is_rush_hour", "is_late_night", "is_weekend"))
        low = low * F.when(holiday, 0.8).otherwise(1.0)
        high = high * F.when(holiday, 1.5).when(rush, 1.3).when(late, 0.7).when(weekend, 1.15).otherwise(1.0)
    if distance is not None:
        d = F.coalesce(F.when(is_nan(distance), None).otherwise(as_double(distance)), F.lit(0.0))
        high = high * F.when(d > 20, 1 + (d - 20) * 0.05).otherwise(1.0)
    return low, high


def fare_range(fare: Column, low: Column, high: Column, rule_id: str = "SEM001") -> Check:
    f = as_double(fare)
    reason = first_of((is_nan(fare), "NAN_VALUE"), ((f < low) | (f > high), "OUT_OF_CONTEXTUAL_RANGE"))
    return Check(rule_id, "Fare is in its contextual range", "MEDIUM", "SEMANTIC", reason, details={"value": f}, expected={"min": low, "max": high})


def duration_sane(seconds: Column, context: Column | None = None, low: float = MIN_SECONDS, high: float = MAX_SECONDS, rule_id: str = "SEM002") -> Check:
    most = F.lit(high)
    if context is not None:
        most = most * F.when(context["is_rush_hour"], 1.5).when(context["is_weekend"], 1.2).otherwise(1.0)
    return Check(rule_id, "Trip duration is sane", "HIGH", "SEMANTIC", first_of((seconds < low, "TOO_SHORT"), (seconds > most, "TOO_LONG")), details={"seconds": seconds}, expected={"max": most})


def speed_sane(distance: Column, seconds: Column, context: Column | None = None, high: float = MAX_MPH, rule_id: str = "SEM003") -> Check:
    d = as_double(distance)
    most = F.lit(high)
    if context is not None:
        most = most + F.when(context["is_late_night"], 15.0).when(context["is_rush_hour"], -5.0).otherwise(0.0)
    mph = F.try_divide(d, seconds / F.lit(3600.0))  # null where no time has passed
    usable = seconds >= MIN_SECONDS
    reason = first_of((distance.isNull() | seconds.isNull(), None), (is_nan(distance), "NAN_VALUE"), (usable & (d <= 0), "ZERO_OR_NEGATIVE_DISTANCE"), (usable & (mph > most), "EXCEEDS_MAX_SPEED"))
    return Check(rule_id, "Average speed is sane", "MEDIUM", "SEMANTIC", reason, details={"mph": mph}, expected={"max": most})


def fitness(fields: dict[str, Column], threshold: float = 0.5, rule_id: str = "FIT001") -> Check:
    score = 1 - F.size(missing_fields(fields)) / F.lit(float(len(fields)))
    severity = F.when(score < 0.25, "HIGH").otherwise("MEDIUM")
    return Check(rule_id, "Record is fit for use", "MEDIUM", "FITNESS", F.when(score <= threshold, "BELOW_FITNESS"), severity_of=severity, details={"score": score})


def consumer_pack(fare: Column, pickup: Column, dropoff: Column, distance: Column) -> list[Check]:
    """The four plain checks of the single-process consumer."""
    zone = lambda c: ~c.between(FIRST_ZONE, LAST_ZONE)
    per_mile = F.when((fare > 0) & (distance > 0), fare / distance)
    return [
        Check("cSYN001", "Fare is not negative", "HIGH", "SYNTACTIC", F.when(fare < 0, "NEGATIVE_VALUE")),
        Check("cSYN002", "Pickup location is valid", "MEDIUM", "SYNTACTIC", F.when(zone(pickup), "OUT_OF_RANGE")),
        Check("cSYN003", "Dropoff location is valid", "MEDIUM", "SYNTACTIC", F.when(zone(dropoff), "OUT_OF_RANGE")),
        Check("cSEM001", "Fare per mile is plausible", "MEDIUM", "SEMANTIC", F.when((per_mile < 1) | (per_mile > 50), "OUT_OF_RANGE")),
    ]


def multi_filter(fare: Column, pickup: Column, rule_id: str = "MULTI") -> Check:
    return Check(rule_id, "Fare or pickup location is invalid", "HIGH", "SYNTACTIC", F.when((fare < 0) | (pickup < FIRST_ZONE) | (pickup > LAST_ZONE), "INVALID"))


def design_pack(fare: Column, passengers: Column, distance: Column, straight_line_miles: Column) -> list[Check]:
    """The further checks that the designs name: passengers, least fare, fare per mile, distance against the straight line."""
    per_mile = F.when(distance > 0, fare / distance)
    return [
        Check("V2-PAX", "Passengers are 1 to 6", "MEDIUM", "SYNTACTIC", F.when(~passengers.between(1, 6), "OUT_OF_RANGE")),
        Check("V2-MINFARE", "Fare reaches the least fare", "MEDIUM", "SEMANTIC", F.when(fare < MIN_FARE, "BELOW_MINIMUM")),
        Check("V2-PERMILE", "Fare per mile is 2 to 50", "MEDIUM", "SEMANTIC", F.when((per_mile < 2) | (per_mile > 50), "OUT_OF_RANGE")),
        Check("V2-DIST", "Distance is not shorter than the straight line by over a fifth", "MEDIUM", "SEMANTIC", F.when(distance < straight_line_miles * 0.8, "SHORTER_THAN_STRAIGHT_LINE")),
    ]


def required(names: Sequence[str]) -> dict[str, Column]:
    return {n: F.col(n) for n in names}
