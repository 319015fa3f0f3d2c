"""Scalar Column functions: missing values, times, distances, keys, serialisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M, EARTH_KM = 6_371_000.0, 6_371.0
MILES_PER_KM = 0.621371


def as_double(c: Column) -> Column:
    return c.try_cast("double")


def is_nan(c: Column) -> Column:
    """True for a float NaN and for the string "NaN" exactly; null gives false."""
    return F.coalesce((c.cast("string") == F.lit("NaN")) & F.isnan(as_double(c)), F.lit(False))


def is_missing(c: Column) -> Column:
    return c.isNull() | is_nan(c)


def parse_time(c: Column) -> Column:
    """ISO text (with T, Z or offset) or a timestamp; null where it is neither."""
    return c.cast("string").try_cast("timestamp")


def parse_epoch_or_time(c: Column) -> Column:
    """As parse_time, and whole seconds since 1970 too."""
    text = c.cast("string")
    # a cast that fails costs as much as an exception, so only digits are cast
    seconds = F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), text.try_cast("long"))
    return F.when(seconds.isNotNull(), F.timestamp_seconds(seconds)).otherwise(parse_time(c))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1_000_000.0)


def _haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    return F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), _haversine(lat1, lon1, lat2, lon2))))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = _haversine(lat1, lon1, lat2, lon2)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def km_to_mph(kmh: Column) -> Column:
    return kmh * F.lit(MILES_PER_KM)


def fingerprint(*fields: Column) -> Column:
    """md5 of the fields joined by "|"; nulls read "None", so that they keep their place."""
    return F.md5(F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("None")) for f in fields]))


def joined_key(*fields: Column, sep: str = ":") -> Column:
    return F.concat_ws(sep, *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])


def arrival_latency_ms(now_ms: Column, arrival_ms: Column) -> Column:
    return F.greatest(now_ms - arrival_ms, F.lit(0))


def surrogate_id(existing: Column, partition: Column, offset: Column) -> Column:
    """existing, or partition-offset where there is none."""
    return F.coalesce(existing, F.concat_ws("-", partition.cast("string"), offset.cast("string")))


def serialised(value: Column) -> Column:
    """The text form that goes to a message: NaN as "NaN", null as null."""
    return F.when(is_nan(value), F.lit("NaN")).otherwise(value.cast("string"))


def decimal_places(c: Column) -> Column:
    """Digits after the point of the shortest decimal form."""
    text = c.cast("decimal(38,10)").cast("string")
    return F.length(F.rtrim(F.regexp_extract(text, r"\.(\d+)$", 1), F.lit("0")))
