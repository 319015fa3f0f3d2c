"""Reference, conformity and timeliness checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import decimal_places
from .finding import Check

#: Named formats; matching is anchored at the start only.
FORMATS = {
    "uuid": r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone_e164": r"\+[1-9]\d{1,14}$",
    "iso8601": r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}",
    "hex_color": r"(?i)#[0-9a-f]{6}$",
    "ipv4": r"(\d{1,3}\.){3}\d{1,3}$",
}
REFERENCE_RANGES = {"PULocationID": (1, 263), "DOLocationID": (1, 263), "VendorID": (1, 4), "payment_type": (1, 6), "RatecodeID": (1, 6)}
ENUMERATIONS = {"store_and_fwd_flag": ["Y", "N"], "trip_type": [1, 2], "passenger_count": list(range(10))}


def in_reference_set(value: Column, field: str, allowed: Iterable | None = None, rule_id: str = "REF001") -> Check:
    """Null is exempt.  Without allowed, the field's known range of whole numbers (1.0 is one, the text "1.0" is not); a field that has none accepts nothing."""
    if allowed is not None:
        ok = value.isin(*allowed) if (allowed := list(allowed)) else F.lit(False)
    elif field in REFERENCE_RANGES:
        whole = F.when(F.typeof(value) == "string", value.cast("string").try_cast("int").cast("double")).otherwise(value.cast("string").try_cast("double"))
        ok = F.coalesce(whole.between(*REFERENCE_RANGES[field]) & (whole == F.floor(whole)), F.lit(False))
    else:
        ok = F.lit(False)
    return Check(rule_id, f"Reference of {field}", "MEDIUM", "REFERENTIAL", F.when(value.isNotNull() & ~ok, "FOREIGN_KEY_NOT_FOUND"), details={"value": value.cast("string")})


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of child whose key is set and not in parent.  Spark broadcasts the distinct keys if their size allows."""
    keys = parent.select(F.col(parent_key).alias("_parent")).distinct()
    return child.where(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("_parent"), "left_anti")


def cardinality(child: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Keys with fewer than low or more than high rows: (key, n)."""
    return child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(~F.col("n").between(low, high))


def format_conforms(value: Column, fmt: str, rule_id: str = "CON001") -> Check:
    """fmt: a named format, or a pattern given as "re:...". Null is exempt."""
    if fmt.startswith("re:"):
        pattern = fmt[3:]
    elif fmt in FORMATS:
        pattern = FORMATS[fmt]
    else:
        raise ValueError(f"unknown format: {fmt}")
    case = "(?i)" if pattern.startswith("(?i)") else ""
    bad = ~value.rlike(f"{case}^(?:{pattern.removeprefix('(?i)')})")
    return Check(rule_id, f"Format {fmt}", "MEDIUM", "CONFORMITY", F.when(value.isNotNull() & bad, "FORMAT_MISMATCH"), details={"value": F.substring(value.cast("string"), 1, 100)})


def precision_conforms(value: Column, places: int, allow_fewer: bool = True, rule_id: str = "CON002") -> Check:
    n = decimal_places(value)
    reason = F.when(n > places, "EXCESSIVE_PRECISION") if allow_fewer else F.when(n != places, "PRECISION_MISMATCH")
    return Check(rule_id, "Decimal places", "LOW", "CONFORMITY", reason, details={"places": n})


def enumeration_conforms(value: Column, field: str, allowed: Iterable | None = None, rule_id: str = "CON003") -> Check:
    values = list(allowed) if allowed is not None else ENUMERATIONS.get(field, [])
    ok = value.isin(*values) if values else F.lit(False)
    return Check(rule_id, f"Enumeration of {field}", "MEDIUM", "CONFORMITY", F.when(value.isNotNull() & ~ok, "INVALID_ENUM_VALUE"), details={"value": value.cast("string")})


def timely(ts: Column, as_of: Column, is_replay: Column | None = None, late: int = 300, very_late: int = 3600, rule_id: str = "TIM001") -> Check:
    delay = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(ts.cast("timestamp"))
    live = ~F.coalesce(is_replay, F.lit(False)) if is_replay is not None else F.lit(True)
    return Check(rule_id, "Record arrives in time", "MEDIUM", "TIMELINESS", F.when(live & (delay > late), "LATE_ARRIVAL"), severity_of=F.when(delay > very_late, "HIGH").otherwise("MEDIUM"), details={"delay_seconds": delay})
