"""Rules, contracts and zones from YAML, compiled to checks before a plan is built."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.context import external
from ..functions.scalars import parse_epoch_or_time, parse_time, seconds_between
from ..operators import taxi_checks as taxi
from ..operators import transit_checks as transit
from ..operators.finding import Check

SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def _taxi_context() -> Column:
    return external(parse_time(F.col("tpep_pickup_datetime")))


def _seconds() -> Column:
    return seconds_between(parse_time(F.col("tpep_pickup_datetime")), parse_time(F.col("tpep_dropoff_datetime")))


def _fare_range(rule_id: str, p: dict, as_of: Column) -> Check:
    field = p.get("field", "fare_amount")
    mode = p.get("threshold", {}).get("mode", "static")
    stats = (F.col("stat.p10"), F.col("stat.p90")) if mode in ("adaptive", "global", "context") else (None, None)
    low, high = taxi.fare_bounds(_taxi_context(), F.col("trip_distance"), *stats)
    return taxi.fare_range(F.col(field), low, high, rule_id)


#: Check makers by the type name that YAML gives (fixed names).
TYPES: dict[str, Callable[[str, dict, Column], Check]] = {
    "CompletenessRule": lambda i, p, a: taxi.completeness(taxi.required(p.get("required_fields", ["fare_amount", "PULocationID", "tpep_pickup_datetime"])), i),
    "FareAmountRangeRule": lambda i, p, a: taxi.fare_valid(F.col(p.get("field", "fare_amount")), i),
    "PickupLocationValidRule": lambda i, p, a: taxi.zone_valid(F.col(p.get("field", "PULocationID")), rule_id=i),
    "TimestampNotFutureRule": lambda i, p, a: taxi.not_future(F.col(p.get("field", "tpep_pickup_datetime")), parse_time(F.col(p.get("field", "tpep_pickup_datetime"))), a, p.get("tolerance_seconds", taxi.FUTURE_SECONDS), i),
    "FareRangeRule": _fare_range,
    "TripDurationSanityRule": lambda i, p, a: taxi.duration_sane(_seconds(), _taxi_context(), rule_id=i),
    "AverageSpeedSanityRule": lambda i, p, a: taxi.speed_sane(F.col("trip_distance"), _seconds(), _taxi_context(), rule_id=i),
    "GTFSVehicleIDValidRule": lambda i, p, a: transit.vehicle_id_valid(F.col("vehicle_id"), i),
    "GTFSLatLongRangeRule": lambda i, p, a: transit.position_valid(F.col("latitude"), F.col("longitude"), rule_id=i),
    "GTFSSpeedRangeRule": lambda i, p, a: transit.speed_valid(F.col("speed"), i),
    "GTFSImpossibleSpeedRule": lambda i, p, a: transit.speed_possible(F.col("speed"), i),
    "GTFSStaleDataRule": lambda i, p, a: transit.not_stale(F.col("timestamp"), parse_epoch_or_time(F.col("timestamp")), a, rule_id=i),
}


def compile_rule(path: str | Path, as_of: Column, honor_severity: bool = False) -> Check:
    """The check of one file.  A rule's own severity holds unless honor_severity takes the file's."""
    data = yaml.safe_load(Path(path).read_text())
    rule = (data or {}).get("rule")
    if not isinstance(rule, dict):
        raise ValueError(f"{path}: no rule")
    absent = [k for k in ("id", "name", "type", "severity") if k not in rule]
    if absent:
        raise ValueError(f"{path}: missing {', '.join(absent)}")
    if rule["type"] not in TYPES:
        raise ValueError(f"{path}: unknown rule type {rule['type']}")
    if rule["severity"] not in SEVERITIES:
        raise ValueError(f"{path}: unknown severity {rule['severity']}")
    check = TYPES[rule["type"]](rule["id"], rule.get("parameters") or {}, as_of)
    if honor_severity:
        check = check.with_severity(rule["severity"])
    return check if rule.get("enabled", True) else Check(**{**check.__dict__, "enabled": False})


def load_rules(folder: str | Path, as_of: Column, honor_severity: bool = False) -> list[Check]:
    """The enabled rules of a folder, by file name; the first bad file stops the load."""
    folder = Path(folder)
    if not folder.is_dir():
        raise FileNotFoundError(folder)
    return [c for f in sorted(folder.glob("*.yaml")) if (c := compile_rule(f, as_of, honor_severity)).enabled]


def load_zones(path: str | Path) -> tuple[list[tuple[int, str, str]], list[int]]:
    """(zones, least samples per level) of a context file."""
    data = yaml.safe_load(Path(path).read_text())
    zones = [(int(z["location_id"]), z["zone_name"], z["borough"]) for z in data.get("zones", [])]
    levels = sorted(data.get("hierarchy", []), key=lambda x: x["level"])
    return zones, [int(x.get("min_samples", 100)) for x in levels]


class Registry:
    """Checks and stateful transforms of an entity type, gated by a contract."""

    def __init__(self):
        self.checks: dict[str, Check] = {}
        self.stateful: dict[str, Callable] = {}

    def register(self, check: Check) -> None:
        self.checks[check.rule_id] = check

    def register_stateful(self, rule_id: str, transform: Callable) -> None:
        self.stateful[rule_id] = transform

    def register_validated(self, check: Check, validation: dict) -> bool:
        """Registers a check only if its validation row says accepted."""
        if validation.get("accepted"):
            self.register(check)
            return True
        return False

    def gated(self, contract) -> "Registry":
        kept = set(contract.gate([*self.checks, *self.stateful]))
        r = Registry()
        r.checks = {k: v for k, v in self.checks.items() if k in kept}
        r.stateful = {k: v for k, v in self.stateful.items() if k in kept}
        return r

    def summary(self) -> dict:
        return {"stateless": sorted(self.checks), "stateful": sorted(self.stateful), "total": len(self.checks) + len(self.stateful)}


def default_registry(entity_type: str, as_of: Column) -> Registry:
    """The rules that an entity type has without configuration."""
    from ..operators import duplicates, motion

    r = Registry()
    names = {
        "nyc_taxi": [("SYN000", "CompletenessRule"), ("SYN001", "FareAmountRangeRule"), ("SYN002", "PickupLocationValidRule"), ("SYN003", "TimestampNotFutureRule"), ("SEM001", "FareRangeRule"), ("SEM002", "TripDurationSanityRule"), ("SEM003", "AverageSpeedSanityRule")],
        "gtfs": [("GTFSSyn001", "GTFSVehicleIDValidRule"), ("GTFSSyn002", "GTFSLatLongRangeRule"), ("GTFSSyn003", "GTFSSpeedRangeRule"), ("GTFSSem001", "GTFSImpossibleSpeedRule"), ("GTFSSem002", "GTFSStaleDataRule")],
    }
    if entity_type not in names:
        raise ValueError(f"unknown entity type: {entity_type}")
    for rule_id, kind in names[entity_type]:
        r.register(TYPES[kind](rule_id, {}, as_of))
    if entity_type == "nyc_taxi":
        r.register_stateful("CRS003", duplicates.duplicates)
    else:
        r.register_stateful("GTFSCRS001", motion.transit_motion_check)
        r.register_stateful("GTFSCRS002", duplicates.repeated_positions)
    r.register_stateful("CRS001", motion.motion_checks)
    r.register_stateful("CRS002", motion.motion_checks)
    return r
