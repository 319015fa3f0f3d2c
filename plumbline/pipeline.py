"""The whole way in one call: registry, contract, checks, statistics, store, quality events, alerts.

``Pipeline.process`` takes a batch, ``Pipeline.start`` a stream.  Both read the records once
for all stateless checks; checks across records run on their own keys.  Findings are written
to the store, and what follows (summary, quality events, alerts) reads them there.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .functions.scalars import fingerprint, parse_epoch_or_time
from .operators import alerts, contracts, duplicates, motion, profile, reports, stats
from .operators.finding import findings
from .sources.config import Registry, default_registry, load_rules
from .streaming.pipeline import FindingStore, in_batches

STAGES = ("idle", "profiling", "monitoring")


@dataclass(frozen=True)
class Entity:
    """Where an entity's records have what the pipeline needs; time is text or a timestamp."""

    kind: str
    id: str
    time: str
    adaptive: tuple[str, ...]
    fingerprint: tuple[str, ...]


#: The entities that have default rules.
ENTITIES = {
    "nyc_taxi": Entity("nyc_taxi", "trip_id", "tpep_pickup_datetime", ("fare_amount", "trip_distance"), ("trip_id", "tpep_pickup_datetime", "PULocationID", "fare_amount")),
    "gtfs": Entity("gtfs", "vehicle_id", "timestamp", ("speed",), ("vehicle_id", "timestamp", "latitude", "longitude")),
}


@dataclass
class Result:
    """What a batch gave: tables, and counts as a dictionary."""

    found: DataFrame
    summary: DataFrame
    quality: DataFrame
    statistics: DataFrame
    metrics: dict = field(default_factory=dict)


class Pipeline:
    def __init__(
        self, spark: SparkSession, entity: str | Entity, as_of: Column | None = None, contract: contracts.Contract | None = None, rules: str | Path | None = None, store: str | None = None,
        router: alerts.Router | None = None, order: str = "arrival", arrived: str | None = None, source: str | None = None, batch: str | None = None, is_replay: str | None = None, window: str = "5 minutes",
    ):
        """order: a whole number that tells the order of arrival; arrived: the time to go by instead of the entity's own."""
        self.spark, self.entity = spark, entity if isinstance(entity, Entity) else ENTITIES[entity]
        as_of = F.current_timestamp() if as_of is None else as_of
        registry = default_registry(self.entity.kind, as_of)
        if rules is not None:
            registry.checks = {c.rule_id: c for c in load_rules(rules, as_of)}
        self.registry: Registry = registry.gated(contract) if contract else registry
        self.contract, self.router, self.window = contract, router, window
        self.order, self.arrived, self.source, self.batch, self.is_replay = order, arrived, source, batch, is_replay
        folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        self.store = FindingStore(spark, store or f"{folder.rstrip('/')}/findings-{uuid.uuid4().hex}")
        self.reset()

    def reset(self) -> None:
        """Forgets what was counted and profiled; the store stays."""
        self.stage = STAGES[0]
        self.totals: dict = {"total_events": 0, "total_violations": 0, "by_rule": {}, "by_type": {}, "by_severity": {}}
        self.profile: DataFrame | None = None

    def profile_dataset(self, records: DataFrame, exact_distinct: bool = False) -> DataFrame:
        self.stage = STAGES[1]
        try:
            self.profile = profile.profile(records, exact_distinct)
        finally:
            self.stage = STAGES[0]
        return self.profile

    def _placed(self, records: DataFrame) -> DataFrame:
        e = self.entity
        time = F.col(self.arrived) if self.arrived else parse_epoch_or_time(F.col(e.time))
        return records.withColumns({"entity_id": F.col(e.id).cast("string"), "event_time": time, "arrival": F.col(self.order).cast("long")})

    def _across(self, d: DataFrame, keep: Sequence[str]) -> list[DataFrame]:
        """Findings of the checks across records that the registry has."""
        names, parts = self.registry.stateful, []
        if {"latitude", "longitude"} <= set(d.columns) and {"CRS001", "CRS002", "GTFSCRS001"} & names.keys():
            checks = [c for c in [*motion.motion_checks(ts="event_time"), motion.transit_motion_check(ts="event_time")] if c.rule_id in names]
            parts.append(findings(motion.with_previous(d, self.entity.id, "arrival", ts="event_time"), checks, keep))
        made = lambda df, rule, name, kind, severity, reason: df.select(*keep, F.lit(rule).alias("rule_id"), F.lit(name).alias("rule_name"), severity.alias("severity"), F.lit(kind).alias("violation_type"), F.lit(reason).alias("reason"), F.lit(None).cast("string").alias("details"), F.lit(None).cast("string").alias("expected"))
        if {"CRS003", "GTFSCRS002"} & names.keys():
            keyed = d.where("event_time IS NOT NULL").withColumns({
                "_key": fingerprint(*[F.col(c) for c in self.entity.fingerprint]), "_source": F.col(self.source) if self.source else F.lit(None).cast("string"),
                "_batch": F.col(self.batch) if self.batch else F.lit(None).cast("string"), "_replay": F.col(self.is_replay) if self.is_replay else F.lit(False),
            }).select(*keep, "_key", "_source", "_batch", "_replay")
            if "CRS003" in names:
                parts.append(made(duplicates.duplicates(keyed, "_key", "event_time", "arrival", "_source", "_batch", "_replay"), "CRS003", "Record is no duplicate", "CROSS_RECORD", F.col("severity"), "DUPLICATE"))
            if "GTFSCRS002" in names:
                parts.append(made(duplicates.repeated_positions(keyed, "_key", "event_time", "arrival"), "GTFSCRS002", "Position is no repeat", "CROSS_RECORD", F.lit("MEDIUM"), "DUPLICATE"))
        return parts

    def found_in(self, records: DataFrame, across: bool = True) -> DataFrame:
        """Findings of all checks: entity_id, event_time, arrival and the finding's fields."""
        d, keep = self._placed(records), ["entity_id", "event_time", "arrival"]
        checks = [*self.registry.checks.values(), *(self.contract.field_checks() if self.contract else [])]
        parts = [findings(d, checks, keep)] if checks else []
        parts += self._across(d, keep) if across else []
        if not parts:
            raise ValueError("no rule is left to run")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def process(self, records: DataFrame, across: bool = True) -> Result:
        """All stages over a batch.  The counts add up over batches until reset."""
        run = uuid.uuid4().hex
        self.store.append(self.found_in(records, across).withColumn("run", F.lit(run)))
        found = self.store.read_run(run)
        d = self._placed(records)
        self._count(d.count(), found)
        self.stage = STAGES[2]
        rules = [*self.registry.checks, *(self.registry.stateful if across else ())]
        quality = reports.quality_events(d.where("event_time IS NOT NULL"), found.where("event_time IS NOT NULL"), "event_time", rules, self.window)
        if self.router:
            self.totals["alerts"] = self.router.route(alerts.to_send(found.where("event_time IS NOT NULL"), "event_time", "arrival"))
        numbers = [c for c in self.entity.adaptive if c in records.columns]
        statistics = stats.field_stats(records.select(*[F.col(c).try_cast("double").alias(c) for c in numbers]), numbers)
        return Result(found, reports.summary(found), quality, statistics, self.metrics())

    def _count(self, events: int, found: DataFrame) -> None:
        self.totals["total_events"] += events
        names = {"rule_id": "by_rule", "violation_type": "by_type", "severity": "by_severity"}
        for r in reports.summary(found).collect():  # a row per rule, type and severity
            if r["dimension"] == "total":
                self.totals["total_violations"] += r["n"]
            else:
                of = self.totals[names[r["dimension"]]]
                of[r["key"]] = of.get(r["key"], 0) + r["n"]

    def metrics(self) -> dict:
        t = self.totals
        return {**t, "violation_rate": t["total_violations"] / max(t["total_events"], 1), "lifecycle_stage": self.stage}

    def evaluated(self) -> DataFrame:
        """The contract held against what was counted."""
        if not self.contract:
            raise ValueError("there is no contract")
        by_rule = self.spark.createDataFrame(list(self.totals["by_rule"].items()) or [], "rule_id string, n long")
        total = self.spark.createDataFrame([(self.totals["total_events"],)], "total long")
        return contracts.evaluate(by_rule, total, self.contract)

    def start(self, stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        """Micro-batches through the stateless checks, the store and the alerts.

        Checks across records need state beyond a batch: ``streaming.stateful`` has them as
        queries of their own.
        """
        return in_batches(stream, lambda batch, _: self.process(batch, across=False) and None, checkpoint, once)


def summary_rows(result: Result) -> DataFrame:
    """(dimension, key, n): the summary, the number of events, and the stage."""
    m = result.metrics
    spark = result.summary.sparkSession
    return result.summary.unionByName(spark.createDataFrame([("events", "total", m["total_events"]), ("stage", m["lifecycle_stage"], 1)], "dimension string, key string, n long"))
