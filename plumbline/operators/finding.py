"""Checks as Columns: one struct per check, all checks of a table in one scan.

A Check holds a Column that gives a reason code, or null where the record passes; further
Columns may give the severity and details.  ``findings`` first filters the records with any
reason, which is compiled code over plain Columns, and only for those packs all checks into
an array and explodes it.  So a thousand checks still read a table once, and details and
snapshots are made for violating rows only.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    rule_id: str
    name: str
    severity: str
    violation_type: str
    reason: Column
    #: Column where the severity depends on the record.
    severity_of: Column | None = None
    details: dict[str, Column] = field(default_factory=dict)
    expected: dict[str, Column] = field(default_factory=dict)
    enabled: bool = True

    def struct(self, details: bool = True, reason: Column | None = None) -> Column:
        """The finding, null where there is none; reason: a column that has the reason already."""
        reason = self.reason if reason is None else reason
        text = lambda d: F.to_json(F.struct(*[c.alias(k) for k, c in d.items()])) if d else F.lit(None).cast("string")
        severity = self.severity_of if self.severity_of is not None else F.lit(self.severity)
        fields = [F.lit(self.rule_id).alias("rule_id"), F.lit(self.name).alias("rule_name"), severity.alias("severity"), F.lit(self.violation_type).alias("violation_type"), reason.alias("reason")]
        if details:
            fields += [text(self.details).alias("details"), text(self.expected).alias("expected")]
        return F.when(reason.isNotNull(), F.struct(*fields))

    def with_severity(self, severity: str) -> "Check":
        return replace(self, severity=severity, severity_of=None)


def findings(df: DataFrame, checks: Sequence[Check], keep: Sequence[str] = (), snapshot: Sequence[str] = (), details: bool = True) -> DataFrame:
    """A row per finding: the columns in keep, the finding's fields, and record_snapshot if columns are named for it."""
    live = [c for c in checks if c.enabled]
    if not live:
        raise ValueError("no check is enabled")
    if len(live) == 1:
        rows = df.where(live[0].reason.isNotNull()).select(*keep, *[c for c in snapshot if c not in keep], live[0].struct(details).alias("_f"))
        return rows.select(*keep, "_f.*", *([F.to_json(F.struct(*snapshot)).alias("record_snapshot")] if snapshot else []))
    # a generator keeps the reasons from being put in again wherever they are used
    made = df.select("*", F.explode(F.array(F.struct(*[c.reason.alias(f"r{i}") for i, c in enumerate(live)]))).alias("_reasons"))
    of = [F.col(f"_reasons.r{i}") for i in range(len(live))]
    hit = made.where(F.coalesce(*of).isNotNull())
    each = F.filter(F.array(*[c.struct(details, r) for c, r in zip(live, of)]), lambda f: f.isNotNull())
    rows = hit.select(*keep, *[c for c in snapshot if c not in keep], F.explode(each).alias("_f"))
    extra = [F.to_json(F.struct(*snapshot)).alias("record_snapshot")] if snapshot else []
    return rows.select(*keep, "_f.*", *extra)


def first_of(*pairs: tuple[Column, str]) -> Column:
    """The reason of the first condition that holds; a condition that is null does not."""
    out = None
    for condition, reason in pairs:
        out = F.when(condition, reason) if out is None else out.when(condition, reason)
    return out
