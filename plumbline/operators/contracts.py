"""Data contracts: rule gating, field constraints, tiers, the agreed violation rate."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .finding import Check, first_of

#: Tiers from the most lenient on, with the share of records that must be clean.
TIERS = {"BRONZE": 0.85, "SILVER": 0.90, "GOLD": 0.95}
TYPES = {"float": "double", "double": "double", "int": "int", "integer": "int", "long": "bigint", "string": "string", "bool": "boolean", "boolean": "boolean", "timestamp": "timestamp"}


@dataclass(frozen=True)
class FieldContract:
    name: str
    data_type: str = "string"
    nullable: bool = True
    min_value: float | None = None
    max_value: float | None = None
    allowed_values: tuple | None = None
    description: str = ""

    def reason(self, c: Column) -> Column:
        kind = TYPES.get(self.data_type, self.data_type)
        typed = c if kind == "string" else c.try_cast(kind)
        pairs: list[tuple[Column, str]] = []
        if not self.nullable:
            pairs.append((c.isNull(), "NULL"))
        if kind != "string":
            pairs.append((c.isNotNull() & typed.isNull(), "TYPE_MISMATCH"))
        if self.min_value is not None:
            pairs.append((typed < self.min_value, "BELOW_MINIMUM"))
        if self.max_value is not None:
            above = typed > self.max_value
            pairs.append((above & ~F.isnan(typed) if kind == "double" else above, "ABOVE_MAXIMUM"))
        if self.allowed_values is not None:
            pairs.append((c.isNotNull() & ~c.isin(*self.allowed_values), "NOT_ALLOWED"))
        return first_of(*pairs) if pairs else F.lit(None).cast("string")


@dataclass(frozen=True)
class Contract:
    name: str
    version: str = "v1"
    tier: str = "BRONZE"
    owner: str = ""
    description: str = ""
    required_rules: tuple[str, ...] = ()
    optional_rules: tuple[str, ...] = ()
    suppressed_rules: tuple[str, ...] = ()
    sla_max_violation_rate: float = 1.0
    fields: tuple[FieldContract, ...] = field(default_factory=tuple)

    def __post_init__(self):
        if self.tier not in TIERS:
            raise ValueError(f"unknown tier: {self.tier}")
        if not 0.0 <= self.sla_max_violation_rate <= 1.0:
            raise ValueError("sla_max_violation_rate must be from 0 to 1")

    def gate(self, rules: list[str]) -> list[str]:
        """The rules that run: required or optional ones (all, if none are named), less suppressed ones."""
        named = set(self.required_rules) | set(self.optional_rules)
        return [r for r in rules if r not in self.suppressed_rules and (not named or r in named)]

    def gated(self, checks: list[Check]) -> list[Check]:
        kept = set(self.gate([c.rule_id for c in checks]))
        return [c for c in checks if c.rule_id in kept]

    def field_checks(self) -> list[Check]:
        return [Check(f"FIELD_{f.name}", f"Contract of {f.name}", "MEDIUM", "CONTRACT", f.reason(F.col(f.name))) for f in self.fields]


def load_contract(path: str | Path) -> Contract:
    data = yaml.safe_load(Path(path).read_text())
    if not isinstance(data, dict) or "name" not in data:
        raise ValueError(f"{path}: a contract needs a name")
    fields = []
    for f in data.get("fields") or []:
        if "name" not in f:
            raise ValueError(f"{path}: a field needs a name")
        known = {k: f[k] for k in ("name", "data_type", "nullable", "min_value", "max_value", "description") if k in f}
        fields.append(FieldContract(**known, allowed_values=tuple(f["allowed_values"]) if f.get("allowed_values") is not None else None))
    lists = {k: tuple(data.get(k) or ()) for k in ("required_rules", "optional_rules", "suppressed_rules")}
    rest = {k: data[k] for k in ("version", "tier", "owner", "description", "sla_max_violation_rate") if k in data}
    return Contract(name=data["name"], fields=tuple(fields), **lists, **rest)


def evaluate(by_rule: DataFrame, total: DataFrame, contract: Contract) -> DataFrame:
    """One row: the achieved tier and what is missing.

    by_rule: (rule_id, n), a row per rule; total: one row (total).  The achieved tier is the
    strictest whose bound holds, and the lowest one even if none does.
    """
    v = by_rule.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"), F.collect_set("rule_id").alias("fired"))  # rules, not records
    j = total.crossJoin(v)
    rate = F.when(F.col("total") > 0, F.col("violations") / F.col("total")).otherwise(1.0)
    tier = F.lit("BRONZE")
    for name, clean in TIERS.items():
        tier = F.when(F.col("rate") <= F.lit(1 - clean), name).otherwise(tier)
    rank = {n: i for i, n in enumerate(TIERS)}
    number = F.lit(0)
    for n, i in rank.items():
        number = F.when(F.col("tier_achieved") == n, i).otherwise(number)
    need = F.lit(1 - TIERS[contract.tier])
    out = j.withColumn("rate", rate).withColumn("tier_achieved", F.when(F.col("total") > 0, tier))
    out = out.withColumn("tier_met", F.coalesce((F.col("total") > 0) & (number >= rank[contract.tier]), F.lit(False)))
    out = out.withColumn("sla_met", F.col("rate") <= F.lit(contract.sla_max_violation_rate))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(r) for r in contract.required_rules]).cast("array<string>"), "fired"))
    gap = F.when(F.col("total") == 0, "No records to evaluate").when(~F.col("tier_met"), F.concat(F.lit("Violation rate exceeds the bound of "), F.lit(contract.tier), F.lit(" by "), F.round(F.col("rate") - need, 4).cast("string"))).otherwise("")
    return out.select(F.lit(contract.name).alias("contract"), F.lit(contract.tier).alias("tier_required"), "total", "violations", F.bround("rate", 4).alias("violation_rate"), "tier_achieved", "tier_met", "sla_met", missing.alias("missing_rules"), gap.alias("gap"))
