"""Population stability index between a baseline and current data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS, EPSILON, DRIFT = 10, 1e-4, 0.2


def approx_psi(base_p10: Column, base_p90: Column, p10: Column, p90: Column) -> Column:
    """Half the sum of relative changes of two percentiles; null where the baseline has no spread."""
    part = lambda now, then: F.abs(now - then) / F.greatest(then, F.lit(1e-9))
    return F.when(base_p10 != base_p90, 0.5 * (part(p10, base_p10) + part(p90, base_p90)))


def level(psi: Column) -> Column:
    return F.when(psi >= 0.25, "CRITICAL").when(psi >= 0.2, "HIGH").when(psi >= 0.1, "MEDIUM").when(psi >= 0.05, "LOW").when(psi.isNotNull(), "OK")


def is_drift(psi: Column, threshold: float = DRIFT) -> Column:
    return F.coalesce(psi >= threshold, F.lit(False))


def bucket_psi(df: DataFrame, value: str, is_current: str, by: Sequence[str] = (), bins: int = BINS, eps: float = EPSILON, exact: bool = False) -> DataFrame:
    """(by, psi): shares in equal buckets from the baseline's p10 to its p90; the outer buckets take what lies beyond.

    One pass makes the edges, one counts both sides by bucket; empty buckets count as eps.
    """
    q = lambda p: F.percentile(value, F.lit(p)) if exact else F.percentile_approx(value, p, 10_000)
    d = df.where(F.col(value).isNotNull())
    edges = d.where(~F.col(is_current)).groupBy(*by).agg(q(0.1).alias("_lo"), q(0.9).alias("_hi"))
    j = d.join(edges, list(by)) if by else d.crossJoin(F.broadcast(edges))  # edges: one row
    raw = F.floor((F.col(value) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins))
    slot = F.greatest(F.lit(0), F.least(F.lit(bins - 1), raw))
    counts = j.where("_hi > _lo").groupBy(*by, slot.alias("_slot")).agg(F.count(F.when(~F.col(is_current), 1)).alias("_e"), F.count(F.when(F.col(is_current), 1)).alias("_a"))
    totals = counts.groupBy(*by).agg(F.sum("_e").alias("_et"), F.sum("_a").alias("_at"), F.collect_list(F.struct("_slot", "_e", "_a")).alias("_c"))  # bins entries
    spine = F.sequence(F.lit(0), F.lit(bins - 1))

    def term(i: Column) -> Column:
        hit = F.filter("_c", lambda s: s["_slot"] == i)
        e = F.greatest(F.coalesce(F.get(hit, F.lit(0))["_e"], F.lit(0)) / F.col("_et"), F.lit(eps))
        a = F.greatest(F.coalesce(F.get(hit, F.lit(0))["_a"], F.lit(0)) / F.col("_at"), F.lit(eps))
        return (a - e) * F.log(a / e)

    psi = F.aggregate(F.transform(spine, term), F.lit(0.0), lambda acc, x: acc + x)
    return totals.where("_et > 0 AND _at > 0").select(*by, psi.alias("psi"))


def drift_report(baseline: DataFrame, current: DataFrame, by: Sequence[str], threshold: float = DRIFT) -> DataFrame:
    """(by, psi, severity, drift) from two tables of statistics with p10 and p90."""
    b = baseline.select(*by, F.col("p10").alias("_b10"), F.col("p90").alias("_b90"))
    psi = approx_psi(F.col("_b10"), F.col("_b90"), F.col("p10"), F.col("p90"))
    return current.join(b, list(by)).select(*by, psi.alias("psi")).withColumn("severity", level(F.col("psi"))).withColumn("drift", is_drift(F.col("psi"), threshold))


def notify(report: DataFrame, callback) -> int:
    """Calls callback(row) for each drifting key and gives their number; meant for foreachBatch, on one row per key."""
    n = 0
    for row in report.where("drift").toLocalIterator():
        callback(row)
        n += 1
    return n
