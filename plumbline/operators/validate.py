"""Rule validation against ground truth, and statistics that compare detectors and samples."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import cumulative


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def validate_rules(flags: DataFrame, rule: str, hit: str, truth: str | None, max_fpr: float = 0.1, min_precision: float = 0.7, min_coverage: float = 0.001, min_events: int = 100) -> DataFrame:
    """A row per rule: rates and the decision.

    flags has a row per (event, rule) with a boolean hit and, if truth is given, a boolean
    truth (null counts as false).  fpr is the share of hits that are wrong (fdr by its usual
    name, which is given too); without truth every hit counts as wrong.
    """
    t = F.coalesce(F.col(truth), F.lit(False)) if truth else F.lit(False)
    h = F.coalesce(F.col(hit), F.lit(False))
    g = flags.groupBy(rule).agg(F.count(F.lit(1)).alias("events"), F.count_if(h).alias("hits"), F.count_if(h & t).alias("tp"), F.count_if(h & ~t).alias("fp"), F.count_if(~h & t).alias("fn"))
    fpr = safe_ratio(F.col("fp"), F.col("tp") + F.col("fp")) if truth else safe_ratio(F.col("hits"), F.col("events"))
    g = g.withColumns({"fpr": fpr, "fdr": safe_ratio(F.col("fp"), F.col("hits")), "precision": safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe_ratio(F.col("tp"), F.col("tp") + F.col("fn")), "coverage": safe_ratio(F.col("hits"), F.col("events"))})
    why = F.when(F.col("events") < min_events, "INSUFFICIENT_DATA").when(F.col("fpr") > max_fpr, "FPR").when(F.col("coverage") < min_coverage, "COVERAGE")
    if truth:
        why = why.when(F.col("precision") < min_precision, "PRECISION")
    return g.withColumn("rejection", why).withColumn("accepted", F.col("rejection").isNull())


def complementarity(truth: DataFrame, mine: DataFrame, other: DataFrame, key: str = "entity_id", restrict_to_truth: bool = True) -> DataFrame:
    """One row: a both find, b only mine, c only other, d neither; cc, ci, recalls, gain.

    With restrict_to_truth, findings outside of the truth do not count; else they do, as they
    stand in the detectors' sets.
    """
    t = truth.select(key).distinct().withColumn("_t", F.lit(True))
    m = mine.select(key).distinct().withColumn("_m", F.lit(True))
    o = other.select(key).distinct().withColumn("_o", F.lit(True))
    j = t.join(m, key, "full_outer").join(o, key, "full_outer").select(*[F.coalesce(c, F.lit(False)).alias(c) for c in ("_t", "_m", "_o")])
    inside = F.col("_t") if restrict_to_truth else F.lit(True)
    g = j.agg(
        F.count_if(inside & F.col("_m") & F.col("_o")).alias("a"), F.count_if(inside & F.col("_m") & ~F.col("_o")).alias("b"), F.count_if(inside & ~F.col("_m") & F.col("_o")).alias("c"),
        F.count_if(F.col("_t") & ~F.col("_m") & ~F.col("_o")).alias("d"), F.count_if("_t").alias("n_truth"), F.count_if(F.col("_t") & F.col("_m")).alias("_tm"), F.count_if(F.col("_t") & F.col("_o")).alias("_to"), F.count_if(F.col("_t") & (F.col("_m") | F.col("_o"))).alias("_both"),
    )
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    g = g.withColumns({"cc": safe_ratio(F.col("b"), F.col("b") + F.col("d")), "ci": safe_ratio(F.col("b"), n), "recall_mine": safe_ratio(F.col("_tm"), F.col("n_truth")), "recall_other": safe_ratio(F.col("_to"), F.col("n_truth")), "recall_union": safe_ratio(F.col("_both"), F.col("n_truth"))})
    return g.withColumn("gain", F.col("recall_union") - F.col("recall_other")).withColumn("mcnemar", mcnemar_statistic(F.col("b"), F.col("c"))).drop("_tm", "_to", "_both")


def mcnemar_statistic(b: Column, c: Column) -> Column:
    """With continuity correction; 0 where nothing differs."""
    return F.when(b + c > 0, (F.abs(b - c) - 1) * (F.abs(b - c) - 1) / (b + c)).otherwise(0.0)


def chi2_p(statistic: float) -> float:
    """Upper tail of chi square with one degree of freedom."""
    return math.erfc(math.sqrt(max(0.0, statistic) / 2))


def is_complementary(b: int, c: int, cc: float, p: float, least: int = 30, least_cc: float = 0.30, alpha: float = 0.05) -> bool:
    return b + c >= least and cc >= least_cc and p < alpha


def bootstrap_cc(a: int, b: int, c: int, d: int, resamples: int = 1000, seed: int = 42) -> tuple[float, float]:
    """95 % interval of b / (b + d): only the counts matter, so they are resampled."""
    n = a + b + c + d
    if not n:
        return 0.0, 0.0
    draw = np.random.Generator(np.random.PCG64(seed)).multinomial(n, np.array([a, b, c, d]) / n, size=resamples)
    total = draw[:, 1] + draw[:, 3]
    cc = np.where(total > 0, draw[:, 1] / np.maximum(total, 1), 0.0)
    return float(np.percentile(cc, 2.5)), float(np.percentile(cc, 97.5))


def chi_square_2x2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Pearson's statistic of a 2 x 2 table; 0 where a margin is empty."""
    n, cross = (a + b + c + d).cast("double"), (a * d - b * c).cast("double")
    margins = (a + b).cast("double") * (c + d) * (a + c) * (b + d)
    return F.when(margins > 0, n * cross * cross / margins).otherwise(0.0)


def ks_two_sample(df: DataFrame, value: str, is_second: str, slices: int = 256) -> DataFrame:
    """One row: the statistic, both sizes, and the critical value at 5 %.

    Counts by value come first.  Running sums then go over the distinct values within slices
    of equal width, on top of what the slices before hold, so no task sorts all values.
    """
    d = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count_if(~F.col(is_second)).alias("c1"), F.count_if(is_second).alias("c2"))
    sizes = d.agg(F.sum("c1").alias("n1"), F.sum("c2").alias("n2"))  # one row
    run = cumulative(d, "v", {"r1": F.col("c1"), "r2": F.col("c2")}, slices).crossJoin(F.broadcast(sizes))
    out = run.groupBy("n1", "n2").agg(F.max(F.abs(F.try_divide("r1", "n1") - F.try_divide("r2", "n2"))).alias("statistic"))
    return out.withColumn("critical", F.lit(1.36) * F.sqrt(F.try_divide(F.col("n1") + F.col("n2"), F.col("n1") * F.col("n2")))).select("statistic", "n1", "n2", "critical")


def wilson(successes: Column, n: Column, z: float = 1.959964) -> tuple[Column, Column]:
    """Wilson's interval of a share."""
    p = successes / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, centre - half), F.when(n > 0, centre + half)


def match_truth(injected: DataFrame, found: DataFrame, key: str = "entity_index", rule: str = "rule_id", kind: str = "anomaly_type") -> DataFrame:
    """(kind, rule, tp): exact matches of findings and injected anomalies; null kind: findings of clean records, null rule: missed."""
    f = found.select(key, rule).distinct()
    return injected.select(key, kind).distinct().join(f, key, "full_outer").groupBy(kind, rule).agg(F.count(F.lit(1)).alias("n"))


def precision_recall(injected: DataFrame, found: DataFrame, key: str = "entity_index", by: str = "rule_id") -> DataFrame:
    """Per rule tp, fp and precision, and recall over all injected records."""
    inj = injected.select(key).distinct().withColumn("_i", F.lit(True))
    total = inj.agg(F.count(F.lit(1)).alias("n_injected"))
    f = found.select(key, by).distinct().join(inj, key, "left")
    g = f.groupBy(by).agg(F.count_if(F.col("_i").isNotNull()).alias("tp"), F.count_if(F.col("_i").isNull()).alias("fp")).crossJoin(total)
    return g.withColumns({"precision": safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe_ratio(F.col("tp"), F.col("n_injected"))})


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: Pearson's and Spearman's correlation; ranks of ties are averaged."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def ranks(frame: DataFrame, c: str, name: str) -> DataFrame:
        counts = frame.groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        r = cumulative(counts, c, {"_upto": F.col("_n")}).select(c, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name))
        return frame.join(r, c)

    both = ranks(ranks(d, x, "_rx"), y, "_ry")
    return both.agg(F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"))


def cohens_d(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: standardised difference of the means of two groups (a boolean column); null where they have no spread or too few rows."""
    g = df.agg(*[f.alias(n) for n, f in (("m1", F.avg(F.when(F.col(group), F.col(value)))), ("m0", F.avg(F.when(~F.col(group), F.col(value)))), ("v1", F.var_samp(F.when(F.col(group), F.col(value)))), ("v0", F.var_samp(F.when(~F.col(group), F.col(value)))), ("n1", F.count(F.when(F.col(group), F.col(value)))), ("n0", F.count(F.when(~F.col(group), F.col(value)))))])
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0"), F.col("n1") + F.col("n0") - 2))
    return g.select(F.try_divide(F.col("m1") - F.col("m0"), pooled).alias("cohens_d"))
