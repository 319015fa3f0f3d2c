"""Duplicates by fingerprint: confidence from time, source and count, then clusters.

Confidence needs the occurrence before (lag), and how many there were within the window.
Simultaneous ones count in order of arrival: a range frame up to now, less those at the same
time, plus the earlier of those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .greedy import anchored

WINDOW_SECONDS, AT_ONCE_SECONDS, DECAY_SECONDS, CLUSTER_SECONDS = 3600, 5.0, 300.0, 10.0
SUPPRESS, HIGH = 0.4, 0.7


def score(dt: Column, same_batch: Column, same_source: Column, n_prior: Column) -> Column:
    """Half time, three tenths source, two tenths count; 0 without a prior occurrence."""
    t = F.when(dt <= AT_ONCE_SECONDS, 1.0).otherwise(F.exp(-dt / F.lit(DECAY_SECONDS)))
    s = F.when(same_batch, 1.0).when(same_source, 0.5).otherwise(0.0)
    f = F.when(n_prior >= 2, 1.0).otherwise(0.5)
    c = F.lit(0.5) * t + F.lit(0.3) * s + F.lit(0.2) * f
    return F.when(n_prior > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))).otherwise(0.0)


def with_confidence(df: DataFrame, key: str, ts: str, order: str, source: str, batch: str, window: int = WINDOW_SECONDS) -> DataFrame:
    """Adds n_prior and confidence.  One shuffle by key serves all windows."""
    o = Window.partitionBy(key).orderBy("_us", order)
    span = Window.partitionBy(key).orderBy("_us").rangeBetween(-window * 1_000_000, Window.currentRow)
    same = Window.partitionBy(key, "_us")
    d = df.withColumn("_us", F.unix_micros(ts))
    d = d.withColumns({
        "n_prior": F.count(F.lit(1)).over(span) - F.count(F.lit(1)).over(same) + F.row_number().over(same.orderBy(order)) - 1,
        "_dt": (F.col("_us") - F.lag("_us").over(o)) / F.lit(1_000_000.0),
        "_source": F.lag(source).over(o), "_batch": F.lag(batch).over(o),
    })
    same_source = F.col("_source").eqNullSafe(F.col(source))
    same_batch = same_source & F.col("_batch").isNotNull() & (F.col("_batch") == F.col(batch))
    return d.withColumn("confidence", score(F.col("_dt"), same_batch, same_source, F.col("n_prior"))).drop("_dt", "_source", "_batch")


def duplicates(df: DataFrame, key: str, ts: str, order: str, source: str, batch: str, is_replay: str | None = None, cluster: float = CLUSTER_SECONDS) -> DataFrame:
    """CRS003: the emitted duplicates with confidence, severity and n_prior.

    Replayed events are never duplicates.  Below the suppression threshold nothing is emitted;
    of the others, the first of each anchored cluster.
    """
    live = df if is_replay is None else df.where(~F.coalesce(F.col(is_replay), F.lit(False)))
    scored = with_confidence(live, key, ts, order, source, batch).where(F.col("confidence") > SUPPRESS)
    scored = scored.withColumn("_t", F.col("_us") / F.lit(1_000_000.0)).drop("_us")
    out = anchored(scored, key, "_t", order, cluster).where("opens").drop("opens", "_t")
    return out.withColumn("severity", F.when(F.col("confidence") > HIGH, "HIGH").otherwise("MEDIUM"))


def repeated_positions(df: DataFrame, key: str, ts: str, order: str, within: float = 300.0) -> DataFrame:
    """GTFSCRS002: rows that come within so many seconds of the first seen of their key (the row that opened the window)."""
    d = df.withColumn("_t", F.unix_micros(ts) / F.lit(1_000_000.0))
    # a repeat counts up to and with the limit, so the window ends just after it
    return anchored(d, key, "_t", order, within + 1e-6).where(~F.col("opens")).drop("opens", "_t")


def evidence_count(df: DataFrame, key: str, ts: str, window: int = WINDOW_SECONDS) -> DataFrame:
    """Evidence that each event finds for its key, itself included."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(ts)).rangeBetween(-window * 1_000_000, Window.currentRow)
    return df.withColumn("n_evidence", F.count(F.lit(1)).over(w))
