"""Counts, latencies, quality events, monitoring conditions and composite scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import cumulative


def summary(found: DataFrame, by: Sequence[str] = ("rule_id", "severity", "violation_type")) -> DataFrame:
    """(dimension, key, n) for each dimension and in total, by grouping sets over one scan."""
    sets = [[F.col(c)] for c in by] + [[]]
    g = found.groupingSets(sets, *by).agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"))
    full = (1 << len(by)) - 1
    dim, key = F.lit("total"), F.lit("total")
    for i, c in enumerate(by):
        mine = F.col("gid") == full - (1 << (len(by) - 1 - i))
        dim, key = F.when(mine, c).otherwise(dim), F.when(mine, F.col(c)).otherwise(key)
    return g.select(dim.alias("dimension"), key.alias("key"), "n")


def violation_rate(found: DataFrame, events: DataFrame) -> DataFrame:
    v, e = found.agg(F.count(F.lit(1)).alias("violations")), events.agg(F.count(F.lit(1)).alias("events"))
    return v.crossJoin(e).withColumn("rate", F.col("violations") / F.greatest("events", F.lit(1)))


def nearest_rank(df: DataFrame, value: str, by: Sequence[str] = (), p: Sequence[float] = (0.5, 0.99)) -> DataFrame:
    """sorted[floor(n p)] of each group.  Counts by value and running sums: no group's values are gathered."""
    d = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    if by:
        w = Window.partitionBy(*by)
        d = d.withColumns({"_upto": F.sum("_c").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("_c").over(w)})
    else:
        d = cumulative(d, "_v", {"_upto": F.col("_c")}).crossJoin(F.broadcast(d.agg(F.sum("_c").alias("_n"))))  # one row
    picks = [F.min(F.when(F.col("_upto") > F.floor(F.col("_n") * F.lit(x)), F.col("_v"))).alias(f"p{round(x * 100)}") for x in p]
    return d.groupBy(*by).agg(*picks)


def rule_health(labelled: DataFrame) -> DataFrame:
    """tp / (tp + fp) per rule, from a boolean column is_true."""
    return labelled.groupBy("rule_id").agg(F.count_if("is_true").alias("tp"), F.count_if(~F.col("is_true")).alias("fp"), (F.count_if("is_true") / F.count(F.lit(1))).alias("health"))


def quality_events(events: DataFrame, found: DataFrame, ts: str, rules: Sequence[str], width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """A row per window: events, events per second, violations, rate, counts by rule and severity, silent rules."""
    win = F.window(ts, width, slide) if slide else F.window(ts, width)
    e = events.groupBy(win.alias("w")).agg(F.count(F.lit(1)).alias("events"))
    counted = found.groupBy(win.alias("w"), "rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))
    both = counted.groupBy("w", "rule_id").agg(F.sum("n").alias("n")).groupBy("w").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule_id", "n")))).alias("by_rule"), F.sum("n").alias("violations"))
    sev = counted.groupBy("w", "severity").agg(F.sum("n").alias("n")).groupBy("w").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("by_severity"))
    j = e.join(both, "w", "left").join(sev, "w", "left")
    seconds = F.unix_seconds("w.end") - F.unix_seconds("w.start")
    every = F.array(*[F.lit(r) for r in rules])
    silent = F.array_sort(F.array_except(every, F.coalesce(F.map_keys("by_rule"), F.array().cast("array<string>"))))
    return j.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events", F.bround(F.col("events") / F.greatest(seconds, F.lit(1)), 2).alias("events_per_second"),
        F.coalesce("violations", F.lit(0)).alias("violations"), F.bround(F.coalesce("violations", F.lit(0)) / F.greatest("events", F.lit(1)), 4).alias("violation_rate"), "by_rule", "by_severity", silent.alias("silent_rules"),
    )


def filled(windows: DataFrame, order: str, step: int = 1, zeros: Sequence[str] = ("events", "violations", "errors")) -> DataFrame:
    """windows with a row for each step from the first to the last: where nothing happened counts are 0 and the rest null."""
    low, high = windows.agg(F.min(order), F.max(order)).first()  # two numbers
    if low is None:
        return windows
    spine = windows.sparkSession.range(int(low), int(high) + 1, step).select(F.col("id").cast(windows.schema[order].dataType).alias(order))
    out = spine.join(windows, order, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zeros if c in windows.columns})


def sustained(windows: DataFrame, flag: Column, order: str, n: int, by: Sequence[str] = (), step: int = 1) -> DataFrame:
    """Adds firing: the flag held in this and in each of the n - 1 windows before; a window that is missing did not hold.

    order numbers the windows, step apart.  A window that holds is counted for itself and the
    n - 1 after it, so there is no order to sort by.
    """
    held = windows.where(F.coalesce(flag, F.lit(False))).select(*by, F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.col(order) + k * step)).alias("_at"))
    whole = held.groupBy(*by, F.col("_at").cast(windows.schema[order].dataType).alias(order)).agg(F.count(F.lit(1)).alias("_held"))
    return windows.join(whole, [*by, order], "left").withColumn("firing", F.coalesce(F.col("_held") == n, F.lit(False))).drop("_held")


#: Monitoring conditions on a table of windows (rate, events, p99_ms, error_rate, errors, p10, p90, violations): name, condition, minutes.
CONDITIONS = {
    "high_violation_rate": ("violation_rate > 0.15", 5),
    "critical_violation_rate": ("violation_rate > 0.25", 2),
    "no_events": ("events = 0", 2),
    "slow_p99": ("p99_ms > 2000", 5),
    "very_slow_p99": ("p99_ms > 5000", 5),
    "high_error_rate": ("error_rate > 0.1", 5),
    "many_errors": ("errors > 50", 5),
    "threshold_spread": ("(p90 - p10) / (p10 + 0.001) > 10", 5),
    "no_violations": ("violations = 0", 30),
}


def conditions(windows: DataFrame, order: str, minutes_per_window: int = 1, names: Sequence[str] | None = None, step: int = 1) -> DataFrame:
    """(order, condition) of those that have held for their time.  Windows without any event count too."""
    chosen = list(names or CONDITIONS)
    w = filled(windows, order, step)
    each = []
    for name in chosen:
        text, minutes = CONDITIONS[name]
        n = max(1, minutes // minutes_per_window)
        each.append(F.when(F.expr(text), F.struct(F.lit(name).alias("condition"), F.lit(n).alias("n"))))
    ahead = F.explode(F.transform(F.sequence(F.lit(0), F.col("_c.n") - 1), lambda k: F.col(order) + k * step))
    held = w.select(order, F.explode(F.array_compact(F.array(*each))).alias("_c")).select("_c.*", ahead.alias("_at"))
    full = held.groupBy("condition", "n", F.col("_at").cast(windows.schema[order].dataType).alias(order)).agg(F.count(F.lit(1)).alias("_held")).where("_held = n")
    return full.join(w.select(order), order, "left_semi").select(order, "condition")


def tqs(events: DataFrame, ts: str, by: Sequence[str], value: str, key: str, low: float, high: float, width: str = "5 minutes", weights: Sequence[float] = (0.2, 0.2, 0.2, 0.2, 0.2)) -> DataFrame:
    """Composite score per window and context: timeliness, completeness, accuracy, consistency, uniqueness.

    Timeliness falls with the variance of gaps between events; uniqueness is distinct keys per event.
    """
    w = Window.partitionBy(*by, "_w").orderBy(ts)
    d = events.withColumn("_w", F.window(ts, width)["start"]).withColumn("_gap", (F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w))) / F.lit(1_000_000.0))
    ok = F.col(value).isNotNull() & ~F.isnan(value)
    g = d.groupBy(*by, F.col("_w").alias("window_start")).agg(
        F.count(F.lit(1)).alias("n"), F.exp(-F.lit(1e-8) * F.coalesce(F.var_pop("_gap"), F.lit(0.0))).alias("timeliness"), F.avg(ok.cast("double")).alias("completeness"),
        F.avg((ok & F.col(value).between(low, high)).cast("double")).alias("accuracy"), F.avg((ok & (F.col(value) >= 0)).cast("double")).alias("consistency"), (F.count_distinct(key) / F.count(F.lit(1))).alias("uniqueness"),
    )
    parts = ("timeliness", "completeness", "accuracy", "consistency", "uniqueness")
    return g.withColumn("tqs", sum((F.lit(w) * F.col(p) for p, w in zip(parts, weights)), F.lit(0.0)))


def six_dimensions(scores: dict[str, Column]) -> Column:
    """Weighted score of completeness, accuracy, validity, consistency (.2 each), timeliness and uniqueness (.1 each)."""
    weights = {"completeness": 0.2, "accuracy": 0.2, "validity": 0.2, "consistency": 0.2, "timeliness": 0.1, "uniqueness": 0.1}
    return sum((F.lit(w) * F.coalesce(scores[k], F.lit(0.0)) for k, w in weights.items() if k in scores), F.lit(0.0))
