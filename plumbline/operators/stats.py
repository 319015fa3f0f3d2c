"""Field statistics: whole, rolling, by context with fallback; entropy; bootstrap; overrides."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import in_blocks

PERCENTILES = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}
MIN_SAMPLES, WINDOW_ROWS, BINS = 100, 10_000, 10
#: Levels of the context hierarchy, and contexts of all levels that are broadcast at most.
LEVELS, BROADCAST_CONTEXTS = 5, 50_000
#: Counts whose Poisson weights are drawn by inversion.
SMALL_COUNT = 30


def aggregates(c: Column, exact: bool = False) -> list[Column]:
    """count, min, max, mean, population deviation and percentiles.

    Percentiles are approximate (within a ten-thousandth of the ranks), in bounded memory.
    exact ones keep a histogram of distinct values for each group: for groups of bounded size.
    """
    names, levels = list(PERCENTILES), list(PERCENTILES.values())
    q = F.percentile(c, F.array(*[F.lit(x) for x in levels])) if exact else F.percentile_approx(c, levels, 10_000)
    return [F.count(c).alias("count"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias("std"), *[q[i].alias(n) for i, n in enumerate(names)]]


def melted(df: DataFrame, fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep, field, value): a row for each field that is not null and not NaN, from one scan."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields]))
    return df.select(*keep, pairs.alias("_p")).select(*keep, "_p.field", "_p.value").where(F.col("value").isNotNull() & ~F.isnan("value"))


def field_stats(df: DataFrame, fields: Sequence[str], min_samples: int = MIN_SAMPLES, exact: bool = False) -> DataFrame:
    return melted(df, fields).groupBy("field").agg(*aggregates(F.col("value"), exact)).where(F.col("count") >= min_samples)


def rolling_stats(df: DataFrame, field: str, order: str, partition: Sequence[str] = (), rows: int = WINDOW_ROWS, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Statistics over the last rows up to and with each row; null below min_samples.

    Without a partition the rows are cut into blocks along the order, each with the rows before it that its frames need.
    """
    d = df if partition else in_blocks(df, order, rows - 1)
    w = (Window.partitionBy(*partition).orderBy(order) if partition else Window.partitionBy("_block").orderBy("_n")).rowsBetween(-(rows - 1), 0)
    n = F.count(field).over(w)
    enough = lambda c: F.when(n >= min_samples, c)
    out = d.withColumns({"roll_count": n, "roll_mean": enough(F.avg(field).over(w)), "roll_p10": enough(F.percentile(field, F.lit(0.1)).over(w)), "roll_p90": enough(F.percentile(field, F.lit(0.9)).over(w))})
    return out if partition else out.where("NOT _lead").drop("_n", "_block", "_lead")


def entropy(df: DataFrame, field: str, by: Sequence[str] = (), bins: int = BINS, least: int = 10) -> DataFrame:
    """Shannon entropy in bits over equal-width bins of each group; 0 for few rows or a constant."""
    d = df.where(F.col(field).isNotNull())
    edges = d.groupBy(*by).agg(F.min(field).alias("_lo"), F.max(field).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    joined = d.join(edges, list(by)) if by else d.crossJoin(F.broadcast(edges))  # edges: one row
    slot = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col(field) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)), F.lit(bins - 1))).otherwise(0)
    counts = joined.groupBy(*by, "_lo", "_hi", "_n", slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_c"))
    p = F.col("_c") / F.col("_n")
    h = counts.groupBy(*by).agg(F.max("_n").alias("count"), F.max(F.col("_hi") > F.col("_lo")).alias("_spread"), (-F.sum(p * F.log2(p))).alias("_h"))
    return h.select(*by, "count", F.when((F.col("count") >= least) & F.col("_spread"), F.col("_h")).otherwise(0.0).alias("entropy"))


def entropy_warnings(per_window: DataFrame, order: str, change: float = 0.2, by: Sequence[str] = ()) -> DataFrame:
    """Adds warning: the entropy differs from the window before by more than the share."""
    d = per_window if by else in_blocks(per_window, order, 1)
    before = F.lag("entropy").over(Window.partitionBy(*by).orderBy(order) if by else Window.partitionBy("_block").orderBy("_n"))
    out = d.withColumn("warning", F.coalesce((before > 0) & (F.abs(F.col("entropy") - before) > change * before), F.lit(False)))
    return out if by else out.where("NOT _lead").drop("_n", "_block", "_lead")


def bootstrap_interval(df: DataFrame, field: str, probability: float, resamples: int = 100, seed: int = 42) -> DataFrame:
    """(low, high): the 95 % interval of a percentile, by Poisson resampling of the histogram of values.

    A value that occurs c times gets a Poisson(c) weight in each resample: by inversion of a
    uniform number up to SMALL_COUNT, by the normal approximation beyond.  The numbers come
    from md5 of the seed, the resample and the value, so reruns agree and rows are not copied.
    """
    v = F.col(field).cast("double")
    d = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    table = [(c, k, _poisson_below(c, k)) for c in range(1, SMALL_COUNT + 1) for k in range(c + int(8 * c**0.5) + 8)]
    known = df.sparkSession.createDataFrame(pa.table(list(map(pa.array, zip(*table))), ["c", "k", "below"]))  # of constant size
    steps = known.groupBy("c").agg(F.array_sort(F.collect_list("below")).alias("steps"))
    name = F.concat_ws("|", F.lit(str(seed)), F.col("i").cast("string"), F.format_string("%.6f", "v"))
    u = lambda tag: (F.conv(F.substring(F.md5(F.concat(F.lit(tag), name)), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    d = d.join(F.broadcast(steps), "c", "left").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("u", u("a"))
    normal = F.greatest(F.lit(0), F.round(F.col("c") + F.sqrt("c") * F.sqrt(-2 * F.log("u")) * F.cos(2 * math.pi * u("b"))))
    weight = F.when(F.col("steps").isNotNull(), F.size(F.filter("steps", lambda s: s < F.col("u")))).otherwise(normal).cast("long")
    each = d.withColumn("w", weight).where("w > 0").groupBy("i").agg(F.percentile("v", F.lit(probability), F.col("w")).alias("v"))
    order = each.agg(F.sort_array(F.collect_list("v")).alias("a"))  # one number per resample
    return order.select(F.element_at("a", int(resamples * 0.025) + 1).alias("low"), F.element_at("a", int(resamples * 0.975)).alias("high"))


def _poisson_below(mean: int, k: int) -> float:
    """The probability of k or less."""
    return math.fsum(math.exp(-mean + j * math.log(mean) - math.lgamma(j + 1)) for j in range(k + 1))


def context_stats(df: DataFrame, value: str, hour: str, category: str, zone: str, borough: str, weekend: str, exact: bool = False) -> DataFrame:
    """Statistics at the five levels of the context hierarchy, by grouping sets: (level, ctx, statistics).

    level and ctx are the hierarchy's level and key.
    """
    d = df.select(F.col(hour).alias("h"), F.col(category).alias("b"), F.col(zone).alias("zc"), F.col(borough).alias("bo"), F.when(F.col(weekend), "weekend").otherwise("weekday").alias("w"), F.col(value).cast("double").alias("v"))
    d = d.where("v IS NOT NULL AND NOT isnan(v)")
    sets = [["h", "zc", "w"], ["b", "zc", "w"], ["b", "bo", "w"], ["b"], []]
    g = d.groupingSets([[F.col(c) for c in s] for s in sets], "h", "zc", "w", "b", "bo").agg(F.grouping_id().alias("gid"), *aggregates(F.col("v"), exact))
    level = {3: 0, 17: 1, 24: 2, 29: 3, 31: 4}
    # bits of grouping_id in the order h, zc, w, b, bo; a set bit is a column that is left out
    lv = F.lit(None).cast("int")
    for gid, n in level.items():
        lv = F.when(F.col("gid") == gid, n).otherwise(lv)
    key = (
        F.when(F.col("level") == 0, F.concat_ws("_", F.lit("hour"), F.col("h").cast("string"), "zc", "w")).when(F.col("level") == 1, F.concat_ws("_", "b", "zc", "w"))
        .when(F.col("level") == 2, F.concat_ws("_", "b", "bo", "w")).when(F.col("level") == 3, F.col("b")).otherwise("global")
    )
    return g.withColumn("level", lv).withColumn("ctx", key).select("level", "ctx", "count", "min", "max", "mean", "std", *PERCENTILES)


def with_fallback(df: DataFrame, keys: str, stats: DataFrame, row_id: str, min_samples: int | Sequence[int] = MIN_SAMPLES, broadcast_rows: int = BROADCAST_CONTEXTS) -> DataFrame:
    """Adds stat: the statistics of the most specific level with enough samples.

    keys is an array of (level, key) per row, one for each level.  At most broadcast_rows + 1
    contexts are fetched: if those are all, they are broadcast, once for each level, and rows
    do not move.  Beyond that the keys are exploded, joined by a shuffle on (level, key), and the row with the
    smallest level wins; only the id and the statistics go through that aggregation.
    """
    least = min_samples if not isinstance(min_samples, int) else [min_samples] * LEVELS
    bound = F.element_at(F.array(*[F.lit(int(m)) for m in least]), F.col("level") + 1)
    names = [c for c in stats.columns if c not in ("level", "ctx")]
    s = stats.where(F.col("count") >= bound)
    few = s.limit(broadcast_rows + 1).toArrow()
    if few.num_rows <= broadcast_rows:
        one = df.sparkSession.createDataFrame(few).select(F.struct("level", "ctx", *names).alias("_s"))
        out = df
        for level in range(LEVELS):
            mine = one.where(F.col("_s.level") == level).select(F.col("_s.ctx").alias(f"_k{level}"), F.col("_s").alias(f"_s{level}"))
            key = F.get(F.filter(keys, lambda k: k["level"] == F.lit(level)), F.lit(0))["key"]
            out = out.join(F.broadcast(mine), key == F.col(f"_k{level}"), "left")
        return out.withColumn("stat", F.coalesce(*[F.col(f"_s{i}") for i in range(LEVELS)])).drop(*[f"_{x}{i}" for i in range(LEVELS) for x in "ks"])
    s = s.select(F.col("level").alias("_l"), F.col("ctx").alias("_k"), F.struct("level", "ctx", *names).alias("_s"))
    wide = df.select(row_id, F.explode(keys).alias("_e")).select(row_id, F.col("_e.level").alias("_l"), F.col("_e.key").alias("_k"))
    best = wide.join(s, ["_l", "_k"]).groupBy(row_id).agg(F.min_by("_s", "_l").alias("stat"))
    return df.join(best, row_id, "left")


def with_overrides(stats: DataFrame, overrides: DataFrame) -> DataFrame:
    """Puts (field, name, value) overrides over statistics and tells the source of each row."""
    o = overrides.groupBy("field").pivot("name", ["p10", "p90", "min", "max"]).agg(F.first("value"))
    o = o.select("field", *[F.col(c).alias(f"override_{c}") for c in ("p10", "p90", "min", "max")])
    j = stats.join(o, "field", "left")
    any_set = F.coalesce(*[F.col(f"override_{c}") for c in ("p10", "p90", "min", "max")]).isNotNull()
    return j.withColumns({c: F.coalesce(F.col(f"override_{c}"), F.col(c)) for c in ("p10", "p90", "min", "max")}).withColumn("source", F.when(any_set, "override").otherwise("adaptive")).drop(*[f"override_{c}" for c in ("p10", "p90", "min", "max")])


def since_reset(df: DataFrame, by: Sequence[str], order: str, resets: DataFrame) -> DataFrame:
    """Rows after the last reset of their key; resets: (by, reset_at)."""
    last = resets.groupBy(*by).agg(F.max("reset_at").alias("_reset"))
    return df.join(last, list(by), "left").where(F.col("_reset").isNull() | (F.col(order) > F.col("_reset"))).drop("_reset")


def idle_fields(last_seen: DataFrame, total: int, idle: int = 50_000, most: int = 50) -> DataFrame:
    """The fields to keep: seen within the last idle updates, the latest ones if there are too many.  last_seen: (field, at)."""
    return last_seen.where(F.lit(total) - F.col("at") <= idle).orderBy(F.col("at").desc(), "field").limit(most)
