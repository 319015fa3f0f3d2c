"""Queries of field statistics, contexts with fallback, entropy and drift."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import context as ctx
from ..operators import drift, stats, taxi_checks
from ..operators.finding import findings
from ..sources.readers import star
from .context_queries import LOCATED, located
from .fixtures import DRIFT_SPLIT, counted, counted_sql, events
from .base import query

QUANTILES = ", ".join(f"round(quantile_cont(v, {p}), 6) AS {n}" for n, p in stats.PERCENTILES.items())


def _rounded(df, names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("stats_field", f"WITH m AS (SELECT 'fare' AS field, l_extendedprice AS v FROM lineitem UNION ALL SELECT 'quantity', l_quantity FROM lineitem UNION ALL SELECT 'discount', l_discount FROM lineitem) SELECT field, count(*) AS count, min(v) AS min, max(v) AS max, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, {QUANTILES} FROM m GROUP BY field")
def stats_field(spark, sf_dir):
    d = star(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("fare"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))
    s = _rounded(stats.field_stats(d, ["fare", "quantity", "discount"], exact=True), stats.PERCENTILES)
    return s.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("stats_rolling", "SELECT event_id, n AS roll_count, round(m * n, 2) AS roll_total, round(p10, 6) AS roll_p10, round(p90, 6) AS roll_p90 FROM (SELECT event_id, count(value) OVER w AS n, CASE WHEN count(value) OVER w >= 20 THEN avg(value) OVER w END AS m, CASE WHEN count(value) OVER w >= 20 THEN quantile_cont(value, 0.1) OVER w END AS p10, CASE WHEN count(value) OVER w >= 20 THEN quantile_cont(value, 0.9) OVER w END AS p90 FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))")
def stats_rolling(spark, sf_dir):
    d = stats.rolling_stats(star(spark, sf_dir, "events"), "value", "event_id", ["event_type"], rows=50, min_samples=20)
    return d.select("event_id", "roll_count", F.round(F.col("roll_mean") * F.col("roll_count"), 2).alias("roll_total"), F.round("roll_p10", 6).alias("roll_p10"), F.round("roll_p90", 6).alias("roll_p90"))


ENTROPY = """e AS (SELECT {by}, min(value) AS lo, max(value) AS hi, count(*) AS n FROM {src} GROUP BY {by}),
  b AS (SELECT s.{by}, e.n, least(floor((value - lo) / ((hi - lo) / 10)), 9) AS slot, count(*) AS c FROM {src} s JOIN e ON e.{by} = s.{by} GROUP BY ALL),
  h AS (SELECT {by}, max(n) AS count, round(-sum(c / n * log2(c / n)), 6) AS entropy FROM b GROUP BY {by})"""


@query("entropy", f"WITH {ENTROPY.format(by='event_type', src='events')} SELECT event_type, count, entropy FROM h")
def entropy(spark, sf_dir):
    return _rounded(stats.entropy(star(spark, sf_dir, "events"), "value", ["event_type"]), ["entropy"])


@query("entropy_warnings", f"WITH d AS (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, CASE WHEN CAST(floor(epoch(ts) / 86400) AS BIGINT) % 5 = 0 THEN CASE WHEN event_id % 9 = 0 THEN value ELSE 100.0 END ELSE value END AS value FROM events), {ENTROPY.format(by='day', src='d')} SELECT day, entropy, coalesce(lag(entropy) OVER (ORDER BY day) > 0 AND abs(entropy - lag(entropy) OVER (ORDER BY day)) / lag(entropy) OVER (ORDER BY day) > 0.2, false) AS warning FROM h")
def entropy_warnings(spark, sf_dir):
    day = F.floor(F.unix_seconds("ts") / 86400)
    d = star(spark, sf_dir, "events").select(day.alias("day"), F.when((day % 5 == 0) & (F.col("event_id") % 9 != 0), 100.0).otherwise(F.col("value")).alias("value"))
    h = _rounded(stats.entropy(d, "value", ["day"]), ["entropy"])
    return stats.entropy_warnings(h, "day").select("day", "entropy", "warning")


BOOTSTRAP = """hist AS (SELECT value AS v, count(*) AS c FROM events GROUP BY 1),
  below AS (SELECT c, k, sum(p) OVER (PARTITION BY c ORDER BY k) AS below FROM (SELECT c, k, exp(-c + k * ln(c) - lgamma(k + 1)) AS p FROM (SELECT unnest(range(1, 31)) AS c), (SELECT unnest(range(100)) AS k)) WHERE k < c + CAST(trunc(8 * sqrt(c)) AS BIGINT) + 8),
  steps AS (SELECT c, list(below) AS steps FROM below GROUP BY c),
  u AS (SELECT v, hist.c, i, steps, (('0x' || substr(md5('a42|' || i || '|' || printf('%.6f', v)), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u, (('0x' || substr(md5('b42|' || i || '|' || printf('%.6f', v)), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u2
    FROM hist LEFT JOIN steps ON steps.c = hist.c, (SELECT unnest(range(100)) AS i)),
  w AS (SELECT v, i, CASE WHEN steps IS NOT NULL THEN len(list_filter(steps, lambda s: s < u)) ELSE CAST(greatest(0, round(c + sqrt(c) * sqrt(-2 * ln(u)) * cos(2 * pi() * u2))) AS BIGINT) END AS w FROM u),
  q AS (SELECT i, quantile_cont(v, 0.9) AS v FROM (SELECT v, i, unnest(range(w)) FROM w) GROUP BY i),
  o AS (SELECT v, row_number() OVER (ORDER BY v) AS n FROM q)"""


@query("bootstrap_interval", f"WITH {BOOTSTRAP} SELECT round(max(v) FILTER (WHERE n = 3), 6) AS low, round(max(v) FILTER (WHERE n = 97), 6) AS high FROM o")
def bootstrap(spark, sf_dir):
    e = star(spark, sf_dir, "events")
    b = stats.bootstrap_interval(e, "value", 0.9)
    return b.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


LEVELS = [
    (0, "'hour_' || h || '_' || zone_category || '_' || w"), (1, "b || '_' || zone_category || '_' || w"),
    (2, "b || '_' || borough || '_' || w"), (3, "b"), (4, "'global'"),
]
BY_LEVEL = "k AS (" + " UNION ALL ".join(f"SELECT event_id, {n} AS level, {key} AS ctx, value AS v FROM le" for n, key in LEVELS) + ")"
CONTEXT_STATS = f"WITH {LOCATED}, {BY_LEVEL} SELECT level, ctx, count(*) AS count, min(v) AS min, max(v) AS max, round(sum(v), 2) AS total, {QUANTILES} FROM k GROUP BY level, ctx"


def _context_stats(spark, sf_dir):
    return stats.context_stats(located(spark, sf_dir), "value", "h", "b", "zone_category", "borough", "weekend", exact=True)


@query("stats_context", CONTEXT_STATS)
def stats_context(spark, sf_dir):
    s = _rounded(_context_stats(spark, sf_dir), stats.PERCENTILES).drop("std")
    return s.withColumn("total", F.round(F.col("mean") * F.col("count"), 2)).drop("mean")


FALLBACK = f"WITH {LOCATED}, {BY_LEVEL}, s AS (SELECT level, ctx, count(*) AS n, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.9) AS p90 FROM k GROUP BY level, ctx HAVING count(*) >= 60), f AS (SELECT event_id, min(k.level) AS level, round(arg_min(p10, k.level), 6) AS p10, round(arg_min(p90, k.level), 6) AS p90, any_value(v) AS v FROM k JOIN s ON s.level = k.level AND s.ctx = k.ctx GROUP BY event_id)"


def _fallback(spark, sf_dir):
    d = located(spark, sf_dir)
    keys = ctx.context_keys(F.col("h"), F.col("b"), F.col("zone_category"), F.col("borough"), F.col("weekend"))
    return stats.with_fallback(d.withColumn("keys", keys), "keys", _context_stats(spark, sf_dir), "event_id", 60)


@query("stats_fallback", f"{FALLBACK} SELECT level, count(*) AS n, round(sum(p10), 2) AS p10, round(sum(p90), 2) AS p90 FROM f GROUP BY level")
def stats_fallback(spark, sf_dir):
    f = _fallback(spark, sf_dir)
    return f.groupBy("stat.level").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.round("stat.p10", 6)), 2).alias("p10"), F.round(F.sum(F.round("stat.p90", 6)), 2).alias("p90"))


@query("sem001_context", f"{FALLBACK} SELECT level, count(*) AS n FROM f WHERE v < p10 OR v > 1.05 * p90 GROUP BY level")
def sem001_context(spark, sf_dir):
    f = _fallback(spark, sf_dir).withColumn("level", F.col("stat.level"))
    check = taxi_checks.fare_range(F.col("value"), F.round("stat.p10", 6), F.lit(1.05) * F.round("stat.p90", 6))
    return findings(f, [check], keep=["level"]).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("sem001_global", counted_sql("g AS (SELECT value, (SELECT quantile_cont(value, 0.1) FROM events) AS p10, (SELECT quantile_cont(value, 0.9) FROM events) AS p90 FROM events)", ("SEM001", "'MEDIUM'", "CASE WHEN value < p10 OR value > 1.0 * p90 THEN 'OUT_OF_CONTEXTUAL_RANGE' END")))
def sem001_global(spark, sf_dir):
    e = star(spark, sf_dir, "events")
    s = stats.field_stats(e, ["value"], exact=True).select("p10", "p90")
    low, high = taxi_checks.fare_bounds(None, None, F.col("p10"), F.col("p90"))
    return counted(e.crossJoin(F.broadcast(s)), [taxi_checks.fare_range(F.col("value"), low, high / 2)])  # s: one row


@query("stats_overrides", "WITH s AS (SELECT event_type AS field, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90 FROM events GROUP BY 1) SELECT field, CASE field WHEN 'click' THEN 5.0 ELSE round(p10, 6) END AS p10, CASE field WHEN 'view' THEN 300.0 ELSE round(p90, 6) END AS p90, CASE WHEN field IN ('click', 'view') THEN 'override' ELSE 'adaptive' END AS source FROM s")
def stats_overrides(spark, sf_dir):
    s = star(spark, sf_dir, "events").groupBy(F.col("event_type").alias("field")).agg(*stats.aggregates(F.col("value"), exact=True))
    o = spark.createDataFrame([("click", "p10", 5.0), ("view", "p90", 300.0)], "field string, name string, value double")
    return _rounded(stats.with_overrides(s, o), ["p10", "p90"]).select("field", "p10", "p90", "source")


@query("stats_since_reset", "WITH r AS (SELECT event_type, max(event_id) AS reset_at FROM events WHERE event_id % 997 = 0 GROUP BY 1) SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50 FROM events LEFT JOIN r USING (event_type) WHERE reset_at IS NULL OR event_id > reset_at GROUP BY 1")
def stats_since_reset(spark, sf_dir):
    e = star(spark, sf_dir, "events")
    r = e.where("event_id % 997 = 0").select("event_type", F.col("event_id").alias("reset_at"))
    return stats.since_reset(e, ["event_type"], "event_id", r).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"))


@query("top_contexts", f"WITH {LOCATED}, {BY_LEVEL} SELECT ctx, count(*) AS n FROM k WHERE level = 1 GROUP BY ctx ORDER BY n DESC, ctx LIMIT 10")
def top_contexts(spark, sf_dir):
    s = _context_stats(spark, sf_dir).where("level = 1").select("ctx", F.col("count").alias("n"))
    return s.orderBy(F.col("n").desc(), "ctx").limit(10)


@query("idle_fields", 'SELECT event_type AS field, max(event_id) AS "at" FROM events GROUP BY 1 HAVING (SELECT max(event_id) FROM events) - max(event_id) <= 3 ORDER BY "at" DESC, field LIMIT 50')
def idle_fields(spark, sf_dir):
    e = star(spark, sf_dir, "events")
    last = e.groupBy(F.col("event_type").alias("field")).agg(F.max("event_id").alias("at"))
    total = e.agg(F.max("event_id")).first()[0]
    return stats.idle_fields(last, total, idle=3)


SPLIT = f"ts >= TIMESTAMP '{DRIFT_SPLIT}'"


def _split(e):
    return e.withColumn("is_current", F.col("ts") >= F.lit(DRIFT_SPLIT).cast("timestamp"))


#: Values of the current half move up for some kinds, so that there is drift to find.
MOVED = f"mv AS (SELECT *, {SPLIT} AS is_current, CASE WHEN {SPLIT} AND event_type = 'error' THEN value * 1.5 + 20 WHEN {SPLIT} AND event_type = 'view' THEN value * 1.1 ELSE value END AS v FROM events)"


def _moved(spark, sf_dir):
    e = _split(star(spark, sf_dir, "events"))
    now = F.col("is_current")
    return e.withColumn("v", F.when(now & (F.col("event_type") == "error"), F.col("value") * 1.5 + 20).when(now & (F.col("event_type") == "view"), F.col("value") * 1.1).otherwise(F.col("value")))


@query("psi_bucket", f"""WITH {MOVED}, ed AS (SELECT event_type, quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.9) AS hi FROM mv WHERE NOT is_current GROUP BY 1),
  c AS (SELECT m.event_type, greatest(0, least(9, floor((v - lo) / ((hi - lo) / 10)))) AS slot, count(*) FILTER (WHERE NOT is_current) AS e, count(*) FILTER (WHERE is_current) AS a FROM mv m JOIN ed ON ed.event_type = m.event_type GROUP BY 1, 2),
  t AS (SELECT event_type, sum(e) AS et, sum(a) AS at FROM c GROUP BY 1),
  p AS (SELECT t.event_type, greatest(coalesce(c.e, 0) / t.et, 0.0001) AS e, greatest(coalesce(c.a, 0) / t.at, 0.0001) AS a FROM t CROSS JOIN range(10) s(i) LEFT JOIN c ON c.event_type = t.event_type AND c.slot = s.i)
  SELECT event_type, round(sum((a - e) * ln(a / e)), 6) AS psi, CASE WHEN sum((a - e) * ln(a / e)) >= 0.25 THEN 'CRITICAL' WHEN sum((a - e) * ln(a / e)) >= 0.2 THEN 'HIGH' WHEN sum((a - e) * ln(a / e)) >= 0.1 THEN 'MEDIUM' WHEN sum((a - e) * ln(a / e)) >= 0.05 THEN 'LOW' ELSE 'OK' END AS severity FROM p GROUP BY 1""")
def psi_bucket(spark, sf_dir):
    p = drift.bucket_psi(_moved(spark, sf_dir), "v", "is_current", ["event_type"], exact=True)
    return p.select("event_type", F.round("psi", 6).alias("psi"), drift.level(F.col("psi")).alias("severity"))


@query("psi_approx", f"""WITH {MOVED}, s AS (SELECT event_type, is_current, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.9) AS p90 FROM mv GROUP BY ALL),
  j AS (SELECT c.event_type, CASE WHEN b.p10 <> b.p90 THEN 0.5 * (abs(c.p10 - b.p10) / greatest(b.p10, 1e-9) + abs(c.p90 - b.p90) / greatest(b.p90, 1e-9)) END AS psi FROM s c JOIN s b ON b.event_type = c.event_type AND c.is_current AND NOT b.is_current)
  SELECT event_type, round(psi, 6) AS psi, CASE WHEN psi >= 0.25 THEN 'CRITICAL' WHEN psi >= 0.2 THEN 'HIGH' WHEN psi >= 0.1 THEN 'MEDIUM' WHEN psi >= 0.05 THEN 'LOW' ELSE 'OK' END AS severity, psi >= 0.2 AS drift FROM j""")
def psi_approx(spark, sf_dir):
    m = _moved(spark, sf_dir)
    of = lambda d: d.groupBy("event_type").agg(*stats.aggregates(F.col("v"), exact=True))
    r = drift.drift_report(of(m.where("NOT is_current")), of(m.where("is_current")), ["event_type"])
    return r.withColumn("psi", F.round("psi", 6))


@query("psi_by_context", f"""WITH {LOCATED}, s AS (SELECT b || '_' || zone_category || '_' || w AS ctx, {SPLIT} AS cur, count(*) AS n, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90 FROM le GROUP BY 1, 2)
  SELECT c.ctx, round(0.5 * (abs(c.p10 - b.p10) / greatest(b.p10, 1e-9) + abs(c.p90 - b.p90) / greatest(b.p90, 1e-9)), 6) AS psi FROM s c JOIN s b ON b.ctx = c.ctx AND c.cur AND NOT b.cur WHERE b.p10 <> b.p90""")
def psi_by_context(spark, sf_dir):
    d = _split(located(spark, sf_dir))
    key = F.concat_ws("_", "b", "zone_category", F.when(F.col("weekend"), "weekend").otherwise("weekday"))
    of = lambda x: x.groupBy(key.alias("ctx")).agg(*stats.aggregates(F.col("value"), exact=True))
    r = drift.drift_report(of(d.where("NOT is_current")), of(d.where("is_current")), ["ctx"])
    return r.where("psi IS NOT NULL").select("ctx", F.round("psi", 6).alias("psi"))


@query("last_value_per_key", "SELECT user_id, max(event_id) AS last_event, arg_max(event_type, event_id) AS last_type, count(*) AS n FROM events GROUP BY user_id")
def last_value(spark, sf_dir):
    return star(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("last_event"), F.max_by("event_type", "event_id").alias("last_type"), F.count(F.lit(1)).alias("n"))


@query("occurrence_numbers", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS seen, event_id - lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS gap FROM events")
def occurrence_numbers(spark, sf_dir):
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return events(spark, sf_dir).select("event_id", F.row_number().over(w).alias("seen"), (F.col("event_id") - F.lag("event_id").over(w)).alias("gap"))
