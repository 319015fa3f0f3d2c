"""Queries of summaries, contracts, profiles, validation, comparison of detectors, monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts, profile, reports, validate
from ..sources.inject import inject
from ..sources.readers import star
from .cross_record import SEVERITY, alerting
from .fixtures import EVENTS, TRIPS, counted, events, trips
from .base import query
from .source_queries import INJECTED, KIND
from .stateless import CONTRACT

FOUND = f"fd AS (SELECT event_id, ts, event_type AS rule_id, {SEVERITY} AS severity, CAST(event_id % 4 AS VARCHAR) AS violation_type FROM events WHERE value > 60)"


def _found(spark, sf_dir):
    return alerting(spark, sf_dir).join(star(spark, sf_dir, "events").where("value > 60").select("event_id"), "event_id", "left_semi")


@query("summary", f"WITH {FOUND} SELECT 'rule_id' AS dimension, rule_id AS key, count(*) AS n FROM fd GROUP BY rule_id UNION ALL SELECT 'severity', severity, count(*) FROM fd GROUP BY severity UNION ALL SELECT 'violation_type', violation_type, count(*) FROM fd GROUP BY violation_type UNION ALL SELECT 'total', 'total', count(*) FROM fd")
def summary(spark, sf_dir):
    return reports.summary(_found(spark, sf_dir))


@query("violation_rate", "SELECT count(*) FILTER (WHERE value > 60) AS violations, count(*) AS events, round(count(*) FILTER (WHERE value > 60) / count(*), 6) AS rate FROM events")
def violation_rate(spark, sf_dir):
    return reports.violation_rate(_found(spark, sf_dir), star(spark, sf_dir, "events")).withColumn("rate", F.round("rate", 6))


@query("latency_nearest_rank", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(value) FILTER (WHERE i = CAST(floor(n * 0.5) AS BIGINT)) AS p50, max(value) FILTER (WHERE i = CAST(floor(n * 0.99) AS BIGINT)) AS p99 FROM r GROUP BY 1")
def nearest_rank(spark, sf_dir):
    return reports.nearest_rank(star(spark, sf_dir, "events"), "value", ["event_type"])


@query("rule_health", "SELECT event_type AS rule_id, count(*) FILTER (WHERE event_id % 3 = 0) AS tp, count(*) FILTER (WHERE event_id % 3 <> 0) AS fp, round(count(*) FILTER (WHERE event_id % 3 = 0) / count(*), 6) AS health FROM events WHERE value > 60 GROUP BY 1")
def rule_health(spark, sf_dir):
    return reports.rule_health(_found(spark, sf_dir).withColumn("is_true", F.col("event_id") % 3 == 0)).withColumn("health", F.round("health", 6))


RULES = ["click", "error", "purchase", "signup", "view", "never"]


@query("quality_events", f"""WITH {FOUND}, e AS (SELECT CAST(floor(epoch(ts) / 300) AS BIGINT) AS w, count(*) AS events FROM events GROUP BY 1),
  v AS (SELECT CAST(floor(epoch(ts) / 300) AS BIGINT) AS w, count(*) AS violations, list_sort(list(DISTINCT rule_id)) AS fired, count(*) FILTER (WHERE severity = 'HIGH') AS n_high, count(*) FILTER (WHERE rule_id = 'click') AS n_click FROM fd GROUP BY 1)
  SELECT e.w * 300 AS window_start, events, round_even(events / CAST(300 AS DOUBLE), 2) AS events_per_second, coalesce(violations, 0) AS violations, round_even(coalesce(violations, 0) / CAST(events AS DOUBLE), 4) AS violation_rate,
    coalesce(n_high, 0) AS n_high, coalesce(n_click, 0) AS n_click, array_to_string(list_sort(list_filter(['click', 'error', 'never', 'purchase', 'signup', 'view'], lambda x: NOT coalesce(list_contains(fired, x), false))), ',') AS silent FROM e LEFT JOIN v USING (w)""")
def quality_events(spark, sf_dir):
    q = reports.quality_events(star(spark, sf_dir, "events"), _found(spark, sf_dir), "ts", RULES)
    of = lambda m, k: F.coalesce(F.try_element_at(F.col(m), F.lit(k)), F.lit(0))
    return q.select(F.unix_seconds("window_start").alias("window_start"), "events", "events_per_second", "violations", "violation_rate", of("by_severity", "HIGH").alias("n_high"), of("by_rule", "click").alias("n_click"), F.concat_ws(",", "silent_rules").alias("silent"))


@query("sliding_rates", "WITH s AS (SELECT unnest(range(5)) AS k), w AS (SELECT (CAST(floor(epoch(ts) / 60) AS BIGINT) - k) * 60 AS window_start, value FROM events, s) SELECT window_start, count(*) AS events, round(count(*) FILTER (WHERE value > 60) / count(*), 6) AS rate FROM w GROUP BY 1")
def sliding_rates(spark, sf_dir):
    w = F.window("ts", "5 minutes", "1 minute")
    g = star(spark, sf_dir, "events").groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("value") > 60).alias("v"))
    return g.select(F.unix_seconds("w.start").alias("window_start"), "events", F.round(F.col("v") / F.col("events"), 6).alias("rate"))


HOURS = "h AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, count(*) AS events, count(*) FILTER (WHERE value > 60) AS violations, count(*) FILTER (WHERE value > 60) / count(*) AS violation_rate, count(*) FILTER (WHERE event_type = 'error') / count(*) AS error_rate, count(*) FILTER (WHERE event_type = 'error') AS errors, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.99) * 10 AS p99_ms FROM events GROUP BY 1)"


def _hours(spark, sf_dir):
    e = star(spark, sf_dir, "events")
    bad, err = F.count_if(F.col("value") > 60), F.count_if(F.col("event_type") == "error")
    q = lambda p: F.percentile("value", F.lit(p))
    return e.groupBy(F.floor(F.unix_seconds("ts") / 3600).alias("hour")).agg(F.count(F.lit(1)).alias("events"), bad.alias("violations"), (bad / F.count(F.lit(1))).alias("violation_rate"), (err / F.count(F.lit(1))).alias("error_rate"), err.alias("errors"), q(0.1).alias("p10"), q(0.9).alias("p90"), (q(0.99) * 10).alias("p99_ms"))


def _held(condition: str, n: int, name: str) -> str:
    return f"SELECT hour, '{name}' AS condition FROM (SELECT hour, min(CASE WHEN {condition} THEN 1 ELSE 0 END) OVER w AS ok, count(*) OVER w AS n FROM a WINDOW w AS (ORDER BY hour ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)) WHERE ok = 1 AND n = {n}"


#: Hours without events count as windows too; the conditions and their numbers of two-minute windows, written out.
ALL_HOURS = f"WITH {HOURS}, a AS (SELECT s.hour, coalesce(events, 0) AS events, coalesce(violations, 0) AS violations, violation_rate, error_rate, coalesce(errors, 0) AS errors, p10, p90, p99_ms FROM (SELECT unnest(range((SELECT min(hour) FROM h), (SELECT max(hour) FROM h) + 1)) AS hour) s LEFT JOIN h ON h.hour = s.hour) "
HELD = [
    _held("violation_rate > 0.15", 2, "high_violation_rate"), _held("violation_rate > 0.25", 1, "critical_violation_rate"), _held("events = 0", 1, "no_events"),
    _held("p99_ms > 2000", 2, "slow_p99"), _held("p99_ms > 5000", 2, "very_slow_p99"), _held("error_rate > 0.1", 2, "high_error_rate"), _held("errors > 50", 2, "many_errors"),
    _held("(p90 - p10) / (p10 + 0.001) > 10", 2, "threshold_spread"), _held("violations = 0", 15, "no_violations"),
]


@query("alert_conditions", ALL_HOURS + " UNION ALL ".join(HELD))
def alert_conditions(spark, sf_dir):
    return reports.conditions(_hours(spark, sf_dir), "hour", minutes_per_window=2)


@query("dashboard", f"WITH {HOURS} SELECT count(*) AS hours, CAST(sum(events) AS BIGINT) AS events, CAST(sum(violations) AS BIGINT) AS violations, round(100.0 * sum(violations) / sum(events), 4) AS rate_percent, round(max(p90), 6) AS p90_most, round(min(p10), 6) AS p10_least, round(max(2 * p90), 6) AS bound_most FROM h")
def dashboard(spark, sf_dir):
    return _hours(spark, sf_dir).agg(F.count(F.lit(1)).alias("hours"), F.sum("events").alias("events"), F.sum("violations").alias("violations"), F.round(100.0 * F.sum("violations") / F.sum("events"), 4).alias("rate_percent"), F.round(F.max("p90"), 6).alias("p90_most"), F.round(F.min("p10"), 6).alias("p10_least"), F.round(F.max(2 * F.col("p90")), 6).alias("bound_most"))


TIER = contracts.Contract("replay", tier="SILVER", required_rules=("SYN001", "SYN002", "SEM001"), suppressed_rules=("CRS003",), sla_max_violation_rate=0.10)


@query("contract_tier", f"""WITH {TRIPS}, t AS (SELECT count(*) AS total, count(*) FILTER (WHERE fare_raw IS NULL OR fare_raw IN ('NaN', 'abc') OR try_cast(fare_raw AS DOUBLE) < 0) AS violations FROM trips), r AS (SELECT *, violations / CAST(total AS DOUBLE) AS rate FROM t)
  SELECT 'replay' AS contract, 'SILVER' AS tier_required, total, violations, round_even(rate, 4) AS violation_rate, CASE WHEN rate <= 1 - CAST(0.95 AS DOUBLE) THEN 'GOLD' WHEN rate <= 1 - CAST(0.90 AS DOUBLE) THEN 'SILVER' ELSE 'BRONZE' END AS tier_achieved, rate <= 1 - CAST(0.90 AS DOUBLE) AS tier_met, rate <= CAST(0.10 AS DOUBLE) AS sla_met, 'SEM001,SYN002' AS missing FROM r""")
def contract_tier(spark, sf_dir):
    from ..operators import taxi_checks

    t = trips(spark, sf_dir)
    by_rule = counted(t, [taxi_checks.fare_valid(F.col("fare_raw"))]).groupBy("rule_id").agg(F.sum("n").alias("n"))
    e = contracts.evaluate(by_rule, t.agg(F.count(F.lit(1)).alias("total")), TIER)
    return e.withColumn("missing", F.concat_ws(",", "missing_rules")).drop("missing_rules", "gap")


@query("contract_gating", "SELECT rule_id, rule_id IN ('SYN001', 'SYN002', 'SEM001') AS runs FROM (VALUES ('SYN000'), ('SYN001'), ('SYN002'), ('SEM001'), ('CRS001'), ('CRS003')) v(rule_id)")
def contract_gating(spark, sf_dir):
    rules = ["SYN000", "SYN001", "SYN002", "SEM001", "CRS001", "CRS003"]
    kept = TIER.gate(rules)
    return spark.createDataFrame([(r, r in kept) for r in rules], "rule_id string, runs boolean")


@query("contract_fields_by_tier", f"WITH {TRIPS}, f AS (SELECT count(*) AS total, count(*) FILTER (WHERE flag NOT IN ('A', 'N')) AS flag_bad, count(*) FILTER (WHERE try_cast(distance_raw AS DOUBLE) < 2) AS distance_bad FROM trips) SELECT 'FIELD_flag' AS rule_id, round(flag_bad / total, 6) AS rate FROM f UNION ALL SELECT 'FIELD_distance_raw', round(distance_bad / total, 6) FROM f")
def contract_fields(spark, sf_dir):
    t = trips(spark, sf_dir)
    checks = [c for c in CONTRACT.field_checks() if c.rule_id in ("FIELD_flag", "FIELD_distance_raw")]
    one = t.agg(F.count(F.lit(1)).alias("total"), *[F.count(c.reason).alias(c.rule_id) for c in checks])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c.rule_id).alias("rule_id"), F.round(F.col(c.rule_id) / F.col("total"), 6).alias("rate")) for c in checks])).alias("r")).select("r.*")


@query("profile", f"""WITH {EVENTS}, c AS (SELECT count(*) AS n FROM ev)
  SELECT 'value' AS field, 'float' AS kind, count(*) AS n, count(*) - count(value) AS n_null, count(DISTINCT value) AS n_distinct, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 4) AS mean, NULL AS len_min, NULL AS len_max FROM ev
  UNION ALL SELECT 'user_id', 'int', count(*), count(*) - count(user_id), count(DISTINCT user_id), min(user_id), max(user_id), round(avg(user_id), 4), NULL, NULL FROM ev
  UNION ALL SELECT 'value_raw', 'mixed', count(*), count(*) - count(value_raw), count(DISTINCT value_raw), NULL, NULL, NULL, min(length(value_raw)), max(length(value_raw)) FROM ev
  UNION ALL SELECT 'batch', 'int', count(*), count(*) - count(batch), count(DISTINCT batch), NULL, NULL, NULL, min(length(batch)), max(length(batch)) FROM ev
  UNION ALL SELECT 'event_type', 'string', count(*), count(*) - count(event_type), count(DISTINCT event_type), NULL, NULL, NULL, min(length(event_type)), max(length(event_type)) FROM ev""")
def profile_query(spark, sf_dir):
    p = profile.profile(events(spark, sf_dir).select("value", "user_id", "value_raw", "batch", "event_type"), exact_distinct=True)
    r = p.withColumns({"min": F.round("min", 6), "max": F.round("max", 6), "mean": F.round("mean", 4), "len_min": F.col("len_min").cast("long"), "len_max": F.col("len_max").cast("long")})
    return r.select("field", "kind", "n", "n_null", "n_distinct", "min", "max", "mean", "len_min", "len_max")


@query("profile_flags", "SELECT * FROM (VALUES ('CONSTANT_FIELD: one'), ('HIGH_NULL: hollow'), ('HIGH_CARDINALITY: event_id'), ('LOW_VARIANCE: level'), ('MIXED_TYPE: value_raw')) v(flag)")
def profile_flags(spark, sf_dir):
    e = events(spark, sf_dir)
    d = e.select("event_id", F.lit("x").alias("one"), F.when(F.col("event_id") % 4 == 0, F.col("event_type")).alias("hollow"), (F.lit(1000.0) + F.col("event_id") % 2).alias("level"), "value_raw", "event_type")
    return profile.quality_flags(profile.profile(d, exact_distinct=True)).where("flag <> 'HIGH_CARDINALITY: value_raw'")


@query("null_rate", f"WITH {EVENTS} SELECT round((count(*) - count(value_raw) + count(*) - count(vehicle)) / (2.0 * count(*)), 6) AS null_rate FROM ev")
def null_rate(spark, sf_dir):
    p = profile.profile(events(spark, sf_dir).select("value_raw", "vehicle"))
    return profile.overall_null_rate(p).select(F.round("null_rate", 6).alias("null_rate"))


#: Three rules against a truth: one that always fires, one that never misses by much, one that is rare.
FLAGS = "fl AS (SELECT event_id, r.rule, CASE r.rule WHEN 'weak' THEN true WHEN 'strong' THEN event_id % 20 = 0 ELSE event_id % 4999 = 0 END AS hit, event_id % 20 = 0 OR event_id % 33 = 0 AS truth FROM events, (VALUES ('weak'), ('strong'), ('rare')) r(rule))"


@query("rule_validation", f"""WITH {FLAGS}, g AS (SELECT rule, count(*) AS events, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE hit AND truth) AS tp, count(*) FILTER (WHERE hit AND NOT truth) AS fp, count(*) FILTER (WHERE NOT hit AND truth) AS fn FROM fl GROUP BY rule),
  m AS (SELECT *, CASE WHEN hits > 0 THEN fp / hits ELSE 0 END AS fpr, CASE WHEN hits > 0 THEN tp / hits ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, hits / events AS coverage FROM g)
  SELECT rule, hits, tp, fp, fn, round(fpr, 6) AS fpr, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coverage, 6) AS coverage, CASE WHEN fpr > 0.1 THEN 'FPR' WHEN coverage < 0.001 THEN 'COVERAGE' WHEN precision < 0.7 THEN 'PRECISION' END AS rejection FROM m""")
def rule_validation(spark, sf_dir):
    k = F.col("event_id")
    e = star(spark, sf_dir, "events").select("event_id", F.explode(F.array(*[F.lit(x) for x in ("weak", "strong", "rare")])).alias("rule"))
    e = e.withColumn("hit", F.when(F.col("rule") == "weak", True).when(F.col("rule") == "strong", k % 20 == 0).otherwise(k % 4999 == 0)).withColumn("truth", (k % 20 == 0) | (k % 33 == 0))
    v = validate.validate_rules(e, "rule", "hit", "truth")
    return v.select("rule", "hits", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("fpr", "precision", "recall", "coverage")], "rejection")


@query("rule_validation_no_truth", f"WITH {FLAGS} SELECT rule, count(*) FILTER (WHERE hit) AS hits, round(count(*) FILTER (WHERE hit) / count(*), 6) AS fpr FROM fl GROUP BY rule")
def rule_validation_no_truth(spark, sf_dir):
    k = F.col("event_id")
    e = star(spark, sf_dir, "events").select("event_id", F.explode(F.array(*[F.lit(x) for x in ("weak", "strong", "rare")])).alias("rule"))
    e = e.withColumn("hit", F.when(F.col("rule") == "weak", True).when(F.col("rule") == "strong", k % 20 == 0).otherwise(k % 4999 == 0))
    return validate.validate_rules(e, "rule", "hit", None).select("rule", "hits", F.round("fpr", 6).alias("fpr"))


SETS = "tr AS (SELECT event_id FROM events WHERE event_id % 7 = 0), me AS (SELECT event_id FROM events WHERE event_id % 14 = 0 OR event_id % 11 = 0), ot AS (SELECT event_id FROM events WHERE event_id % 21 = 0 OR event_id % 35 = 0), j AS (SELECT e.event_id, e.event_id IN (FROM tr) AS t, e.event_id IN (FROM me) AS m, e.event_id IN (FROM ot) AS o FROM events e)"


def _sets(spark, sf_dir):
    e = star(spark, sf_dir, "events").select("event_id")
    return e.where("event_id % 7 = 0"), e.where("event_id % 14 = 0 OR event_id % 11 = 0"), e.where("event_id % 21 = 0 OR event_id % 35 = 0")


def _complement(inside: str) -> str:
    return f"""WITH {SETS}, g AS (SELECT count(*) FILTER (WHERE {inside} AND m AND o) AS a, count(*) FILTER (WHERE {inside} AND m AND NOT o) AS b, count(*) FILTER (WHERE {inside} AND NOT m AND o) AS c, count(*) FILTER (WHERE t AND NOT m AND NOT o) AS d, count(*) FILTER (WHERE t) AS n_truth, count(*) FILTER (WHERE t AND m) AS tm, count(*) FILTER (WHERE t AND o) AS tot, count(*) FILTER (WHERE t AND (m OR o)) AS tb FROM j)
  SELECT a, b, c, d, n_truth, round(b / (b + d), 6) AS cc, round(b / (a + b + c + d), 6) AS ci, round(tm / n_truth, 6) AS recall_mine, round(tot / n_truth, 6) AS recall_other, round(tb / n_truth, 6) AS recall_union, round(tb / n_truth - tot / n_truth, 6) AS gain, round((abs(b - c) - 1) * (abs(b - c) - 1) / (b + c), 6) AS mcnemar FROM g"""


def _rounded_complement(df):
    return df.withColumns({c: F.round(c, 6) for c in ("cc", "ci", "recall_mine", "recall_other", "recall_union", "gain", "mcnemar")})


@query("complementarity", _complement("t"))
def complementarity(spark, sf_dir):
    return _rounded_complement(validate.complementarity(*_sets(spark, sf_dir), key="event_id"))


@query("complementarity_as_found", _complement("true"))
def complementarity_as_found(spark, sf_dir):
    return _rounded_complement(validate.complementarity(*_sets(spark, sf_dir), key="event_id", restrict_to_truth=False))


@query("chi_square", "WITH c AS (SELECT count(*) FILTER (WHERE event_type = 'error' AND value > 50) AS a, count(*) FILTER (WHERE event_type = 'error' AND value <= 50) AS b, count(*) FILTER (WHERE event_type <> 'error' AND value > 50) AS c, count(*) FILTER (WHERE event_type <> 'error' AND value <= 50) AS d FROM events) SELECT a, b, c, d, round((a + b + c + d)::DOUBLE * (a * d - b * c)::DOUBLE * (a * d - b * c)::DOUBLE / ((a + b)::DOUBLE * (c + d) * (a + c) * (b + d)), 6) AS chi_square FROM c")
def chi_square(spark, sf_dir):
    e, high = F.col("event_type") == "error", F.col("value") > 50
    c = star(spark, sf_dir, "events").agg(F.count_if(e & high).alias("a"), F.count_if(e & ~high).alias("b"), F.count_if(~e & high).alias("c"), F.count_if(~e & ~high).alias("d"))
    return c.withColumn("chi_square", F.round(validate.chi_square_2x2(*[F.col(x) for x in "abcd"]), 6))


@query("kolmogorov_smirnov", "WITH v AS (SELECT value, count(*) FILTER (WHERE event_type <> 'error') AS c1, count(*) FILTER (WHERE event_type = 'error') AS c2 FROM events GROUP BY value), r AS (SELECT sum(c1) OVER w AS r1, sum(c2) OVER w AS r2, sum(c1) OVER () AS n1, sum(c2) OVER () AS n2 FROM v WINDOW w AS (ORDER BY value ROWS UNBOUNDED PRECEDING)) SELECT round(max(abs(r1 / n1 - r2 / n2)), 6) AS statistic, CAST(max(n1) AS BIGINT) AS n1, CAST(max(n2) AS BIGINT) AS n2, round(1.36 * sqrt((max(n1) + max(n2)) / (max(n1) * max(n2))), 6) AS critical FROM r")
def ks(spark, sf_dir):
    d = star(spark, sf_dir, "events").withColumn("second", F.col("event_type") == "error")
    return validate.ks_two_sample(d, "value", "second").withColumns({"statistic": F.round("statistic", 6), "critical": F.round("critical", 6)})


@query("wilson_intervals", "WITH g AS (SELECT event_type, count(*) FILTER (WHERE value > 60) AS k, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1), p AS (SELECT event_type, k / n AS p, n, 1.959964::DOUBLE AS z FROM g) SELECT event_type, round((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 6) AS low, round((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 6) AS high FROM p")
def wilson(spark, sf_dir):
    g = star(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 60).alias("k"), F.count(F.lit(1)).cast("double").alias("n"))
    low, high = validate.wilson(F.col("k"), F.col("n"))
    return g.select("event_type", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("correlations", "WITH d AS (SELECT CAST(value AS DOUBLE) AS x, CAST(event_id * 7919 % 997 AS DOUBLE) + value * 3 AS y FROM events), r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM d) SELECT round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r")
def correlations(spark, sf_dir):
    d = star(spark, sf_dir, "events").select(F.col("value").alias("x"), (F.col("event_id") * 7919 % 997 + F.col("value") * 3).alias("y"))
    return validate.spearman(d, "x", "y").select(F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


@query("effect_size", "WITH events2 AS (SELECT event_type, CASE WHEN event_type = 'error' THEN value + 10 ELSE value END AS value FROM events) SELECT round((avg(value) FILTER (WHERE event_type = 'error') - avg(value) FILTER (WHERE event_type <> 'error')) / sqrt(((count(*) FILTER (WHERE event_type = 'error') - 1) * var_samp(value) FILTER (WHERE event_type = 'error') + (count(*) FILTER (WHERE event_type <> 'error') - 1) * var_samp(value) FILTER (WHERE event_type <> 'error')) / (count(*) - 2)), 6) AS cohens_d FROM events2")
def effect_size(spark, sf_dir):
    d = star(spark, sf_dir, "events").withColumn("g", F.col("event_type") == "error").withColumn("value", F.when(F.col("g"), F.col("value") + 10).otherwise(F.col("value")))
    return validate.cohens_d(d, "value", "g").select(F.round("cohens_d", 6).alias("cohens_d"))


@query("truth_matching", f"""WITH {TRIPS}, {INJECTED}, f AS (SELECT DISTINCT n, 'SYN001' AS rule_id FROM ij WHERE fare < 0 UNION SELECT DISTINCT n, 'SEM002' FROM ij WHERE dropoff < pickup UNION SELECT DISTINCT n, 'REF' FROM ij WHERE location > 5000 OR n % 1009 = 0),
  i AS (SELECT DISTINCT n, {KIND} AS kind FROM trips WHERE {KIND} IS NOT NULL) SELECT i.kind AS anomaly_type, f.rule_id, count(*) AS n FROM i FULL JOIN f ON i.n = f.n GROUP BY ALL""")
def truth_matching(spark, sf_dir):
    return validate.match_truth(*_injected_found(spark, sf_dir), key="n")


def _injected_found(spark, sf_dir):
    t = trips(spark, sf_dir).withColumns({"total": F.col("fare"), "location": F.col("pu")})
    j = inject(t, "n")
    rule = F.array_compact(F.array(F.when(F.col("fare") < 0, "SYN001"), F.when(F.col("dropoff") < F.col("pickup"), "SEM002"), F.when((F.col("location") > 5000) | (F.col("n") % 1009 == 0), "REF")))
    found = j.select("n", F.explode(rule).alias("rule_id"))
    return j.where("anomaly_type IS NOT NULL").select("n", "anomaly_type"), found


@query("precision_recall", f"""WITH {TRIPS}, {INJECTED}, f AS (SELECT DISTINCT n, 'SYN001' AS rule_id FROM ij WHERE fare < 0 UNION SELECT DISTINCT n, 'SEM002' FROM ij WHERE dropoff < pickup UNION SELECT DISTINCT n, 'REF' FROM ij WHERE location > 5000 OR n % 1009 = 0),
  i AS (SELECT DISTINCT n FROM trips WHERE {KIND} IS NOT NULL), g AS (SELECT rule_id, count(i.n) AS tp, count(*) - count(i.n) AS fp FROM f LEFT JOIN i ON i.n = f.n GROUP BY 1)
  SELECT rule_id, tp, fp, (SELECT count(*) FROM i) AS n_injected, round(tp / (tp + fp), 6) AS precision, round(tp / (SELECT count(*) FROM i), 6) AS recall FROM g""")
def precision_recall(spark, sf_dir):
    r = validate.precision_recall(*_injected_found(spark, sf_dir), key="n")
    return r.withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


@query("tqs", """WITH g AS (SELECT *, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS w, CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type, CAST(floor(epoch(ts) / 86400) AS BIGINT) ORDER BY ts)) AS DOUBLE) / 1000000.0 AS gap FROM events)
  SELECT event_type, w * 86400 AS window_start, count(*) AS n, round(exp(-1e-8::DOUBLE * coalesce(var_pop(gap), 0)), 6) AS timeliness, round(avg(CASE WHEN value BETWEEN 2.5 AND 150 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(count(DISTINCT user_id) / count(*), 6) AS uniqueness,
    round(0.2 * exp(-1e-8::DOUBLE * coalesce(var_pop(gap), 0)) + 0.4 + 0.2 * avg(CASE WHEN value BETWEEN 2.5 AND 150 THEN 1.0 ELSE 0.0 END) + 0.2 * count(DISTINCT user_id) / count(*), 5) AS tqs FROM g GROUP BY event_type, w""")
def tqs(spark, sf_dir):
    t = reports.tqs(star(spark, sf_dir, "events"), "ts", ["event_type"], "value", "user_id", 2.5, 150.0, "1 day")
    return t.select("event_type", F.unix_seconds("window_start").alias("window_start"), "n", *[F.round(c, 6).alias(c) for c in ("timeliness", "accuracy", "uniqueness")], F.round("tqs", 5).alias("tqs"))


@query("six_dimensions", f"WITH {EVENTS} SELECT event_type, round(0.2 * avg(CASE WHEN value_raw IS NOT NULL AND value_raw <> 'NaN' THEN 1.0 ELSE 0.0 END) + 0.2 * avg(CASE WHEN try_cast(value_raw AS DOUBLE) BETWEEN 0 AND 200 THEN 1.0 ELSE 0.0 END) + 0.1 * count(DISTINCT event_id) / count(*), 5) AS score FROM ev GROUP BY 1")
def six(spark, sf_dir):
    e = events(spark, sf_dir)
    raw = F.col("value_raw")
    complete = F.avg(F.when(raw.isNotNull() & (raw != "NaN"), 1.0).otherwise(0.0))
    accurate = F.avg(F.when(raw.try_cast("double").between(0, 200), 1.0).otherwise(0.0))
    score = reports.six_dimensions({"completeness": complete, "accuracy": accurate, "uniqueness": F.count_distinct("event_id") / F.count(F.lit(1))})
    return e.groupBy("event_type").agg(F.round(score, 5).alias("score"))


@query("detector_agreement", """WITH d AS (SELECT doc_id, text, quality = 0 AS bad, toxic = 1 AS toxic FROM documents JOIN labels USING (doc_id)), g AS (SELECT m.method, d.bad OR d.toxic AS truth, CASE m.method WHEN 'short' THEN length(text) < 300 WHEN 'marks' THEN contains(text, '!!') OR contains(text, '%%%') ELSE contains(text, ' | ') END AS hit FROM d, (VALUES ('short'), ('marks'), ('table')) m(method))
  SELECT method, count(*) FILTER (WHERE truth AND hit) AS a, count(*) FILTER (WHERE NOT truth AND hit) AS b, count(*) FILTER (WHERE truth AND NOT hit) AS c, count(*) FILTER (WHERE NOT truth AND NOT hit) AS d FROM g GROUP BY method""")
def detector_agreement(spark, sf_dir):
    d = star(spark, sf_dir, "documents").select("doc_id", "text").join(star(spark, sf_dir, "labels"), "doc_id")
    hit = F.when(F.col("method") == "short", F.length("text") < 300).when(F.col("method") == "marks", F.contains("text", F.lit("!!")) | F.contains("text", F.lit("%%%"))).otherwise(F.contains("text", F.lit(" | ")))
    truth = (F.col("quality") == 0) | (F.col("toxic") == 1)
    g = d.withColumn("method", F.explode(F.array(*[F.lit(x) for x in ("short", "marks", "table")]))).withColumn("hit", hit).withColumn("truth", truth)
    return g.groupBy("method").agg(F.count_if(F.col("truth") & F.col("hit")).alias("a"), F.count_if(~F.col("truth") & F.col("hit")).alias("b"), F.count_if(F.col("truth") & ~F.col("hit")).alias("c"), F.count_if(~F.col("truth") & ~F.col("hit")).alias("d"))
