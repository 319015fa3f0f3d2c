"""Worked numbers and edge cases of the operators."""

from __future__ import annotations

import json
import math
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from plumbline.functions import context as ctx
from plumbline.functions import scalars
from plumbline.operators import alerts, contracts, drift, duplicates, integrity, motion, reports, scoring, stats, taxi_checks, transit_checks, validate
from plumbline.operators.finding import findings
from plumbline.sources import config, inject, readers
from plumbline.sources.vehicle_feed import VehicleFeed

T0 = datetime(2024, 1, 15, 10, 30, tzinfo=timezone.utc)


def reasons(spark, check_of, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    got = {r["i"]: r["reason"] for r in findings(df, [check_of(F.col("v"))], ["i"]).collect()}
    return [got.get(i) for i in range(len(values))]


def test_missing_values_are_told_apart(spark):
    values = [None, "NaN", "nan", "x", "-1", "5", "0"]
    assert reasons(spark, taxi_checks.fare_valid, values) == ["NULL", "NAN_VALUE", None, "TYPE_MISMATCH", "NEGATIVE_VALUE", None, None]


def test_zone_text_and_numbers(spark):
    assert reasons(spark, taxi_checks.zone_valid, [None, "1", "263", "264", "0", "12.5", " 12 "]) == ["NULL", None, None, "OUT_OF_RANGE", "OUT_OF_RANGE", "TYPE_MISMATCH", None]
    assert reasons(spark, lambda c: taxi_checks.zone_valid(c, is_text=False), [263.9, 0.5, float("nan"), None], "double") == [None, "OUT_OF_RANGE", "TYPE_MISMATCH", "NULL"]


def test_future_boundary(spark):
    as_of = F.lit("2024-01-15 10:00:00").cast("timestamp")
    check = lambda c: taxi_checks.not_future(c, scalars.parse_time(c), as_of)
    assert reasons(spark, check, ["2024-01-15T10:05:00Z", "2024-01-15T10:05:01Z", "soon", None]) == [None, "FUTURE_TIMESTAMP", "PARSE_ERROR", "NULL"]


def test_speed_and_duration(spark):
    df = spark.createDataFrame([(1, "10", 600.0), (2, "100", 1800.0), (3, "0", 600.0), (4, "NaN", 600.0), (5, "1", 30.0), (6, None, 600.0), (7, "1", 90_000.0)], "i int, d string, s double")
    got = {(r["i"], r["rule_id"]): r["reason"] for r in findings(df, [taxi_checks.speed_sane(F.col("d"), F.col("s")), taxi_checks.duration_sane(F.col("s"))], ["i"]).collect()}
    assert got == {(2, "SEM003"): "EXCEEDS_MAX_SPEED", (3, "SEM003"): "ZERO_OR_NEGATIVE_DISTANCE", (4, "SEM003"): "NAN_VALUE", (5, "SEM002"): "TOO_SHORT", (7, "SEM002"): "TOO_LONG"}


def test_transit_positions(spark):
    df = spark.createDataFrame([(1, "91", "0"), (2, "x", "0"), (3, None, None), (4, "0", "181"), (5, "NaN", "0"), (6, "45", "-74"), (7, None, "0")], "i int, a string, o string")
    got = {r["i"]: r["reason"] for r in findings(df, [transit_checks.position_valid(F.col("a"), F.col("o"))], ["i"]).collect()}
    assert got == {1: "OUT_OF_RANGE", 2: "PARSE_ERROR", 4: "OUT_OF_RANGE", 5: "OUT_OF_RANGE", 7: "PARSE_ERROR"}
    assert reasons(spark, transit_checks.speed_valid, ["-1", "301", "300", "NaN", "x", None]) == ["NEGATIVE_VALUE", "EXCEEDS_MAX", None, None, "PARSE_ERROR", None]
    assert reasons(spark, transit_checks.vehicle_id_valid, [None, " ", "a"]) == ["MISSING_OR_EMPTY", "MISSING_OR_EMPTY", None]


def test_formats_and_precision(spark):
    uuid = "123E4567-e89b-12d3-a456-426614174000"
    assert reasons(spark, lambda c: integrity.format_conforms(c, "uuid"), [uuid, "123", None]) == [None, "FORMAT_MISMATCH", None]
    assert reasons(spark, lambda c: integrity.format_conforms(c, "hex_color"), ["#Aa00ff", "#12"]) == [None, "FORMAT_MISMATCH"]
    assert reasons(spark, lambda c: integrity.format_conforms(c, "phone_e164"), ["+491234567", "0123"]) == [None, "FORMAT_MISMATCH"]
    with pytest.raises(ValueError):
        integrity.format_conforms(F.lit("x"), "nope")
    assert reasons(spark, lambda c: integrity.precision_conforms(c, 1), [2.5, 0.1, 3.0, 901.825], "double") == [None, None, None, "EXCESSIVE_PRECISION"]
    assert reasons(spark, lambda c: integrity.precision_conforms(c, 1, allow_fewer=False), [2.5, 3.0], "double") == [None, "PRECISION_MISMATCH"]
    assert reasons(spark, lambda c: integrity.in_reference_set(c, "unknown_field"), ["1", None]) == ["FOREIGN_KEY_NOT_FOUND", None]
    assert reasons(spark, lambda c: integrity.enumeration_conforms(c, "store_and_fwd_flag"), ["Y", "X", None]) == [None, "INVALID_ENUM_VALUE", None]


@pytest.mark.parametrize(
    ("events", "want"),
    [
        ([(0, "a", "b")], [0.0]),
        ([(0, "a", "b"), (2, "a", "b")], [0.0, 0.9]),
        ([(0, "a", "b"), (3, "z", "b")], [0.0, 0.6]),
        ([(0, "a", "b"), (60, "a", "b")], [0.0, 0.5 * math.exp(-0.2) + 0.4]),
        ([(0, "a", "b"), (1, "a", "b"), (2, "a", "b")], [0.0, 0.9, 1.0]),
        ([(0, "a", "b"), (200, "z", "b")], [0.0, 0.5 * math.exp(-2 / 3) + 0.1]),
        ([(0, "a", None), (2, "a", None)], [0.0, 0.75]),
        ([(0, "a", "b"), (4000, "a", "b")], [0.0, 0.0]),
    ],
)
def test_confidence(spark, events, want):
    df = spark.createDataFrame([("k", T0 + timedelta(seconds=s), i, src, b) for i, (s, src, b) in enumerate(events)], "key string, ts timestamp, n int, source string, batch string")
    got = [r["confidence"] for r in duplicates.with_confidence(df, "key", "ts", "n", "source", "batch").orderBy("n").collect()]
    assert got == pytest.approx(want)


def test_bursts_are_one_finding(spark):
    df = spark.createDataFrame([("k", T0 + timedelta(seconds=2 * i), i, "a", "b", False) for i in range(5)], "key string, ts timestamp, n int, source string, batch string, replay boolean")
    got = duplicates.duplicates(df, "key", "ts", "n", "source", "batch", "replay").collect()
    assert [(r["n"], r["severity"]) for r in got] == [(1, "HIGH")]
    assert duplicates.duplicates(df.withColumn("replay", F.lit(True)), "key", "ts", "n", "source", "batch", "replay").count() == 0


def test_keys_of_the_hierarchy(spark):
    df = ctx.with_zone(spark.createDataFrame([(161, T0), (999, T0)], "loc int, ts timestamp"), "loc", ctx.zone_table(spark)).withColumn("t", ctx.temporal(F.col("ts")))
    keys = ctx.context_keys(F.col("t.hour_of_day"), F.col("t.time_category"), F.col("zone_category"), F.col("borough"), F.col("t.is_weekend"))
    rows = {r["loc"]: [k["key"] for k in r["k"]] for r in df.select("loc", keys.alias("k")).collect()}
    assert rows[161] == ["hour_10_midtown_weekday", "morning_midtown_weekday", "morning_Manhattan_weekday", "morning", "global"]
    assert rows[999][:3] == ["hour_10_unknown_weekday", "morning_unknown_weekday", "morning_unknown_weekday"]
    assert [ctx.confidence(i) for i in range(5)] == [1.0, 0.9, 0.8, 0.7, 0.5]


def test_holidays_are_thirty():
    months = {2024: "01-01 01-15 02-19 05-27 06-19 07-04 09-02 10-14 11-28 12-25", 2025: "01-01 01-20 02-17 05-26 06-19 07-04 09-01 10-13 11-27 12-25", 2026: "01-01 01-19 02-16 05-25 06-19 07-03 09-07 10-12 11-26 12-25"}
    assert ctx.us_holidays() == [f"{y}-{d}" for y, days in months.items() for d in days.split()]
    assert ctx.us_holidays(2025, 2025)[0] == "2025-01-01" and len(ctx.us_holidays(2025, 2025)) == 10


def test_drift_numbers(spark):
    df = spark.createDataFrame([(15.0, 50.0, 25.0, 80.0), (10.0, 30.0, 10.5, 31.0), (5.0, 5.0, 9.0, 9.0)], "a double, b double, c double, d double")
    rows = df.select(drift.approx_psi(*[F.col(c) for c in "abcd"]).alias("p")).select("p", drift.level(F.col("p")).alias("l"), drift.is_drift(F.col("p")).alias("d")).collect()
    assert [round(r["p"], 4) if r["p"] is not None else None for r in rows] == [0.6333, 0.0417, None]
    assert [(r["l"], r["d"]) for r in rows] == [("CRITICAL", True), ("OK", False), (None, False)]
    seen = []
    report = spark.createDataFrame([("f", 0.3, True), ("g", 0.1, False)], "field string, psi double, drift boolean")
    assert drift.notify(report, seen.append) == 1 and seen[0]["field"] == "f"


def test_contracts(tmp_path, spark):
    f = tmp_path / "c.yaml"
    f.write_text("name: replay\ntier: SILVER\nrequired_rules: [A]\noptional_rules: [B]\nsuppressed_rules: [B]\nsla_max_violation_rate: 0.1\nfields:\n  - {name: x, data_type: float, nullable: false, min_value: 0, max_value: 10}\n")
    c = contracts.load_contract(f)
    assert c.gate(["A", "B", "C"]) == ["A"]
    df = spark.createDataFrame([("1",), (None,), ("-1",), ("11",), ("y",), ("NaN",)], "x string")
    got = sorted(r["reason"] for r in findings(df, c.field_checks()).collect())
    assert got == ["ABOVE_MAXIMUM", "BELOW_MINIMUM", "NULL", "TYPE_MISMATCH"]
    with pytest.raises(ValueError):
        contracts.Contract("x", sla_max_violation_rate=1.5)
    with pytest.raises(ValueError):
        contracts.Contract("x", tier="TIN")
    total = spark.createDataFrame([(0,)], "total long")
    none = contracts.evaluate(spark.createDataFrame([], "rule_id string, n long"), total, c).first()
    assert none["tier_achieved"] is None and not none["tier_met"] and none["gap"] == "No records to evaluate"
    full = contracts.evaluate(spark.createDataFrame([("A", 100)], "rule_id string, n long"), spark.createDataFrame([(100,)], "total long"), c).first()
    assert full["tier_achieved"] == "BRONZE" and full["violation_rate"] == 1.0 and full["missing_rules"] == []


def test_rules_from_yaml(tmp_path, spark):
    (tmp_path / "a.yaml").write_text("rule: {id: S1, name: n, type: FareAmountRangeRule, severity: LOW}\n")
    (tmp_path / "b.yaml").write_text("rule: {id: S2, name: n, type: PickupLocationValidRule, severity: LOW, enabled: false}\n")
    as_of = F.lit("2024-01-01").cast("timestamp")
    rules = config.load_rules(tmp_path, as_of)
    assert [(r.rule_id, r.severity) for r in rules] == [("S1", "HIGH")]
    assert config.load_rules(tmp_path, as_of, honor_severity=True)[0].severity == "LOW"
    for text in ("rule: {name: n, type: FareAmountRangeRule, severity: LOW}", "rule: {id: x, name: n, type: Nope, severity: LOW}", "other: 1"):
        bad = tmp_path / "z.yaml"
        bad.write_text(text)
        with pytest.raises(ValueError):
            config.compile_rule(bad, as_of)
    with pytest.raises(FileNotFoundError):
        config.load_rules(tmp_path / "none", as_of)


def test_live_events_without_times_give_25_findings(spark):
    """Ten live events in five pairs: 10 completeness, 10 timestamps, 5 duplicates."""
    rows = [(f"t{i // 2}", str(10 + i // 2), "100", None, T0 + timedelta(seconds=i), i) for i in range(10)]
    df = spark.createDataFrame(rows, "trip_id string, fare_amount string, PULocationID string, tpep_pickup_datetime string, arrived timestamp, n int")
    df = df.withColumns({"tpep_dropoff_datetime": F.lit(None).cast("string"), "trip_distance": F.lit("1")})
    r = config.default_registry("nyc_taxi", F.lit(T0))
    stateless = findings(df, list(r.checks.values())).count()
    dup = duplicates.duplicates(df.withColumn("k", scalars.fingerprint(F.col("trip_id"))).withColumns({"s": F.lit("s"), "b": F.lit("b")}), "k", "arrived", "n", "s", "b").count()
    assert (stateless, dup) == (20, 5)
    replay = contracts.Contract("replay", required_rules=("SYN001", "SYN002", "SEM001", "SEM002"), optional_rules=("CRS001",), suppressed_rules=("CRS003",))
    g = r.gated(replay)
    assert findings(df, list(g.checks.values())).count() == 0 and "CRS003" not in g.stateful
    assert g.summary()["total"] == 5


def test_motion_needs_time_to_pass(spark):
    rows = [("v", 1, 40.0, -74.0, T0), ("v", 2, 40.0, -74.0, T0), ("v", 3, 40.1, -74.0, T0 + timedelta(seconds=60)), ("v", 4, 40.101, -74.0, T0 + timedelta(seconds=660)), (" ", 5, 0.0, 0.0, T0)]
    df = spark.createDataFrame(rows, "vehicle string, n int, latitude double, longitude double, ts timestamp")
    got = [(r["n"], r["rule_id"], r["severity"]) for r in motion.motion_findings(df, "vehicle", "n", motion.motion_checks(), ["n"]).collect()]
    assert got == [(3, "CRS001", "HIGH"), (4, "CRS002", "CRITICAL")]
    strict = findings(motion.with_previous(df, "vehicle", "n"), [motion.transit_motion_check(strict_reference=True)], ["n"]).collect()
    loose = findings(motion.with_previous(df, "vehicle", "n"), [motion.transit_motion_check()], ["n"]).collect()
    assert [r["n"] for r in strict] == [2, 3] and [r["n"] for r in loose] == [3]


def test_alert_router(spark):
    found = spark.createDataFrame([("R", "e", "X", "HIGH", T0, 1), ("R", "e", "X", "HIGH", T0 + timedelta(seconds=10), 2), ("R", "e", "X", "LOW", T0, 3), ("R", "e", "X", "HIGH", T0 + timedelta(seconds=300), 4)], "rule_id string, entity_id string, violation_type string, severity string, ts timestamp, n int")
    sent = alerts.to_send(found, "ts", "n")
    assert sorted(r["n"] for r in sent.collect()) == [1, 4]
    r = alerts.Router()
    r.register("told", lambda a: a["message"] == "[HIGH] R on e: X")
    r.register("broken", lambda a: 1 / 0)
    r.register("nowhere", alerts.Slack(None))
    assert r.route(sent) == {"told": {"sent": 2, "failed": 0}, "broken": {"sent": 0, "failed": 2}, "nowhere": {"sent": 0, "failed": 2}}
    assert r.route(sent.where("false"))["told"] == {"sent": 0, "failed": 0}


def test_channels():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    got = []

    class Hook(BaseHTTPRequestHandler):
        def do_POST(self):
            got.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200)
            self.end_headers()

        def log_message(self, *_):
            pass

    alert = {"severity": "HIGH", "rule_id": "R", "entity_id": "e", "violation_type": "X", "message": "m", "colour": "#ff9900"}
    server = HTTPServer(("127.0.0.1", 0), Hook)
    threading.Thread(target=server.handle_request, daemon=True).start()
    assert alerts.Slack(f"http://127.0.0.1:{server.server_port}/")(alert)
    server.server_close()
    assert got[0]["attachments"][0]["color"] == "#ff9900" and got[0]["attachments"][0]["text"] == "m"
    assert alerts.Slack(None, enabled=False)(alert) and not alerts.Email([])(alert)
    mail = alerts.Email(["a@example.org", "b@example.org"]).mail(alert)
    assert mail["Subject"] == "[HIGH] Finding: R" and mail["To"] == "a@example.org, b@example.org" and mail.get_content() == "m\n"


def test_comparison_of_methods():
    assert validate.chi2_p(3.841458820694124) == pytest.approx(0.05, abs=1e-6)
    assert validate.is_complementary(40, 2, 0.5, 0.001) and not validate.is_complementary(10, 2, 0.5, 0.001)
    low, high = validate.bootstrap_cc(10, 40, 5, 60)
    assert low < 0.4 < high and validate.bootstrap_cc(0, 0, 0, 0) == (0.0, 0.0)


def test_overall_entropy_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([(1.0,)] * 20, "v double")
    assert stats.entropy(df, "v").first()["entropy"] == 0.0
    few = spark.createDataFrame([(float(i),) for i in range(5)], "v double")
    assert stats.entropy(few, "v").first()["entropy"] == 0.0


def test_condition_must_hold_for_its_windows(spark):
    df = spark.createDataFrame([(i, i >= 2) for i in range(6)], "w int, f boolean")
    assert [r["firing"] for r in reports.sustained(df, F.col("f"), "w", 3).orderBy("w").collect()] == [False] * 4 + [True] * 2
    gap = df.where("w <> 3")
    assert not any(r["firing"] for r in reports.sustained(gap, F.col("f"), "w", 3).collect())


def test_effect_size_of_constants(spark):
    df = spark.createDataFrame([(1.0, True), (1.0, True), (1.0, False), (1.0, False)], "v double, g boolean")
    assert validate.cohens_d(df, "v", "g").first()[0] is None
    assert validate.cohens_d(df.where("false"), "v", "g").first()[0] is None


def test_bootstrap_weights_are_poisson(spark):
    from collections import Counter

    import numpy as np

    values = np.repeat(np.arange(200.0), 5).tolist() + [500.0] * 1000  # counts of 5, and one of 1000
    df = spark.createDataFrame([(v,) for v in values], "v double")
    low, high = stats.bootstrap_interval(df, "v", 0.25).first()
    draws = np.random.default_rng(1).poisson([[c for c in Counter(values).values()]] * 400)
    found = [np.percentile(np.repeat(list(Counter(values)), w), 25) for w in draws]
    assert low == pytest.approx(np.percentile(found, 2.5), abs=3) and high == pytest.approx(np.percentile(found, 97.5), abs=3)


def test_order_without_a_task_for_all(spark):
    from plumbline.operators import ordered

    df = spark.createDataFrame([(i * i % 97, i) for i in range(97)] + [(None, 200)], "v int, i int")
    got = {(r["v"], r["i"]): r["s"] for r in ordered.cumulative(df, "v", {"s": F.lit(1)}, slices=7).collect()}
    assert sorted(got.values()) == list(range(1, 99)) and got[None, 200] == 1
    rows = sorted(((v, s) for (v, _), s in got.items() if v is not None), key=lambda x: x[1])
    assert [v for v, _ in rows] == sorted(v for v, _ in rows)


def test_anchored_windows_in_small_batches(spark):
    import random

    from plumbline.operators import greedy

    r = random.Random(4)
    rows = [(r.choice([None, "a", "b", "c"]), r.randint(0, 300) / 2, i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t double, n int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {x["n"]: (x["opens"], x["at"]) for x in greedy.anchored(df, "k", "t", "n", 5.0, members="at").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for key in (None, "a", "b", "c"):
        anchor = None
        for t, n in sorted((t, n) for k, t, n in rows if k == key):
            opens = anchor is None or t - anchor >= 5.0
            anchor, at = (t, 1) if opens else (anchor, at + 1)  # noqa: F821
            assert got[n] == (opens, at)


def test_replay_keeps_its_pace(spark, tmp_path):
    df = spark.createDataFrame([(i, f"r{i}") for i in range(30)], "n int, what string")
    q = readers.paced(spark, df, "n", 1000).writeStream.format("memory").queryName("paced").option("checkpointLocation", str(tmp_path)).start()
    try:
        for _ in range(60):
            if spark.sql("SELECT count(*) FROM paced").first()[0] == 30:
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    assert [r["what"] for r in spark.sql("SELECT what FROM paced ORDER BY arrived, n").collect()] == [f"r{i}" for i in range(30)]


def test_feed_over_http(spark):
    import struct
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from plumbline.sources import vehicle_feed

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    part = lambda field, body: varint(field << 3 | 2) + varint(len(body)) + body
    whole = lambda field, n: varint(field << 3) + varint(n)
    real = lambda field, x: varint(field << 3 | 5) + struct.pack("<f", x)
    vehicle = part(1, part(1, b"t1") + part(5, b"r7") + whole(6, 1)) + part(2, real(1, 40.5) + real(2, -74.25) + real(5, 3.5)) + whole(5, 1705312790) + part(8, part(1, b"bus 1"))
    body = part(1, part(1, b"2.0") + whole(3, 1705312800)) + part(2, part(1, b"e1") + part(4, vehicle)) + part(2, part(1, b"e2"))

    class Feed(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.send_header("Content-Type", "application/x-protobuf")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Feed)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(VehicleFeed)
        r = spark.read.format("vehicle_feed").option("url", f"http://127.0.0.1:{server.server_port}/").option("agency", "x").load().collect()
    finally:
        server.shutdown()
    assert [(x["vehicle_id"], x["latitude"], x["longitude"], x["speed"], x["route_id"], x["direction_id"], x["timestamp"]) for x in r] == [("bus 1", 40.5, -74.25, 3.5, "r7", 1, 1705312790)]
    with pytest.raises((ValueError, IndexError)):
        vehicle_feed.decoded(body[:-1])


def test_pipeline_counts_and_stages(spark, tmp_path):
    from plumbline.pipeline import Pipeline

    rows = [(f"t{i // 2}", str(10 + i // 2), "100", "2024-01-15 10:00:00", "2024-01-15 10:20:00", "2", i) for i in range(10)] + [("bad", "-1", "900", "2024-01-15 10:01:00", "2024-01-15 10:20:00", "2", 10)]
    df = spark.createDataFrame(rows, "trip_id string, fare_amount string, PULocationID string, tpep_pickup_datetime string, tpep_dropoff_datetime string, trip_distance string, n int")
    router = alerts.Router()
    router.register("told", lambda a: True)
    c = contracts.Contract("live", tier="BRONZE", required_rules=("SYN001", "SYN002", "CRS003"))
    p = Pipeline(spark, "nyc_taxi", F.lit(T0).cast("timestamp"), c, store=str(tmp_path / "store"), router=router, order="n")
    assert p.stage == "idle" and p.profile_dataset(df).count() == 7 and p.stage == "idle"
    out = p.process(df)
    assert out.metrics["lifecycle_stage"] == "monitoring" and out.metrics["total_events"] == 11
    assert out.metrics["by_rule"] == {"SYN001": 1, "SYN002": 1, "CRS003": 5} and out.metrics["alerts"]["told"]["sent"] == 7
    assert p.evaluated().first()["total"] == 11 and out.quality.agg(F.sum("events")).first()[0] == 11
    p.process(df.where("n < 2"))
    assert p.metrics()["total_events"] == 13
    clean = p.process(df.where("n = 0"))
    assert clean.found.count() == 0
    p.reset()
    assert p.metrics()["total_events"] == 0 and p.stage == "idle"


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from plumbline import __main__ as cli

    spark.createDataFrame([("v", 1.0, 2.0, "400", "2024-01-15T10:00:00Z")], "vehicle_id string, latitude double, longitude double, speed string, timestamp string").write.parquet(str(tmp_path / "in"))
    monkeypatch.setattr(cli, "build_session", lambda *a, **k: spark)
    assert cli.main(["batch", "--entity", "gtfs", "--path", str(tmp_path / "in"), "--store", str(tmp_path / "out"), "--as-of", "2024-01-15 10:00:00"]) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["by_rule"] == {"GTFSSyn003": 1, "GTFSSem001": 1}
    assert cli.main(["profile", "--path", str(tmp_path / "in")]) == 0 and "vehicle_id" in capsys.readouterr().out
    assert cli.main(["stream", "--once", "--entity", "gtfs", "--path", str(tmp_path / "in"), "--store", str(tmp_path / "out2"), "--checkpoint", str(tmp_path / "cp"), "--as-of", "2024-01-15 10:00:00"]) == 0
    assert json.loads(capsys.readouterr().out)["total_violations"] == 2
    with pytest.raises(SystemExit):
        cli.main(["batch"])


def test_scoring_falls_back(spark):
    df = spark.createDataFrame([(1.0,), (1000.0,)], "x double")
    got = scoring.with_prediction(df, ["x"], lambda: lambda pdf: pdf["x"] * 2, F.lit(7.0)).collect()
    assert [r["predicted"] for r in got] == [2.0, 7.0]


def test_vehicle_feed(spark, tmp_path):
    doc = {"header": {"timestamp": 1705312800}, "entity": [{"vehicle": {"vehicle": {"id": "a"}, "position": {"latitude": 1.0, "longitude": 2.0}, "timestamp": 1705312790}}, {"vehicle": {"vehicle": {"id": "b"}}}]}
    (tmp_path / "1.json").write_text(json.dumps(doc))
    spark.dataSource.register(VehicleFeed)
    rows = spark.read.format("vehicle_feed").option("path", str(tmp_path)).option("agency", "x").load().collect()
    assert [(r["vehicle_id"], r["timestamp"], r["_agency"]) for r in rows] == [("a", 1705312790, "x")]


def test_injection_doubles_duplicates(spark):
    df = spark.range(0, 1600).select(F.col("id").alias("n"), F.lit(10.0).alias("fare"), F.lit(12.0).alias("total"), F.lit(5).alias("location"), F.lit(1.0).alias("distance"), F.lit(T0).alias("pickup"), F.lit(T0 + timedelta(minutes=10)).alias("dropoff"))
    d = inject.inject(df, "n")
    counts = {r["anomaly_type"]: r["count"] for r in d.groupBy("anomaly_type").count().collect()}
    assert counts["duplicate"] == 20 and counts["fare_negative"] == 10 and d.where("anomaly_type = 'fare_negative' AND fare >= 0").count() == 0
    with pytest.raises(ValueError):
        inject.degrade(df, "fare", "n", "melt")


def test_malformed_messages_are_kept_apart(spark):
    from pyspark.sql import types as T

    m = spark.createDataFrame([('{"a": 1}',), ("{oops",), (None,)], "value string")
    good, bad = readers.split_malformed(readers.parsed(m, T.StructType([T.StructField("a", T.IntegerType())])))
    assert good.count() == 2 and [r[0] for r in bad.collect()] == ["{oops"]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "v string")
    assert findings(df, [taxi_checks.fare_valid(F.col("v"))]).count() == 0
    with pytest.raises(ValueError):
        findings(df, [])


def test_fallback_with_and_without_broadcast(spark):
    s = spark.createDataFrame([(0, "a", 5, 1.0), (1, "b", 200, 2.0), (4, "global", 900, 3.0)], "level int, ctx string, count long, p10 double")
    keys = F.array(*[F.struct(F.lit(i).alias("level"), F.col(c).alias("key")) for i, c in ((0, "x"), (1, "y"), (4, "z"))])
    df = spark.createDataFrame([(1, "a", "b", "global"), (2, "a", "q", "global"), (3, "a", "q", "q")], "i int, x string, y string, z string").withColumn("keys", keys)
    for rows in (10, 0):
        got = {r["i"]: r["stat"] and r["stat"]["p10"] for r in stats.with_fallback(df, "keys", s, "i", 100, broadcast_rows=rows).collect()}
        assert got == {1: 2.0, 2: 3.0, 3: None}
