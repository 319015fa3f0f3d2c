"""Command line: ``python -m plumbline batch|stream|profile``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from .operators import alerts, profile
from .operators.contracts import load_contract
from .pipeline import ENTITIES, Pipeline
from .session import build_session
from .sources import readers
from .schemas import TAXI, VEHICLE


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    p.add_argument("mode", choices=["batch", "stream", "profile"])
    p.add_argument("--entity", choices=sorted(ENTITIES), default="nyc_taxi")
    p.add_argument("--path", help="Parquet to read")
    p.add_argument("--kafka", help="servers of a Kafka source (stream)")
    p.add_argument("--topic", help="topics of a Kafka source, comma-separated")
    p.add_argument("--rules", help="folder of YAML rules in the place of the default ones")
    p.add_argument("--contract", help="YAML file of a contract")
    p.add_argument("--store", help="folder of the findings")
    p.add_argument("--checkpoint", help="folder of a stream's progress")
    p.add_argument("--order", help="column with the order of arrival; made if absent")
    p.add_argument("--as-of", help="reference time of checks against a clock; now if absent")
    p.add_argument("--window", default="5 minutes")
    p.add_argument("--stdout-alerts", action="store_true")
    p.add_argument("--slack", help="web hook of a chat channel")
    p.add_argument("--email", action="append", help="recipient of alerts; may be repeated")
    p.add_argument("--smtp-host", default="localhost")
    p.add_argument("--once", action="store_true", help="a stream ends when its source is read")
    p.add_argument("--master")
    return p


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if not (a.path or (a.mode == "stream" and a.kafka and a.topic)):
        p.error("name a --path, or --kafka and --topic for a stream")
    if a.mode == "stream" and not a.checkpoint:
        p.error("a stream needs a --checkpoint")
    spark = build_session("plumbline", a.master)
    router = alerts.Router()
    if a.stdout_alerts:
        router.register("stdout", alerts.to_stdout)
    if a.slack:
        router.register("slack", alerts.Slack(a.slack))
    if a.email:
        router.register("email", alerts.Email(a.email, host=a.smtp_host))
    schema = TAXI if a.entity == "nyc_taxi" else VEHICLE
    if a.mode == "stream" and a.kafka:
        records = readers.split_malformed(readers.parsed(readers.kafka_stream(spark, a.kafka, a.topic), schema, keep=("offset",)))[0]
        order = a.order or "offset"
    elif a.mode == "stream":
        records, order = readers.instants(readers.file_stream(spark, a.path, spark.read.parquet(a.path).schema)), a.order
    else:
        records, order = readers.instants(spark.read.parquet(a.path)), a.order
    if a.mode == "profile":
        print(profile.report(profile.profile(records)))
        return 0
    if order is None:
        # a stream has no running number, but the time of its micro-batches
        made = F.unix_micros(F.current_timestamp()) if a.mode == "stream" else F.monotonically_increasing_id()
        records, order = records.withColumn("_order", made), "_order"
    as_of = F.lit(a.as_of).cast("timestamp") if a.as_of else None
    contract = load_contract(a.contract) if a.contract else None
    line = Pipeline(spark, a.entity, as_of, contract, a.rules, a.store, router if router.channels else None, order, window=a.window)
    if a.mode == "stream":
        line.start(records, a.checkpoint, a.once).awaitTermination()
    else:
        line.process(records)
    print(json.dumps(line.metrics(), indent=1))
    if contract:
        print(json.dumps(line.evaluated().first().asDict(), indent=1))
    return 0


if __name__ == "__main__":
    sys.exit(main())
