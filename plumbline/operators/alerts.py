"""Alert routing: severity, suppression of repeats, confidence, channels, digests."""

from __future__ import annotations

import json
import smtplib
import urllib.request
from collections.abc import Callable, Sequence
from email.message import EmailMessage

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .greedy import anchored

SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
#: Colour of each severity in a chat message (fixed values).
COLOURS = {"LOW": "#36a64f", "MEDIUM": "#ffcc00", "HIGH": "#ff9900", "CRITICAL": "#ff0000"}
SUPPRESS_SECONDS, CONFIDENCE = 300.0, 0.7
TALLY = pa.schema([("channel", pa.string()), ("sent", pa.int64()), ("failed", pa.int64())])


def severity_rank(severity: Column) -> Column:
    """0 for LOW up to 3; null for an unknown severity, which never alerts."""
    out = None
    for i, s in enumerate(SEVERITIES):
        out = F.when(severity == s, i) if out is None else out.when(severity == s, i)
    return out


def passes_threshold(severity: Column, threshold: str = "MEDIUM") -> Column:
    return F.coalesce(severity_rank(severity) >= SEVERITIES.index(threshold), F.lit(False))


def should_route(confidence: Column, threshold: float = CONFIDENCE) -> Column:
    """A finding without confidence is routed; one with it only above the threshold."""
    return confidence.isNull() | (confidence > threshold)


def to_send(found: DataFrame, ts: str, order: str, threshold: str = "MEDIUM", within: float = SUPPRESS_SECONDS, confidence: str | None = None) -> DataFrame:
    """The findings that become alerts: severe enough, and none sent for (rule, entity, type) within the time."""
    d = found.where(passes_threshold(F.col("severity"), threshold))
    if confidence:
        d = d.where(should_route(F.col(confidence)))
    d = d.withColumn("_key", F.concat_ws("\x1f", "rule_id", F.coalesce("entity_id", F.lit("")), F.coalesce("violation_type", F.lit("")))).withColumn("_t", F.unix_micros(ts) / F.lit(1_000_000.0))
    return anchored(d, "_key", "_t", order, within).where("opens").drop("opens", "_key", "_t")


def message(alert: Column | None = None) -> Column:
    return F.format_string("[%s] %s on %s: %s", F.col("severity"), F.col("rule_id"), F.coalesce(F.col("entity_id"), F.lit("?")), F.coalesce(F.col("violation_type"), F.lit("?")))


def colour(severity: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in COLOURS.items() for x in p])[severity], F.lit("#808080"))


def hourly_digest(alerts: DataFrame, ts: str) -> DataFrame:
    return alerts.groupBy(F.date_trunc("hour", ts).alias("hour"), "rule_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity_id").alias("n_entities"))


class Router:
    """Sends alerts to channels, in a foreachBatch or after a batch.  A channel is a function of a dict that says whether it worked."""

    def __init__(self):
        self.channels: dict[str, Callable[[dict], bool]] = {}

    def register(self, name: str, send: Callable[[dict], bool]) -> None:
        self.channels[name] = send

    def route(self, alerts: DataFrame) -> dict[str, dict[str, int]]:
        """{channel: {sent, failed}}.  The executors send what their partitions hold; a channel that fails does not stop the others.

        Channels and what they refer to travel to the executors, so they must be picklable.  A
        task that is run again sends its alerts again.
        """
        channels = dict(self.channels)

        def send_all(batches):
            tally = {name: [0, 0] for name in channels}
            for b in batches:
                for alert in b.to_pylist():
                    for name, send in channels.items():
                        try:
                            worked = bool(send(alert))
                        except Exception:  # counted as a failure of this channel
                            worked = False
                        tally[name][0 if worked else 1] += 1
            yield pa.RecordBatch.from_pydict({"channel": list(tally), "sent": [x[0] for x in tally.values()], "failed": [x[1] for x in tally.values()]}, schema=TALLY)

        told = alerts.withColumn("message", message()).withColumn("colour", colour(F.col("severity")))
        rows = told.mapInArrow(send_all, "channel string, sent long, failed long").groupBy("channel").agg(F.sum("sent").alias("sent"), F.sum("failed").alias("failed")).collect()  # a row per channel
        out = {name: {"sent": 0, "failed": 0} for name in channels}
        out.update({r["channel"]: {"sent": r["sent"], "failed": r["failed"]} for r in rows})
        return out


def to_stdout(alert: dict) -> bool:
    print(alert["message"], flush=True)
    return True


class Slack:
    """Posts an alert to a web hook as a message with an attachment in the severity's colour."""

    def __init__(self, url: str | None, enabled: bool = True, seconds: float = 5.0):
        self.url, self.enabled, self.seconds = url, enabled, seconds

    def payload(self, alert: dict) -> dict:
        fact = lambda title, key: {"title": title, "value": str(alert.get(key) or "?"), "short": True}
        facts = [fact("Entity", "entity_id"), fact("Rule", "rule_id"), fact("Type", "violation_type"), fact("Severity", "severity")]
        return {"text": f":warning: *{alert['severity']}* finding: `{alert['rule_id']}`", "attachments": [{"color": alert["colour"], "fields": facts, "text": alert["message"]}]}

    def __call__(self, alert: dict) -> bool:
        if not self.enabled:
            return True
        if not self.url:
            return False
        body = json.dumps(self.payload(alert)).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json"}, method="POST")
        with urllib.request.urlopen(request, timeout=self.seconds) as answer:
            return answer.status == 200


class Email:
    """Mails an alert as plain text."""

    def __init__(self, to: Sequence[str], sender: str = "alerts@example.com", host: str = "localhost", port: int = 587, enabled: bool = True):
        self.to, self.sender, self.host, self.port, self.enabled = list(to), sender, host, port, enabled

    def mail(self, alert: dict) -> EmailMessage:
        m = EmailMessage()
        m["Subject"] = f"[{alert['severity']}] Finding: {alert['rule_id']}"
        m["From"], m["To"] = self.sender, ", ".join(self.to)
        m.set_content(alert["message"])
        return m

    def __call__(self, alert: dict) -> bool:
        if not self.enabled:
            return True
        if not self.to:
            return False
        with smtplib.SMTP(self.host, self.port) as server:
            server.send_message(self.mail(alert))
        return True
