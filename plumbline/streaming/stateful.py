"""Stateful processors: motion by vehicle, duplicates by fingerprint, suppression of alerts.

Each gives in a stream what the batch operator of the same name gives, if rows come in
order of arrival.  State is a few numbers per key and expires.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import duplicates as dup

MOTION_SCHEMA = "vehicle_id string, arrival long, rule_id string, severity string, reason string"
DUPLICATE_SCHEMA = "fingerprint string, arrival long, confidence double, severity string"
ALERT_SCHEMA = "alert_key string, arrival long"
TTL_MS = 24 * 3600 * 1000


def metres_between(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    p, q = math.radians(lat1), math.radians(lat2)
    a = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6_371_000.0 * math.asin(min(1.0, math.sqrt(a)))


class Motion(StatefulProcessor):
    """CRS001 and CRS002: rows (vehicle_id, arrival, t, latitude, longitude)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t double, lat double, lon double", ttlDurationMs=TTL_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        out = []
        pdf = pd.concat(list(rows)).sort_values("arrival")
        before = self.last.get() if self.last.exists() else None
        for r in pdf.itertuples(index=False):
            if pd.isna(r.latitude) or pd.isna(r.longitude) or pd.isna(r.t):
                continue
            if before is not None and r.t > before[0]:
                m = metres_between(before[1], before[2], r.latitude, r.longitude)
                kmh = m / (r.t - before[0]) * 3.6
                if kmh > 160.0:
                    out.append((key[0], r.arrival, "CRS001", "HIGH", "IMPOSSIBLE_SPEED"))
                if m > 100.0 and kmh < 40.0:
                    out.append((key[0], r.arrival, "CRS002", "CRITICAL" if kmh < 1 else "HIGH" if kmh < 20 else "MEDIUM", "POSITION_JUMP"))
            before = (float(r.t), float(r.latitude), float(r.longitude))
        if before is not None:
            self.last.update(tuple(before))
        yield pd.DataFrame(out, columns=["vehicle_id", "arrival", "rule_id", "severity", "reason"])

    def close(self) -> None:
        pass


class Duplicates(StatefulProcessor):
    """CRS003: rows (fingerprint, arrival, t, source, batch).  Evidence older than the window is dropped."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "t double", ttlDurationMs=TTL_MS)
        self.last = handle.getValueState("last", "t double, source string, batch string, cluster double", ttlDurationMs=TTL_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        times = [x[0] for x in self.seen.get()] if self.seen.exists() else []
        last = self.last.get() if self.last.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values(["t", "arrival"]).itertuples(index=False):
            times = [t for t in times if r.t - t <= dup.WINDOW_SECONDS]
            if times and last is not None:
                dt = r.t - last[0]
                time = 1.0 if dt <= dup.AT_ONCE_SECONDS else math.exp(-dt / dup.DECAY_SECONDS)
                same = last[1] == r.source
                source = (1.0 if r.batch is not None and last[2] == r.batch else 0.5) if same else 0.0
                confidence = min(1.0, max(0.0, 0.5 * time + 0.3 * source + 0.2 * (1.0 if len(times) >= 2 else 0.5)))
            else:
                confidence = 0.0
            cluster = last[3] if last is not None else None
            if confidence > dup.SUPPRESS and (cluster is None or r.t - cluster >= dup.CLUSTER_SECONDS):
                cluster = float(r.t)
                out.append((key[0], r.arrival, confidence, "HIGH" if confidence > dup.HIGH else "MEDIUM"))
            times.append(float(r.t))
            last = (float(r.t), r.source, r.batch, cluster)
        self.seen.put([(t,) for t in times])
        if last is not None:
            self.last.update(last)
        yield pd.DataFrame(out, columns=["fingerprint", "arrival", "confidence", "severity"])

    def close(self) -> None:
        pass


class Suppression(StatefulProcessor):
    """Alerts that are sent: rows (alert_key, arrival, t); none within 300 s of the last one sent."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sent = handle.getValueState("sent", "t double", ttlDurationMs=TTL_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        last = self.sent.get()[0] if self.sent.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values(["t", "arrival"]).itertuples(index=False):
            if last is None or r.t - last >= 300.0:
                last = float(r.t)
                out.append((key[0], r.arrival))
        if last is not None:
            self.sent.update((last,))
        yield pd.DataFrame(out, columns=["alert_key", "arrival"])

    def close(self) -> None:
        pass


def _apply(df: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    return df.groupBy(key).transformWithStateInPandas(processor, schema, "append", "ProcessingTime")


def motion(df: DataFrame) -> DataFrame:
    return _apply(df, "vehicle_id", Motion(), MOTION_SCHEMA)


def duplicates(df: DataFrame) -> DataFrame:
    return _apply(df, "fingerprint", Duplicates(), DUPLICATE_SCHEMA)


def suppressed_alerts(df: DataFrame) -> DataFrame:
    return _apply(df, "alert_key", Suppression(), ALERT_SCHEMA)
