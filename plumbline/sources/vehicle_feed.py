"""Vehicle positions polled from feeds, as a Python data source.

Options: url (one or more feeds, parted by spaces, fetched over HTTP as protobuf or JSON) or
path (a folder of feed documents, one per poll: .json or .pb), and agency.  A folder that
all executors see is read through Arrow's file systems.  Entities without a position are
skipped.  A stream of a folder reads the documents in order of their names, and its offset is
their number; a stream of URLs polls them once a batch.
"""

from __future__ import annotations

import json
import struct
import urllib.request
from collections.abc import Iterator

from pyarrow.fs import FileSelector, FileSystem, LocalFileSystem
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = (
    "vehicle_id string, label string, latitude double, longitude double, bearing double, speed double, route_id string, trip_id string, "
    "direction_id int, stop_id string, timestamp long, timestamp_iso string, event_time string, _agency string"
)

#: Fields of the feed's messages by number (fixed values of the public format): name, and the message within, "text", or nothing.
FIELDS: dict[str, dict[int, tuple[str, str]]] = {
    "feed": {1: ("header", "header"), 2: ("entity", "entity")},
    "header": {1: ("gtfs_realtime_version", "text"), 3: ("timestamp", "")},
    "entity": {1: ("id", "text"), 4: ("vehicle", "vehicle")},
    "vehicle": {1: ("trip", "trip"), 2: ("position", "position"), 5: ("timestamp", ""), 7: ("stop_id", "text"), 8: ("vehicle", "descriptor")},
    "position": {1: ("latitude", ""), 2: ("longitude", ""), 3: ("bearing", ""), 5: ("speed", "")},
    "trip": {1: ("trip_id", "text"), 5: ("route_id", "text"), 6: ("direction_id", "")},
    "descriptor": {1: ("id", "text"), 2: ("label", "text")},
}


def rows_of(document: dict, agency: str) -> Iterator[tuple]:
    from datetime import datetime, timezone

    polled = document.get("header", {}).get("timestamp")
    iso = lambda s: datetime.fromtimestamp(int(s), timezone.utc).isoformat() if s is not None else None
    for entity in document.get("entity", ()):
        v = entity.get("vehicle") or {}
        p = v.get("position")
        if not p:
            continue
        who, trip, ts = v.get("vehicle") or {}, v.get("trip") or {}, v.get("timestamp")
        number = lambda k: float(p[k]) if p.get(k) is not None else None
        yield (
            who.get("id"), who.get("label"), number("latitude"), number("longitude"), number("bearing"), number("speed"), trip.get("route_id"), trip.get("trip_id"),
            trip.get("direction_id"), v.get("stop_id"), int(ts) if ts is not None else None, iso(ts), iso(polled), agency,
        )


def decoded(data: bytes, kind: str = "feed") -> dict:
    """A realtime feed message in protobuf's wire format, as the dictionary that its JSON form gives."""
    out: dict = {}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        tag = number()
        field, wire = tag >> 3, tag & 7
        if wire == 0:
            value: object = number()
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value = struct.unpack_from("<d" if wire == 1 else "<f", data, at)[0]
            at += size
        elif wire == 2:
            size = number()
            value = data[at : at + size]
            if len(value) < size:
                raise ValueError("the message ends within a field")
            at += size
        else:
            raise ValueError(f"wire type {wire}")
        if (known := FIELDS[kind].get(field)) is None:
            continue
        name, within = known
        if within == "text":
            value = value.decode("utf-8", "replace")
        elif within:
            value = decoded(value, within)
        if (kind, name) == ("feed", "entity"):
            out.setdefault(name, []).append(value)
        else:
            out[name] = value
    return out


def fetched(url: str, seconds: float = 30.0) -> dict:
    """One poll of a feed over HTTP: JSON if the server says so, else protobuf."""
    with urllib.request.urlopen(url, timeout=seconds) as answer:
        body, kind = answer.read(), answer.headers.get_content_type()
    return json.loads(body) if kind == "application/json" else decoded(body)


def _documents(spark_path: str) -> list[str]:
    """Files of a folder by name, through the file system that Arrow finds for the path (local, HDFS, S3, ...)."""
    system, path = FileSystem.from_uri(spark_path) if "://" in spark_path else (LocalFileSystem(), spark_path)
    return sorted(f.path for f in system.get_file_info(FileSelector(path)) if f.base_name.endswith((".json", ".pb")))


def _read(spark_path: str, name: str) -> dict:
    system = FileSystem.from_uri(spark_path)[0] if "://" in spark_path else LocalFileSystem()
    with system.open_input_stream(name) as f:
        body = f.read()
    return json.loads(body) if name.endswith(".json") else decoded(body)


class _Poll(InputPartition):
    """A document of a folder, or a URL to fetch."""


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.urls, self.agency = options.get("path"), options.get("url", "").split(), options.get("agency", "unknown")
        if not self.path and not self.urls:
            raise ValueError("a feed needs a path or a url")

    def partitions(self):
        return [_Poll(u) for u in self.urls] or [_Poll(f) for f in _documents(self.path)]

    def read(self, partition):
        if partition is not None:
            yield from rows_of(fetched(partition.value) if self.urls else _read(self.path, partition.value), self.agency)


class _Stream(SimpleDataSourceStreamReader):
    """Documents of a folder in order; or one poll of each URL a batch, whose rows are kept until the batch is committed."""

    def __init__(self, options: dict):
        self.path, self.urls, self.agency, self.most = options.get("path"), options.get("url", "").split(), options.get("agency", "unknown"), int(options.get("documentspertrigger", 100))
        self.polled: dict[int, list[tuple]] = {}

    def initialOffset(self) -> dict:
        return {"read": 0}

    def read(self, start: dict):
        n = start["read"]
        if self.urls:
            self.polled[n] = [row for u in self.urls for row in rows_of(fetched(u), self.agency)]
            return iter(self.polled[n]), {"read": n + 1}
        end = min(len(_documents(self.path)), n + self.most)
        return self._rows(n, end), {"read": end}

    def readBetweenOffsets(self, start: dict, end: dict):
        if self.urls:  # a poll is not to be had again: what this reader still holds
            return iter([row for n in range(start["read"], end["read"]) for row in self.polled.get(n, ())])
        return self._rows(start["read"], end["read"])

    def commit(self, end: dict):
        for n in [n for n in self.polled if n < end["read"]]:
            del self.polled[n]

    def _rows(self, a: int, b: int) -> Iterator[tuple]:
        for name in _documents(self.path)[a:b]:
            yield from rows_of(_read(self.path, name), self.agency)


class VehicleFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vehicle_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def simpleStreamReader(self, schema):
        return _Stream(self.options)
