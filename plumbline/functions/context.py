"""Context of an event: when, where, from whom, under which policy; and the keys of the hierarchy."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Location, name, borough of the zones that a deployment knows (fixed values).
ZONES = [(161, "Midtown Center", "Manhattan"), (237, "Upper West Side", "Manhattan"), (132, "JFK Airport", "Queens"), (138, "LaGuardia Airport", "Queens"), (140, "Flatbush", "Brooklyn")]
LEVELS = 5


#: Observed US holidays (fixed values).
HOLIDAYS = [
    "2024-01-01", "2024-01-15", "2024-02-19", "2024-05-27", "2024-06-19", "2024-07-04", "2024-09-02", "2024-10-14", "2024-11-28", "2024-12-25",
    "2025-01-01", "2025-01-20", "2025-02-17", "2025-05-26", "2025-06-19", "2025-07-04", "2025-09-01", "2025-10-13", "2025-11-27", "2025-12-25",
    "2026-01-01", "2026-01-19", "2026-02-16", "2026-05-25", "2026-06-19", "2026-07-03", "2026-09-07", "2026-10-12", "2026-11-26", "2026-12-25",
]


def us_holidays(first: int = 2024, last: int = 2026) -> list[str]:
    """ISO dates of the known holidays of these years."""
    return [d for d in HOLIDAYS if first <= int(d[:4]) <= last]


def is_holiday(ts: Column, days: list[str] | None = None) -> Column:
    return F.date_format(ts, "yyyy-MM-dd").isin(days if days is not None else us_holidays())


def external(ts: Column, late_from: int = 22, late_to: int = 5, holidays: list[str] | None = ()) -> Column:
    """hour, weekday (Monday 0), weekend, rush hour (7-9, 17-19 on weekdays), late night, holiday."""
    hour, day = F.hour(ts), F.weekday(ts)
    weekend = day >= 5
    late = (hour >= late_from) | (hour < late_to)
    rush = (hour.between(7, 9) | hour.between(17, 19)) & ~weekend
    holiday = is_holiday(ts, list(holidays)) if holidays else F.lit(False)
    return F.struct(hour.alias("hour"), day.alias("day_of_week"), weekend.alias("is_weekend"), rush.alias("is_rush_hour"), late.alias("is_late_night"), holiday.alias("is_holiday"))


def time_category(hour: Column) -> Column:
    return F.when(hour.between(6, 11), "morning").when(hour.between(12, 17), "afternoon").when(hour.between(18, 21), "evening").otherwise("night")


def time_category_six(hour: Column) -> Column:
    """The finer division: early morning, morning rush, midday, evening rush, evening, late night."""
    return (
        F.when(hour.between(5, 6), "early_morning").when(hour.between(7, 9), "morning_rush").when(hour.between(10, 15), "midday")
        .when(hour.between(16, 19), "evening_rush").when(hour.between(20, 22), "evening").otherwise("late_night")
    )


def temporal(ts: Column) -> Column:
    hour, day = F.hour(ts), F.weekday(ts)
    weekend = day >= 5
    rush = (hour.between(7, 10) | hour.between(16, 19)) & ~weekend
    return F.struct(hour.alias("hour_of_day"), day.alias("day_of_week"), weekend.alias("is_weekend"), time_category(hour).alias("time_category"), rush.alias("is_rush_hour"))


def zone_category(name: Column, borough: Column) -> Column:
    low = F.lower(name)
    return F.when(low.contains("midtown"), "midtown").when(low.contains("airport"), "airport").when(borough == "Manhattan", "manhattan_other").otherwise("outer")


def zone_table(spark: SparkSession, zones=None) -> DataFrame:
    """The zones as a local relation, whose size the planner knows."""
    columns = zip(*(zones or ZONES))
    kinds = {"location_id": pa.int32(), "zone_name": pa.string(), "borough": pa.string()}
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, kinds.values())], list(kinds)))


def with_zone(df: DataFrame, location: str, zones: DataFrame) -> DataFrame:
    """Adds zone_name, borough and zone_category; a location that is not mapped gets zone_<id> and unknown.

    zones is a dimension with one row per location; Spark broadcasts it as long as its size allows.
    """
    z = zones.select(F.col("location_id").alias("_zone_id"), "zone_name", "borough")
    out = df.join(z, F.col(location).cast("int") == F.col("_zone_id"), "left")
    known = F.col("_zone_id").isNotNull()
    name = F.when(known, F.col("zone_name")).otherwise(F.concat(F.lit("zone_"), F.col(location).cast("string")))
    category = F.when(known, zone_category(F.col("zone_name"), F.col("borough"))).otherwise("unknown")
    return out.withColumn("zone_category", category).withColumn("zone_name", name).withColumn("borough", F.coalesce("borough", F.lit("unknown"))).drop("_zone_id")


def context_keys(hour: Column, category: Column, zone: Column, borough: Column, weekend: Column) -> Column:
    """Array of (level, key, confidence), from the most specific to global."""
    day = F.when(weekend, "weekend").otherwise("weekday")
    keys = [F.concat_ws("_", F.lit("hour"), hour.cast("string"), zone, day), F.concat_ws("_", category, zone, day), F.concat_ws("_", category, borough, day), category, F.lit("global")]
    return F.array(*[F.struct(F.lit(i).alias("level"), k.alias("key"), F.lit(confidence(i)).alias("confidence")) for i, k in enumerate(keys)])


def confidence(level: int) -> float:
    return 0.5 if level == LEVELS - 1 else round(1.0 - 0.1 * level, 1)


def lineage_defaults(c: Column) -> Column:
    """The lineage struct with what is missing filled in."""
    filled = {"source_id": F.lit("unknown"), "source_type": F.lit("unknown"), "is_replay": F.lit(False), "batch_id": F.lit(None).cast("string"), "kafka_offset": F.lit(None).cast("long"), "kafka_partition": F.lit(None).cast("int"), "producer_timestamp": F.lit(None).cast("string"), "ingestion_timestamp": F.lit(None).cast("string"), "hop_count": F.lit(0), "upstream_event_ids": F.array().cast("array<string>"), "entity_index": F.lit(None).cast("string")}
    return F.struct(*[F.coalesce(c[k], v).alias(k) for k, v in filled.items()])


def lineage(source_id: str, source_type: str, is_replay: bool, batch: Column, offset: Column, index: Column) -> Column:
    """A lineage struct for a producer."""
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(source_id).alias("source_id"), F.lit(source_type).alias("source_type"), F.lit(is_replay).alias("is_replay"), batch.cast("string").alias("batch_id"),
        offset.cast("long").alias("kafka_offset"), F.lit(None).cast("int").alias("kafka_partition"), none.alias("producer_timestamp"), none.alias("ingestion_timestamp"),
        F.lit(0).alias("hop_count"), F.array().cast("array<string>").alias("upstream_event_ids"), index.cast("string").alias("entity_index"),
    )


def source_context(line: Column, tier: Column | None = None, owner: Column | None = None) -> Column:
    return F.struct(
        F.coalesce(line["source_id"], F.lit("unknown")).alias("source_id"), F.coalesce(line["source_type"], F.lit("unknown")).alias("source_type"),
        F.coalesce(line["is_replay"], F.lit(False)).alias("is_replay"), F.coalesce(tier if tier is not None else F.lit(None).cast("string"), F.lit("unknown")).alias("contract_tier"),
        F.coalesce(owner if owner is not None else F.lit(None).cast("string"), F.lit("unknown")).alias("owner"),
    )
