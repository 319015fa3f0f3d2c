"""Model features and a hook for scoring with a model, with a fallback in Columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SANE_LOW, SANE_HIGH = 0.0, 500.0


def feature_columns(ctx: Column, fare: Column, distance: Column, passengers: Column, pickup: Column, dropoff: Column, p10: Column, p90: Column, mean: Column, std: Column) -> dict[str, Column]:
    """The 18 features: time, flags, regions of ten zones, ratios with floors, statistics."""
    flag = lambda k: ctx[k].cast("int")
    return {
        "hour": ctx["hour"], "day_of_week": ctx["day_of_week"], "is_weekend": flag("is_weekend"), "is_rush_hour": flag("is_rush_hour"), "is_late_night": flag("is_late_night"), "is_holiday": flag("is_holiday"),
        "pickup_region": F.floor(pickup / 10), "dropoff_region": F.floor(dropoff / 10), "distance": distance, "passengers": passengers, "fare": fare,
        "fare_per_mile": fare / F.greatest(distance, F.lit(0.01)), "fare_per_passenger": fare / F.greatest(passengers, F.lit(1.0)), "same_zone": (pickup == dropoff).cast("int"),
        "p10": p10, "p90": p90, "mean": mean, "std": std,
    }


def sane(predicted: Column, fallback: Column) -> Column:
    return F.when(predicted.between(SANE_LOW, SANE_HIGH), predicted).otherwise(fallback)


def with_prediction(df: DataFrame, features: list[str], load: Callable[[], Callable[[pd.DataFrame], pd.Series]], fallback: Column, name: str = "predicted") -> DataFrame:
    """Adds a prediction.  load runs once a task, in the worker; what is not sane is replaced by fallback."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = load()
        for columns in batches:
            yield model(pd.concat(list(columns) if isinstance(columns, tuple) else [columns], axis=1, keys=features)).astype("float64")

    return df.withColumn(name, sane(score(*[F.col(f) for f in features]), fallback))
