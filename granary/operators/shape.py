"""Renames, unpivots, nested payloads."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import columns as C
from granary.functions import constants as K


def rename_present(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


def normal_header(name: str) -> str:
    """Lower case, separators to one underscore, everything else dropped."""
    joined = re.sub(r"[\s\-/\\]+", "_", name.strip().lower())
    return re.sub(r"[^a-z0-9_]", "", joined).strip("_")


def rename_by_synonym(df: DataFrame, synonyms: Mapping[str, Sequence[str]]) -> DataFrame:
    """Canonical names by normalised header; several sources of one name are coalesced in order."""
    target = {normal_header(alias): name for name, aliases in synonyms.items() for alias in aliases}
    sources: dict[str, list[str]] = {}
    for column in df.columns:
        header = normal_header(column)
        sources.setdefault(target.get(header, header), []).append(column)
    return df.select(*[
        F.coalesce(*[F.col(f"`{c}`") for c in found]).alias(name) for name, found in sources.items()
    ])


def is_month_label(name: str) -> bool:
    try:
        datetime.strptime(name, "%b-%y")
    except ValueError:
        return False
    return True


def melt_months(df: DataFrame, ids: Sequence[str], value: str) -> DataFrame:
    """Month columns to rows; other columns are dropped, as are cells that are not numbers."""
    months = [c for c in df.columns if c not in ids and is_month_label(c)]
    kept = [c for c in ids if c in df.columns]
    cells = F.array(*[
        F.struct(F.lit(m).alias("month_label"), C.number(F.col(f"`{m}`")).alias(value)) for m in months])
    return (
        df.select(*[F.col(f"`{c}`") for c in kept], F.explode(cells).alias("_cell"))
        .select(*[F.col(f"`{c}`") for c in kept], "_cell.*")
        .where(F.col(value).isNotNull())
        .withColumn("date", C.month_label_date("month_label"))
        .where(F.col("date").isNotNull())
    )


HISTORY_PAYLOAD = "properties struct<parameter: map<string, map<string, double>>>"

# Payload parameter -> weather column; the first decides whether a day counts.
HISTORY_PARAMETERS = {
    "T2M": "temperature_mean", "PRECTOTCORR": "precipitation_mm", "RH2M": "humidity",
    "WS2M": "wind_speed",
}


def weather_history_rows(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Date-keyed JSON maps to one row per day; sentinel readings become NULL."""
    def reading(name: str) -> Column:
        value = F.try_element_at(F.try_element_at("parameters", F.lit(name)), F.col("day"))
        return F.when(value > K.MISSING_BELOW, value)

    first = next(iter(HISTORY_PARAMETERS))
    days = (
        df.withColumn("parameters", F.from_json(payload, HISTORY_PAYLOAD)["properties"]["parameter"])
        .withColumn("day", F.explode(F.map_keys(F.try_element_at("parameters", F.lit(first)))))
    )
    return (
        days.select(
            *[c for c in df.columns if c != payload],
            F.try_to_timestamp("day", F.lit("yyyyMMdd")).cast("date").alias("date"),
            *[reading(p).alias(name) for p, name in HISTORY_PARAMETERS.items()])
        .where(F.col("date").isNotNull() & F.col(HISTORY_PARAMETERS[first]).isNotNull())
    )


FORECAST_PAYLOAD = (
    "daily struct<time: array<string>, temperature_2m_max: array<double>, "
    "temperature_2m_min: array<double>, precipitation_sum: array<double>, "
    "relative_humidity_2m_max: array<double>>"
)


def forecast_features(daily: Column) -> dict[str, Column]:
    """Outlook over the next 7 and 14 days from arrays that start today."""
    highs, lows = daily["temperature_2m_max"], daily["temperature_2m_min"]
    rain, humidity = daily["precipitation_sum"], daily["relative_humidity_2m_max"]
    middles = F.zip_with(F.slice(highs, 1, 7), F.slice(lows, 1, 7), lambda a, b: (a + b) / 2)
    usable = F.size(F.coalesce(highs, F.array().cast("array<double>"))) > 0
    features = {
        "forecast_temp_7d_avg": C.array_mean(middles),
        "forecast_precip_7d_sum": C.array_sum(F.slice(rain, 1, 7)),
        "forecast_precip_14d_sum": C.array_sum(F.slice(rain, 1, 14)),
        "forecast_humidity_7d_avg": C.array_mean(F.slice(humidity, 1, 7)),
    }
    return {name: F.when(usable, F.round(value, 2)) for name, value in features.items()}


def add_forecast_features(df: DataFrame, payload: str = "payload") -> DataFrame:
    daily = F.from_json(payload, FORECAST_PAYLOAD)["daily"]
    return df.withColumns(forecast_features(daily)).drop(payload)


def counts_map(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Value counts per key as one map; the pair list is as long as the value has distinct entries."""
    pairs = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return pairs.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias(name))
