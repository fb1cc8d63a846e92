"""Time-series features. Each table is first brought to one row per (entity, date).

That aggregation combines on the map side, so a hot entity is already small when it shuffles, and no
window partition can grow past the number of days in the history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from granary.functions import columns as C
from granary.functions import constants as K

SERIES = ("mandi_id", "commodity")


def to_daily(df: DataFrame, keys: Sequence[str] = SERIES, means: Sequence[str] = ("modal_price",),
             sums: Sequence[str] = ("arrivals_tonnes",), parts: Sequence[str] = (),
             smallest: Sequence[str] = ()) -> DataFrame:
    """One row per (keys, date). `parts` are text columns the keys already contain: grouping by them too
    keeps the aggregation on hashes, where carrying text through min() would sort."""
    return df.groupBy(*keys, *[c for c in parts if c in df.columns], "date").agg(
        *[F.avg(c).alias(c) for c in means if c in df.columns],
        *[F.sum(c).alias(c) for c in sums if c in df.columns],
        *[F.min(c).alias(c) for c in smallest if c in df.columns],
    )


def day_number(date: Column | str) -> Column:
    return F.unix_date(C.col(date))


def history(keys: Sequence[str], order: Column | str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def lags(value: str, over: WindowSpec, steps: Sequence[int] = K.LAGS, prefix: str = "price_lag") -> dict[str, Column]:
    return {f"{prefix}_{k}d": F.lag(value, k).over(over) for k in steps}


def leads(value: str, over: WindowSpec, steps: Sequence[int] = K.HORIZONS) -> dict[str, Column]:
    return {f"target_price_{k}d": F.lead(value, k).over(over) for k in steps}


def rolling(value: str, over: WindowSpec, sizes: Sequence[int] = K.ROLLING, prefix: str = "price") -> dict[str, Column]:
    """Mean and spread of the rows before this one, so no row sees its own value."""
    out = {}
    for n in sizes:
        past = over.rowsBetween(-n, -1)
        out[f"{prefix}_mean_{n}d"] = F.avg(value).over(past)
        out[f"{prefix}_std_{n}d"] = F.stddev_samp(value).over(past)
    return out


def momentum(value: str = "modal_price", before: str = "price_lag_7d") -> Column:
    return (F.col(value) - F.col(before)) / C.clip(before, low=1e-6)


def price_features(df: DataFrame, keys: Sequence[str] = SERIES, value: str = "modal_price",
                   arrivals: str = "arrivals_tonnes", calendar: bool = False) -> DataFrame:
    """Lags, shifted rolling statistics and targets of every series from one exchange and one sort."""
    if calendar:
        made = _calendar_features(keys, value, arrivals if arrivals in df.columns else None)
    else:
        over = history(keys)
        made = {**lags(value, over), **rolling(value, over), **leads(value, over)}
        if arrivals in df.columns:
            made["arrivals_mean_7d"] = F.avg(arrivals).over(over.rowsBetween(-7, -1))
    return df.select("*", *[c.alias(n) for n, c in made.items()]).withColumn(
        "price_momentum_7d", momentum(value))


def _calendar_features(keys: Sequence[str], value: str, arrivals: str | None) -> dict[str, Column]:
    """The same columns counted in days instead of rows: a gap in the series gives NULL lags."""
    over = history(keys, day_number("date"))
    made = {f"price_lag_{k}d": F.max(value).over(over.rangeBetween(-k, -k)) for k in K.LAGS}
    made |= {f"target_price_{k}d": F.max(value).over(over.rangeBetween(k, k)) for k in K.HORIZONS}
    for n in K.ROLLING:
        past = over.rangeBetween(-n, -1)
        made[f"price_mean_{n}d"] = F.avg(value).over(past)
        made[f"price_std_{n}d"] = F.stddev_samp(value).over(past)
    if arrivals:
        made["arrivals_mean_7d"] = F.avg(arrivals).over(over.rangeBetween(-7, -1))
    return made


def weather_rolling(daily: DataFrame, key: str = "mandi_id") -> DataFrame:
    """Seven previous days of weather per market; the input has one row per (market, date)."""
    past = history([key]).rowsBetween(-7, -1)
    return daily.select(
        "*",
        F.avg("temperature_mean").over(past).alias("temp_mean_7d"),
        F.sum("precipitation_mm").over(past).alias("precip_sum_7d"),
        F.avg("humidity").over(past).alias("humidity_mean_7d"),
    )


def signal_delta(daily: DataFrame, key: str = "mandi_id", value: str = "ndvi", steps: int = 30) -> DataFrame:
    """Change of the daily signal against `steps` rows earlier."""
    before = F.lag(value, steps).over(history([key]))
    return daily.withColumn(f"{value}_lag_{steps}d", before).withColumn(
        f"{value}_delta_{steps}d", F.col(value) - F.col(f"{value}_lag_{steps}d"))


def trailing_mean(daily: DataFrame, value: str, name: str, key: str = "mandi_id", rows: int = 7) -> DataFrame:
    """Mean of this row and the ones before it."""
    return daily.withColumn(name, F.avg(value).over(history([key]).rowsBetween(1 - rows, 0)))


def fill_daily(observed: DataFrame, key: str = "mandi_id", value: str = "ndvi",
               carried: Sequence[str] = ()) -> DataFrame:
    """Carry each observation forward to the day before the next one, the last to the global end.

    The window runs on the sparse observations and each of them unfolds into its own days, so the dense
    calendar is never shuffled, sorted or joined, and days before the first observation never exist.
    """
    known = observed.where(F.col(value).isNotNull() & F.col("date").isNotNull())
    end = known.agg(F.max("date").alias("end")).scalar()
    until = F.coalesce(F.date_sub(F.lead("date").over(history([key])), 1), end)
    return (
        known.select(key, *carried, F.col("date").alias("observed_on"), value, until.alias("until"))
        .select("*", F.explode(F.sequence("observed_on", "until")).alias("date"))
        .withColumn("is_observed", (F.col("date") == F.col("observed_on")).cast("int"))
        .drop("until")
    )


def observation_age(daily: DataFrame, value: str, key: str = "mandi_id") -> DataFrame:
    """Observations so far, and days since the latest one."""
    so_far = history([key]).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.col(value).isNotNull()
    latest = F.last(F.when(seen, F.col("date")), ignorenulls=True).over(so_far)
    return daily.select(
        "*",
        F.sum(seen.cast("int")).over(so_far).cast("int").alias("ndvi_obs_count"),
        F.datediff("date", latest).alias("days_since_ndvi_obs"),
    )


def recent_weather(rows: DataFrame, keys: Sequence[str], count: int = 7) -> DataFrame:
    """Summary of the most recent rows of each location."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("date")))
    recent = rows.withColumn("_rank", rank).where(F.col("_rank") <= count)
    return recent.groupBy(*keys).agg(
        F.avg("temperature_mean").alias("temp_mean_7d"),
        F.sum("precipitation_mm").alias("precip_sum_7d"),
        F.avg("humidity").alias("humidity_mean_7d"),
        F.avg("wind_speed").alias("wind_speed_mean_7d"),
    )


def regional_average(df: DataFrame, keys: Sequence[str] = ("state", "commodity"), value: str = "modal_price",
                     name: str = "state_avg_price_7d") -> DataFrame:
    """Mean over all markets of a region and day, then the mean of the seven days before."""
    daily = df.groupBy(*keys, "date").agg(F.avg(value).alias("_mean"))
    return daily.withColumn(name, F.avg("_mean").over(history(keys).rowsBetween(-7, -1))).drop("_mean")
