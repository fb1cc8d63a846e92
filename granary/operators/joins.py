"""Joins. Sides that grow with the data are merged, never broadcast: Spark takes the size of a staged file for that of its rows, but
a file of repeated values is a hundredth of them, and days unfolded from a reading count as one. Other sides are not hinted.

Every right side is reduced to one row per key before it is joined, so a left join never adds rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import columns as C
from granary.functions import constants as K
from granary.operators.dedup import keep_first

WEATHER = ("temperature_mean", "precipitation_mm", "humidity", "wind_speed")


def with_grid_key(df: DataFrame, digits: int = 2) -> DataFrame:
    return df.withColumn("lat2", F.round("latitude", digits)).withColumn("lon2", F.round("longitude", digits))


def join_weather_grid(daily: DataFrame, weather: DataFrame, digits: int = 2) -> DataFrame:
    """Weather of the rounded coordinate on the same day."""
    readings = [c for c in WEATHER if c in weather.columns]
    grid = keep_first(
        with_grid_key(weather, digits).select("date", "lat2", "lon2", "latitude", "longitude", *readings),
        ["date", "lat2", "lon2"], ["latitude", "longitude", *readings],
    ).drop("latitude", "longitude")
    return with_grid_key(daily, digits).join(grid.hint("merge"), ["date", "lat2", "lon2"], "left").drop("lat2", "lon2")


def monthly_index(df: DataFrame, value: str, name: str, preferred: Column) -> DataFrame:
    """Monthly mean of the preferred rows, or of all rows when nothing at all is preferred."""
    wanted = F.coalesce(preferred, F.lit(False))
    monthly = df.groupBy(C.month_start("date").alias("month_start")).agg(
        F.avg(F.when(wanted, F.col(value))).alias("_wanted"),
        F.avg(value).alias("_all"),
        F.max(wanted.cast("int")).alias("_has"),
    )
    anywhere = monthly.agg(F.max("_has")).scalar()
    return (
        monthly.select("month_start", "_has", "_wanted", "_all", anywhere.alias("_anywhere"))
        .where("_has = 1 or _anywhere = 0")
        .select("month_start", F.when(F.col("_anywhere") == 1, F.col("_wanted"))
                .otherwise(F.col("_all")).alias(name))
    )


def consumer_price_index(cpi: DataFrame) -> DataFrame:
    national = C.clean_text("state") == "ALL INDIA"
    return monthly_index(cpi, "cpi_index", "food_cpi_index", national & C.contains_text("division", "FOOD"))


def wholesale_price_index(wpi: DataFrame) -> DataFrame:
    preferred = C.clean_text(F.col("level").cast("string")) == "ALL" if "level" in wpi.columns else F.lit(False)
    return monthly_index(wpi, "wpi_index", "food_wpi_index", preferred)


def join_published_index(df: DataFrame, *indices: DataFrame, lag_months: int = 1) -> DataFrame:
    """Each row gets the index of `lag_months` earlier, the last one published by then."""
    out = df.withColumn("_month", C.month_start("date"))
    for index in indices:
        lagged = index.withColumn("_month", F.add_months("month_start", lag_months)).drop("month_start")
        out = out.join(lagged, "_month", "left")
    return out.drop("_month")


def attach_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """The columns of a one-row table on every row, as one scalar subquery and no join."""
    names = one_row.columns
    packed = one_row.agg(F.first(F.struct(*names)).alias("s")).scalar()
    return df.withColumn("_s", packed).select("*", *[F.col("_s")[n].alias(n) for n in names]).drop("_s")


def by_group_and(df: DataFrame, groups: DataFrame, keys: Sequence[str], spread: str, how: str = "inner",
                 pairs: DataFrame | None = None) -> DataFrame:
    """`df.join(groups, keys)` for groups of any size: each group's row is copied to the group's values of `spread` and joined
    by them too, so a large group is many keys. `groups` has one row per key; `pairs` holds all keys and values of `spread` that `df` has,
    where they are read more cheaply than from `df`."""
    found = (df if pairs is None else pairs).select(*keys, spread).distinct().join(groups, list(keys)).withColumnsRenamed(
        {c: f"_g_{c}" for c in (*keys, spread)})
    same = F.col(spread).eqNullSafe(F.col(f"_g_{spread}"))
    for k in keys:
        same &= F.col(k) == F.col(f"_g_{k}")
    out = df.join(found.hint("merge"), same, how).drop(*[f"_g_{c}" for c in (*keys, spread)])
    return out.select(*keys, *[c for c in df.columns if c not in keys], *[c for c in groups.columns if c not in keys])


def attach_group_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Group aggregates back on the rows: aggregated on the map side, then joined, so no group is sorted whole."""
    grouped = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    return df.join(grouped, list(keys), "left")


def region_keys(df: DataFrame, state: str = "state", district: str = "district") -> DataFrame:
    return df.withColumn(state, C.clean_text(state)).withColumn(district, C.clean_text(district))


def enrich_with_locations(df: DataFrame, locations: DataFrame) -> DataFrame:
    """Coordinates, code and id by (state, market); else only coordinates by (state, district)."""
    known = locations.select(
        C.clean_text("state").alias("_state"), C.clean_text("district").alias("_district"),
        C.clean_text("mandi_name").alias("_market"), "latitude", "longitude", "market_code", "mandi_id")
    by_market = keep_first(known.where("_market is not null and _state is not null"),
                           ["_state", "_market"], ["mandi_id", "latitude", "longitude"]).select(
        "_state", "_market", F.col("latitude").alias("_lat1"), F.col("longitude").alias("_lon1"),
        F.col("market_code").alias("_code"), F.col("mandi_id").alias("_id"))
    by_district = keep_first(known.where("_district is not null and _state is not null"),
                             ["_state", "_district"], ["mandi_id", "latitude", "longitude"]).select(
        "_state", "_district", F.col("latitude").alias("_lat2"), F.col("longitude").alias("_lon2"))
    keyed = df.drop("latitude", "longitude", "market_code", "mandi_id").withColumns({
        "_state": C.clean_text("state_name"), "_market": C.clean_text("market_center"),
        "_district": C.clean_text("district_name")})
    found = F.col("_id").isNotNull()
    return (
        keyed.join(by_market, ["_state", "_market"], "left").join(by_district, ["_state", "_district"], "left")
        .withColumns({
            "latitude": F.when(found, F.col("_lat1")).otherwise(F.col("_lat2")),
            "longitude": F.when(found, F.col("_lon1")).otherwise(F.col("_lon2")),
            "market_code": F.col("_code"), "mandi_id": F.col("_id")})
        .drop("_state", "_market", "_district", "_lat1", "_lon1", "_lat2", "_lon2", "_code", "_id")
    )


def fallback_signal(keys: DataFrame, signal: DataFrame, locations: DataFrame, gate: float | None = None) -> DataFrame:
    """Signal by exact date, else the market's month mean, else the state's day-of-year mean.

    `keys` has one row per (mandi_id, state, date). With a gate, a level is used only while the share of
    matched rows so far is below it; without, the levels always cascade. match_level says which one served.
    """
    signal = signal.select("mandi_id", "date", F.col("ndvi").alias("_v"), F.col("ndvi_anomaly").alias("_a"))
    # One row per key, so that no level can multiply rows.
    exact = signal.groupBy("mandi_id", "date").agg(F.avg("_v").alias("_v1"), F.avg("_a").alias("_a1"))
    month = signal.groupBy("mandi_id", C.month_start("date").alias("_month")).agg(
        F.avg("_v").alias("_v2"), F.avg("_a").alias("_a2"))
    states = locations.select("mandi_id", C.clean_identifier("state").alias("_state"))
    season = (
        signal.join(keep_first(states, ["mandi_id"]), "mandi_id")
        .groupBy("_state", F.dayofyear("date").alias("_doy"))
        .agg(F.avg("_v").alias("_v3"), F.avg("_a").alias("_a3"))
    )
    joined = (
        keys.withColumns({"_month": C.month_start("date"), "_doy": F.dayofyear("date"),
                          "_state": C.clean_identifier("state")})
        .join(exact.hint("merge"), ["mandi_id", "date"], "left")
        .join(month.hint("merge"), ["mandi_id", "_month"], "left")
        .join(season, ["_state", "_doy"], "left")
    )
    use_month, use_season = F.lit(True), F.lit(True)
    if gate is not None:
        shares = joined.agg(
            F.avg(F.col("_v1").isNotNull().cast("int")).alias("exact"),
            F.avg(F.coalesce("_v1", "_v2").isNotNull().cast("int")).alias("month")).first()
        use_month = F.lit((shares["exact"] or 0.0) < gate)
        served = shares["month"] if (shares["exact"] or 0.0) < gate else shares["exact"]
        use_season = F.lit((served or 0.0) < gate)
    level = (
        F.when(F.col("_v1").isNotNull(), "date")
        .when(use_month & F.col("_v2").isNotNull(), "month")
        .when(use_season & F.col("_v3").isNotNull(), "season"))

    def served_by(stem: str) -> Column:
        return (F.when(level == "date", F.col(f"{stem}1")).when(level == "month", F.col(f"{stem}2"))
                .when(level == "season", F.col(f"{stem}3")))

    return joined.withColumns({
        "modis_ndvi": served_by("_v"), "ndvi_anomaly": served_by("_a"), "match_level": level,
    }).drop("_month", "_doy", "_state", "_v1", "_v2", "_v3", "_a1", "_a2", "_a3")


def baseline_stats(baseline: DataFrame) -> DataFrame:
    return baseline.groupBy("mandi_id", F.dayofyear("date").alias("doy")).agg(
        F.avg("ndvi").alias("ndvi_mean"), F.stddev_samp("ndvi").alias("ndvi_std"),
        F.count("ndvi").alias("n_years"))


def baseline_table(baseline: DataFrame, details: Sequence[str]) -> DataFrame:
    """Statistics per (market, day of year) with the market's first detail row."""
    first = keep_first(baseline.select("mandi_id", "date", *details), ["mandi_id"], ["date", *details]).drop("date")
    return baseline_stats(baseline).join(first, "mandi_id", "left")


def signal_anomaly(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """How far each reading lies from the baseline of its day of year, in baseline spreads."""
    stats = baseline_stats(baseline).select(
        "mandi_id", "doy", F.col("ndvi_mean").alias("ndvi_baseline_mean"),
        F.col("ndvi_std").alias("ndvi_baseline_std"), F.col("n_years").alias("n_baseline_years"))
    joined = current.withColumn("doy", F.dayofyear("date")).join(stats.hint("merge"), ["mandi_id", "doy"], "left")
    return joined.withColumns({
        "ndvi_anomaly": (F.col("ndvi") - F.col("ndvi_baseline_mean")) / C.clip("ndvi_baseline_std", low=1e-6),
        "has_anomaly": F.col("ndvi_baseline_mean").isNotNull().cast("int"),
    })


def signal_flags(df: DataFrame, value: str = "ndvi_anomaly") -> DataFrame:
    return df.withColumns({
        "ndvi_anomaly_direction": F.signum(value),
        "ndvi_stress_flag": C.flag(F.col(value) < -1.0),
        "ndvi_surplus_flag": C.flag(F.col(value) > 1.0),
    })


def signal_label(stress: Column | str, surplus: Column | str) -> Column:
    return F.when(C.col(stress) == 1, "STRESS").when(C.col(surplus) == 1, "SURPLUS").otherwise("NORMAL")


def join_zone(df: DataFrame, zones: DataFrame) -> DataFrame:
    """Agro-climatic zone of the state; an empty zone table leaves NULLs."""
    known = keep_first(zones.select(C.clean_text("state").alias("_state"),
                                    F.col("zone_name").alias("agro_climatic_zone")), ["_state"])
    return df.withColumn("_state", C.clean_text("state")).join(known, "_state", "left").drop("_state")


def side_by_side(df: DataFrame, keys: Sequence[str], on: str, names: dict[str, str],
                 values: Sequence[str]) -> DataFrame:
    """Rows of several methods as suffixed columns of one row, in one aggregation instead of a self-join."""
    return df.groupBy(*keys).agg(*[
        F.max(F.when(F.col(on) == method, F.col(v))).alias(f"{v}_{suffix}")
        for method, suffix in names.items() for v in values])
