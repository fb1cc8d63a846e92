"""Feature tables and the serving snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import columns as C
from granary.operators import geo, joins, windows
from granary.operators.dedup import latest_per_key
from granary.plans.forecast import interval_uncertainty
from granary.plans.risk import proxy_score, score_risk
from granary.session import dealt, durable

ANOMALY_COLUMNS = ("modis_ndvi", "ndvi_anomaly", "ndvi_anomaly_7d_avg", "ndvi_anomaly_direction",
                   "ndvi_stress_flag", "ndvi_surplus_flag")


def with_market_ids(prices: DataFrame) -> DataFrame:
    if "mandi_id" in prices.columns:
        return prices
    return prices.withColumn("mandi_id", C.market_key("state", "district", "market_code", "market"))


PARTS, PLACE = ("state", "district"), ("latitude", "longitude")


def daily_panel(prices: DataFrame) -> DataFrame:
    """One row per (market, commodity, date), varieties averaged; the market id holds state and district."""
    return windows.to_daily(with_market_ids(prices), parts=PARTS, smallest=PLACE)


def market_days(panel: DataFrame, rows: int | None = None) -> DataFrame:
    """The distinct (market, date) pairs with the market's place. Where it is known how many rows the panel has at most, they are
    dealt out by that: the pairs are hardly fewer than the rows."""
    if rows is not None:
        panel = dealt(panel, rows, "mandi_id", "date")
    return windows.to_daily(panel, ["mandi_id"], means=(), sums=(), parts=PARTS, smallest=PLACE)


def market_weather(days: DataFrame, weather: DataFrame) -> DataFrame:
    """Weather of each market day and of the seven market days before it."""
    joined = joins.join_weather_grid(days.select("mandi_id", "date", "latitude", "longitude"), weather)
    return windows.weather_rolling(joined).drop("latitude", "longitude")


def market_anomaly(days: DataFrame, signal: DataFrame, locations: DataFrame, gate: float | None = None) -> DataFrame:
    """Anomaly per market day by date, month or state season, with trend and flags."""
    matched = joins.fallback_signal(days.select("mandi_id", "state", "date"), signal, locations, gate)
    return joins.signal_flags(windows.trailing_mean(matched, "ndvi_anomaly", "ndvi_anomaly_7d_avg"))


def join_market_days(panel: DataFrame, by_day: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    kept = by_day.select("mandi_id", "date", *(columns or [
        c for c in by_day.columns if c not in ("mandi_id", "date", "state", "district")]))
    return panel.join(kept.hint("merge"), ["mandi_id", "date"], "left")


def join_anomaly(panel: DataFrame, anomaly: DataFrame | None) -> DataFrame:
    """Anomaly columns, or typed NULLs where there is no anomaly table."""
    if anomaly is None:
        kinds = {"ndvi_stress_flag": "int", "ndvi_surplus_flag": "int"}
        return panel.withColumns({c: F.lit(None).cast(kinds.get(c, "double")) for c in ANOMALY_COLUMNS})
    # The columns depend on (market, date), but a table at price grain repeats them.
    daily = anomaly.groupBy("mandi_id", "date").agg(*[F.max(c).alias(c) for c in ANOMALY_COLUMNS])
    return join_market_days(panel, daily, ANOMALY_COLUMNS)


def anomaly_prices(panel: DataFrame, anomaly: DataFrame) -> DataFrame:
    """Prices with the anomaly, its interaction, its score within the commodity, and observation age."""
    aged = windows.observation_age(anomaly, "modis_ndvi")
    # The commodity statistics need a pass of their own, so the joined rows are written once and read twice.
    joined = durable(join_market_days(panel, aged), "anomaly-prices")
    scored = joins.attach_group_stats(
        joined, ["commodity"], _mean=F.avg("ndvi_anomaly"), _std=F.stddev_samp("ndvi_anomaly"))
    return scored.withColumns({
        "price_ndvi_interaction": F.col("modal_price") * F.col("ndvi_anomaly"),
        "ndvi_anomaly_commodity_z": C.zscore_or_zero("ndvi_anomaly", "_mean", "_std"),
        "has_modis_obs": F.col("modis_ndvi").isNotNull().cast("int"),
    }).drop("_mean", "_std")


def gold_prices(prices: DataFrame, weather: DataFrame, signal_daily: DataFrame, cpi: DataFrame, wpi: DataFrame,
                anomaly: DataFrame | None = None, zones: DataFrame | None = None, calendar: bool = False) -> DataFrame:
    """The full price feature table, one row per (market, commodity, date).

    Everything that depends only on (market, date) or (state, commodity, date) is built at that grain. The panel feeds several
    branches that need different columns, so it is written once and each branch reads only its columns. What is joined comes to
    its few columns first, in steps that are written, so that no two exchanges of the panel lie on disk together; all series
    features, the most columns, are added last and need one exchange.
    """
    panel = durable(daily_panel(prices), "panel")
    places = durable(panel.groupBy("mandi_id").agg(
        F.min("latitude").alias("latitude"), F.min("longitude").alias("longitude")).dropna(), "places")
    signal = windows.signal_delta(signal_daily.select("mandi_id", "date", "ndvi"))
    by_day = durable(market_weather(market_days(panel), weather), "weather-days")
    by_day = durable(by_day.join(signal.hint("merge"), ["mandi_id", "date"], "left"), "signal-days")
    by_day = durable(join_anomaly(by_day, anomaly), "market-days")
    near = durable(geo.neighbour_means(panel, places), "near")
    regions = durable(windows.regional_average(panel), "regions")
    means = panel.join(regions.hint("merge"), ["state", "commodity", "date"], "left")
    means = durable(means.join(near.hint("merge"), ["mandi_id", "commodity", "date"], "left"), "means")
    out = windows.price_features(durable(join_market_days(means, by_day), "joined"), calendar=calendar)
    out = joins.join_published_index(out, joins.consumer_price_index(cpi), joins.wholesale_price_index(wpi))
    out = out.withColumns({
        **C.calendar_parts("date"),
        "distance_to_nearest_major_market_km": C.hub_distance_km("latitude", "longitude")})
    if zones is None:
        return out.withColumn("agro_climatic_zone", F.lit(None).cast("string"))
    return joins.join_zone(out, zones)


def warehouse_regions(warehouses: DataFrame) -> DataFrame:
    """Capacity and number of named warehouses per (state, district); unreadable capacity counts as 0."""
    df = joins.region_keys(warehouses)
    return df.groupBy("state", "district").agg(
        F.sum(F.coalesce(C.scrubbed_number("capacity_mt"), F.lit(0.0))).alias("total_capacity_mt"),
        F.count("warehouse_name").alias("n_warehouses"))


def price_summary(prices: DataFrame) -> DataFrame:
    return joins.region_keys(prices).groupBy("state", "district", "commodity").agg(
        F.avg("modal_price").alias("mandi_mean_price"),
        F.stddev_samp("modal_price").alias("mandi_std_price"),
        F.count("modal_price").alias("mandi_n_days"))


def portfolio_summary(loans: DataFrame) -> DataFrame:
    def mean(name: str):
        return (F.avg(name) if name in loans.columns else F.lit(None).cast("double"))

    return loans.agg(mean("is_default").alias("portfolio_default_rate"), mean("ltv_ratio").alias("portfolio_mean_ltv"))


def latest_state_anomaly(anomaly: DataFrame, locations: DataFrame) -> DataFrame:
    """Per state the latest known value of each column on its own; ties on a date go to the larger market id."""
    states = locations.select("mandi_id", C.clean_text("state").alias("state")).distinct()
    names = ("ndvi_anomaly", "ndvi_stress_flag", "ndvi_surplus_flag")
    dated = F.coalesce("date", F.lit("0001-01-01").cast("date"))  # undated rows come before all others
    # By market first, ordered by the date alone: that combines on hashes, where ordering by a struct would sort all days by state.
    by_market = anomaly.groupBy("mandi_id").agg(*[made for n in names for known in [F.when(F.col(n).isNotNull(), dated)] for made in (
        F.max_by(n, known).alias(n), F.max(known).alias(f"_at_{n}"))])

    def latest(name: str):
        at = F.when(F.col(name).isNotNull(), F.struct(f"_at_{name}", "mandi_id"))
        return F.max_by(name, at).alias(name)

    return by_market.join(states, "mandi_id").groupBy("state").agg(*[latest(n) for n in names])


def gold_risk(prices: DataFrame, warehouses: DataFrame, loans: DataFrame, predictions: DataFrame | None = None,
              anomaly: DataFrame | None = None, locations: DataFrame | None = None) -> DataFrame:
    """Risk features per (state, district, commodity)."""
    df = price_summary(prices).join(warehouse_regions(warehouses), ["state", "district"], "left")
    df = df.fillna({"total_capacity_mt": 0.0, "n_warehouses": 0})
    df = joins.attach_scalar(df, portfolio_summary(loans))
    df = df.withColumns({
        "commodity_category": C.commodity_category("commodity"),
        "price_cv": C.safe_ratio("mandi_std_price", "mandi_mean_price", 1.0)})
    if predictions is None:
        df = df.withColumn("forecast_uncertainty", F.lit(None).cast("double"))
    else:
        df = df.join(interval_uncertainty(predictions), "commodity", "left")
    if anomaly is None or locations is None:
        df = df.withColumns({"ndvi_anomaly": F.lit(None).cast("double"), "ndvi_stress_flag": F.lit(0),
                             "ndvi_surplus_flag": F.lit(0)})
    else:
        df = df.join(latest_state_anomaly(anomaly, locations), "state", "left").fillna(
            {"ndvi_anomaly": 0.0, "ndvi_stress_flag": 0, "ndvi_surplus_flag": 0})
    return proxy_score(df)


def score_table(risk: DataFrame) -> DataFrame:
    """What the read-side reports run on."""
    return score_risk(risk)


def serving_snapshot(gold: DataFrame) -> DataFrame:
    """Latest row of every series, without the columns that look ahead."""
    # First by the date alone, in the order the series features have: whole rows are sorted only where the latest date repeats.
    after = F.lead("date").over(windows.history(["mandi_id", "commodity"]))
    last = gold.withColumn("_after", after).where("_after is null or _after = date").drop("_after")
    latest = latest_per_key(last, ["mandi_id", "commodity"], "date",
                            [c for c in gold.columns if c not in ("mandi_id", "commodity", "date")])
    return latest.drop(*[c for c in gold.columns if c.startswith("target_price_")])
