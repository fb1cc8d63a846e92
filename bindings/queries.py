"""One query per operator over the bound views, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import sql as S
from bindings import views as V
from granary.functions import columns as C
from granary.functions import constants as K
from granary.operators import dedup, geo, joins, metrics, quantiles, shape, splits, windows
from granary.plans import boosting, clean, evaluation, features, forecast, reports, risk, scoring
from granary.session import durable, scratch_path, shuffles_dropped
from granary.sources import sinks, tables
from granary.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = S.query(sql)
        return fn
    return register


def to(df: DataFrame, plain: str, **digits: str) -> DataFrame:
    """Columns as they are, then columns rounded once: r6='a b' rounds a and b to 6 digits."""
    return df.select(*plain.split(), *[
        F.round(F.col(c).cast("double"), int(d[1:])).alias(c) for d, names in digits.items() for c in names.split()])


def cols(plain: str, **digits: str) -> str:
    return ", ".join([*plain.split(), *[
        f"round(CAST({c} AS DOUBLE), {d[1:]}) AS {c}" for d, names in digits.items() for c in names.split()]])


# --- shared inputs ------------------------------------------------------------------------------

_STORED: dict[tuple, str] = {}


def stored(spark: SparkSession, d: str, name: str, make: Query) -> DataFrame:
    """A table the lake keeps between its jobs: built by the first query of a session that reads it, then read back.

    It is built anew if a file of the folder has another name, size or time.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(d)
    listing = files.agg(F.hash(F.sort_array(F.collect_list(F.struct("path", "length", "modificationTime"))))).first()[0]
    key = (spark.sparkContext.applicationId, d, listing, name)
    if key not in _STORED:
        path = scratch_path(spark, name)
        with shuffles_dropped(spark):
            make(spark, d).write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def series(spark, d, prices=None):
    return windows.price_features(V.panel(spark, d) if prices is None else prices)


def signal(spark, d):
    return clean.clean_signal(V.raw_signal(spark, d))


def signal_days(spark, d):
    return clean.daily_signal(signal(spark, d))


def anomaly(spark, d, cleaned=None):
    s = durable(signal(spark, d), "signal") if cleaned is None else cleaned
    split = F.lit("2000-01-01").cast("date")
    return joins.signal_anomaly(s.where(F.col("date") >= split), s.where(F.col("date") < split))


def day_anomaly(spark, d, prices=None):
    rows = (V.table(spark, d, "lineitem") if prices is None else prices).count()  # by the footers; the panel has no more rows than sales
    days = features.market_days(V.panel(spark, d) if prices is None else prices, rows)
    return features.market_anomaly(days, durable(anomaly(spark, d), "anomaly"), V.locations(spark, d))


def weather(spark, d):
    return clean.clean_weather(V.raw_weather(spark, d))


def cpi(spark, d):
    return clean.clean_consumer_index(V.raw_cpi(spark, d))


def wpi(spark, d):
    return clean.clean_wholesale_index(V.raw_wpi(spark, d))


def bands(spark, d, prices=None):
    df = series(spark, d, prices)
    made = {}
    for h in K.HORIZONS:
        band = forecast.band_from_history(h)
        made |= {f"q10_{h}d": band["low"], f"q50_{h}d": band["median"], f"q90_{h}d": band["high"]}
    return df.withColumns(made)


def relative_bands(spark, d, prices=None):
    df = bands(spark, d, prices).where("q50_7d is not null")
    return df.select("commodity", *[(F.col(f"{q}_{h}d") / F.col(f"q50_{h}d")).alias(f"pred_{q}_{h}d")
                                    for h in K.HORIZONS for q in ("q10", "q90")])


def risk_table(spark, d):
    # Three branches read the prices: stored once, as in gold.
    prices = durable(V.panel(spark, d), "prices")
    return features.gold_risk(
        prices, clean.clean_warehouses(V.raw_warehouses(spark, d)),
        clean.clean_loans(V.raw_crop_loans(spark, d)), relative_bands(spark, d, prices),
        day_anomaly(spark, d, prices), V.locations(spark, d))


def scores(spark, d):
    return stored(spark, d, "scores", lambda s, path: features.score_table(risk_table(s, path)))


def snapshot(spark, d):
    return features.serving_snapshot(series(spark, d).withColumns(C.calendar_parts("date")))


def gold(spark, d):
    """Built as the pipeline does it: from stored clean tables."""
    prices, readings = durable(V.panel(spark, d), "prices"), durable(signal(spark, d), "signal")
    scored = durable(anomaly(spark, d, readings), "anomaly")
    by_day = features.market_anomaly(features.market_days(prices), scored, V.locations(spark, d))
    return features.gold_prices(prices, durable(weather(spark, d)), clean.daily_signal(readings),
                                durable(cpi(spark, d)), durable(wpi(spark, d)), durable(by_day), V.zones(spark, d))


# --- text, numbers, dates -----------------------------------------------------------------------

@check("p3_date_parse", "SELECT report_date, " + S.any_date("report_date", "%d/%m/%Y", "%Y-%m-%d")
       + " AS date, count(*) AS n FROM raw_prices GROUP BY 1, 2")
def _(spark, d):
    parsed = C.parse_date("report_date", K.PRICE_DATE_FORMATS)
    return V.raw_prices(spark, d).groupBy("report_date", parsed.alias("date")).agg(F.count("*").alias("n"))


@check("p5_numeric_cast", "SELECT modal_price, TRY_CAST(modal_price AS DOUBLE) AS price, "
       "TRY_CAST(regexp_replace(modal_price, '[, %]', '', 'g') AS DOUBLE) AS scrubbed, count(*) AS n "
       "FROM raw_prices GROUP BY 1, 2, 3")
def _(spark, d):
    return V.raw_prices(spark, d).groupBy(
        "modal_price", C.number("modal_price").alias("price"), C.scrubbed_number("modal_price").alias("scrubbed")
    ).agg(F.count("*").alias("n"))


@check("p6_scrub", "SELECT capacity_mt AS raw, TRY_CAST(regexp_replace(capacity_mt, '[, %]', '', 'g') AS DOUBLE) AS number, "
       "TRY_CAST(nullif(regexp_extract(capacity_mt, '(\\d+)', 1), '') AS INTEGER) AS digits, count(*) AS n "
       "FROM raw_warehouses GROUP BY 1, 2, 3")
def _(spark, d):
    raw = V.raw_warehouses(spark, d).select(F.col("Capacity(MT)").alias("raw"))
    return raw.groupBy("raw", C.scrubbed_number("raw").alias("number"), C.leading_digits("raw").alias("digits")).agg(
        F.count("*").alias("n"))


@check("p10_range_rules", """
SELECT date, count(CASE WHEN temperature_mean BETWEEN -5 AND 55 THEN 1 END) AS good_temperature,
  sum(CASE WHEN precipitation_mm BETWEEN 0 AND 500 THEN precipitation_mm ELSE 0 END) AS rain,
  count(CASE WHEN humidity BETWEEN 0 AND 100 THEN 1 END) AS good_humidity,
  count(CASE WHEN wind_speed BETWEEN 0 AND 150 THEN 1 END) AS good_wind FROM raw_weather GROUP BY 1""")
def _(spark, d):
    return V.raw_weather(spark, d).groupBy("date").agg(
        F.count(C.nullify_outside("temperature_mean", *K.TEMPERATURE_RANGE)).alias("good_temperature"),
        F.sum(C.default_outside("precipitation_mm", *K.PRECIPITATION_RANGE, 0.0)).alias("rain"),
        F.count(C.nullify_outside("humidity", *K.HUMIDITY_RANGE)).alias("good_humidity"),
        F.count(C.nullify_outside("wind_speed", *K.WIND_RANGE)).alias("good_wind"))


@check("p9_box_filter", f"SELECT count(*) AS n, count(DISTINCT longitude) AS places FROM raw_weather WHERE {S.BOX}")
def _(spark, d):
    return V.raw_weather(spark, d).where(C.inside_box()).agg(
        F.count("*").alias("n"), F.count_distinct("longitude").alias("places"))


@check("p14_calendar", f"""
SELECT DISTINCT date, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(day(date) AS INTEGER) AS day_of_month,
  CAST(month(date) AS INTEGER) AS month, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend,
  CAST(dayofyear(date) AS INTEGER) AS doy, {S.SEASON.format(m="month(date)")} AS season FROM panel""")
def _(spark, d):
    return V.panel(spark, d).select("date").distinct().withColumns({
        **C.calendar_parts("date"), "doy": F.dayofyear("date"), "season": C.season(F.month("date"))})


@check("p15_identifier", "SELECT DISTINCT " + S.clean_id("state_name") + " || '_' || " + S.clean_id("district_name")
       + " || '_' || market_code || '_' || " + S.clean_id("market_center") + " AS mandi_id FROM raw_prices")
def _(spark, d):
    return V.raw_prices(spark, d).select(
        C.market_key("state_name", "district_name", "market_code", "market_center").alias("mandi_id")).distinct()


@check("p16_category", f"""
SELECT commodity, {S.TIER.format(c="commodity")} AS tier, count(*) AS n, CASE commodity WHEN 'WHEAT' THEN 'Cereal'
  WHEN 'RICE' THEN 'Cereal' WHEN 'TOMATO' THEN 'Vegetable' WHEN 'ONION' THEN 'Vegetable' WHEN 'COTTON' THEN 'Fiber'
  ELSE 'Other' END AS category FROM panel GROUP BY 1""")
def _(spark, d):
    return V.panel(spark, d).groupBy("commodity").agg(F.count("*").alias("n")).withColumns({
        "tier": risk.tier("commodity"), "category": C.commodity_category("commodity")})


# --- cleaning -----------------------------------------------------------------------------------

@check("c1_clean_prices", "SELECT *, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month FROM prices")
def _(spark, d):
    # Stored first, as the raw files are: else each derived text is worked out again wherever it is read.
    return clean.clean_prices(durable(V.raw_prices(spark, d), "raw"))


@check("c2_clean_weather", "SELECT * FROM weather")
def _(spark, d):
    return weather(spark, d)


@check("c3_clean_signal", "SELECT " + cols("mandi_id market_code mandi_name district state date", r6="latitude longitude ndvi")
       + " FROM signal")
def _(spark, d):
    return to(signal(spark, d), "mandi_id market_code mandi_name district state date", r6="latitude longitude ndvi")


@check("c4_warehouses", "SELECT * FROM warehouses")
def _(spark, d):
    return clean.clean_warehouses(V.raw_warehouses(spark, d))


@check("c5_consumer_index", 'SELECT date, state, sector, division, "group", item, code, cpi_index, inflation FROM cpi')
def _(spark, d):
    return cpi(spark, d)


@check("n1_melt", "SELECT * FROM wpi")
def _(spark, d):
    return wpi(spark, d)


@check("c6_crop_loans", "SELECT " + cols(
    "loan_id state commodity_category season disburse_date loan_amount_inr interest_rate_pct term_months credit_grade "
    "is_default grade_loan_count", r6="ltv_ratio grade_default_rate") + " FROM crop_loans")
def _(spark, d):
    return to(clean.clean_loans(V.raw_crop_loans(spark, d)),
              "loan_id state commodity_category season disburse_date loan_amount_inr interest_rate_pct term_months "
              "credit_grade is_default grade_loan_count", r6="ltv_ratio grade_default_rate")


_status = "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(V.STATUSES)) + " END"


@check("c6_consumer_loans", f"""
SELECT DISTINCT floor(o_totalprice) AS loan_amount_usd, substr(o_orderpriority, 1, 1) AS credit_grade,
  'B2' AS credit_sub_grade, '10+ years' AS employment_length, CAST(20000 + o_orderkey % 100 * 500 AS DOUBLE) AS annual_income_usd,
  upper(status) AS loan_status, CAST(o_orderkey % 40 AS DOUBLE) AS debt_to_income,
  CAST(o_orderkey % 3 AS DOUBLE) AS delinquencies_2yr, CAST(o_orderkey % 20 AS DOUBLE) AS open_credit_lines,
  CAST(o_orderkey % 2 AS DOUBLE) AS public_records, CAST(5 + o_orderkey % 30 AS DOUBLE) AS total_credit_lines,
  'CAR' AS loan_purpose, o_orderstatus AS borrower_state,
  CASE WHEN o_orderkey % 70 <> 3 THEN 5.5e0 + o_orderkey % 20 END AS interest_rate_pct,
  CAST(o_orderkey % 100 AS DOUBLE) AS revolving_util_pct, CAST(36 + 24 * (o_orderkey % 2) AS INTEGER) AS term_months,
  CAST(status IN {K.DEFAULT_STATUSES} AS INTEGER) AS is_default,
  round(avg(CAST(status IN {K.DEFAULT_STATUSES} AS INTEGER)) OVER (PARTITION BY substr(o_orderpriority, 1, 1)), 6) AS grade_default_rate,
  count(*) OVER (PARTITION BY substr(o_orderpriority, 1, 1)) AS grade_loan_count,
  '{K.CONSUMER_LOAN_SOURCE}' AS data_source, '{K.CONSUMER_LOAN_NOTE}' AS proxy_note
FROM (SELECT *, {_status} AS status FROM orders) WHERE upper(status) IN {K.CLEAR_STATUSES}""")
def _(spark, d):
    return clean.clean_loans(V.raw_consumer_loans(spark, d)).withColumn(
        "grade_default_rate", F.round("grade_default_rate", 6))


def raw_history(spark, d):
    return durable(V.raw_prices(spark, d), "raw").select(
        F.col("state_name").alias("State"), F.col("district_name").alias("District"),
        F.concat(F.col("market_center"), F.lit(" ")).alias("Market Center"), F.col("commodity").alias("Commodity"),
        F.col("variety").alias("Variety"), F.col("modal_price").alias("Modal Price (Rs/Quintal)"),
        F.col("arrivals_tonnes").alias("Arrivals(Tonnes)"), F.col("report_date").alias("Report Date"))


S.VIEWS["history"] = S.first_row("""
(SELECT * FROM (SELECT upper(trim(state_name)) AS state_name, upper(trim(district_name)) AS district_name,
   trim(market_center) AS market_center, upper(trim(commodity)) AS commodity, variety,
   TRY_CAST(regexp_replace(modal_price, '[, %]', '', 'g') AS DOUBLE) AS modal_price,
   TRY_CAST(arrivals_tonnes AS DOUBLE) AS arrivals_tonnes,
   strftime(""" + S.any_date("report_date", "%d/%m/%Y", "%Y-%m-%d") + """, '%Y-%m-%d') AS report_date
 FROM raw_prices) WHERE report_date IS NOT NULL AND modal_price > 0)""",
    "report_date, state_name, district_name, market_center, commodity", "variety,modal_price,arrivals_tonnes")


@check("c7_price_history", """
SELECT h.*, coalesce(m.latitude, x.latitude) AS latitude, coalesce(m.longitude, x.longitude) AS longitude,
  m.market_code, m.mandi_id FROM history h
LEFT JOIN locations m ON m.state = h.state_name AND upper(m.mandi_name) = upper(h.market_center)
LEFT JOIN (SELECT state, district, min_by(latitude, mandi_id) AS latitude, min_by(longitude, mandi_id) AS longitude
  FROM locations GROUP BY 1, 2) x ON x.state = h.state_name AND x.district = h.district_name""")
def _(spark, d):
    return clean.price_history(raw_history(spark, d), V.locations(spark, d))


@check("c8_location_master", "SELECT DISTINCT " + S.clean_id("state_name") + " || '_' || " + S.clean_id("district_name")
       + " || '_' || market_code || '_' || " + S.clean_id("market_center") + """ AS mandi_id,
  CAST(market_code AS BIGINT) AS market_code, market_center AS mandi_name, district_name AS district,
  state_name AS state, round(CAST(latitude AS DOUBLE), 6) AS latitude, round(CAST(longitude AS DOUBLE), 6) AS longitude
FROM raw_prices""")
def _(spark, d):
    return to(clean.location_master(V.raw_prices(spark, d)), "mandi_id market_code mandi_name district state",
              r6="latitude longitude")


@check("a13_key_audit", """
SELECT state_code, count(DISTINCT market_center) > 1 AS varies_market_center,
  count(DISTINCT coalesce(state_name, '?')) > 1 AS varies_state_name, count(DISTINCT latitude) > 1 AS varies_latitude
FROM raw_prices GROUP BY 1 HAVING varies_market_center OR varies_state_name OR varies_latitude""")
def _(spark, d):
    return dedup.inconsistent_keys(V.raw_prices(spark, d), "state_code", ["market_center", "state_name", "latitude"])


@check("d1_dedup", S.first_row("(SELECT l_orderkey, l_suppkey, l_linenumber, l_quantity FROM lineitem)",
                              "l_orderkey", "l_linenumber,l_suppkey,l_quantity"))
def _(spark, d):
    rows = V.table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity")
    return dedup.keep_first(rows, ["l_orderkey"], ["l_linenumber", "l_suppkey", "l_quantity"])


@check("d2_distinct_rows", "SELECT DISTINCT state_name, district_name, market_center, market_code FROM raw_prices")
def _(spark, d):
    return V.raw_prices(spark, d).select("state_name", "district_name", "market_center", "market_code").distinct()


@check("d3_assertions", f"""
SELECT count(*) FILTER (mandi_id IS NULL) AS missing_id, count(mandi_id) - count(DISTINCT mandi_id) AS duplicate_id,
  count(*) FILTER (latitude IS NULL OR longitude IS NULL) AS missing_coordinates,
  count(*) FILTER (NOT ({S.BOX})) AS outside_box FROM (
    SELECT mandi_id, latitude, longitude FROM locations UNION ALL SELECT mandi_id, latitude, longitude FROM signal)""")
def _(spark, d):
    both = V.locations(spark, d).select("mandi_id", "latitude", "longitude").unionByName(
        signal(spark, d).select("mandi_id", "latitude", "longitude"))
    return dedup.location_violations(both)


# --- windows ------------------------------------------------------------------------------------

KEY = "mandi_id commodity date"


@check("w1_lags", "SELECT " + cols(KEY, r6="price_lag_1d price_lag_7d price_lag_14d price_lag_30d") + " FROM series")
def _(spark, d):
    return to(series(spark, d), KEY, r6="price_lag_1d price_lag_7d price_lag_14d price_lag_30d")


@check("w2_targets", "SELECT mandi_id, commodity, date, target_price_7d, target_price_15d, target_price_30d FROM series")
def _(spark, d):
    return series(spark, d).select("mandi_id", "commodity", "date", *[f"target_price_{h}d" for h in K.HORIZONS])


ROLLED = dict(r6="price_mean_7d price_mean_14d price_mean_30d arrivals_mean_7d price_momentum_7d",
              r4="price_std_7d price_std_14d price_std_30d")


@check("w3_rolling", "SELECT " + cols(KEY, **ROLLED) + " FROM series")
def _(spark, d):
    return to(series(spark, d), KEY, **ROLLED)


@check("w3_rolling_calendar", f"""
SELECT mandi_id, commodity, date, max(modal_price) OVER (w RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 7 DAY PRECEDING) AS price_lag_7d,
  max(modal_price) OVER (w RANGE BETWEEN INTERVAL 7 DAY FOLLOWING AND INTERVAL 7 DAY FOLLOWING) AS target_price_7d,
  round(avg(modal_price) OVER (w RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 6) AS price_mean_30d,
  round(avg(arrivals_tonnes) OVER (w RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 6) AS arrivals_mean_7d
FROM panel WINDOW w AS ({S.SERIES})""")
def _(spark, d):
    df = windows.price_features(V.panel(spark, d), calendar=True)
    return to(df, KEY + " price_lag_7d target_price_7d", r6="price_mean_30d arrivals_mean_7d")


@check("w5_weather_roll", "SELECT " + cols("mandi_id date", r6="temp_mean_7d precip_sum_7d humidity_mean_7d") + " FROM day_weather")
def _(spark, d):
    df = features.market_weather(features.market_days(V.panel(spark, d)), weather(spark, d))
    return to(df, "mandi_id date", r6="temp_mean_7d precip_sum_7d humidity_mean_7d")


@check("w6_signal_delta", "SELECT " + cols("mandi_id date", r6="ndvi ndvi_lag_30d ndvi_delta_30d") + " FROM signal_lag")
def _(spark, d):
    return to(windows.signal_delta(signal_days(spark, d)), "mandi_id date", r6="ndvi ndvi_lag_30d ndvi_delta_30d")


@check("w7_trailing", "SELECT mandi_id, date, round(ndvi_anomaly_7d_avg, 4) AS ndvi_anomaly_7d_avg FROM day_anomaly")
def _(spark, d):
    return to(day_anomaly(spark, d), "mandi_id date", r4="ndvi_anomaly_7d_avg")


@check("w8_locf", "SELECT " + cols("mandi_id date observed_on is_observed", r6="ndvi") + " FROM signal_daily")
def _(spark, d):
    return to(signal_days(spark, d), "mandi_id date observed_on is_observed", r6="ndvi")


@check("w9_observation_age", """
SELECT mandi_id, date, CAST(sum(CAST(modis_ndvi IS NOT NULL AS INTEGER)) OVER w AS INTEGER) AS ndvi_obs_count,
  CAST(date - last_value(CASE WHEN modis_ndvi IS NOT NULL THEN date END IGNORE NULLS) OVER w AS INTEGER) AS days_since_ndvi_obs
FROM matched WINDOW w AS (PARTITION BY mandi_id ORDER BY date)""")
def _(spark, d):
    return windows.observation_age(day_anomaly(spark, d), "modis_ndvi").select(
        "mandi_id", "date", "ndvi_obs_count", "days_since_ndvi_obs")


@check("w10_zscore", """
SELECT mandi_id, commodity, date, round(CASE WHEN s IS NULL OR s = 0 THEN 0 ELSE (ndvi_anomaly - m) / greatest(s, 1e-6) END, 4)
  AS ndvi_anomaly_commodity_z, round(modal_price * ndvi_anomaly, 2) AS price_ndvi_interaction,
  CAST(modis_ndvi IS NOT NULL AS INTEGER) AS has_modis_obs
FROM (SELECT p.*, a.ndvi_anomaly, a.modis_ndvi, avg(a.ndvi_anomaly) OVER (PARTITION BY commodity) AS m,
  stddev_samp(a.ndvi_anomaly) OVER (PARTITION BY commodity) AS s
  FROM panel p LEFT JOIN day_anomaly a USING (mandi_id, date))""")
def _(spark, d):
    df = features.anomaly_prices(V.panel(spark, d), day_anomaly(spark, d))
    return to(df, KEY + " has_modis_obs", r4="ndvi_anomaly_commodity_z", r2="price_ndvi_interaction")


SNAP = dict(r6="modal_price price_lag_1d price_mean_7d price_mean_30d arrivals_mean_7d price_momentum_7d",
            r4="price_std_7d price_std_30d")


@check("w11_snapshot", "SELECT " + cols(KEY + " state", **SNAP) + " FROM snapshot")
def _(spark, d):
    return to(snapshot(spark, d), KEY + " state", **SNAP)


@check("w12_state_average", "SELECT " + cols("state commodity date", r6="state_avg_price_7d") + " FROM state_avg")
def _(spark, d):
    return to(windows.regional_average(V.panel(spark, d)), "state commodity date", r6="state_avg_price_7d")


@check("w13_split", "SELECT commodity, split, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM split GROUP BY 1, 2")
def _(spark, d):
    return splits.chronological_split(V.panel(spark, d), ["commodity"]).groupBy("commodity", "split").agg(
        F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@check("w14_folds", """
SELECT fold, role, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM (
  SELECT CAST(f AS INTEGER) AS fold, date, CASE WHEN i <= 6 + (f - 1) * 3 THEN 'train' WHEN i <= 6 + f * 3 THEN 'val' END AS role
  FROM (SELECT date, dense_rank() OVER (ORDER BY date_trunc('month', date)) AS i FROM panel),
    (SELECT unnest(generate_series(1, CAST(floor((count(DISTINCT date_trunc('month', date)) - 6) / 3) AS BIGINT))) AS f FROM panel))
WHERE role IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    panel = V.panel(spark, d)
    folds = splits.walk_forward_folds(panel, 6, 3)
    return splits.assign_folds(panel, folds).groupBy("fold", "role").agg(
        F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@check("w15_recent7", """
SELECT request_id, round(avg(temperature_mean), 6) AS temp_mean_7d, sum(precipitation_mm) AS precip_sum_7d,
  round(avg(humidity), 6) AS humidity_mean_7d, round(avg(wind_speed), 6) AS wind_speed_mean_7d FROM (
  SELECT CAST(user_id AS VARCHAR) AS request_id, t AS temperature_mean, CASE WHEN rain > -900 THEN rain END AS precipitation_mm,
    hum AS humidity, wind AS wind_speed, row_number() OVER (PARTITION BY user_id ORDER BY date DESC) AS rk
  FROM user_days WHERE t > -900) WHERE rk <= 7 GROUP BY 1""")
def _(spark, d):
    return to(scoring.live_weather(V.history_payloads(spark, d)), "request_id precip_sum_7d",
              r6="temp_mean_7d humidity_mean_7d wind_speed_mean_7d")


@check("w16_naive", """
SELECT commodity, max_by(modal_price, strftime(date, '%Y-%m-%d') || mandi_id) FILTER (split = 'train') AS naive_price,
  count(*) FILTER (split = 'test') AS n_test FROM split GROUP BY 1""")
def _(spark, d):
    rows = splits.chronological_split(V.panel(spark, d), ["commodity"])
    test = splits.persistence(rows.where("split = 'train'"), rows.where("split = 'test'"), ["commodity"])
    return test.groupBy("commodity").agg(F.max("naive_price").alias("naive_price"), F.count("*").alias("n_test"))


# --- joins --------------------------------------------------------------------------------------

@check("j1_grid", "SELECT mandi_id, date, temperature_mean, precipitation_mm, humidity, wind_speed FROM day_weather")
def _(spark, d):
    return joins.join_weather_grid(features.market_days(V.panel(spark, d)), weather(spark, d)).select(
        "mandi_id", "date", "temperature_mean", "precipitation_mm", "humidity", "wind_speed")


@check("j2_entity_date", "SELECT " + cols(KEY, r6="modal_price ndvi ndvi_delta_30d")
       + " FROM panel LEFT JOIN signal_lag USING (mandi_id, date)")
def _(spark, d):
    daily = windows.signal_delta(signal_days(spark, d))
    return to(features.join_market_days(V.panel(spark, d), daily), KEY, r6="modal_price ndvi ndvi_delta_30d")


@check("j3_macro_lag", "SELECT " + cols(KEY, r6="food_cpi_index food_wpi_index") + """ FROM panel p
LEFT JOIN cpi_month c ON c.month_start + INTERVAL 1 MONTH = date_trunc('month', p.date)
LEFT JOIN wpi_month w ON w.month_start + INTERVAL 1 MONTH = date_trunc('month', p.date)""")
def _(spark, d):
    df = joins.join_published_index(V.panel(spark, d), joins.consumer_price_index(cpi(spark, d)),
                                    joins.wholesale_price_index(wpi(spark, d)))
    return to(df, KEY, r6="food_cpi_index food_wpi_index")


@check("j4_scalar", "SELECT state, district, commodity, round(portfolio_default_rate, 6) AS portfolio_default_rate, "
       "round(portfolio_mean_ltv, 6) AS portfolio_mean_ltv FROM (SELECT DISTINCT state, district, commodity FROM panel), portfolio")
def _(spark, d):
    loans = clean.clean_loans(V.raw_crop_loans(spark, d))
    groups = V.panel(spark, d).select("state", "district", "commodity").distinct()
    return to(joins.attach_scalar(groups, features.portfolio_summary(loans)), "state district commodity",
              r6="portfolio_default_rate portfolio_mean_ltv")


@check("j6_cascade", """
SELECT (m.mandi_id IS NOT NULL) AS by_market, (x.d IS NOT NULL) AS by_district, count(*) AS n,
  count(coalesce(m.latitude, x.latitude)) AS located FROM history h
LEFT JOIN locations m ON m.state = h.state_name AND upper(m.mandi_name) = upper(h.market_center) AND m.market_code % 3 = 0
LEFT JOIN (SELECT state, district AS d, min_by(latitude, mandi_id) AS latitude FROM locations GROUP BY 1, 2) x ON x.state = h.state_name AND x.d = h.district_name AND m.mandi_id IS NULL GROUP BY 1, 2""")
def _(spark, d):
    # All locations, but two of three under another name, so that their markets are found by district.
    named = F.when(F.col("market_code") % 3 == 0, F.col("mandi_name")).otherwise(F.concat(F.lit("once "), "mandi_name"))
    df = clean.price_history(raw_history(spark, d), V.locations(spark, d).withColumn("mandi_name", named))
    market = F.col("mandi_id").isNotNull()
    return df.groupBy(market.alias("by_market"), (~market & F.col("latitude").isNotNull()).alias("by_district")).agg(
        F.count("*").alias("n"), F.count("latitude").alias("located"))


@check("j7_fallback", "SELECT " + cols("mandi_id date match_level", r6="modis_ndvi", r4="ndvi_anomaly") + " FROM matched")
def _(spark, d):
    return to(day_anomaly(spark, d), "mandi_id date match_level", r6="modis_ndvi", r4="ndvi_anomaly")


@check("j9_anomaly", "SELECT " + cols("mandi_id date n_baseline_years has_anomaly",
                                      r4="ndvi_baseline_mean ndvi_baseline_std ndvi_anomaly") + " FROM anomaly")
def _(spark, d):
    return to(anomaly(spark, d), "mandi_id date n_baseline_years has_anomaly",
              r4="ndvi_baseline_mean ndvi_baseline_std ndvi_anomaly")


@check("j11_baseline_table", "SELECT " + cols("mandi_id doy n_years district state mandi_name", r4="ndvi_mean ndvi_std") + """
FROM (SELECT mandi_id, CAST(doy AS INTEGER) AS doy, n_years, ndvi_mean, ndvi_std FROM baseline)
JOIN (SELECT DISTINCT mandi_id, district, state, mandi_name FROM signal) USING (mandi_id)""")
def _(spark, d):
    base = signal(spark, d).where(F.col("date") < F.lit("2000-01-01").cast("date"))
    return to(joins.baseline_table(base, ["district", "state", "mandi_name"]),
              "mandi_id doy n_years district state mandi_name", r4="ndvi_mean ndvi_std")


@check("j10_group_stats", "SELECT loan_id, credit_grade, grade_loan_count, round(grade_default_rate, 6) AS grade_default_rate FROM crop_loans")
def _(spark, d):
    loans = clean.clean_loans(V.raw_crop_loans(spark, d))
    return to(loans, "loan_id credit_grade grade_loan_count", r6="grade_default_rate")


_pairs = S.km("q.latitude", "q.longitude", "l.latitude", "l.longitude")
_knn = """
SELECT request_id, near_id, rank, distance_km FROM (
  SELECT request_id, near_id, distance_km, row_number() OVER (PARTITION BY request_id ORDER BY distance_km, near_id) AS rank
  FROM (SELECT q.request_id, l.mandi_id AS near_id, round({km}, 6) AS distance_km
    FROM requests q, locations l WHERE q.latitude IS NOT NULL {extra})) WHERE rank <= {k}"""


@check("j12_knn", _knn.format(km=_pairs, extra="", k=5))
def _(spark, d):
    near = geo.nearest_join(V.requests(spark, d), V.locations(spark, d), 5)
    return to(near.withColumn("rank", F.col("rank").cast("bigint")), "request_id near_id rank distance_km")


@check("j13_knn_with_data", _knn.format(
    km=_pairs, extra="AND l.mandi_id IN (SELECT mandi_id FROM day_anomaly WHERE ndvi_stress_flag = 1 AND match_level = 'date')", k=2))
def _(spark, d):
    stressed = day_anomaly(spark, d).where("ndvi_stress_flag = 1 and match_level = 'date'")
    near = geo.nearest_with_data(V.requests(spark, d), V.locations(spark, d), stressed, 2)
    return to(near.withColumn("rank", F.col("rank").cast("bigint")), "request_id near_id rank distance_km")


@check("j14_neighbour_avg", "SELECT " + cols(KEY, r6="nearest5_mandi_avg_price")
       + " FROM panel LEFT JOIN near_avg USING (mandi_id, commodity, date)")
def _(spark, d):
    return to(geo.neighbour_average(V.panel(spark, d), V.locations(spark, d)), KEY, r6="nearest5_mandi_avg_price")


@check("j15_hub_distance", "SELECT mandi_id, round(least(" + ", ".join(
    S.km("latitude", "longitude", f"{a}e0", f"{b}e0") for _, a, b in K.HUBS) + "), 4) AS distance_km FROM locations")
def _(spark, d):
    return V.locations(spark, d).select(
        "mandi_id", F.round(C.hub_distance_km("latitude", "longitude"), 4).alias("distance_km"))


@check("j16_resolve", "SELECT request_id, named_id AS mandi_id, named_type AS resolution_type FROM named")
def _(spark, d):
    return geo.resolve_by_name(V.requests(spark, d), V.locations(spark, d)).select(
        "request_id", "mandi_id", "resolution_type")


@check("j17_resolve_geo", "SELECT request_id, mandi_id, resolution_type, mandi_distance_km FROM resolved")
def _(spark, d):
    return geo.resolve(V.requests(spark, d), V.locations(spark, d)).select(
        "request_id", "mandi_id", "resolution_type", "mandi_distance_km")


@check("j18_snapshot_lookup", """
SELECT request_id, coalesce(o.modal_price, s.modal_price) AS modal_price,
  CASE WHEN o.mandi_id IS NOT NULL THEN 'market' WHEN s.state IS NOT NULL THEN 'state' ELSE 'none' END AS snapshot_match
FROM resolved r JOIN locations l ON l.mandi_id = r.mandi_id
LEFT JOIN snapshot o ON o.mandi_id = r.mandi_id AND o.commodity = r.commodity
LEFT JOIN (SELECT state, commodity, min_by(modal_price, lpad(CAST(length(mandi_id) AS VARCHAR), 4, '0') || mandi_id) AS modal_price
  FROM snapshot GROUP BY 1, 2) s ON s.state = l.state AND s.commodity = r.commodity""")
def _(spark, d):
    places = V.locations(spark, d)
    located = geo.resolve(V.requests(spark, d), places).join(
        places.select("mandi_id", F.col("state").alias("mandi_state")), "mandi_id")
    return geo.snapshot_lookup(located, snapshot(spark, d), ["modal_price"]).select("request_id", "modal_price", "snapshot_match")


@check("j20_zone", "SELECT mandi_id, state, agro_climatic_zone FROM locations LEFT JOIN zones USING (state)")
def _(spark, d):
    return joins.join_zone(V.locations(spark, d), V.zones(spark, d)).select("mandi_id", "state", "agro_climatic_zone")


# --- aggregations -------------------------------------------------------------------------------

@check("a1_price_stats", "SELECT state, district, commodity, round(avg(modal_price), 6) AS mandi_mean_price, "
       "round(stddev_samp(modal_price), 4) AS mandi_std_price, count(modal_price) AS mandi_n_days FROM panel GROUP BY 1, 2, 3")
def _(spark, d):
    return to(features.price_summary(V.panel(spark, d)), "state district commodity mandi_n_days",
              r6="mandi_mean_price", r4="mandi_std_price")


@check("a2_capacity", "SELECT * FROM capacity")
def _(spark, d):
    return features.warehouse_regions(clean.clean_warehouses(V.raw_warehouses(spark, d)))


@check("a4_monthly_index", "SELECT month_start, round(food_cpi_index, 6) AS food_cpi_index, food_wpi_index "
       "FROM cpi_month FULL JOIN wpi_month USING (month_start)")
def _(spark, d):
    both = joins.consumer_price_index(cpi(spark, d)).join(joins.wholesale_price_index(wpi(spark, d)), "month_start", "full")
    return to(both, "month_start food_wpi_index", r6="food_cpi_index")


@check("a8_interval_width", "SELECT commodity, round(forecast_uncertainty, 6) AS forecast_uncertainty FROM widths")
def _(spark, d):
    return to(forecast.interval_uncertainty(relative_bands(spark, d)), "commodity", r6="forecast_uncertainty")


PERCENTILES = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


@check("a12_percentiles", "SELECT commodity, " + ", ".join(
    f"round(quantile_cont(modal_price, {q}), 6) AS {n}" for n, q in PERCENTILES.items()) + " FROM panel GROUP BY 1")
def _(spark, d):
    return to(quantiles.exact_quantiles(V.panel(spark, d), ["commodity"], "modal_price", PERCENTILES),
              "commodity", r6=" ".join(PERCENTILES))


S.VIEWS["forecasts"] = " UNION ALL ".join(
    f"SELECT commodity, {h} AS horizon_d, target_price_{h}d AS y, q10_{h}d AS q10, q50_{h}d AS q50, q90_{h}d AS q90 "
    f"FROM bands WHERE target_price_{h}d IS NOT NULL AND q50_{h}d IS NOT NULL" for h in K.HORIZONS)
METRICS = ("pinball_q10 pinball_q50 pinball_q90 rmse mape coverage_80pct avg_interval_width relative_interval_width")


@check("a14_metrics", "SELECT " + cols("commodity horizon_d n", r3=METRICS) + """ FROM (
SELECT commodity, CAST(horizon_d AS INTEGER) AS horizon_d, count(*) AS n,
  avg(greatest(0.1e0 * (y - q10), -0.9e0 * (y - q10))) AS pinball_q10,
  avg(greatest(0.5e0 * (y - q50), -0.5e0 * (y - q50))) AS pinball_q50,
  avg(greatest(0.9e0 * (y - q90), -0.1e0 * (y - q90))) AS pinball_q90, sqrt(avg((y - q50) * (y - q50))) AS rmse,
  avg(abs(y - q50) / greatest(abs(y), 1e-6)) * 100 AS mape, avg(CAST(y BETWEEN q10 AND q90 AS INTEGER)) * 100 AS coverage_80pct,
  avg(q90 - q10) AS avg_interval_width, avg(q90 - q10) / median(abs(y)) * 100 AS relative_interval_width
FROM forecasts GROUP BY 1, 2)""")
def _(spark, d):
    b = bands(spark, d)
    rows = [F.struct(F.lit(h).alias("horizon_d"), F.col(f"target_price_{h}d").alias("y"), F.col(f"q10_{h}d").alias("q10"),
                     F.col(f"q50_{h}d").alias("q50"), F.col(f"q90_{h}d").alias("q90")) for h in K.HORIZONS]
    long = b.select("commodity", F.explode(F.array(*rows)).alias("r")).select("commodity", "r.*").where(
        "y is not null and q50 is not null")
    return to(metrics.forecast_metrics(long, ["commodity", "horizon_d"]), "commodity horizon_d n", r3=METRICS)


_label = """
SELECT *, CAST(coalesce(price_cv > (SELECT median(price_cv) FROM scores)
  AND forecast_uncertainty > (SELECT median(forecast_uncertainty) FROM scores), false) AS INTEGER) AS a,
  CAST(decision = 'REJECT' AS INTEGER) AS p FROM scores"""


@check("a15_confusion", f"""
SELECT *, CASE WHEN precision + recall > 0 THEN round(2 * precision * recall / (precision + recall), 6) ELSE 0 END AS f1 FROM (
SELECT count(*) FILTER (p = 1 AND a = 1) AS tp, count(*) FILTER (p = 1 AND a = 0) AS fp, count(*) FILTER (p = 0 AND a = 1) AS fn,
  count(*) FILTER (p = 0 AND a = 0) AS tn, count(*) AS n_samples, coalesce(round(tp / nullif(tp + fp, 0), 6), 0) AS precision,
  coalesce(round(tp / nullif(tp + fn, 0), 6), 0) AS recall, round((tp + tn) / n_samples, 6) AS accuracy,
  round(avg(risk_score), 6) AS avg_risk_score, round(avg(recommended_ltv), 6) AS avg_recommended_ltv,
  count(*) FILTER (decision = 'APPROVE') AS n_approve, count(*) FILTER (decision = 'CONDITIONAL') AS n_conditional,
  count(*) FILTER (decision = 'REJECT') AS n_reject FROM ({_label}))""")
def _(spark, d):
    return to(risk.evaluate_decisions(durable(risk_table(spark, d), "risk")),
              "tp fp fn tn n_samples n_approve n_conditional n_reject",
              r6="precision recall f1 accuracy avg_risk_score avg_recommended_ltv")


@check("m13_high_risk_label", f"SELECT state, district, commodity, a AS synthetic_high_risk FROM ({_label})")
def _(spark, d):
    return risk.label_high_risk(durable(risk_table(spark, d), "risk")).select("state", "district", "commodity", "synthetic_high_risk")


@check("a17_match_rate", """
SELECT state, round(avg(CAST(modis_ndvi IS NOT NULL AS INTEGER)) * 100, 6) AS matched_pct,
  round(avg(CAST(match_level = 'date' AS INTEGER)) * 100, 6) AS exact_pct FROM matched GROUP BY 1""")
def _(spark, d):
    return to(day_anomaly(spark, d).groupBy("state").agg(
        metrics.share_pct(F.col("modis_ndvi").isNotNull()).alias("matched_pct"),
        metrics.share_pct(F.col("match_level") == "date").alias("exact_pct")), "state", r6="matched_pct exact_pct")


@check("a18_latest_nonnull", "SELECT state, round(ndvi_anomaly, 4) AS ndvi_anomaly, ndvi_stress_flag, ndvi_surplus_flag FROM state_anomaly")
def _(spark, d):
    return to(features.latest_state_anomaly(day_anomaly(spark, d), V.locations(spark, d)),
              "state ndvi_stress_flag ndvi_surplus_flag", r4="ndvi_anomaly")


@check("a19_coverage", """
SELECT mandi_id, count(DISTINCT date_trunc('month', date)) AS n_months, count(DISTINCT date) AS n_days,
  min(date) AS first_date, max(date) AS last_date FROM panel GROUP BY 1""")
def _(spark, d):
    return metrics.coverage_profile(V.panel(spark, d))


@check("a11_entities_per_state", "SELECT state, count(DISTINCT mandi_id) AS n_mandis FROM panel GROUP BY 1")
def _(spark, d):
    return metrics.entities_per_state(V.panel(spark, d))


@check("a20_histogram", """
SELECT CAST(bin AS INTEGER) AS bin, round(lo + bin * w, 6) AS bin_start, round(lo + (bin + 1) * w, 6) AS bin_end, count(*) AS n FROM (
  SELECT lo, w, least(CAST(floor((modal_price - lo) / w) AS BIGINT), 49) AS bin FROM panel,
    (SELECT min(modal_price) AS lo, (max(modal_price) - min(modal_price)) / 50 AS w FROM panel)) GROUP BY 1, lo, w, bin""")
def _(spark, d):
    return to(metrics.histogram(V.panel(spark, d), "modal_price"), "bin n", r6="bin_start bin_end")


@check("a20_monthly_box", """
SELECT CAST(month(date) AS INTEGER) AS month, round(min(ndvi), 6) AS low, round(quantile_cont(ndvi, 0.25), 6) AS p25,
  round(quantile_cont(ndvi, 0.5), 6) AS p50, round(quantile_cont(ndvi, 0.75), 6) AS p75, round(max(ndvi), 6) AS high,
  count(ndvi) AS n FROM signal_daily GROUP BY 1""")
def _(spark, d):
    return to(metrics.monthly_box(signal_days(spark, d), "ndvi"), "month n", r6="low p25 p50 p75 high")


@check("o2_topn", "SELECT commodity, count(modal_price) AS n_rows FROM panel GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def _(spark, d):
    return evaluation.top_by_rows(V.panel(spark, d), 3)


# --- nested data --------------------------------------------------------------------------------

@check("n3_json_rows", """
SELECT CAST(user_id AS VARCHAR) AS request_id, date, t AS temperature_mean, CASE WHEN rain > -900 THEN rain END AS precipitation_mm,
  hum AS humidity, wind AS wind_speed FROM user_days WHERE t > -900""")
def _(spark, d):
    return shape.weather_history_rows(V.history_payloads(spark, d))


@check("n4_array_aggs", """
SELECT CAST(user_id AS VARCHAR) AS request_id, round(avg((top + low) / 2) FILTER (i <= 7), 2) AS forecast_temp_7d_avg,
  sum(CASE WHEN rain > -900 THEN rain END) FILTER (i <= 7) AS forecast_precip_7d_sum,
  sum(CASE WHEN rain > -900 THEN rain END) FILTER (i <= 14) AS forecast_precip_14d_sum,
  round(avg(hum) FILTER (i <= 7), 2) AS forecast_humidity_7d_avg
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date) AS i FROM user_days) GROUP BY 1""")
def _(spark, d):
    return scoring.outlook(V.forecast_payloads(spark, d))


# --- forecasts and risk -------------------------------------------------------------------------

_band = ", ".join(f"round({q}_{h}d, 2) AS {n}_{h}d" for h in K.HORIZONS
                  for q, n in (("q10", "low"), ("q50", "median"), ("q90", "high")))


@check("m6_tier_forecast", f"""
SELECT mandi_id, commodity, date, CASE WHEN price_mean_30d IS NULL THEN 'insufficient_data'
  ELSE 'historical_percentile_fallback' END AS forecast_method, {_band} FROM bands""")
def _(spark, d):
    df = forecast.add_forecast(series(spark, d))
    return df.select("mandi_id", "commodity", "date", "forecast_method", *[
        F.col("forecast")[f"{h}d"][n].alias(f"{n}_{h}d") for h in K.HORIZONS for n in ("low", "median", "high")])


SCORED = dict(r6="price_cv forecast_uncertainty risk_score recommended_ltv")


@check("m8_risk_score", "SELECT " + cols("state district commodity decision", **SCORED) + " FROM scores")
def _(spark, d):
    return to(scores(spark, d), "state district commodity decision", **SCORED)


@check("m9_decision", f"SELECT client, round(risk_score, 6) AS risk_score, {S.DECISION} AS decision, round({S.LTV}, 6) AS recommended_ltv, n "
       "FROM (SELECT user_id AS client, CAST(event_id % 101 AS DOUBLE) / 100e0 AS risk_score, count(*) AS n FROM events GROUP BY 1, 2)")
def _(spark, d):
    rows = V.table(spark, d, "events").groupBy(
        F.col("user_id").alias("client"), ((F.col("event_id") % 101).cast("double") / 100.0).alias("risk_score")).agg(
        F.count("*").alias("n"))
    return to(rows.withColumns({"decision": risk.decision("risk_score"), "recommended_ltv": risk.recommended_ltv("risk_score")}),
              "client decision n", r6="risk_score recommended_ltv")


@check("m10_proxy", "SELECT " + cols("state district commodity", r6="risk_score_proxy recommended_max_ltv") + " FROM risk")
def _(spark, d):
    return to(risk_table(spark, d), "state district commodity", r6="risk_score_proxy recommended_max_ltv")


@check("m11_loan_amount", """
SELECT request_id, CASE WHEN requested_loan_amount <> 0 THEN round(least(requested_loan_amount, 0.7e0 * 20 * quantity_kg), 2) END AS amount
FROM requests""")
def _(spark, d):
    return V.requests(spark, d).select("request_id", risk.loan_amount(
        "requested_loan_amount", F.lit(0.7), F.lit(20.0), "quantity_kg").alias("amount"))


@check("m12_signal_label", """
SELECT mandi_id, date, CASE WHEN ndvi_stress_flag = 1 THEN 'STRESS' WHEN ndvi_surplus_flag = 1 THEN 'SURPLUS' ELSE 'NORMAL' END
  AS ndvi_signal, ndvi_anomaly_direction FROM day_anomaly""")
def _(spark, d):
    return day_anomaly(spark, d).select(
        "mandi_id", "date", joins.signal_label("ndvi_stress_flag", "ndvi_surplus_flag").alias("ndvi_signal"),
        "ndvi_anomaly_direction")


# --- reports ------------------------------------------------------------------------------------

_avgs = 'count(risk_score) AS "count", round(avg(risk_score), 3) AS avg_risk, round(avg(recommended_ltv) * 100, 1) AS avg_ltv'
_approve = "round(avg(CAST(decision = 'APPROVE' AS INTEGER)) * 100, 1) AS approve_pct"


@check("q1_scores", "SELECT " + cols("state district commodity n_warehouses decision", r6="mandi_mean_price price_cv "
       "forecast_uncertainty risk_score recommended_ltv") + " FROM scores WHERE commodity = 'WHEAT' AND state LIKE '%NATION_1%' "
       "ORDER BY state, district, commodity LIMIT 25")
def _(spark, d):
    return to(reports.scores(scores(spark, d), "wheat", state="nation_1", limit=25),
              "state district commodity n_warehouses decision",
              r6="mandi_mean_price price_cv forecast_uncertainty risk_score recommended_ltv")


_dec = ", ".join(f"count(*) FILTER (decision = '{x}') AS n_{x.lower()}" for x in ("APPROVE", "CONDITIONAL", "REJECT"))


def flat(df: DataFrame) -> DataFrame:
    """Decision map to one column per decision, so that SQL can compare."""
    return df.withColumns({f"n_{x.lower()}": F.coalesce(F.try_element_at("decisions", F.lit(x)), F.lit(0))
                           for x in ("APPROVE", "CONDITIONAL", "REJECT")}).drop("decisions")


@check("q2_commodity_scores", f"SELECT commodity, {_avgs}, {_dec} FROM scores WHERE commodity = 'TOMATO' GROUP BY 1")
def _(spark, d):
    return flat(reports.commodity_scores(scores(spark, d), "tomato"))


@check("q3_summary", """
SELECT count(*) AS total_rows, count(DISTINCT commodity) AS total_commodities, count(DISTINCT state) AS total_states,
  round(avg(risk_score), 3) AS avg_risk_score, round(avg(recommended_ltv) * 100, 1) AS avg_recommended_ltv, """ + _dec + ", "
       + ", ".join(f"round(quantile_cont(risk_score, {q}), 3) AS {n}" for n, q in PERCENTILES.items()) + " FROM scores")
def _(spark, d):
    return reports.summary(scores(spark, d))


@check("q4_decisions", 'SELECT commodity, decision, count(*) AS "count" FROM scores GROUP BY 1, 2')
def _(spark, d):
    return reports.decisions_by_commodity(scores(spark, d))


@check("q5_league", f"SELECT commodity, {_avgs}, {_approve} FROM scores GROUP BY 1")
def _(spark, d):
    return reports.commodity_league(scores(spark, d))


@check("q6_categories", 'SELECT commodity_category, round(avg(risk_score), 3) AS avg_risk, count(risk_score) AS "count" FROM scores GROUP BY 1')
def _(spark, d):
    return reports.overview(scores(spark, d))["category_risk"]


@check("q6_top_commodities", f"SELECT commodity, {_avgs} FROM scores GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(spark, d):
    return reports.overview(scores(spark, d))["top_commodities"]


@check("q6_top_states", f'SELECT state, count(risk_score) AS "count", round(avg(risk_score), 3) AS avg_risk, {_approve} '
       "FROM scores GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def _(spark, d):
    return reports.overview(scores(spark, d))["top_states"]


@check("q7_detail", f"""
SELECT commodity, count(*) AS total, round(avg(risk_score), 3) AS avg_risk, round(avg(recommended_ltv) * 100, 1) AS avg_ltv,
  string_agg(DISTINCT commodity_category, ',') AS categories, {_dec} FROM scores WHERE commodity = 'ONION' GROUP BY 1""")
def _(spark, d):
    return flat(reports.commodity_detail(scores(spark, d), "onion")).withColumn("categories", F.array_join("categories", ","))


@check("q7_states", f"SELECT state, {_avgs}, {_approve} FROM scores WHERE commodity = 'ONION' GROUP BY 1")
def _(spark, d):
    return reports.commodity_states(scores(spark, d), "onion")


@check("q7_districts", f"SELECT state, district, {_avgs} FROM scores WHERE commodity = 'ONION' GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20")
def _(spark, d):
    return reports.commodity_districts(scores(spark, d), "onion")


@check("q8_state_search", "SELECT DISTINCT state FROM locations WHERE state LIKE '%N_1%' ESCAPE '$' AND contains(state, 'N_1') ORDER BY 1 LIMIT 10")
def _(spark, d):
    return reports.search_states(V.locations(spark, d), "n_1")


@check("q9_market_search", """
SELECT mandi_id, mandi_name, district, state, round(latitude, 4) AS latitude, round(longitude, 4) AS longitude FROM locations
WHERE contains(upper(mandi_name), '00001') OR contains(district, '00001') ORDER BY mandi_id LIMIT 15""")
def _(spark, d):
    return reports.search_markets(V.locations(spark, d), "00001")


@check("q10_decision_shares", """
SELECT decision, CASE WHEN risk_score < 0.35 THEN 'LOW' WHEN risk_score < 0.60 THEN 'MED' ELSE 'HIGH' END AS band,
  count(*) AS "count", round(count(*) / (SELECT count(*) FROM scores) * 100, 1) AS share_pct FROM scores GROUP BY 1, 2""")
def _(spark, d):
    return reports.decision_shares(scores(spark, d))


# --- pipelines ----------------------------------------------------------------------------------

GOLD = dict(r6="modal_price price_lag_7d price_mean_30d price_momentum_7d arrivals_mean_7d temp_mean_7d precip_sum_7d "
               "humidity_mean_7d ndvi ndvi_delta_30d food_cpi_index food_wpi_index state_avg_price_7d nearest5_mandi_avg_price "
               "modis_ndvi",
            r4="price_std_7d ndvi_anomaly ndvi_anomaly_7d_avg distance_to_nearest_major_market_km")
GOLD_PLAIN = ("mandi_id commodity date state agro_climatic_zone day_of_week month is_weekend ndvi_stress_flag "
              "target_price_7d target_price_30d")


S.VIEWS["gold"] = """
SELECT s.*, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month,
  CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, w.temp_mean_7d, w.precip_sum_7d, w.humidity_mean_7d, g.ndvi, g.ndvi_delta_30d,
  a.modis_ndvi, a.ndvi_anomaly, a.ndvi_anomaly_7d_avg, a.ndvi_stress_flag, c.food_cpi_index, i.food_wpi_index,
  v.state_avg_price_7d, n.nearest5_mandi_avg_price, z.agro_climatic_zone, least(""" + ", ".join(
    S.km("s.latitude", "s.longitude", f"{a}e0", f"{b}e0") for _, a, b in K.HUBS) + """) AS distance_to_nearest_major_market_km
FROM series s LEFT JOIN day_weather w USING (mandi_id, date) LEFT JOIN signal_lag g USING (mandi_id, date)
LEFT JOIN day_anomaly a USING (mandi_id, date)
LEFT JOIN cpi_month c ON c.month_start + INTERVAL 1 MONTH = date_trunc('month', s.date)
LEFT JOIN wpi_month i ON i.month_start + INTERVAL 1 MONTH = date_trunc('month', s.date)
LEFT JOIN state_avg v ON v.state = s.state AND v.commodity = s.commodity AND v.date = s.date
LEFT JOIN near_avg n ON n.mandi_id = s.mandi_id AND n.commodity = s.commodity AND n.date = s.date
LEFT JOIN zones z ON z.state = s.state"""


@check("c11_gold", "SELECT " + cols(GOLD_PLAIN, **GOLD) + " FROM gold")
def _(spark, d):
    return to(gold(spark, d), GOLD_PLAIN, **GOLD)


@check("c12_risk", "SELECT " + cols(
    "state district commodity commodity_category mandi_n_days total_capacity_mt n_warehouses ndvi_stress_flag ndvi_surplus_flag",
    r6="mandi_mean_price price_cv portfolio_default_rate portfolio_mean_ltv forecast_uncertainty risk_score_proxy "
       "recommended_max_ltv", r4="mandi_std_price ndvi_anomaly") + " FROM risk")
def _(spark, d):
    return to(risk_table(spark, d),
              "state district commodity commodity_category mandi_n_days total_capacity_mt n_warehouses ndvi_stress_flag "
              "ndvi_surplus_flag", r6="mandi_mean_price price_cv portfolio_default_rate portfolio_mean_ltv "
              "forecast_uncertainty risk_score_proxy recommended_max_ltv", r4="mandi_std_price ndvi_anomaly")


def _request_columns(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        "request_id", "status", "mandi_id", "resolution_type", "mandi_distance_km", "commodity", "forecast_method",
        F.col("forecast")["30d"]["high"].alias("high_30d"), "risk_score", "decision", "recommended_ltv_pct",
        "recommended_loan_amount", "modal_price", *more)


_req = f"""
SELECT r.*, l.state AS mandi_state, s.modal_price, s.price_mean_30d, s.price_std_30d, s.price_mean_7d, s.price_std_7d,
  month(s.date) AS month, coalesce(s.price_std_30d, s.price_mean_30d * 0.1e0) AS sd, (s.mandi_id IS NOT NULL) AS found
FROM resolved r LEFT JOIN locations l ON l.mandi_id = r.mandi_id
LEFT JOIN snapshot s ON s.mandi_id = coalesce((SELECT o.mandi_id FROM snapshot o WHERE o.mandi_id = r.mandi_id AND o.commodity = r.commodity),
  (SELECT min_by(o.mandi_id, lpad(CAST(length(o.mandi_id) AS VARCHAR), 4, '0') || o.mandi_id) FROM snapshot o
   WHERE o.state = l.state AND o.commodity = r.commodity)) AND s.commodity = r.commodity"""
S.VIEWS["found"] = _req
S.VIEWS["judged"] = f"""
SELECT *, {S.DECISION} AS decision, round(round({S.LTV} * 100, 6), 1) AS recommended_ltv_pct FROM (
  SELECT *, CASE WHEN commodity IS NULL OR (state IS NULL AND latitude IS NULL) THEN 'invalid_request'
    WHEN mandi_id IS NULL THEN 'no_market' WHEN NOT found THEN 'no_features' WHEN price_mean_30d IS NULL THEN 'insufficient_data'
    ELSE 'ok' END AS status,
  0.25e0 * least(1e0, greatest(0e0, coalesce(CASE WHEN price_mean_7d > 0 AND price_std_7d <> 0 THEN price_std_7d / price_mean_7d END, 0.1e0)))
  + 0.20e0 * coalesce(CASE WHEN round(price_mean_30d, 2) > 0 THEN greatest(0e0, least(1e0,
      (round(price_mean_30d + sd * {1.28 * (1 + 7 / 30 * 0.5)!r}e0, 2) - round(price_mean_30d - sd * {1.28 * (1 + 7 / 30 * 0.5)!r}e0, 2))
      / (2 * round(price_mean_30d, 2)))) END, 0.3e0)
  + 0.15e0 * 0.6e0 + 0.10e0 * CASE warehouse_grade WHEN 'A' THEN 0e0 WHEN 'C' THEN 1e0 ELSE 0.5e0 END
  + 0.20e0 * {S.TIER.format(c="commodity")}
  + 0.10e0 * CASE {S.SEASON.format(m="coalesce(month, 6)")} WHEN 'Kharif' THEN 1e0 WHEN 'Zaid' THEN 0.5e0 ELSE 0e0 END AS risk_score
  FROM found)"""


@check("c15_scoring", f"""
SELECT request_id, status, mandi_id, resolution_type, mandi_distance_km, commodity,
  CASE WHEN price_mean_30d IS NULL THEN 'insufficient_data' ELSE 'historical_percentile_fallback' END AS forecast_method,
  CASE WHEN status = 'ok' THEN round(price_mean_30d + sd * {1.28 * 1.5!r}e0, 2) END AS high_30d,
  CASE WHEN status = 'ok' THEN round(risk_score, 4) END AS risk_score, CASE WHEN status = 'ok' THEN decision END AS decision,
  CASE WHEN status = 'ok' THEN recommended_ltv_pct END AS recommended_ltv_pct,
  CASE WHEN status = 'ok' AND requested_loan_amount <> 0
    THEN round(least(requested_loan_amount, recommended_ltv_pct / 100 * modal_price * quantity_kg), 2) END AS recommended_loan_amount,
  CASE WHEN status = 'ok' THEN modal_price END AS modal_price FROM judged""")
def _(spark, d):
    return _request_columns(scoring.score_requests(V.requests(spark, d), V.locations(spark, d), snapshot(spark, d)))


S.VIEWS["judged_live"] = S.VIEWS["judged"].replace("WHEN NOT found THEN", "WHEN NOT found AND NOT live THEN").replace(
    "WHEN price_mean_30d IS NULL THEN", "WHEN price_mean_30d IS NULL AND NOT live THEN").replace("FROM found)", """FROM (
  SELECT *, client % 3 <> 0 AND client IN (SELECT user_id FROM user_days WHERE t > -900) AS live FROM found))""")


@check("c15_scoring_live_weather", f"""
SELECT request_id, status, mandi_id, resolution_type, mandi_distance_km, commodity,
  CASE WHEN price_mean_30d IS NULL THEN 'insufficient_data' ELSE 'historical_percentile_fallback' END AS forecast_method,
  CASE WHEN status = 'ok' THEN round(price_mean_30d + sd * {1.28 * 1.5!r}e0, 2) END AS high_30d,
  CASE WHEN status = 'ok' THEN round(risk_score, 4) END AS risk_score, CASE WHEN status = 'ok' THEN decision END AS decision,
  CASE WHEN status = 'ok' THEN recommended_ltv_pct END AS recommended_ltv_pct,
  CASE WHEN status = 'ok' AND requested_loan_amount <> 0 THEN
    round(least(requested_loan_amount, recommended_ltv_pct / 100 * coalesce(modal_price, 0) * quantity_kg), 2) END AS recommended_loan_amount,
  CASE WHEN status = 'ok' THEN coalesce(modal_price, 0) END AS modal_price, live AS live_weather_used, true AS forecast_weather_used
FROM judged_live""")
def _(spark, d):
    asked = V.requests(spark, d)
    users = asked.select("request_id", F.col("client").cast("string").alias("_u"))

    def per_request(df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("request_id", "_u").join(users, "_u").drop("_u")

    # a third of the clients send no readings
    live = per_request(scoring.live_weather(V.history_payloads(spark, d)).where(F.col("request_id").cast("long") % 3 != 0))
    ahead = per_request(scoring.outlook(V.forecast_payloads(spark, d)))
    return _request_columns(scoring.score_requests(asked, V.locations(spark, d), snapshot(spark, d), None, live, ahead),
                            "live_weather_used", "forecast_weather_used")


_answer = ", ".join([
    *[f"round(price_mean_30d + {sign} * sd * {1.28 * (1 + h / 30 * 0.5)!r}e0, 2) AS {name}_{h}d"
      for h in K.HORIZONS for name, sign in (("low", -1), ("median", 0), ("high", 1))],
    *[f"round({weight}e0 * {value} * 100, 1) AS share_{name}" for (name, weight), value in zip(K.RISK_WEIGHTS.items(), (
        "least(1e0, greatest(0e0, cv))", "width", "0.6e0", "CASE warehouse_grade WHEN 'A' THEN 0e0 WHEN 'C' THEN 1e0 ELSE 0.5e0 END",
        S.TIER.format(c="commodity"), "CASE season WHEN 'Kharif' THEN 1e0 WHEN 'Zaid' THEN 0.5e0 ELSE 0e0 END"))],
    *[f"{weight}e0 AS weight_{name}" for name, weight in K.RISK_WEIGHTS.items()]])


@check("n5_nested_answer", f"""
SELECT request_id, {_answer}, round(cv, 4) AS price_cv, round(width, 4) AS forecast_uncertainty, CAST(2 AS INTEGER) AS n_warehouses,
  CASE WHEN warehouse_grade IN ('A', 'B', 'C') THEN warehouse_grade ELSE 'B' END AS warehouse_grade,
  round({S.TIER.format(c="commodity")}, 4) AS commodity_tier, season, {K.APPROVE_BELOW}e0 AS approve, {K.REJECT_FROM}e0 AS reject FROM (
  SELECT *, coalesce(CASE WHEN price_mean_7d > 0 AND price_std_7d <> 0 THEN price_std_7d / price_mean_7d END, 0.1e0) AS cv,
    coalesce(CASE WHEN round(price_mean_30d, 2) > 0 THEN greatest(0e0, least(1e0,
      (round(price_mean_30d + sd * {1.28 * (1 + 7 / 30 * 0.5)!r}e0, 2) - round(price_mean_30d - sd * {1.28 * (1 + 7 / 30 * 0.5)!r}e0, 2))
      / (2 * round(price_mean_30d, 2)))) END, 0.3e0) AS width, {S.SEASON.format(m="coalesce(month, 6)")} AS season
  FROM judged WHERE status = 'ok')""")
def _(spark, d):
    """The answers as they stand in JSON, taken apart again."""
    made = scoring.score_requests(V.requests(spark, d), V.locations(spark, d), snapshot(spark, d)).where("status = 'ok'")
    said = made.select("request_id", F.to_json(F.struct("forecast")).alias("said"), "explanation")

    def number(column: str, path: str):
        return F.get_json_object(column, path).cast("double")

    return said.select(
        "request_id",
        *[number("said", f"$.forecast.{h}d.{n}").alias(f"{n}_{h}d") for h in K.HORIZONS for n in ("low", "median", "high")],
        *[number("explanation", f"$.feature_importance.{n}").alias(f"share_{n}") for n in K.RISK_WEIGHTS],
        *[number("explanation", f"$.weights.{n}").alias(f"weight_{n}") for n in K.RISK_WEIGHTS],
        *[number("explanation", f"$.components.{n}").alias(n) for n in ("price_cv", "forecast_uncertainty", "commodity_tier")],
        number("explanation", "$.components.n_warehouses").cast("int").alias("n_warehouses"),
        *[F.get_json_object("explanation", f"$.components.{n}").alias(n) for n in ("warehouse_grade", "season")],
        *[number("explanation", f"$.thresholds.{n}").alias(n) for n in ("approve", "reject")])


@check("m4_boost", "SELECT commodity, count(*) AS n, count(*) AS n_ordered, true AS better_than_start FROM panel GROUP BY 1")
def _(spark, d):
    df = stored(spark, d, "gold", gold)
    targets = {f"{h}d": f"target_price_{h}d" for h in K.HORIZONS}
    model = boosting.train(df, targets)
    start = boosting.predict(df, model.stump())
    made = boosting.predict(df, model).select("mandi_id", "commodity", "date", *targets.values(), *[
        f"q{q}_{h}d" for h in K.HORIZONS for q in (10, 50, 90)])
    both = made.join(start.select("mandi_id", "commodity", "date", *[
        F.col(f"q50_{h}d").alias(f"start_{h}d") for h in K.HORIZONS]), ["mandi_id", "commodity", "date"])
    ordered, better = F.lit(True), F.lit(True)
    for h in K.HORIZONS:
        ordered &= (F.col(f"q10_{h}d") <= F.col(f"q50_{h}d")) & (F.col(f"q50_{h}d") <= F.col(f"q90_{h}d"))
        better &= F.coalesce(F.avg(C.pinball(targets[f"{h}d"], f"q50_{h}d", 0.5))
                             <= F.avg(C.pinball(targets[f"{h}d"], f"start_{h}d", 0.5)) + 1e-9, F.lit(True))
    return both.groupBy("commodity").agg(
        F.count("*").alias("n"), F.count_if(ordered).alias("n_ordered"), better.alias("better_than_start"))


NAIVE = "pinball_q10_naive pinball_q50_naive pinball_q90_naive rmse_naive mape_naive"
S.VIEWS["complete"] = "SELECT * FROM gold WHERE " + " AND ".join(f"{f} IS NOT NULL" for f in K.FEATURES if f != "day_of_month")
_method = """
SELECT commodity, horizon_d, avg(greatest(0.1e0 * e, -0.9e0 * e)) AS pinball_q10_naive, avg(0.5e0 * abs(e)) AS pinball_q50_naive,
  avg(greatest(0.9e0 * e, -0.1e0 * e)) AS pinball_q90_naive, sqrt(avg(e * e)) AS rmse_naive,
  avg(abs(e) / greatest(abs(y), 1e-6)) * 100 AS mape_naive, true AS lifts_follow, true AS calibration_follows, true AS complete
FROM (SELECT r.commodity, r.h AS horizon_d, r.y, r.y - last.naive AS e FROM (""" + " UNION ALL ".join(f"""
    SELECT g.commodity, CAST({h} AS INTEGER) AS h, g.date, g.target_price_{h}d AS y, c.train_cut, c.val_cut
    FROM complete g JOIN (
      SELECT commodity, min(date) FILTER (upto > floor(total * 0.70e0)) AS train_cut,
        min(date) FILTER (upto > floor(total * 0.85e0)) AS val_cut FROM (
        SELECT commodity, date, sum(n) OVER (PARTITION BY commodity ORDER BY date) AS upto, sum(n) OVER (PARTITION BY commodity) AS total
        FROM (SELECT commodity, date, count(*) AS n FROM complete WHERE target_price_{h}d IS NOT NULL GROUP BY 1, 2)) GROUP BY 1) c
      ON c.commodity = g.commodity WHERE g.target_price_{h}d IS NOT NULL""" for h in K.HORIZONS) + """) r JOIN (
  SELECT t.commodity, t.h, max_by(g.modal_price, strftime(g.date, '%Y-%m-%d') || g.mandi_id) AS naive FROM (""" + " UNION ALL ".join(f"""
    SELECT commodity, CAST({h} AS INTEGER) AS h, min(date) FILTER (upto > floor(total * 0.70e0)) AS train_cut FROM (
        SELECT commodity, date, sum(n) OVER (PARTITION BY commodity ORDER BY date) AS upto, sum(n) OVER (PARTITION BY commodity) AS total
        FROM (SELECT commodity, date, count(*) AS n FROM complete WHERE target_price_{h}d IS NOT NULL GROUP BY 1, 2)) GROUP BY 1"""
    for h in K.HORIZONS) + """) t JOIN complete g ON g.commodity = t.commodity AND g.date <= t.train_cut
    AND CASE t.h """ + " ".join(f"WHEN {h} THEN g.target_price_{h}d" for h in K.HORIZONS) + """ END IS NOT NULL GROUP BY 1, 2) last
  ON last.commodity = r.commodity AND last.h = r.h WHERE r.date > r.val_cut) GROUP BY 1, 2"""


@check("c14_evaluation", "SELECT " + cols("commodity horizon_d lifts_follow calibration_follows complete", r6=NAIVE) + f" FROM ({_method})")
def _(spark, d):
    rows = evaluation.evaluation_rows(stored(spark, d, "gold", gold))
    model = evaluation.train_on_split(rows)
    made = evaluation.report(durable(evaluation.evaluate(rows, model), "metrics"))
    lifts, complete = F.lit(True), F.lit(True)
    for m in metrics.LOSSES:
        naive, mine = F.col(f"{m}_naive"), F.col(f"{m}_model")
        lifts &= F.abs(F.col(f"{m}_lift_pct") - (naive - mine) / naive * 100) < 1e-6
        complete &= mine.isNotNull() & (mine > 0)
    covered = F.col("coverage_80pct")
    follows = F.when((covered >= 75) & (covered <= 85), "OK").otherwise("CALIBRATION NEEDED") == F.col("calibration")
    return to(made.withColumns({"lifts_follow": lifts, "calibration_follows": follows, "complete": complete}),
              "commodity horizon_d lifts_follow calibration_follows complete", r6=NAIVE)


def _best_cut(level: int) -> str:
    """The cut of every node of one tree level, by trying all of them, and the rows one level further down."""
    return f"""
l{level} AS (SELECT commodity, q, node, f, x, count(*) FILTER (up) AS u, count(*) AS n FROM (
    SELECT commodity, q, node, up, unnest([0, 1]) AS f, unnest([w, m]) AS x FROM n{level}) GROUP BY ALL),
s{level} AS (SELECT *, sum(n) OVER run AS nl, q * sum(u) OVER run - (1 - q) * (sum(n) OVER run - sum(u) OVER run) AS gl,
    sum(n) OVER line AS nt, q * sum(u) OVER line - (1 - q) * (sum(n) OVER line - sum(u) OVER line) AS gt FROM l{level}
  WINDOW run AS (PARTITION BY commodity, q, node, f ORDER BY x), line AS (PARTITION BY commodity, q, node, f)),
c{level} AS (SELECT commodity, q, node, f, x AS cut FROM (
    SELECT *, row_number() OVER (PARTITION BY commodity, q, node ORDER BY gain DESC, f, x) AS rk FROM (
      SELECT *, round(gl * gl / nl + (gt - gl) * (gt - gl) / (nt - nl) - gt * gt / nt, 9) AS gain FROM s{level}
      WHERE nl >= 10 AND nt - nl >= 10) WHERE gain > 1e-9) WHERE rk = 1),
n{level + 1} AS (SELECT n.* REPLACE (CASE WHEN f IS NULL THEN n.node
    ELSE 2 * n.node + CAST((CASE f WHEN 0 THEN w ELSE m END) > cut AS INTEGER) END AS node)
  FROM n{level} n LEFT JOIN c{level} c ON c.commodity = n.commodity AND c.q = n.q AND c.node = n.node)"""


@check("m3_leaf_values", f"""
SELECT * FROM (WITH r AS (SELECT commodity, modal_price AS y, CAST(isodow(date) - 1 AS INTEGER) AS w, CAST(month(date) AS INTEGER) AS m FROM panel),
k AS (SELECT commodity, y, row_number() OVER (PARTITION BY commodity ORDER BY y) AS rk, count(*) OVER (PARTITION BY commodity) AS n FROM r),
b AS (SELECT commodity, q, y AS start FROM k, (SELECT unnest([0.1e0, 0.5e0, 0.9e0]) AS q) WHERE rk = ceil(q * n - 1e-9)),
n0 AS (SELECT r.*, q, start, y > start AS up, 1 AS node FROM r JOIN b USING (commodity)), {_best_cut(0)}, {_best_cut(1)},
v AS (SELECT commodity, q, node, y - start AS rest, row_number() OVER (PARTITION BY commodity, q, node ORDER BY y - start) AS rk,
    count(*) OVER (PARTITION BY commodity, q, node) AS n FROM n2)
SELECT commodity, q AS quantile, -1 AS tree, 1 AS node, NULL AS feature, NULL AS threshold, start AS value FROM b
UNION ALL SELECT commodity, q, 0, node, CASE f WHEN 0 THEN 'day_of_week' ELSE 'month' END, CAST(cut AS DOUBLE), NULL
FROM (SELECT * FROM c0 UNION ALL SELECT * FROM c1)
UNION ALL SELECT commodity, q, 0, node, NULL, NULL, round(rest, 6) FROM v WHERE rk = ceil(q * n - 1e-9))""")
def _(spark, d):
    rows = durable(V.panel(spark, d).withColumns({"day_of_week": F.weekday("date"), "month": F.month("date")}), "rows")
    model = boosting.train(rows, {"now": "modal_price"}, ["day_of_week", "month"],
                           params=boosting.BoostParams(n_estimators=1, max_depth=2, subsample=1.0))
    return model.table(spark).where("tree >= -1").select(
        "commodity", "quantile", "tree", "node", "feature", "threshold", F.round("value", 6).alias("value"))


S.VIEWS["months"] = "SELECT year(m) * 12 + month(m) - 1 AS m, row_number() OVER (ORDER BY m) AS i FROM (SELECT DISTINCT date_trunc('month', date) AS m FROM series)"


@check("m14_search", "SELECT s.commodity, CAST(draw AS INTEGER) AS draw, CAST(fold AS INTEGER) AS fold, horizon, quantile, n_train, n_val, "
       "true AS tried FROM (SELECT commodity, fold, horizon, count(*) FILTER (i <= 48 + (fold - 1) * 12) AS n_train, "
       "count(*) FILTER (i > 48 + (fold - 1) * 12 AND i <= 48 + fold * 12) AS n_val FROM ("
       + " UNION ALL ".join(f"SELECT commodity, date, '{h}d' AS horizon FROM series WHERE target_price_{h}d IS NOT NULL" for h in K.HORIZONS)
       + """) s JOIN months ON m = year(date) * 12 + month(date) - 1,
  (SELECT unnest(generate_series(1, CAST(floor((count(*) - 48) / 12) AS BIGINT))) AS fold FROM months) GROUP BY 1, 2, 3) s,
  (SELECT unnest([0, 1, 2]) AS draw), (SELECT unnest([0.1e0, 0.5e0, 0.9e0]) AS quantile) WHERE n_train > 0 AND n_val > 0""")
def _(spark, d):
    rows = durable(series(spark, d), "series")
    grid = {"n_estimators": [10, 20], "max_depth": [2, 3], "learning_rate": [0.1, 0.3]}
    found = boosting.search_folds(rows, {f"{h}d": f"target_price_{h}d" for h in K.HORIZONS}, boosting.random_draws(grid, 3),
                                  boosting.fold_bounds(rows, 48, 12))
    return found.select("commodity", "draw", "fold", "horizon", "quantile", "n_train", "n_val",
                        (F.col("loss") > 0).alias("tried"))


# --- small functions ----------------------------------------------------------------------------

@check("f3_titles", """
SELECT p_partkey, array_to_string([upper(x[1]) || lower(x[2:]) FOR x IN string_split(trim(p_name), ' ')], ' ') AS title,
  split_part(p_name, ' ', 1) AS first_word FROM part""")
def _(spark, d):
    return V.table(spark, d, "part").select("p_partkey", C.title("p_name").alias("title"), C.first_word("p_name", " ").alias("first_word"))


@check("f19_next_month", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS next_month FROM orders")
def _(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", C.next_month_start("o_orderdate").alias("next_month"))


@check("f22_date_chunks", """
SELECT o_orderpriority, CAST(start AS DATE) AS start, least(CAST(start AS DATE) + 89, hi) AS stop FROM (
  SELECT o_orderpriority, hi, unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 90 DAY)) AS start
  FROM (SELECT o_orderpriority, min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders GROUP BY 1))""")
def _(spark, d):
    day = F.col("o_orderdate").cast("date")
    spans = V.table(spark, d, "orders").groupBy("o_orderpriority").agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    return spans.select("o_orderpriority", F.explode(C.date_chunks("lo", "hi")).alias("c")).select(
        "o_orderpriority", "c.start", F.col("c.end").alias("stop"))


@check("m2_gradient", """
SELECT l_returnflag, l_linestatus, count(*) FILTER (l_extendedprice > l_quantity * 1500) AS up,
  round(sum(CASE WHEN l_extendedprice > l_quantity * 1500 THEN 0.9e0 ELSE -0.1e0 END), 4) AS total FROM lineitem GROUP BY 1, 2""")
def _(spark, d):
    rows = V.table(spark, d, "lineitem").withColumn("guess", F.col("l_quantity") * 1500).withColumn(
        "step", C.pinball_gradient("l_extendedprice", "guess", 0.9))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count_if(F.col("step") > 0).alias("up"), F.round(F.sum("step"), 4).alias("total"))


@check("a16_lift", """
SELECT o_orderpriority, round((naive - model) / greatest(naive, 1e-9) * 100, 6) AS lift_pct,
  CASE WHEN share BETWEEN 75 AND 85 THEN 'OK' ELSE 'CALIBRATION NEEDED' END AS calibration FROM (
  SELECT o_orderpriority, avg(CAST(o_totalprice AS DOUBLE)) AS naive, median(CAST(o_totalprice AS DOUBLE)) AS model,
    round(avg(CAST(o_totalprice < 240000 AS INTEGER)) * 100, 1) AS share FROM orders GROUP BY 1)""")
def _(spark, d):
    price = F.col("o_totalprice").cast("double")
    made = V.table(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.avg(price).alias("naive"), F.median(price).alias("model"),
        F.round(F.avg((price < 240000).cast("int")) * 100, 1).alias("share"))
    return made.select("o_orderpriority", F.round(metrics.lift_pct(F.col("naive"), F.col("model")), 6).alias("lift_pct"),
                       metrics.calibration_status("share").alias("calibration"))


# --- sources and sinks --------------------------------------------------------------------------

@check("s1_csv_text", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def _(spark, d):
    path = scratch_path(spark, "csv")
    sinks.write_csv(V.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), path)
    return tables.read_csv_text(spark, path)


@check("s9_optional_table", "SELECT mandi_id, CAST(NULL AS VARCHAR) AS agro_climatic_zone FROM locations")
def _(spark, d):
    zones = tables.read_optional(spark, scratch_path(spark, "absent"), "state string, zone_name string")
    return joins.join_zone(V.locations(spark, d), zones).select("mandi_id", "agro_climatic_zone")


@check("s2_file_names", """
SELECT replace(state, ' ', '-') AS state, mandi_name AS warehouse_name, CAST(market_code AS VARCHAR) AS capacity_mt FROM locations""")
def _(spark, d):
    path, rows = scratch_path(spark, "warehouses"), V.locations(spark, d)
    # A file per state and header; the state is in the file's name, with its hyphens, and in a column that is not read.
    for half, names in enumerate((("Warehouse Name", "Capacity(MT)"), ("wh_name", "capacityin_mt"))):
        mine = rows.where(F.col("market_code") % 2 == half)
        sinks.write_named_csvs(mine.select(F.col("mandi_name").alias(names[0]), F.col("market_code").alias(names[1]),
                                           F.col("state").alias("held")), path,
                               F.concat(F.lit(f"wdra{half}-"), F.translate("held", " ", "-"), F.lit(".csv")))
    read = tables.read_csv_by_name(spark, path, r"^wdra[01]-(.+)\.csv$", "state", K.WAREHOUSE_COLUMNS)
    return read.select("state", "warehouse_name", "capacity_mt")


@check("s6_history_files", """
SELECT mandi_name AS market_center, CASE WHEN market_code % 2 = 0 THEN state END AS state_name,
  CAST(market_code AS VARCHAR) AS modal_price, 1 AS unreadable FROM locations""")
def _(spark, d):
    path, rows = scratch_path(spark, "history"), V.locations(spark, d)
    even, odd = (rows.where(F.col("market_code") % 2 == half) for half in (0, 1))
    sinks.write_named_csvs(even.select(F.col("state").alias("State"), F.col("mandi_name").alias("Market"),
                                       F.col("market_code").alias("Modal Price (Rs/Quintal)")), path, F.concat(F.col("State"), F.lit(".csv")))
    sinks.write_named_csvs(odd.select(F.col("mandi_name").alias("market_name"), F.col("market_code").alias("prices"),
                                      F.lit("z").alias("extra")), path, F.concat(F.lit("extra-"), F.col("prices") % 5, F.lit(".CSV")))
    system, place = tables.file_system(path)
    with system.open_output_stream(f"{place}/broken.csv") as file:
        file.write(b"\xff\xfe\x00State,Market\n")
    read, unreadable = tables.read_history_csvs(spark, path)
    return read.select("market_center", "state_name", "modal_price", F.lit(len(unreadable)).alias("unreadable"))


@check("s7_pick_file", """
SELECT 'name' AS by, CAST(o_orderkey AS VARCHAR) AS o_orderkey FROM orders WHERE o_orderpriority = (SELECT max(o_orderpriority) FROM orders)
UNION ALL SELECT 'size', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority = (
  SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY sum(length(CAST(o_orderkey AS VARCHAR)) + length(o_orderpriority) + 4) DESC, 1 LIMIT 1)""")
def _(spark, d):
    path = scratch_path(spark, "orders-files")
    sinks.write_named_csvs(V.table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), path,
                           F.concat(F.lit("orders-"), F.translate("o_orderpriority", " ", "_"), F.lit(".csv")))
    return tables.union_all([
        tables.read_csv_text(spark, tables.pick_file(spark, path, "orders-*.csv", by)).select(F.lit(by).alias("by"), "o_orderkey")
        for by in ("name", "size")])


@check("s10_by_state", "SELECT mandi_id, district, replace(replace(state, ' ', '_'), '/', '-') AS state FROM locations")
def _(spark, d):
    path = scratch_path(spark, "by-state")
    sinks.write_by_state(V.locations(spark, d), path)
    return tables.read_dataset(spark, path, ["mandi_id", "district", "state"])


@check("s11_flat", "SELECT " + cols(KEY, r6="modal_price") + " FROM panel")
def _(spark, d):
    path = scratch_path(spark, "flat")
    sinks.write_flat(V.panel(spark, d), path, by=["date", "mandi_id", "commodity"])
    return to(tables.read_dataset(spark, path), KEY, r6="modal_price")


@check("s14_daily_log", "SELECT CAST(ts AS DATE) AS log_date, event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1, 2")
def _(spark, d):
    path = scratch_path(spark, "log")
    events = V.table(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    sinks.write_prediction_log(events, path, "ts")
    log = spark.read.schema("event_id long, event_type string, ts timestamp, log_date date").json(path)
    return log.groupBy("log_date", "event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


# --- streams ------------------------------------------------------------------------------------

def event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = V.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn(
        "ts", F.col("ts").cast("timestamp"))


@check("t1_hourly_counts", """
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n
FROM events GROUP BY 1, 2, 3 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def _(spark, d):
    out = scratch_path(spark, "hourly")
    counts = jobs.hourly_counts(event_stream(spark, d), "ts", "event_type")
    jobs.write_available(counts, out, scratch_path(spark, "hourly-checkpoint")).awaitTermination()
    return spark.read.parquet(out)


@check("t2_rate_audit", """
SELECT client, ts, count(*) AS requests, max(n) AS requests_in_window, CAST(max(n) > 3 AS INTEGER) AS over_limit FROM (
  SELECT user_id AS client, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts
    RANGE BETWEEN INTERVAL 21599999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS n FROM events) GROUP BY 1, 2""")
def _(spark, d):
    events = V.table(spark, d, "events").select(F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"))
    return jobs.rate_audit(events, seconds=21600, limit=3)


@check("t2_rate_stream", """
SELECT client, ts, count(*) AS requests, max(n) AS requests_in_window, CAST(max(n) > 3 AS INTEGER) AS over_limit FROM (
  SELECT user_id AS client, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts
    RANGE BETWEEN INTERVAL 21599999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS n FROM events)
WHERE date_trunc('milliseconds', ts) <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""")
def _(spark, d):
    out = scratch_path(spark, "rates")
    events = event_stream(spark, d).select(F.col("user_id").alias("client"), "ts")
    rates = jobs.rate_stream(events, seconds=21600, limit=3, late="1 hour")
    jobs.write_available(rates, out, scratch_path(spark, "rates-checkpoint")).awaitTermination()
    return spark.read.parquet(out)


@check("t3_snapshot_stream", """
SELECT user_id, event_type, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
  ORDER BY ts DESC, event_id DESC, value DESC) AS rk FROM events) WHERE rk = 1""")
def _(spark, d):
    out, parts = scratch_path(spark, "snapshot"), scratch_path(spark, "event-files")
    columns = ["user_id", "event_type", "ts", "event_id", "value"]
    # Three files and one a batch, so that the merge with the version before runs.
    events = V.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).select(*columns)
    events.repartition(3, "event_id").write.parquet(parts)
    rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(parts)
    query = jobs.refresh_snapshot(rows, out, scratch_path(spark, "snapshot-checkpoint"), keys=("user_id", "event_type"), at="ts")
    query.awaitTermination()
    return jobs.read_snapshot(spark, out, jobs.last_version(query))
