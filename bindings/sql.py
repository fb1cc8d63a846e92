"""The views of bindings/views.py as DuckDB CTEs, and intermediate results that several checks share."""

from __future__ import annotations

import re

from bindings.views import COMMODITIES, DIVISIONS, MONTH_LABELS, STATUSES


def case(key: str, values: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def clean_id(x: str) -> str:
    return f"trim(regexp_replace(upper(trim({x})), '[^A-Z0-9]+', '_', 'g'), '_')"


def km(lat1, lon1, lat2, lon2) -> str:
    a = (f"least(1e0, power(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * "
         f"cos(radians({lat2})) * power(sin((radians({lon2}) - radians({lon1})) / 2), 2))")
    return f"(12742e0 * atan2(sqrt({a}), sqrt(1e0 - {a})))"


def any_date(x: str, *formats: str) -> str:
    return "coalesce(" + ", ".join(f"try_strptime(trim({x}), '{f}')" for f in formats) + ")::DATE"


def first_row(source: str, keys: str, order: str) -> str:
    """One row per key with Spark's NULLs-first order."""
    by = ", ".join(c if " " in c.strip() else f"{c.strip()} ASC NULLS FIRST" for c in order.split(","))
    return (f"SELECT * EXCLUDE (_rk) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {by}) AS _rk "
            f"FROM {source}) WHERE _rk = 1")


COMMODITY = case("p_type", COMMODITIES)
LAT = "(6e0 + CAST(s_suppkey * 37 % 3200 AS DOUBLE) / 100e0)"
LON = "(68e0 + CAST(s_suppkey * 53 % 3000 AS DOUBLE) / 100e0)"
L_LAT, L_LON = LAT.replace("s_suppkey", "l_suppkey"), LON.replace("s_suppkey", "l_suppkey")
BOX = "latitude BETWEEN 6 AND 38 AND longitude BETWEEN 68 AND 98"
SEASON = ("CASE WHEN {m} BETWEEN 6 AND 9 THEN 'Kharif' WHEN {m} IN (4, 5) THEN 'Zaid' ELSE 'Rabi' END")
TIER = "CASE {c} WHEN 'WHEAT' THEN 0.1e0 WHEN 'RICE' THEN 0.1e0 WHEN 'TOMATO' THEN 0.9e0 WHEN 'ONION' THEN 0.9e0 " \
       "WHEN 'COTTON' THEN 0.2e0 ELSE 0.5e0 END"
DECISION = "CASE WHEN risk_score < 0.35 THEN 'APPROVE' WHEN risk_score < 0.60 THEN 'CONDITIONAL' ELSE 'REJECT' END"
LTV = ("CASE WHEN risk_score < 0.35 THEN 0.75e0 - risk_score / 0.35e0 * 0.10e0 "
       "WHEN risk_score < 0.60 THEN 0.65e0 - (risk_score - 0.35e0) / 0.25e0 * 0.15e0 "
       "ELSE 0.50e0 - (risk_score - 0.60e0) / 0.40e0 * 0.10e0 END")
SERIES = "PARTITION BY mandi_id, commodity ORDER BY date"

VIEWS: dict[str, str] = {}

VIEWS["locations"] = f"""
SELECT n_name || '_' || s_suppkey AS mandi_id, s_suppkey AS market_code, s_name AS mandi_name,
  'D' || (s_suppkey % 7) AS district, n_name AS state, {LAT} AS latitude, {LON} AS longitude
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

VIEWS["panel"] = f"""
SELECT mandi_id, state, district, {COMMODITY} AS commodity, CAST(l_shipdate AS DATE) AS date,
  max(floor(l_extendedprice)) AS modal_price, sum(l_quantity) AS arrivals_tonnes,
  any_value(latitude) AS latitude, any_value(longitude) AS longitude
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN locations ON l_suppkey = market_code
GROUP BY 1, 2, 3, 4, 5"""

VIEWS["raw_prices"] = f"""
SELECT CASE WHEN l_orderkey % 29 <> 5 THEN '  ' || lower(state) || ' ' END AS state_name,
  CAST(market_code % 25 AS VARCHAR) AS state_code, lower(district) AS district_name,
  CAST(market_code % 7 AS VARCHAR) AS district_code, mandi_name AS market_center,
  CAST(market_code AS VARCHAR) AS market_code, 'crop ' AS commodity_type, ' ' || lower({COMMODITY}) AS commodity,
  p_brand AS variety, CASE WHEN l_linenumber <> 7 THEN 'local' END AS origin,
  CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) AS min_price,
  CASE WHEN l_orderkey % 5 = 0 THEN 'x' ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) END AS max_price,
  CASE l_orderkey % 23 WHEN 0 THEN '' WHEN 1 THEN '-5' WHEN 2 THEN '1,234.50' WHEN 3 THEN '2000000'
    ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) END AS modal_price,
  CASE WHEN l_linenumber % 5 = 0 THEN strftime(l_shipdate, '%d/%m/%Y')
    WHEN l_linenumber % 5 = 1 OR l_linenumber % 5 = 4 THEN strftime(l_shipdate, '%Y-%m-%d')
    WHEN l_linenumber % 5 = 3 AND l_orderkey % 2 = 0 THEN 'n/a'
    ELSE strftime(l_shipdate, '%-d/%-m/%Y') END AS report_date,
  CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS arrivals_tonnes, 't' AS arrivals_unit, 'INR' AS price_unit,
  CAST(latitude AS VARCHAR) AS latitude, CAST(longitude AS VARCHAR) AS longitude
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN locations ON l_suppkey = market_code"""

_typed_prices = """
(SELECT upper(trim(state_name)) AS state, state_code, upper(trim(district_name)) AS district, district_code,
   upper(trim(market_center)) AS market, TRY_CAST(market_code AS BIGINT) AS market_code,
   upper(trim(commodity_type)) AS commodity_type, upper(trim(commodity)) AS commodity,
   upper(trim(variety)) AS variety, upper(trim(origin)) AS origin, TRY_CAST(min_price AS DOUBLE) AS min_price,
   TRY_CAST(max_price AS DOUBLE) AS max_price, TRY_CAST(modal_price AS DOUBLE) AS modal_price,
   TRY_CAST(arrivals_tonnes AS DOUBLE) AS arrivals_tonnes, arrivals_unit, price_unit,
   TRY_CAST(latitude AS DOUBLE) AS latitude, TRY_CAST(longitude AS DOUBLE) AS longitude,
   """ + any_date("report_date", "%d/%m/%Y", "%Y-%m-%d") + """ AS date
 FROM raw_prices)"""
VIEWS["prices"] = first_row(
    f"(SELECT * FROM {_typed_prices} WHERE date IS NOT NULL AND modal_price > 0 AND modal_price < 1000000 "
    "AND state IS NOT NULL AND commodity IS NOT NULL)",
    "date, state, district, market, commodity, variety",
    "state_code,district_code,market_code,commodity_type,origin,min_price,max_price,modal_price,"
    "arrivals_tonnes,arrivals_unit,price_unit,latitude,longitude")

VIEWS["raw_weather"] = f"""
SELECT date, CAST(CASE WHEN k % 17 = 0 THEN 99 ELSE 20 + k % 20 END AS DOUBLE) AS temperature_mean,
  CAST(CASE WHEN k % 19 = 0 THEN 60 ELSE 26 + k % 20 END AS DOUBLE) AS temperature_max,
  CAST(14 + k % 20 AS DOUBLE) AS temperature_min,
  CAST(CASE WHEN k % 13 = 0 THEN -1 WHEN k % 11 = 0 THEN NULL ELSE k % 9 END AS DOUBLE) AS precipitation_mm,
  CAST(CASE WHEN k % 23 = 0 THEN 120 ELSE 40 + k % 50 END AS DOUBLE) AS humidity,
  CAST(CASE WHEN k % 29 = 0 THEN 200 ELSE k % 30 END AS DOUBLE) AS wind_speed,
  CASE WHEN l_suppkey % 31 = 30 THEN 2.5e0 ELSE {L_LAT} END + j * 0.00001e0 AS latitude, {L_LON} AS longitude
FROM (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS date, CAST(l_linenumber % 3 AS DOUBLE) AS j,
  l_suppkey * 7 + dayofyear(l_shipdate) AS k FROM lineitem)"""

_good_weather = f"""
(SELECT date, CASE WHEN temperature_mean BETWEEN -5 AND 55 THEN temperature_mean END AS temperature_mean,
  CASE WHEN temperature_max BETWEEN -5 AND 55 THEN temperature_max END AS temperature_max,
  CASE WHEN temperature_min BETWEEN -5 AND 55 THEN temperature_min END AS temperature_min,
  CASE WHEN precipitation_mm BETWEEN 0 AND 500 THEN precipitation_mm ELSE 0 END AS precipitation_mm,
  CASE WHEN humidity BETWEEN 0 AND 100 THEN humidity END AS humidity,
  CASE WHEN wind_speed BETWEEN 0 AND 150 THEN wind_speed END AS wind_speed,
  round(latitude, 4) AS latitude, round(longitude, 4) AS longitude
 FROM raw_weather WHERE {BOX})"""
VIEWS["weather"] = "SELECT *, temperature_max - temperature_min AS temp_range FROM (" + first_row(
    _good_weather, "date, latitude, longitude",
    "temperature_mean,temperature_max,temperature_min,precipitation_mm,humidity,wind_speed") + ")"

VIEWS["raw_signal"] = """
SELECT mandi_id, CAST(market_code AS VARCHAR) AS market_code, lower(mandi_name) AS mandi_name, district,
  lower(state) AS state, latitude, longitude,
  CASE WHEN (market_code + month(m) + year(m)) % 37 = 0 THEN 'bad-date' ELSE strftime(m, '%Y-%m-%d') END AS date,
  CAST(q % 130 AS DOUBLE) / 100e0 - 0.2e0 AS ndvi
FROM (SELECT l_suppkey, date_trunc('month', l_shipdate) AS m, CAST(sum(l_quantity) AS BIGINT) AS q
      FROM lineitem GROUP BY 1, 2) JOIN locations ON l_suppkey = market_code"""
VIEWS["signal"] = """
SELECT mandi_id, CAST(market_code AS BIGINT) AS market_code, upper(trim(mandi_name)) AS mandi_name,
  upper(trim(district)) AS district, upper(trim(state)) AS state, latitude, longitude,
  try_strptime(date, '%Y-%m-%d')::DATE AS date, ndvi
FROM raw_signal WHERE try_strptime(date, '%Y-%m-%d') IS NOT NULL AND ndvi BETWEEN -0.2e0 AND 1e0"""
VIEWS["signal_daily"] = """
SELECT mandi_id, date, observed_on, ndvi, is_observed FROM (
  SELECT s.mandi_id, s.date, last_value(g.ndvi IGNORE NULLS) OVER w AS ndvi,
    last_value(g.date IGNORE NULLS) OVER w AS observed_on, CAST(g.ndvi IS NOT NULL AS INTEGER) AS is_observed
  FROM (SELECT m.mandi_id, CAST(d AS DATE) AS date FROM (SELECT DISTINCT mandi_id FROM signal) m,
        (SELECT unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM signal)) s
  LEFT JOIN signal g ON g.mandi_id = s.mandi_id AND g.date = s.date
  WINDOW w AS (PARTITION BY s.mandi_id ORDER BY s.date)) WHERE ndvi IS NOT NULL"""

VIEWS["raw_warehouses"] = """
SELECT CASE WHEN c_custkey % 41 <> 0 THEN ' ' || c_name END AS warehouse_name, 'R' || (c_custkey % 700) AS warehouse_reg_no,
  ' d' || (c_custkey % 7) || ' ' AS district,
  CASE c_custkey % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN '1,' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0')
    WHEN 2 THEN ' 250 ' ELSE CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS VARCHAR) END AS capacity_mt,
  CASE c_custkey % 5 WHEN 0 THEN strftime(d, '%d/%m/%Y') WHEN 1 THEN strftime(d, '%d-%m-%Y')
    WHEN 2 THEN strftime(d, '%Y-%m-%d') WHEN 3 THEN strftime(d, '%-d/%-m/%Y') ELSE strftime(d, '%d-%b-%Y') END AS valid_upto,
  lower(n_name) AS state
FROM (SELECT *, DATE '2020-01-01' + CAST(c_custkey % 1000 AS INTEGER) AS d FROM customer)
JOIN nation ON c_nationkey = n_nationkey"""
VIEWS["warehouses"] = first_row(
    "(SELECT upper(trim(warehouse_name)) AS warehouse_name, warehouse_reg_no, upper(trim(district)) AS district, "
    "TRY_CAST(regexp_replace(capacity_mt, '[, ]', '', 'g') AS DOUBLE) AS capacity_mt, "
    + any_date("valid_upto", "%d/%m/%Y", "%d-%m-%Y", "%Y-%m-%d", "%d-%b-%Y") + " AS valid_upto, "
    "upper(trim(state)) AS state FROM raw_warehouses WHERE warehouse_name IS NOT NULL)",
    "warehouse_reg_no, state, district", "warehouse_name,capacity_mt,valid_upto")

_loans = """
(SELECT 'L' || (o_orderkey % 12000) AS loan_id, 'NATION_' || (o_custkey % 25) AS state,
   upper(o_orderpriority) AS commodity_category, 'RABI' AS season,
   CASE WHEN o_orderkey % 50 <> 7 THEN CAST(o_orderdate AS DATE) END AS disburse_date,
   CASE WHEN o_orderkey % 60 <> 9 THEN floor(o_totalprice) END AS loan_amount_inr,
   7.5e0 + o_orderkey % 9 AS interest_rate_pct, CAST(12 * (1 + o_orderkey % 5) AS INTEGER) AS term_months,
   substr(o_orderpriority, 1, 1) AS credit_grade, CAST(50 + o_orderkey % 40 AS DOUBLE) / 100e0 AS ltv_ratio,
   CAST(o_orderstatus = 'F' AS INTEGER) AS is_default FROM orders)"""
VIEWS["crop_loans"] = first_row(
    f"(SELECT l.*, g.grade_default_rate, g.grade_loan_count FROM {_loans} l JOIN (SELECT credit_grade, "
    f"avg(is_default) AS grade_default_rate, count(is_default) AS grade_loan_count FROM {_loans} GROUP BY 1) g "
    "USING (credit_grade))", "loan_id",
    "credit_grade,state,commodity_category,season,disburse_date,loan_amount_inr,interest_rate_pct,term_months,"
    "ltv_ratio,is_default")

VIEWS["raw_cpi"] = f"""
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
  CASE WHEN o_orderkey % 3 = 0 THEN 'ALL INDIA' ELSE 'NATION_' || (o_custkey % 25) END AS state,
  upper(o_orderstatus) AS sector, upper({case("o_orderpriority", DIVISIONS)}) AS division, 'G' AS "group",
  'ITEM ' || (o_orderkey % 10) AS item, CAST(o_orderkey % 10 AS VARCHAR) AS code,
  CASE WHEN o_orderkey % 31 <> 0 THEN floor(o_totalprice / 1000e0) END AS cpi_index,
  CAST(o_orderkey % 12 AS DOUBLE) AS inflation FROM orders"""
VIEWS["cpi"] = first_row(
    "(SELECT * FROM raw_cpi WHERE division IN ('FOOD AND BEVERAGES', 'FUEL AND LIGHT', 'MISCELLANEOUS'))",
    "date, state, sector, item, code", 'division,"group",cpi_index,inflation')
VIEWS["wpi"] = """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, upper(o_orderpriority) AS commodity_name,
  substr(o_orderpriority, 1, 1) AS commodity_code,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'All' ELSE 'Group' END AS level, '1' AS weight,
  CAST(sum(floor(o_totalprice / 1000e0)) AS DOUBLE) AS wpi_index
FROM orders GROUP BY 1, 2, 3, 4"""
VIEWS["cpi_month"] = """
SELECT date AS month_start, avg(cpi_index) AS food_cpi_index FROM cpi
WHERE state = 'ALL INDIA' AND division LIKE '%FOOD%' GROUP BY 1"""
VIEWS["wpi_month"] = "SELECT date AS month_start, avg(wpi_index) AS food_wpi_index FROM wpi WHERE upper(level) = 'ALL' GROUP BY 1"
VIEWS["zones"] = """
SELECT n_name AS state, r_name AS agro_climatic_zone FROM nation JOIN region ON n_regionkey = r_regionkey
WHERE n_nationkey % 6 <> 5"""

VIEWS["series"] = f"""
SELECT *, (modal_price - price_lag_7d) / greatest(price_lag_7d, 1e-6) AS price_momentum_7d FROM (
  SELECT *, {", ".join(f"lag(modal_price, {k}) OVER w AS price_lag_{k}d" for k in (1, 7, 14, 30))},
  {", ".join(f"avg(modal_price) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS price_mean_{n}d, stddev_samp(modal_price) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS price_std_{n}d" for n in (7, 14, 30))},
  {", ".join(f"lead(modal_price, {k}) OVER w AS target_price_{k}d" for k in (7, 15, 30))},
  avg(arrivals_tonnes) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS arrivals_mean_7d
  FROM panel WINDOW w AS (PARTITION BY mandi_id, commodity ORDER BY date))"""
VIEWS["days"] = """
SELECT mandi_id, date, min(state) AS state, min(latitude) AS latitude, min(longitude) AS longitude
FROM panel GROUP BY 1, 2"""
VIEWS["grid"] = first_row(
    "(SELECT *, round(latitude, 2) AS lat2, round(longitude, 2) AS lon2 FROM weather)", "date, lat2, lon2",
    "latitude,longitude,temperature_mean,precipitation_mm,humidity,wind_speed")
VIEWS["day_weather"] = """
SELECT d.mandi_id, d.date, g.temperature_mean, g.precipitation_mm, g.humidity, g.wind_speed,
  avg(temperature_mean) OVER w AS temp_mean_7d, sum(precipitation_mm) OVER w AS precip_sum_7d,
  avg(humidity) OVER w AS humidity_mean_7d
FROM days d LEFT JOIN grid g ON g.date = d.date AND g.lat2 = round(d.latitude, 2) AND g.lon2 = round(d.longitude, 2)
WINDOW w AS (PARTITION BY d.mandi_id ORDER BY d.date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"""
VIEWS["signal_lag"] = """
SELECT mandi_id, date, ndvi, lag(ndvi, 30) OVER w AS ndvi_lag_30d, ndvi - lag(ndvi, 30) OVER w AS ndvi_delta_30d
FROM signal_daily WINDOW w AS (PARTITION BY mandi_id ORDER BY date)"""
VIEWS["baseline"] = """
SELECT mandi_id, dayofyear(date) AS doy, avg(ndvi) AS ndvi_mean, stddev_samp(ndvi) AS ndvi_std, count(ndvi) AS n_years
FROM signal WHERE date < DATE '2000-01-01' GROUP BY 1, 2"""
VIEWS["anomaly"] = """
SELECT s.mandi_id, s.date, s.ndvi, b.ndvi_mean AS ndvi_baseline_mean, b.ndvi_std AS ndvi_baseline_std,
  b.n_years AS n_baseline_years,
  (s.ndvi - b.ndvi_mean) / CASE WHEN b.ndvi_std IS NOT NULL THEN greatest(b.ndvi_std, 1e-6) END AS ndvi_anomaly,
  CAST(b.ndvi_mean IS NOT NULL AS INTEGER) AS has_anomaly
FROM signal s LEFT JOIN baseline b ON b.mandi_id = s.mandi_id AND b.doy = dayofyear(s.date)
WHERE s.date >= DATE '2000-01-01'"""
VIEWS["matched"] = """
SELECT d.mandi_id, d.state, d.date, coalesce(e.ndvi, m.v, s.v) AS modis_ndvi,
  CASE WHEN e.ndvi IS NOT NULL THEN e.ndvi_anomaly WHEN m.v IS NOT NULL THEN m.a ELSE s.a END AS ndvi_anomaly,
  CASE WHEN e.ndvi IS NOT NULL THEN 'date' WHEN m.v IS NOT NULL THEN 'month' WHEN s.v IS NOT NULL THEN 'season' END AS match_level
FROM days d LEFT JOIN anomaly e ON e.mandi_id = d.mandi_id AND e.date = d.date
LEFT JOIN (SELECT mandi_id, date_trunc('month', date) AS mo, avg(ndvi) AS v, avg(ndvi_anomaly) AS a FROM anomaly
  GROUP BY 1, 2) m ON m.mandi_id = d.mandi_id AND m.mo = date_trunc('month', d.date)
LEFT JOIN (SELECT l.state, dayofyear(date) AS doy, avg(ndvi) AS v, avg(ndvi_anomaly) AS a FROM anomaly
  JOIN locations l USING (mandi_id) GROUP BY 1, 2) s ON s.state = d.state AND s.doy = dayofyear(d.date)"""
VIEWS["day_anomaly"] = """
SELECT *, avg(ndvi_anomaly) OVER (PARTITION BY mandi_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS ndvi_anomaly_7d_avg,
  CAST(sign(ndvi_anomaly) AS DOUBLE) AS ndvi_anomaly_direction,
  CAST(coalesce(ndvi_anomaly < -1, false) AS INTEGER) AS ndvi_stress_flag,
  CAST(coalesce(ndvi_anomaly > 1, false) AS INTEGER) AS ndvi_surplus_flag
FROM matched"""
VIEWS["state_avg"] = """
SELECT state, commodity, date, avg(p) OVER (PARTITION BY state, commodity ORDER BY date
  ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS state_avg_price_7d
FROM (SELECT state, commodity, date, avg(modal_price) AS p FROM panel GROUP BY 1, 2, 3)"""
VIEWS["near5"] = f"""
SELECT * FROM (SELECT a.mandi_id, b.mandi_id AS near_id,
  round({km("a.latitude", "a.longitude", "b.latitude", "b.longitude")}, 6) AS distance_km,
  row_number() OVER (PARTITION BY a.mandi_id ORDER BY
    round({km("a.latitude", "a.longitude", "b.latitude", "b.longitude")}, 6), b.mandi_id) AS rank
  FROM locations a JOIN locations b ON a.mandi_id <> b.mandi_id) WHERE rank <= 5"""
VIEWS["near_avg"] = """
SELECT n.mandi_id, p.commodity, p.date, avg(p.modal_price) AS nearest5_mandi_avg_price
FROM near5 n JOIN panel p ON p.mandi_id = n.near_id GROUP BY 1, 2, 3"""
VIEWS["whole_risk"] = """
SELECT p.*, coalesce(total_capacity_mt, 0) AS total_capacity_mt, coalesce(n_warehouses, 0) AS n_warehouses, f.*,
  CASE commodity WHEN 'WHEAT' THEN 'Cereal' WHEN 'RICE' THEN 'Cereal' WHEN 'TOMATO' THEN 'Vegetable'
    WHEN 'ONION' THEN 'Vegetable' WHEN 'COTTON' THEN 'Fiber' ELSE 'Other' END AS commodity_category,
  mandi_std_price / greatest(mandi_mean_price, 1) AS price_cv, u.forecast_uncertainty,
  coalesce(a.ndvi_anomaly, 0) AS ndvi_anomaly, coalesce(a.ndvi_stress_flag, 0) AS ndvi_stress_flag,
  coalesce(a.ndvi_surplus_flag, 0) AS ndvi_surplus_flag
FROM (SELECT state, district, commodity, avg(modal_price) AS mandi_mean_price, stddev_samp(modal_price) AS mandi_std_price,
  count(modal_price) AS mandi_n_days FROM panel GROUP BY 1, 2, 3) p
LEFT JOIN capacity USING (state, district)
LEFT JOIN widths u USING (commodity)
LEFT JOIN state_anomaly a USING (state), portfolio f"""
VIEWS["capacity"] = """
SELECT state, district, sum(coalesce(capacity_mt, 0)) AS total_capacity_mt, count(warehouse_name) AS n_warehouses
FROM warehouses GROUP BY 1, 2"""
VIEWS["portfolio"] = "SELECT avg(is_default) AS portfolio_default_rate, avg(ltv_ratio) AS portfolio_mean_ltv FROM crop_loans"
VIEWS["bands"] = """
SELECT *, """ + ", ".join(
    f"price_mean_30d - coalesce(price_std_30d, price_mean_30d * 0.1e0) * {1.28 * (1.0 + h / 30.0 * 0.5)!r}e0 AS q10_{h}d, "
    f"price_mean_30d AS q50_{h}d, "
    f"price_mean_30d + coalesce(price_std_30d, price_mean_30d * 0.1e0) * {1.28 * (1.0 + h / 30.0 * 0.5)!r}e0 AS q90_{h}d"
    for h in (7, 15, 30)) + " FROM series"
VIEWS["widths"] = """
SELECT commodity, avg((q90_7d - q10_7d + q90_15d - q10_15d + q90_30d - q10_30d) / 3 / q50_7d) AS forecast_uncertainty
FROM bands WHERE q50_7d IS NOT NULL GROUP BY 1"""
VIEWS["state_anomaly"] = """
SELECT state, max_by(ndvi_anomaly, (date, mandi_id)) FILTER (ndvi_anomaly IS NOT NULL) AS ndvi_anomaly,
  max_by(ndvi_stress_flag, (date, mandi_id)) AS ndvi_stress_flag,
  max_by(ndvi_surplus_flag, (date, mandi_id)) AS ndvi_surplus_flag
FROM (SELECT date, mandi_id, state, ndvi_anomaly, ndvi_stress_flag, ndvi_surplus_flag FROM day_anomaly) GROUP BY 1"""
VIEWS["risk"] = """
SELECT *, greatest(0.40e0, least(0.75e0, 0.75e0 - greatest(0e0, least(0.5e0, risk_score_proxy)))) AS recommended_max_ltv
FROM (SELECT *, coalesce(price_cv, 0.1e0) * 0.4e0 + (1e0 - least(n_warehouses, 50) / 50e0) * 0.3e0
  + coalesce(portfolio_default_rate, 0.06e0) * 0.3e0 AS risk_score_proxy FROM whole_risk)"""
VIEWS["scores"] = f"""
SELECT *, {DECISION} AS decision, {LTV} AS recommended_ltv FROM (
  SELECT *, least(1e0, greatest(0e0, 0e0 + 0.25e0 * greatest(0e0, least(1e0, coalesce(price_cv, 0.1e0)))
    + 0.20e0 * greatest(0e0, least(1e0, coalesce(forecast_uncertainty, 0.3e0)))
    + 0.15e0 * (1e0 - least(n_warehouses, 5) / 5e0) + 0.10e0 * 0.5e0 + 0.20e0 * {TIER.format(c="commodity")}
    + 0.10e0 * 0.5e0)) AS risk_score FROM risk)"""
VIEWS["requests"] = f"""
SELECT CAST(event_id AS VARCHAR) AS request_id, ts, user_id AS client,
  CASE event_id % 7 {" ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(COMMODITIES.values()))} END AS commodity,
  CASE WHEN event_id % 44 = 2 THEN 'ATLANTIS' WHEN event_id % 4 <> 3 THEN state END AS state,
  CASE WHEN event_id % 4 <= 1 THEN district END AS district, CASE WHEN event_id % 4 = 0 THEN upper(mandi_name) END AS market,
  CASE WHEN (event_id % 4 = 3 AND event_id % 40 <> 39) OR event_id % 44 = 2
    THEN latitude + CAST(event_id % 50 AS DOUBLE) / 100e0 END AS latitude,
  CASE WHEN (event_id % 4 = 3 AND event_id % 40 <> 39) OR event_id % 44 = 2
    THEN longitude - CAST(event_id % 30 AS DOUBLE) / 100e0 END AS longitude,
  CAST(100 + event_id % 900 AS DOUBLE) AS quantity_kg, floor(value * 1000) AS requested_loan_amount,
  CASE event_id % 5 WHEN 0 THEN 'A' WHEN 2 THEN 'C' ELSE 'B' END AS warehouse_grade
FROM events JOIN locations ON user_id % (SELECT count(*) FROM supplier) = market_code"""
VIEWS["named"] = """
SELECT r.*, coalesce(a.id, b.id, c.id) AS named_id,
  CASE WHEN a.id IS NOT NULL THEN 'exact_match' WHEN b.id IS NOT NULL THEN 'district_fallback'
    WHEN c.id IS NOT NULL THEN 'state_fallback' ELSE 'not_found' END AS named_type
FROM requests r
LEFT JOIN (SELECT state, upper(mandi_name) AS m, min(mandi_id) AS id FROM locations GROUP BY 1, 2) a
  ON a.state = r.state AND a.m = r.market
LEFT JOIN (SELECT state, district, min(mandi_id) AS id FROM locations GROUP BY 1, 2) b
  ON b.state = r.state AND b.district = r.district
LEFT JOIN (SELECT state, min(mandi_id) AS id FROM locations GROUP BY 1) c ON c.state = r.state"""
VIEWS["resolved"] = f"""
SELECT n.* EXCLUDE (named_id, named_type), coalesce(named_id, g.mandi_id) AS mandi_id,
  CASE WHEN named_id IS NULL AND g.mandi_id IS NOT NULL THEN 'geo_nearest' ELSE named_type END AS resolution_type,
  CASE WHEN named_id IS NULL THEN round(g.km, 2) END AS mandi_distance_km
FROM named n LEFT JOIN (SELECT request_id, min_by(mandi_id, (km, mandi_id)) AS mandi_id, min(km) AS km FROM (
    SELECT request_id, l.mandi_id, round({km("q.latitude", "q.longitude", "l.latitude", "l.longitude")}, 6) AS km
    FROM named q, locations l WHERE q.named_id IS NULL AND q.latitude IS NOT NULL) GROUP BY 1) g USING (request_id)"""
VIEWS["snapshot"] = """
SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY mandi_id, commodity ORDER BY date DESC) AS rk
FROM series) WHERE rk = 1"""
VIEWS["user_days"] = """
SELECT user_id, date, CASE WHEN k % 11 = 0 THEN -999e0 ELSE top END AS t,
  CASE WHEN k % 7 = 0 THEN -999e0 ELSE CAST(n AS DOUBLE) END AS rain, CASE WHEN k % 5 <> 0 THEN low END AS hum,
  top - low AS wind, top, low
FROM (SELECT user_id, CAST(ts AS DATE) AS date, user_id + dayofyear(CAST(ts AS DATE)) AS k, max(floor(value)) AS top,
  min(floor(value)) AS low, count(*) AS n FROM events GROUP BY 1, 2, 3)"""
VIEWS["split"] = """
SELECT p.*, CASE WHEN date <= train_cut THEN 'train' WHEN date <= val_cut THEN 'val' ELSE 'test' END AS split
FROM panel p JOIN cuts USING (commodity)"""
VIEWS["cuts"] = """
SELECT commodity, min(date) FILTER (rn = CAST(floor(n * 0.70e0) AS BIGINT) + 1) AS train_cut,
  min(date) FILTER (rn = CAST(floor(n * 0.85e0) AS BIGINT) + 1) AS val_cut
FROM (SELECT commodity, date, row_number() OVER (PARTITION BY commodity ORDER BY date) AS rn,
  count(*) OVER (PARTITION BY commodity) AS n FROM panel) GROUP BY 1"""


def used(text: str, done: list[str], open_names: set[str]) -> list[str]:
    """Names of the views in the text, each after the views it needs."""
    for name, body in VIEWS.items():
        if name not in open_names and re.search(rf'(?<![\w."]){name}(?![\w"])', text):
            open_names.add(name)
            used(body, done, open_names)
            done.append(name)
    return done


def query(text: str) -> str:
    """The text with the views it names, in dependency order, each worked out once."""
    names = used(text, [], set())
    if not names:
        return text.strip()
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n].strip()})" for n in names) + "\n" + text.strip()
