import json
from datetime import date

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from granary.functions import constants as K
from granary.operators import metrics, shape
from granary.plans import features, forecast, reports, risk, scoring

DEFAULTS = dict(state="TEST", district="TEST", commodity="WHEAT", n_warehouses=2, warehouse_grade="B", price_cv=0.10,
                forecast_uncertainty=0.30)
SCHEMA = ("state string, district string, commodity string, n_warehouses int, warehouse_grade string, price_cv double, "
          "forecast_uncertainty double")


def scored(spark, *rows):
    df = spark.createDataFrame([tuple({**DEFAULTS, **r}.values()) for r in rows], SCHEMA)
    return risk.score_risk(df).collect()


def test_safe_loan_is_approved_and_risky_one_rejected(spark):
    good, bad = scored(spark, dict(price_cv=0.02, forecast_uncertainty=0.10, n_warehouses=10),
                       dict(commodity="TOMATO", price_cv=1.0, forecast_uncertainty=0.95, n_warehouses=0, warehouse_grade="C"))
    assert good["decision"] == "APPROVE" and bad["decision"] == "REJECT"
    assert good["recommended_ltv"] > bad["recommended_ltv"]


@pytest.mark.parametrize("row", [dict(price_cv=None), dict(forecast_uncertainty=None), dict(commodity="UNKNOWN_FRUIT"),
                                 dict(n_warehouses=None), dict(warehouse_grade=None)])
def test_a_score_always_exists(spark, row):
    got = scored(spark, row)[0]
    assert 0.0 <= got["risk_score"] <= 1.0


def test_missing_columns_are_neutral(spark):
    got = risk.score_risk(spark.createDataFrame([("WHEAT", "Kharif")], "commodity string, season string")).first()
    assert 0.0 <= got["risk_score"] <= 1.0


def test_weights_add_up():
    assert sum(K.RISK_WEIGHTS.values()) == pytest.approx(1.0)


@pytest.mark.parametrize("r, ltv, decision", [
    (0.0, 0.75, "APPROVE"), (0.0983, 0.7219, "APPROVE"), (0.35, 0.65, "CONDITIONAL"), (0.60, 0.50, "REJECT"), (1.0, 0.40, "REJECT")])
def test_loan_to_value_curve(spark, r, ltv, decision):
    got = spark.range(1).select(risk.recommended_ltv(F.lit(r)).alias("l"), risk.decision(F.lit(r)).alias("d")).first()
    assert got["l"] == pytest.approx(ltv, abs=1e-4) and got["d"] == decision


def test_loan_to_value_falls_with_risk(spark):
    got = spark.range(101).select((F.col("id") / 100).alias("r")).select("r", risk.recommended_ltv("r").alias("l"))
    values = [r["l"] for r in got.orderBy("r").collect()]
    assert values == sorted(values, reverse=True) and min(values) >= 0.40 and max(values) <= 0.75


def test_perishables_have_higher_tiers(spark):
    got = spark.range(1).select(*[risk.tier(F.lit(c)).alias(c) for c in ("TOMATO", "WHEAT", "ONION", "RICE", "X")]).first()
    assert got["TOMATO"] > got["WHEAT"] and got["ONION"] > got["RICE"] and got["X"] == 0.5


def test_loan_amount(spark):
    def amount(*v):
        return spark.range(1).select(risk.loan_amount(*[F.lit(x).cast("double") for x in v]).alias("a")).first()["a"]

    assert amount(1_000_000, 0.722, 2580, 500) == 931_380.0
    assert amount(1000, 0.722, 2580, 500) == 1000.0
    assert amount(None, 0.722, 2580, 500) is None and amount(1000, 0.722, 2580, 0) is None


def forecasts(spark, rows):
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], "y double, q10 double, q50 double, q90 double")


def test_interval_coverage(spark):
    full = metrics.forecast_metrics(forecasts(spark, [(y, 90, 120, 150) for y in (100, 110, 120, 130, 140)]), []).first()
    assert full["coverage_80pct"] == 100.0 and full["avg_interval_width"] == 60.0 and full["relative_interval_width"] == 50.0
    part = metrics.forecast_metrics(forecasts(spark, [(y, 90, 110, 130) for y in (80, 100, 120, 140, 160)]), []).first()
    assert part["coverage_80pct"] == 40.0


def test_point_errors(spark):
    got = metrics.forecast_metrics(forecasts(spark, [(100, 110, 110, 110), (200, 180, 180, 180)]), []).first()
    assert got["mape"] == pytest.approx(10.0) and got["rmse"] == pytest.approx(250 ** 0.5)
    assert got["pinball_q50"] == pytest.approx(7.5)


def test_confusion(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (0, 0)], "p int, a int")
    got = metrics.confusion(df, "p", "a").first()
    assert (got["tp"], got["fp"], got["fn"], got["tn"]) == (1, 1, 1, 2)
    assert got["precision"] == got["recall"] == got["f1"] == 0.5 and got["accuracy"] == 0.6
    none = metrics.confusion(df.where("p = 0 and a = 0"), "p", "a").first()
    assert none["precision"] == none["recall"] == none["f1"] == 0.0


def test_lift_and_status(spark):
    got = spark.range(1).select(metrics.lift_pct(F.lit(10.0), F.lit(8.0)).alias("l"),
                                metrics.calibration_status(F.lit(80.0)).alias("a"),
                                metrics.calibration_status(F.lit(90.0)).alias("b")).first()
    assert got["l"] == pytest.approx(20.0) and (got["a"], got["b"]) == ("OK", "CALIBRATION NEEDED")


def test_decisions_against_the_proxy_label(spark):
    df = spark.createDataFrame([("WHEAT", 0.1, 0.1), ("TOMATO", 1.0, 1.0), ("ONION", 0.9, 0.9), ("RICE", 0.05, 0.2)],
                               "commodity string, price_cv double, forecast_uncertainty double")
    got = risk.evaluate_decisions(df).first()
    assert got["tp"] + got["fp"] + got["fn"] + got["tn"] == 4 == got["n_approve"] + got["n_conditional"] + got["n_reject"]


def test_forecast_tiers(spark):
    df = spark.createDataFrame([(100.0, 10.0, None), (100.0, None, None), (None, None, None), (100.0, 10.0, 90.0)],
                               "price_mean_30d double, price_std_30d double, q50_7d double")
    df = df.withColumns({f"{q}_{h}d": F.col("q50_7d") for h in K.HORIZONS for q in ("q10", "q50", "q90")})
    got = forecast.add_forecast(df).collect()
    assert [r["forecast_method"] for r in got] == ["historical_percentile_fallback"] * 2 + ["insufficient_data", "quantile_gbm"]
    assert got[0]["forecast"]["30d"]["high"] == pytest.approx(100 + 1.28 * 10 * 1.5)
    assert got[1]["forecast"]["7d"]["low"] == pytest.approx(100 - 1.28 * 10 * (1 + 7 / 60), abs=0.01)
    assert got[2]["forecast"] is None and got[3]["forecast"]["15d"]["median"] == 90.0


def test_interval_uncertainty_skips_missing_horizons(spark):
    df = spark.createDataFrame([("W", 1.0, 3.0, None, 9.0), ("W", 0.0, 4.0, 0.0, 8.0)],
                               "commodity string, pred_q10_7d double, pred_q90_7d double, pred_q10_15d double, pred_q90_15d double")
    assert forecast.interval_uncertainty(df).first()["forecast_uncertainty"] == pytest.approx((2 + 6) / 2)


OUTLOOK = {"temperature_2m_max": [30.0] * 16, "temperature_2m_min": [20.0] * 16,
           "precipitation_sum": [5.0, 10.0, 0.0, 2.0, 8.0, 15.0, 3.0, 5.0, 4.0, 6.0, 7.0, 3.0, 2.0, 4.0, 9.0, 9.0],
           "relative_humidity_2m_max": [80.0, None] * 8}


def outlook(spark, **over):
    payload = json.dumps({"daily": {**OUTLOOK, **over}})
    return scoring.outlook(spark.createDataFrame([("1", payload)], "request_id string, payload string")).first()


def test_outlook(spark):
    got = outlook(spark)
    assert (got["forecast_temp_7d_avg"], got["forecast_precip_7d_sum"], got["forecast_precip_14d_sum"],
            got["forecast_humidity_7d_avg"]) == (25.0, 43.0, 74.0, 80.0)


def test_outlook_of_short_or_empty_arrays(spark):
    assert outlook(spark, precipitation_sum=[5.0, 10.0, 2.0])["forecast_precip_14d_sum"] == 17.0
    empty = outlook(spark, temperature_2m_max=[])
    assert [empty[c] for c in scoring.OUTLOOK] == [None] * 4
    nulls = outlook(spark, precipitation_sum=[None] * 16, temperature_2m_min=[None] * 16)
    assert nulls["forecast_precip_7d_sum"] is None and nulls["forecast_temp_7d_avg"] is None
    bad = scoring.outlook(spark.createDataFrame([("1", "not json"), ("2", None)], "request_id string, payload string"))
    assert {r["forecast_precip_7d_sum"] for r in bad.collect()} == {None}


def test_weather_history(spark):
    payload = json.dumps({"properties": {"parameter": {
        "T2M": {"20250101": 25.0, "20250102": -999.0, "20250103": 27.0}, "PRECTOTCORR": {"20250101": -999.0},
        "RH2M": {"20250101": 60.0, "20250103": 70.0}}}})
    df = spark.createDataFrame([("1", payload)], "request_id string, payload string")
    got = rows_of(shape.weather_history_rows(df), "date")
    assert [(r["date"], r["temperature_mean"], r["precipitation_mm"], r["humidity"], r["wind_speed"]) for r in got] == [
        (date(2025, 1, 1), 25.0, None, 60.0, None), (date(2025, 1, 3), 27.0, None, 70.0, None)]
    assert scoring.live_weather(df).first()["temp_mean_7d"] == 26.0


@pytest.fixture(scope="module")
def table(spark):
    rows = [("KARNATAKA", "A", "WHEAT", 0.2, "Cereal"), ("KARNATAKA", "B", "WHEAT", 0.3, "Cereal"), ("PUNJAB", "C", "WHEAT", 0.4, "Cereal"),
            ("PUNJAB", "C", "TOMATO", 0.7, "Vegetable"), ("PUNJAB", "D", "TOMATO", 0.8, "Vegetable"), ("PUNJAB", "D", "ONION", 0.1, "Vegetable")]
    df = spark.createDataFrame(rows, "state string, district string, commodity string, risk_score double, commodity_category string")
    return df.withColumns({"decision": risk.decision("risk_score"), "recommended_ltv": risk.recommended_ltv("risk_score")})


def test_scores_page(table):
    assert reports.scores(table, commodity="wheat").count() == 3
    assert reports.scores(table, decision="approve").count() == 3
    assert reports.scores(table, state="karna").count() == 2
    assert reports.scores(table, limit="2").count() == 2 and reports.scores(table, limit=-5).count() == 1
    assert reports.clamp_limit("x") == 1000 and reports.clamp_limit(10 ** 9) == 10_000


def test_score_filters_reach_the_file_scan(spark, table, tmp_path):
    table.write.parquet(str(tmp_path / "scores"))
    page = reports.scores(spark.read.parquet(str(tmp_path / "scores")), commodity="wheat")
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(commodity,WHEAT)" in plan and "commodity_category" not in plan


def test_commodity_report(table):
    got = reports.commodity_scores(table, "wheat").first()
    assert got["count"] == 3 and got["avg_risk"] == 0.3 and got["decisions"] == {"APPROVE": 2, "CONDITIONAL": 1}
    assert reports.commodity_scores(table, "nothing").count() == 0
    detail = reports.commodity_detail(table, "tomato").first()
    assert detail["categories"] == ["Vegetable"] and detail["decisions"] == {"REJECT": 2}


def test_summary(table):
    got = reports.summary(table).first()
    assert (got["total_rows"], got["total_commodities"], got["total_states"]) == (6, 3, 2)
    assert got["p10"] <= got["p25"] <= got["p50"] <= got["p75"] <= got["p90"] and got["p50"] == 0.35


def test_league_and_shares(table):
    league = reports.commodity_league(table).collect()
    assert [(r["commodity"], r["count"], r["approve_pct"]) for r in league] == [("WHEAT", 3, 66.7), ("TOMATO", 2, 0.0), ("ONION", 1, 100.0)]
    shares = {(r["decision"], r["band"]): r["share_pct"] for r in reports.decision_shares(table).collect()}
    assert shares == {("APPROVE", "LOW"): 50.0, ("CONDITIONAL", "MED"): 16.7, ("REJECT", "HIGH"): 33.3}


def test_searches(spark):
    places = spark.createDataFrame([("1", "Azadpur", "Delhi", "DELHI", 28.71234, 77.1), ("2", "Vashi", "Mumbai", "MAHARASHTRA", None, 73.0)],
                                   "mandi_id string, mandi_name string, district string, state string, latitude double, longitude double")
    assert [r[0] for r in reports.search_states(places, "ra").collect()] == ["MAHARASHTRA"]
    assert reports.search_states(places, " ").count() == 0
    assert [r["latitude"] for r in reports.search_markets(places, "azad").collect()] == [28.7123]
    assert reports.search_markets(places, "mumb", state="delhi").count() == 0


def test_requests_end_to_end(spark):
    places = spark.createDataFrame([("GOA_A_1_X", "X", "A", "GOA", 15.0, 74.0)],
                                   "mandi_id string, mandi_name string, district string, state string, latitude double, longitude double")
    snapshot = spark.createDataFrame(
        [("GOA_A_1_X", "GOA", "WHEAT", 2580.0, 2591.67, 100.0, 2591.67, 50.0, 11, 1)],
        "mandi_id string, state string, commodity string, modal_price double, price_mean_30d double, price_std_30d double, "
        "price_mean_7d double, price_std_7d double, month int, ndvi_stress_flag int")
    asked = spark.createDataFrame(
        [("1", "wheat", "goa", None, None, 500.0, 1e6, "a"), ("2", "wheat", None, 15.1, 74.1, None, 1e6, None),
         ("3", None, "goa", None, None, 1.0, 1.0, None), ("4", "wheat", "mars", None, None, 1.0, 1.0, None),
         ("5", "gold", "goa", None, None, 1.0, 1.0, None), ("6", "wheat", None, None, None, 1.0, 1.0, None)],
        "request_id string, commodity string, state string, latitude double, longitude double, quantity_kg double, "
        "requested_loan_amount double, warehouse_grade string")
    got = {r["request_id"]: r for r in scoring.score_requests(asked, places, snapshot).collect()}
    assert {k: r["status"] for k, r in got.items()} == {
        "1": "ok", "2": "ok", "3": "invalid_request", "4": "no_market", "5": "no_features", "6": "invalid_request"}
    first = got["1"]
    assert first["decision"] == "APPROVE" and first["resolution_type"] == "state_fallback" and first["recommended_loan_amount"] > 0
    assert json.loads(first["ndvi_anomaly"])["ndvi_signal"] == "STRESS"
    assert json.loads(first["explanation"])["weights"] == K.RISK_WEIGHTS
    assert got["2"]["resolution_type"] == "geo_nearest" and got["2"]["recommended_loan_amount"] is None
    assert got["4"]["decision"] is None

    live = spark.createDataFrame([("5", 25.0, None, None, None)], "request_id string, temp_mean_7d double, precip_sum_7d double, "
                                                                   "humidity_mean_7d double, wind_speed_mean_7d double")
    with_weather = {r["request_id"]: r for r in scoring.score_requests(asked, places, snapshot, weather=live).collect()}
    assert with_weather["5"]["status"] == "ok" and with_weather["5"]["forecast_method"] == "insufficient_data"

    log = scoring.prediction_log(scoring.score_requests(asked, places, snapshot), asked)
    assert log.count() == 2 and "quantity_kg" in log.first()["request"]


def test_risk_features(spark, panel):
    stores = spark.createDataFrame([("s", " d ", "10", "W1"), ("S", "D", "x", "W2"), ("S", "D", "5", None)],
                                   "state string, district string, capacity_mt string, warehouse_name string")
    loans = spark.createDataFrame([(1, 0.5), (0, 0.7)], "is_default int, ltv_ratio double")
    got = features.gold_risk(panel, stores, loans).collect()
    assert len(got) == 1
    row = got[0]
    assert (row["total_capacity_mt"], row["n_warehouses"], row["portfolio_default_rate"]) == (15.0, 2, 0.5)
    cv = row["mandi_std_price"] / row["mandi_mean_price"]
    assert row["risk_score_proxy"] == pytest.approx(0.4 * cv + 0.3 * (1 - 2 / 50) + 0.3 * 0.5)
    assert row["recommended_max_ltv"] == 0.40 or 0.40 <= row["recommended_max_ltv"] <= 0.75


def test_risk_table_reads_the_prices_once(spark, panel, monkeypatch):
    from bindings import queries as Q
    calls = []
    monkeypatch.setattr(Q.V, "panel", lambda _, d: calls.append(d) or panel)
    for name in ("raw_warehouses", "raw_crop_loans", "locations"):
        monkeypatch.setattr(Q.V, name, lambda *_: None)
    for name in ("clean_warehouses", "clean_loans"):
        monkeypatch.setattr(Q.clean, name, lambda raw: raw)
    monkeypatch.setattr(Q, "anomaly", lambda *_: panel)
    monkeypatch.setattr(Q.features, "market_anomaly", lambda *_: None)
    monkeypatch.setattr(Q.features, "gold_risk", lambda prices, *_: prices)
    assert Q.risk_table(spark, "somewhere").count() == 30 and calls == ["somewhere"]


def test_latest_state_anomaly_does_not_sort_days_by_state(spark):
    day = [date(2025, 1, d) for d in range(1, 5)]
    rows = [("A", day[0], 1.0, 1, 0), ("A", day[2], None, None, 1), ("A", day[1], 2.0, None, None), ("B", day[1], 3.0, 0, None),
            ("C", day[3], None, None, None), ("C", day[0], 4.0, 1, 1), ("X", day[3], 9.0, 9, 9),
            ("E", None, 5.0, 1, 0)]
    anomaly = spark.createDataFrame(
        rows, "mandi_id string, date date, ndvi_anomaly double, ndvi_stress_flag int, ndvi_surplus_flag int").withColumn("state", F.lit("?"))
    places = spark.createDataFrame([("A", "goa"), ("B", "Goa "), ("C", "kerala"), ("D", "delhi"), ("E", "assam")], "mandi_id string, state string")
    got = features.latest_state_anomaly(anomaly, places)
    assert {tuple(r) for r in got.collect()} == {("GOA", 3.0, 0, 1), ("KERALA", 4.0, 1, 1), ("ASSAM", 5.0, 1, 0)}
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate(keys=[mandi_id" in plan and plan.count("SortAggregate") <= 2, plan
