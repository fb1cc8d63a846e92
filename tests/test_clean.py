from datetime import date

import pytest
from conftest import rows_of

from granary.functions import constants as K
from granary.operators import dedup, shape
from granary.plans import clean

SIGNAL = ("mandi_id string, market_code string, mandi_name string, district string, state string, latitude string, "
          "longitude string, date string, ndvi string")


def signal(spark, *pairs, market="M001"):
    return spark.createDataFrame(
        [(market, "100", "Mandi A", "Dist1", " state1", "17.5", "78.3", d, v) for d, v in pairs], SIGNAL)


@pytest.mark.parametrize("day, value, kept", [
    ("2025-01-01", "0.35", 1), ("2025-01-01", "1.5", 0), ("2025-01-01", None, 0), ("bad-date", "0.3", 0),
    ("2025-01-01", "-0.15", 1)])
def test_signal_rows_are_checked(spark, day, value, kept):
    assert clean.clean_signal(signal(spark, (day, value))).count() == kept


def test_signal_duplicates_keep_one(spark):
    got = clean.clean_signal(signal(spark, ("2025-01-01", "0.4"), ("2025-01-01", "0.3")))
    assert [(r["state"], r["ndvi"], r["market_code"]) for r in got.collect()] == [("STATE1", 0.3, 100)]


def test_daily_fill(spark):
    a = signal(spark, ("2025-01-01", "0.30"), ("2025-03-01", "0.45"), market="A")
    b = signal(spark, ("2025-01-01", "0.20"), market="B")
    daily = clean.daily_signal(clean.clean_signal(a.unionByName(b)))
    assert daily.count() == 120
    february = daily.where("mandi_id = 'A' and date between '2025-02-01' and '2025-02-28'")
    assert [r["ndvi"] for r in february.collect()] == [0.30] * 28
    assert daily.where("mandi_id = 'A' and is_observed = 1").count() == 2
    assert {r["ndvi"] for r in daily.where("mandi_id = 'B'").collect()} == {0.20}


def test_no_days_before_the_first_reading(spark):
    a = signal(spark, ("2025-01-01", "0.3"), market="A")
    b = signal(spark, ("2025-01-03", "0.2"), ("2025-01-05", "0.1"), market="B")
    daily = clean.daily_signal(clean.clean_signal(a.unionByName(b)))
    assert daily.where("mandi_id = 'B'").count() == 3
    assert daily.where("mandi_id = 'A'").count() == 5


RAW = ["state_name", "state_code", "district_name", "district_code", "market_center", "market_code", "commodity_type",
       "commodity", "variety", "origin", "min_price", "max_price", "modal_price", "report_date", "arrivals_tonnes",
       "arrivals_unit", "price_unit", "latitude", "longitude"]


def price(**over):
    row = dict(zip(RAW, [" karnataka ", "1", "d", "2", "m", "7", "t", "wheat", "v", "o", "1", "3", "2",
                         "15/01/2025", "5", "t", "r", "12.5", "77.5"]))
    return tuple({**row, **over}.values())


def test_prices(spark):
    raw = spark.createDataFrame([
        price(), price(), price(report_date="2025-01-16"), price(report_date="x"), price(modal_price="-1"),
        price(modal_price="1000000"), price(modal_price="abc"), price(state_name=None), price(commodity=None),
        price(report_date="1/2/2025", min_price="?")], ", ".join(f"{c} string" for c in RAW))
    got = rows_of(clean.clean_prices(raw), "date")
    assert [r["date"] for r in got] == [date(2025, 1, 15), date(2025, 1, 16), date(2025, 2, 1)]
    assert got[0]["state"] == "KARNATAKA" and got[0]["market_code"] == 7 and got[0]["month"] == 1
    assert got[2]["min_price"] is None


def test_weather(spark):
    cols = ("date timestamp, temperature_mean double, temperature_max double, temperature_min double, "
            "precipitation_mm double, humidity double, wind_speed double, latitude double, longitude double")
    from datetime import datetime
    at = datetime(2025, 1, 1, 6)
    raw = spark.createDataFrame([
        (at, 99.0, 30.0, 20.0, None, 120.0, 200.0, 18.50001, 73.8), (at, 25.0, 30.0, 20.0, 5.0, 60.0, 5.0, 18.5, 73.80001),
        (at, 25.0, 30.0, 20.0, 5.0, 60.0, 5.0, 2.0, 73.8), (None, 25.0, 30.0, 20.0, 5.0, 60.0, 5.0, 18.5, 73.8)], cols)
    got = clean.clean_weather(raw).collect()
    assert len(got) == 1
    assert got[0]["temperature_mean"] is None and got[0]["precipitation_mm"] == 0.0 and got[0]["temp_range"] == 10.0


def test_warehouse_headers_meet(spark):
    raw = spark.createDataFrame([("W1", "R1", "d1", "1,250", "05-Mar-2024", "ka"), ("W1", "R1", "D1 ", "9", "x", "KA"),
                                 (None, "R2", "d1", "1", "x", "KA")],
                                "`wh_name` string, `Warehouse Registration No` string, `District Name` string, "
                                "`Capacity(MT)` string, `Valid Upto` string, `State` string")
    got = clean.clean_warehouses(raw).collect()
    assert len(got) == 1 and got[0]["capacity_mt"] == 9.0 and got[0]["warehouse_reg_no"] == "R1"


def test_two_headers_of_one_column_are_merged(spark):
    df = spark.createDataFrame([("a", None), (None, "b")], "`Warehouse Name` string, wh_name string")
    got = shape.rename_by_synonym(df, K.WAREHOUSE_COLUMNS)
    assert got.columns == ["warehouse_name"] and sorted(r[0] for r in got.collect()) == ["a", "b"]


def test_wholesale_melt(spark):
    wide = spark.createDataFrame([("All", " wheat", "1", "2", "100.5", "x", "note")],
                                 "`Level` string, `Commodity Name` string, `Commodity Code` string, "
                                 "`Commodity Weight` string, `Apr-23` string, `May-23` string, `Notes` string")
    got = [tuple(r) for r in clean.clean_wholesale_index(wide).collect()]
    assert got == [(date(2023, 4, 1), "WHEAT", "1", "All", "2", 100.5)]


def test_consumer_index(spark):
    raw = spark.createDataFrame(
        [(2025, "December", " all india", "r", "Food and beverages", "g", "i", "1", "119.5", "2"),
         (2025, "Smarch", "x", "r", "Food and beverages", "g", "i", "1", "1", "2"),
         (2025, "May", "x", "r", "Housing", "g", "i", "1", "1", "2")],
        "year int, month string, state string, sector string, division string, `group` string, item string, "
        "code string, index string, inflation string")
    got = clean.clean_consumer_index(raw).collect()
    assert [(r["date"], r["state"], r["cpi_index"]) for r in got] == [(date(2025, 12, 1), "ALL INDIA", 119.5)]


def test_crop_loans(spark):
    names = ["loan_id", "state", "commodity_category", "season", "disburse_date", "loan_amount_inr", "interest_rate_pct",
             "term_months", "credit_grade", "ltv_ratio", "is_default"]
    rows = [("1", "a", "x", "y", "2025-01-01", "10", "7.5", "12", " a", "0.5", "1"),
            ("2", "a", "x", "y", "bad", "zz", "7.5", "12", "A", "0.5", "0"),
            ("2", "a", "x", "y", "bad", "zz", "7.5", "12", "A", "0.5", "0")]
    got = rows_of(clean.clean_loans(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))), "loan_id")
    assert len(got) == 2
    assert got[0]["grade_default_rate"] == pytest.approx(1 / 3) and got[0]["grade_loan_count"] == 3
    assert got[1]["loan_amount_inr"] is None and got[1]["disburse_date"] is None


def test_crop_loans_are_not_dealt_out_by_grade_alone(spark):
    names = ["loan_id", "state", "commodity_category", "season", "disburse_date", "loan_amount_inr", "interest_rate_pct",
             "term_months", "credit_grade", "ltv_ratio", "is_default"]
    rows = [(str(i // 2), "a", "x", "y", (None, "bad", "2025-01-01", "2025-01-02")[i % 4], str(i), "7.5", "12", (None, "a", "b")[i % 3],
             "0.5", str(i % 2)) for i in range(24)]
    raw = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = clean.clean_loans(raw)
        got = rows_of(made, "loan_id")
        plan = made._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "disburse_date" in plan[plan.index("SortMergeJoin"):].split("\n")[0], plan
    assert len(got) == 12 and made.columns[0] == "credit_grade"
    assert all((r["grade_default_rate"], r["grade_loan_count"]) == ((None, None) if r["credit_grade"] is None else (0.5, 8)) for r in got)


def test_consumer_loans(spark):
    raw = spark.createDataFrame(
        [("100", " 36 months", "10.5%", "a", "Charged Off", "5%"), ("100", " 60 months", "n/a", "a", "Fully Paid", "5%"),
         ("100", " 60 months", "9%", "a", "Current", "5%")],
        "loan_amnt string, term string, int_rate string, grade string, loan_status string, revol_util string")
    got = rows_of(clean.clean_loans(raw), "term_months")
    assert [(r["term_months"], r["interest_rate_pct"], r["is_default"]) for r in got] == [(36, 10.5, 1), (60, None, 0)]
    assert got[0]["grade_default_rate"] == 0.5 and got[0]["data_source"] == K.CONSUMER_LOAN_SOURCE


def test_history_takes_drifting_headers_and_locates(spark):
    raw = spark.createDataFrame(
        [("Punjab", "D1", "M1 ", "Wheat", "1,200", "15-Jan-2024"), ("Punjab", "D1", "New", "Wheat", "900", "5/2/2024"),
         ("Goa", "X", "Y", "Wheat", "-1", "5/2/2024")],
        "State string, `District Name` string, Market string, commodity string, `Modal Price (Rs/Quintal)` string, "
        "`Report Date` string")
    places = spark.createDataFrame([("P_M1", 1, "m1", "d1", "punjab", 30.0, 75.0), ("P_M2", 2, "m2", "d1", "punjab", 31.0, 76.0)],
                                   "mandi_id string, market_code long, mandi_name string, district string, state string, "
                                   "latitude double, longitude double")
    got = rows_of(clean.price_history(raw, places), "report_date")
    assert [(r["report_date"], r["mandi_id"], r["latitude"], r["modal_price"]) for r in got] == [
        ("2024-01-15", "P_M1", 30.0, 1200.0), ("2024-02-05", None, 30.0, 900.0)]


def test_location_master_rules(spark):
    good = spark.createDataFrame([("A", 10.0, 70.0), ("B", 11.0, 71.0)], "mandi_id string, latitude double, longitude double")
    dedup.require_no_violations(dedup.location_violations(good))
    bad = good.unionByName(spark.createDataFrame([("A", 50.0, 70.0), (None, None, 70.0)], good.schema))
    with pytest.raises(dedup.CheckFailed) as error:
        dedup.require_no_violations(dedup.location_violations(bad))
    for rule in ("missing_id", "duplicate_id", "missing_coordinates", "outside_box"):
        assert rule in str(error.value)


def test_audit_counts_null_as_a_value(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "a"), (2, "a"), (3, None), (4, "a"), (4, "b")], "code int, name string")
    assert sorted(r["code"] for r in dedup.inconsistent_keys(df, "code", ["name"]).collect()) == [1, 4]


def test_keep_first_limits_copies_before_the_exchange(spark):
    df = spark.createDataFrame([("k", i) for i in range(50)], "k string, v int")
    kept = dedup.keep_first(df, ["k"])
    assert kept.collect()[0]["v"] == 0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
