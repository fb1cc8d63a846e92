import re
from datetime import date, datetime, timedelta

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from granary import session
from granary.operators import joins, quantiles, splits, windows
from granary.operators.quantiles import exact_quantiles
from granary.plans import features
from granary.session import durable


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lags_and_rolling_see_only_the_past(panel):
    got = rows_of(windows.price_features(panel).where("mandi_id = 'M0'"), "date")
    assert [r["price_lag_1d"] for r in got[:3]] == [None, 100.0, 102.0]
    assert got[0]["price_mean_7d"] is None and got[1]["price_mean_7d"] == 100.0 and got[1]["price_std_7d"] is None
    assert got[9]["price_mean_7d"] == pytest.approx(sum(100 + 2 * i for i in range(2, 9)) / 7)
    assert got[9]["price_momentum_7d"] == pytest.approx((118 - 104) / 104)
    assert got[2]["target_price_7d"] == 118.0 and got[3]["target_price_7d"] is None
    assert got[1]["arrivals_mean_7d"] == 10.0


def test_series_do_not_mix(panel):
    changed = panel.withColumn("modal_price", F.when(F.col("mandi_id") == "M1", 9.0).otherwise(F.col("modal_price")))
    one = rows_of(windows.price_features(panel).where("mandi_id <> 'M1'"), "mandi_id", "date")
    two = rows_of(windows.price_features(changed).where("mandi_id <> 'M1'"), "mandi_id", "date")
    assert one == two


def test_all_series_features_share_one_exchange(panel):
    plan = plan_of(windows.price_features(panel.repartition(3)))
    assert plan.count("Exchange hashpartitioning(mandi_id") == 1
    assert plan.count("Window [") == 1
    assert "Python" not in plan


def test_calendar_mode_counts_days(spark):
    rows = [("M", "W", date(2025, 1, d), float(d), 1.0) for d in (1, 2, 8, 9)]
    df = spark.createDataFrame(rows, "mandi_id string, commodity string, date date, modal_price double, arrivals_tonnes double")
    got = rows_of(windows.price_features(df, calendar=True), "date")
    assert [r["price_lag_7d"] for r in got] == [None, None, 1.0, 2.0]
    assert [r["price_lag_1d"] for r in got] == [None, 1.0, None, 8.0]
    assert got[2]["price_mean_7d"] == 1.5 and got[0]["target_price_7d"] == 8.0


def test_daily_grain_averages_varieties(spark):
    df = spark.createDataFrame([("M", "W", date(2025, 1, 1), 10.0, 1.0), ("M", "W", date(2025, 1, 1), 20.0, 2.0)],
                               "mandi_id string, commodity string, date date, modal_price double, arrivals_tonnes double")
    assert [tuple(r) for r in windows.to_daily(df).collect()] == [("M", "W", date(2025, 1, 1), 15.0, 3.0)]


def test_weather_join_and_roll(panel, weather_grid):
    joined = features.market_weather(features.market_days(panel), weather_grid)
    assert joined.count() == 30
    got = rows_of(joined.where("mandi_id = 'M0'"), "date")
    assert got[0]["temp_mean_7d"] is None and got[0]["temperature_mean"] == 25.0
    assert got[9]["precip_sum_7d"] == 14.0 and got[9]["humidity_mean_7d"] == 60.0


def test_published_index_is_last_months(panel, macro):
    cpi, wpi = macro
    got = joins.join_published_index(panel, joins.consumer_price_index(cpi), joins.wholesale_price_index(wpi))
    assert got.count() == panel.count()
    assert {(r["food_cpi_index"], r["food_wpi_index"]) for r in got.collect()} == {(119.0, 109.0)}


def test_index_falls_back_to_all_rows(spark, macro):
    cpi, _ = macro
    other = cpi.withColumn("state", F.lit("GOA"))
    assert joins.consumer_price_index(other).count() == 4


def test_missing_anomaly_table_gives_typed_nulls(panel):
    got = features.join_anomaly(panel, None)
    assert dict(got.dtypes)["ndvi_anomaly"] == "double" and dict(got.dtypes)["ndvi_stress_flag"] == "int"
    assert got.where("ndvi_anomaly is not null").count() == 0


def test_repeated_anomaly_days_do_not_add_rows(spark, panel):
    rows = [("M0", date(2025, 1, 1), 0.5, 1.0, 1.0, 1.0, 0, 0)] * 2
    anomaly = spark.createDataFrame(rows, "mandi_id string, date date, modis_ndvi double, ndvi_anomaly double, "
                                          "ndvi_anomaly_7d_avg double, ndvi_anomaly_direction double, "
                                          "ndvi_stress_flag int, ndvi_surplus_flag int")
    assert features.join_anomaly(panel, anomaly).count() == panel.count()


def test_anomaly_needs_a_baseline(spark):
    base = spark.createDataFrame([("M", date(2021, 2, 1), 0.2), ("M", date(2022, 2, 1), 0.4)], "mandi_id string, date date, ndvi double")
    now = spark.createDataFrame([("M", date(2025, 2, 1), 0.5), ("M", date(2025, 3, 1), 0.5)], base.schema)
    got = rows_of(joins.signal_anomaly(now, base), "date")
    assert got[0]["ndvi_anomaly"] == pytest.approx((0.5 - 0.3) / 0.1414213562) and got[0]["has_anomaly"] == 1
    assert got[1]["ndvi_anomaly"] is None and got[1]["has_anomaly"] == 0


def fallback_inputs(spark):
    keys = spark.createDataFrame([("A", "S T", date(2025, 2, 1)), ("A", "S T", date(2025, 2, 9)),
                                  ("B", "S T", date(2024, 2, 1)), ("B", "S T", date(2024, 7, 7))],
                                 "mandi_id string, state string, date date")
    signal = spark.createDataFrame([("A", date(2025, 2, 1), 0.5, 1.0)], "mandi_id string, date date, ndvi double, ndvi_anomaly double")
    places = spark.createDataFrame([("A", "S_T")], "mandi_id string, state string")
    return keys, signal, places


def test_fallback_levels(spark):
    got = rows_of(joins.fallback_signal(*fallback_inputs(spark)), "date")
    assert [r["match_level"] for r in got] == ["season", None, "date", "month"]


def test_fallback_gate_stops_early(spark):
    got = rows_of(joins.fallback_signal(*fallback_inputs(spark), gate=0.2), "date")
    assert [r["match_level"] for r in got] == [None, None, "date", None]


def test_zone_join_without_zones(spark, panel):
    empty = spark.createDataFrame([], "state string, zone_name string")
    got = joins.join_zone(panel, empty)
    assert got.count() == panel.count() and got.where("agro_climatic_zone is not null").count() == 0


def test_scalar_needs_no_join(spark, panel):
    one = panel.agg(F.max("modal_price").alias("top"), F.count("*").alias("n"))
    got = joins.attach_scalar(panel.select("mandi_id"), one)
    assert {(r["top"], r["n"]) for r in got.collect()} == {(120.0, 30)}
    assert "Join" not in plan_of(got)


@pytest.mark.parametrize("keys", [[], ["g"]])
@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_quantiles_are_exact_for_a_hot_group(spark, keys, accuracy):
    rows = [("hot", float((i * 7919) % 1500)) for i in range(3000)] + [(f"g{i}", float(i)) for i in range(20)] + [("hot", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    wanted = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    got = exact_quantiles(df, keys, "v", wanted, accuracy)
    expected = df.where("v is not null").groupBy(*keys).agg(*[F.percentile("v", q).alias(n) for n, q in wanted.items()])
    for a, b in zip(rows_of(got, *keys or [F.lit(1)]), rows_of(expected, *keys or [F.lit(1)])):
        assert a == pytest.approx(b)


def test_twelve_months_make_six_folds(spark):
    months = [(date(2025, m, 1),) for m in range(1, 13)]
    df = spark.createDataFrame(months, "date date")
    folds = splits.walk_forward_folds(df, 6, 1)
    got = rows_of(splits.assign_folds(df, folds).groupBy("fold").agg(
        F.max(F.when(F.col("role") == "train", F.col("date"))).alias("t"),
        F.min(F.when(F.col("role") == "val", F.col("date"))).alias("v"),
        F.count_if(F.col("role") == "train").alias("n")), "fold")
    assert [r["n"] for r in got] == [6, 7, 8, 9, 10, 11]
    assert all(r["t"] < r["v"] for r in got)


def test_too_few_months_make_no_folds(spark):
    df = spark.createDataFrame([(date(2025, m, 1),) for m in range(1, 5)], "date date")
    assert splits.walk_forward_folds(df, 6, 1).count() == 0


def test_split_keeps_dates_together(spark):
    rows = [("W", date(2025, 1, 1) + timedelta(days=i // 3)) for i in range(30)]
    got = splits.chronological_split(spark.createDataFrame(rows, "commodity string, date date"), ["commodity"])
    parts = {r["date"]: r["split"] for r in got.collect()}
    assert len(parts) == 10 and got.groupBy("date").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert parts[date(2025, 1, 8)] == "train" and parts[date(2025, 1, 9)] == "val" and parts[date(2025, 1, 10)] == "test"


def test_persistence(spark):
    train = spark.createDataFrame([("W", "A", date(2025, 1, i + 1), p) for i, p in enumerate([100.0, 102.0, 105.0, 103.0, 108.0])],
                                  "commodity string, mandi_id string, date date, modal_price double")
    test = spark.createDataFrame([("W", 1), ("X", 2)], "commodity string, y int")
    got = {r["commodity"]: r["naive_price"] for r in splits.persistence(train, test, ["commodity"]).collect()}
    assert got == {"W": 108.0, "X": None}


def test_snapshot(panel):
    got = features.serving_snapshot(windows.price_features(panel))
    assert got.count() == 3 and not [c for c in got.columns if c.startswith("target_price_")]
    assert {r["date"] for r in got.collect()} == {date(2025, 1, 10)}


def test_latest_known_value_per_column(spark):
    rows = [("A", date(2025, 1, 1), 1.0, 1, 0), ("A", date(2025, 1, 2), None, 0, 0)]
    anomaly = spark.createDataFrame(rows, "mandi_id string, date date, ndvi_anomaly double, ndvi_stress_flag int, ndvi_surplus_flag int")
    places = spark.createDataFrame([("A", "goa")], "mandi_id string, state string")
    got = features.latest_state_anomaly(anomaly, places).collect()
    assert [tuple(r) for r in got] == [("GOA", 1.0, 0, 0)]


def test_gold_table_keeps_the_panel(spark, panel, weather_grid, macro):
    cpi, wpi = macro
    signal = spark.createDataFrame([("M0", date(2025, 1, 1), 0.3)], "mandi_id string, date date, ndvi double")
    gold = features.gold_prices(panel, weather_grid, windows.fill_daily(signal), cpi, wpi)
    assert gold.count() == panel.count()
    row = gold.where("mandi_id = 'M0' and date = '2025-01-10'").first()
    assert row["nearest5_mandi_avg_price"] == pytest.approx(119.5)
    assert row["state_avg_price_7d"] == pytest.approx(sum(101 + 2 * i for i in range(2, 9)) / 7)
    assert len(gold.columns) >= 42


def test_gold_rows_are_exchanged_once_when_all_columns_are_on_them(spark, panel, weather_grid, macro):
    cpi, wpi = macro
    signal = spark.createDataFrame([("M0", date(2025, 1, 1), 0.3)], "mandi_id string, date date, ndvi double")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(features.gold_prices(panel, weather_grid, windows.fill_daily(signal), cpi, wpi))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    lines = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "mandi_id" in x]
    assert len(lines) == 1 and "commodity" in lines[0]


@pytest.mark.parametrize("few", [10_000, 0])
def test_quantiles_of_few_groups_are_not_dealt_out_by_group(spark, monkeypatch, few):
    staged = {}

    def watched(df, name):
        staged[name] = df._jdf.queryExecution().toString()
        return durable(df, name)

    monkeypatch.setattr(quantiles, "durable", watched)
    monkeypatch.setattr(quantiles, "FEW_GROUPS", few)
    monkeypatch.setattr(quantiles, "SPREAD", 4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(3000).select((F.col("id") % 2).alias("k"), (F.col("id") * 7919 % 1009).cast("double").alias("v"))
        got = {r["k"]: r["m"] for r in exact_quantiles(df, ["k"], "v", {"m": 0.5}, 10).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == {r["k"]: r["m"] for r in df.groupBy("k").agg(F.percentile("v", 0.5).alias("m")).collect()}
    plan = staged["ranges"]
    assert "_share" in plan if few == 0 else "SortMergeJoin" not in plan


def test_rows_of_a_large_group_are_spread_over_its_days(spark):
    day = date(2025, 1, 1)
    rows = [("WHEAT", day + timedelta(days=i), f"M{i}", float(i)) for i in range(10)] + [
        ("WHEAT", None, "M10", 10.0), (None, day, "M11", 11.0), ("RICE", day, "M12", None)]
    df = spark.createDataFrame(rows, "commodity string, date date, mandi_id string, v double")
    stats = df.groupBy("commodity").agg(F.count("v").alias("_n"), F.avg("v").alias("_mean"))
    got = joins.by_group_and(df, stats, ["commodity"], "date", "left")
    plain = joins.attach_group_stats(df, ["commodity"], _n=F.count("v"), _mean=F.avg("v"))
    assert got.columns == plain.columns and rows_of(got, "mandi_id") == rows_of(plain, "mandi_id")
    split = {r["mandi_id"]: r["split"] for r in splits.chronological_split(df, ["commodity"]).collect()}
    assert len(split) == 12 and split["M0"] == "train" and split["M9"] == split["M10"] == "test"
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for made in (joins.by_group_and(df, stats, ["commodity"], "date", "left"),
                     splits.chronological_split(df, ["commodity"])):
            plan = plan_of(made)
            assert "date" in plan[plan.index("SortMergeJoin"):].split("\n")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_unfolded_readings_are_never_broadcast(spark, panel):
    seen = spark.createDataFrame([("M0", date(2024, 12, 1), 0.5), ("M1", date(2025, 1, 9), 0.6)],
                                 "mandi_id string, date date, ndvi double")
    daily = windows.signal_delta(windows.fill_daily(durable(seen)))
    plan = plan_of(features.join_market_days(panel, daily))
    assert "Broadcast" not in plan.replace("BroadcastQuery", "") and "SortMergeJoin" in plan


def test_snapshot_sorts_whole_rows_only_where_the_latest_date_repeats(spark):
    rows = [("A", "X", d, p) for d, p in (("2024-01-01", 9.0), ("2024-01-03", 5.0), ("2024-01-03", 4.0), ("2024-01-02", 1.0), (None, 0.5))]
    rows += [("B", "X", None, 3.0), ("B", "X", None, 2.0), ("C", None, "2024-01-01", 7.0), (None, "X", "2024-01-05", 6.0), ("C", None, "2024-01-01", 8.0)]
    gold = spark.createDataFrame(rows, "mandi_id string, commodity string, date string, modal_price double").withColumn(
        "date", F.col("date").cast("date")).withColumn("target_price_7d", F.lit(1.0))
    made = features.serving_snapshot(gold)
    assert made.columns == ["mandi_id", "commodity", "date", "modal_price"]
    assert {(m, c, d and str(d), p) for m, c, d, p in made.collect()} == {
        ("A", "X", "2024-01-03", 4.0), ("B", "X", None, 2.0), ("C", None, "2024-01-01", 7.0), (None, "X", "2024-01-05", 6.0)}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "_after" in plan and plan.index("row_number") < plan.index("_after")


def task_sizes(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect())


def test_market_days_are_dealt_out_by_their_number(spark, panel, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 2)
    twice = panel.union(panel.withColumn("commodity", F.lit("RICE")))
    days = features.market_days(twice, 60)
    assert rows_of(days, "mandi_id", "date") == rows_of(features.market_days(twice), "mandi_id", "date")
    sizes = task_sizes(days)
    assert sum(sizes) == 30 and len(sizes) > 8 and max(sizes) <= 6, sizes


def test_sales_are_dealt_out_by_their_number(spark, tmp_path, monkeypatch):
    from bindings import views
    monkeypatch.setattr(session, "ROWS_A_TASK", 2)
    day = datetime(2025, 1, 1)
    sales = [(i % 3 if i % 20 else None, i % 2, day + timedelta(days=i % 10) if i % 19 else None, float(i), 100.0 + i) for i in range(60)]
    for name, rows, schema in (
            ("lineitem", sales + sales, "l_suppkey bigint, l_partkey bigint, l_shipdate timestamp, l_quantity double, l_extendedprice double"),
            ("part", [(0, "ECONOMY"), (1, "PROMO")], "p_partkey bigint, p_type string"),
            ("supplier", [(k, f"S{k}", 0) for k in range(3)], "s_suppkey bigint, s_name string, s_nationkey bigint"),
            ("nation", [(0, "GOA")], "n_nationkey bigint, n_name string")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    made = views.panel(spark, str(tmp_path))
    want = {}
    for s, p, at, quantity, price in sales:
        if s is not None:
            key = (f"GOA_{s}", ("WHEAT", "ONION")[p], at and at.date())
            want[key] = (max(want.get(key, (0, 0))[0], price), want.get(key, (0, 0))[1] + 2 * quantity)
    got = {(r["mandi_id"], r["commodity"], r["date"]): (r["modal_price"], r["arrivals_tonnes"]) for r in made.collect()}
    assert got == want and made.count() == len(want)
    plan = plan_of(made)
    assert re.search(r"hashpartitioning\(l_suppkey#\d+L, date#\d+, 60\), REPARTITION_BY_NUM", plan), plan
