"""All jobs in order on a small lake derived from the generated tables."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from bindings import views as V
from granary.functions import columns as C
from granary.plans import boosting, evaluation
from granary.plans.lake import JOBS, Lake


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    lake = Lake(spark, str(tmp_path_factory.mktemp("lake")))
    raw = {"prices": V.raw_prices(spark, SF).where("state_name is not null"), "signal": V.raw_signal(spark, SF),
           "loans": V.raw_crop_loans(spark, SF), "cpi": V.raw_cpi(spark, SF), "wpi": V.raw_wpi(spark, SF)}
    # The id that prices and locations build for themselves.
    raw["signal"] = raw["signal"].withColumn("mandi_id", C.market_key("state", "district", "market_code", "mandi_name"))
    raw["signal_current"] = raw["signal"].where("date >= '2000'")
    raw["signal_baseline"] = raw["signal"].where("date < '2000'")
    for name, df in raw.items():
        df.write.option("header", True).csv(lake.path("raw", name))
    V.raw_weather(spark, SF).write.parquet(lake.path("raw", "weather"))
    stores = V.raw_warehouses(spark, SF)
    for state in ("Goa", "Nation_3", "Jammu-and-Kashmir"):
        stores.drop("State").coalesce(1).toPandas().to_csv(_folder(lake, "warehouses") / f"register-{state}.csv", index=False)
    history = V.raw_prices(spark, SF).limit(20).selectExpr("state_name as State", "market_center as Market",
                                                           "commodity as Commodity", "modal_price as prices", "report_date as Date")
    history.toPandas().to_csv(_folder(lake, "prices_manual") / "a.csv", index=False)
    V.requests(spark, SF).write.parquet(lake.path("raw", "requests"))
    return lake


def _folder(lake, name):
    from pathlib import Path
    folder = Path(lake.path("raw", name))
    folder.mkdir(parents=True, exist_ok=True)
    return folder


def test_jobs_in_order(spark, lake, monkeypatch):
    quick = boosting.BoostParams(n_estimators=1, max_depth=1)
    monkeypatch.setattr(boosting.train, "__defaults__", (*boosting.train.__defaults__[:-1], quick))
    monkeypatch.setattr(evaluation.train_on_split, "__defaults__", (*evaluation.train_on_split.__defaults__[:-1], quick))
    for name in JOBS:
        JOBS[name](lake)
    gold = lake.read("gold", "price_features")
    assert gold.count() == gold.select("mandi_id", "commodity", "date").distinct().count() > 1000
    assert lake.read("serving", "snapshot").count() == gold.select("mandi_id", "commodity").distinct().count()
    assert lake.read("gold", "scores").where("decision is null or forecast_uncertainty is null").count() == 0
    assert "JAMMU-AND-KASHMIR" in {r.state for r in lake.read("silver", "warehouses").select("state").distinct().collect()}
    assert lake.read("serving", "model").select("horizon").distinct().count() == 3
    decisions = lake.read("serving", "decisions")
    assert decisions.count() == V.requests(spark, SF).count()
    logged = spark.read.json(lake.path("logs", "predictions"))
    assert logged.count() == decisions.where(F.col("status") == "ok").count()
    seen = spark.read.option("header", True).csv(lake.path("serving", "evaluation_status"))
    assert seen.select("commodity").distinct().count() == gold.select("commodity").distinct().count()
    report = spark.read.option("header", True).csv(lake.path("serving", "evaluation_report"))
    assert {"rmse_lift_pct", "calibration"} <= set(report.columns)
