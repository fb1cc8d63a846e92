import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from granary.functions import constants as K
from granary.operators.shape import normal_header
from granary.session import DROP_SHUFFLES, durable, scratch_path
from granary.sources import sinks, tables


def test_csv_is_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n001,2.50\n")
    assert [tuple(r) for r in tables.read_csv_text(spark, str(tmp_path / "a.csv")).collect()] == [("001", "2.50")]


def test_files_with_drifting_headers(spark, tmp_path):
    (tmp_path / "WDRA-Goa.csv").write_text("Warehouse Name,Capacity(MT)\nA,10\n")
    (tmp_path / "WDRA-Tamil Nadu.csv").write_text("wh_name,capacityin_mt\nB,20\n")
    got = tables.read_csv_by_name(spark, str(tmp_path), r"WDRA-([^./]+)\.csv", "state", K.WAREHOUSE_COLUMNS)
    assert sorted((r["state"], r["warehouse_name"], r["capacity_mt"]) for r in got.collect()) == [("Goa", "A", "10"), ("Tamil Nadu", "B", "20")]


def test_history_files_skip_the_unreadable(spark, tmp_path):
    (tmp_path / "a.csv").write_text("State,Market,Modal Price (Rs/Quintal)\nGoa,X,10\n")
    (tmp_path / "b.CSV").write_text("market_name,prices,extra\nY,20,z\n")
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_bytes(b"\xff\xfe\x00state,x\n1,2\n")
    (tmp_path / "e.csv").write_text("x" * (tables.HEADER_BYTES + 1))
    got, unreadable = tables.read_history_csvs(spark, str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in unreadable] == ["d.csv", "e.csv"]
    assert sorted((r["market_center"], r["modal_price"], r["state_name"]) for r in got.collect()) == [("X", "10", "Goa"), ("Y", "20", None)]


def test_headers_are_read_in_one_job_and_grouped(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"x-{i} a.csv").write_text(("a,b\n" if i % 2 else 'b,"a, too",b,\n') + f"{i},2,3,4\n")
    found = tables.csv_headers(spark, str(tmp_path))
    assert found.where("error is null").count() == 30 and found.select("header").distinct().count() == 2
    frames = tables._frames_by_header(spark, str(tmp_path))
    assert [f.columns for f in frames] == [["a", "b"], ["b0", "a, too", "b2", "_c3"]] and [f.count() for f in frames] == [15, 15]


def test_an_unreadable_file_fails_a_strict_read(spark, tmp_path):
    (tmp_path / "w-Goa.csv").write_bytes(b"\xff\xfe,b\n")
    with pytest.raises(OSError, match="w-Goa"):
        tables.read_csv_by_name(spark, str(tmp_path), r"w-(.+)\.csv", "state")


def test_partitioned_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("A B/C", 1), (None, 2), ("007", 3)], "state string, v int")
    sinks.write_by_state(df, str(tmp_path / "t"))
    got = tables.read_dataset(spark, str(tmp_path / "t"), ["state", "v", "missing"])
    assert sorted(((r["state"] or ""), r["v"]) for r in got.collect()) == [("", 2), ("007", 3), ("A_B-C", 1)]
    plan = got.where("state = '007'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(state" in plan
    sinks.write_by_state(df.select("v"), str(tmp_path / "u"))
    assert {r["state"] for r in tables.read_dataset(spark, str(tmp_path / "u")).collect()} == {"ALL"}


def test_flat_and_csv_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    sinks.write_flat(df, str(tmp_path / "p"))
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "p")).collect() == df.collect()
    assert [tuple(r) for r in tables.read_csv_text(spark, str(tmp_path / "c")).collect()] == [("a", "1")]


def test_optional_table(spark, tmp_path):
    empty = tables.read_optional(spark, str(tmp_path / "none"), "a string, b double")
    assert empty.dtypes == [("a", "string"), ("b", "double")] and empty.count() == 0
    spark.createDataFrame([("x",)], "a string").write.parquet(str(tmp_path / "some"))
    assert [tuple(r) for r in tables.read_optional(spark, str(tmp_path / "some"), "a string, b double").collect()] == [("x", None)]


def test_file_choice(spark, tmp_path):
    (tmp_path / "current_2024.csv").write_text("x" * 50)
    (tmp_path / "current_2025.csv").write_text("x")
    (tmp_path / "current_2026_raw.csv").write_text("x")
    assert tables.pick_file(spark, str(tmp_path), "current*.csv", exclude="raw").endswith("current_2025.csv")
    assert tables.pick_file(spark, str(tmp_path), "current*.csv", by="size").endswith("current_2024.csv")
    with pytest.raises(FileNotFoundError):
        tables.pick_file(spark, str(tmp_path), "nothing*.csv")


def test_headers_and_paths():
    assert normal_header(" Capacity (MT) ") == "capacity_mt"
    assert normal_header("Valid-Upto/Date") == "valid_upto_date"
    assert tables.lake_path("s3a://bucket/", "/gold", "prices") == "s3a://bucket/gold/prices"


def test_loan_dialects(spark):
    crop = spark.createDataFrame([tuple("1234567")], sorted(K.CROP_LOAN_COLUMNS))
    assert tables.is_crop_loan_table(crop) and not tables.is_crop_loan_table(crop.drop("season"))


def test_durable_cuts_lineage(spark):
    df = durable(spark.range(10).selectExpr("id * 2 as v"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan and df.agg({"v": "sum"}).first()[0] == 90
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_durable_leaves_no_shuffle_files(spark):
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def held():
        return {f for folder in folders for f in Path(folder).rglob("shuffle_*.data")}

    before, setting = held(), spark.conf.get(DROP_SHUFFLES, "false")
    df = durable(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    until = time.time() + 20
    while held() - before and time.time() < until:
        time.sleep(0.2)
    assert not held() - before and spark.conf.get(DROP_SHUFFLES, "false") == setting
    assert df.agg(F.sum("n")).first()[0] == 1000
