import pytest
from conftest import SF

import __spark_entry__ as entry
from bindings import queries as bound

PLANS = ("c1_clean_prices", "c4_warehouses", "w3_rolling", "w8_locf", "w10_zscore", "w13_split", "j3_macro_lag", "j6_cascade",
         "j7_fallback", "j12_knn", "j14_neighbour_avg", "j17_resolve_geo", "a12_percentiles", "a14_metrics", "a15_confusion",
         "q3_summary", "q10_decision_shares", "c11_gold", "c12_risk", "c15_scoring", "t2_rate_audit")
#: Queries over tables that are stored once a session: the plans that build these.
STORED = {"c11_gold": bound.gold, "q3_summary": bound.risk_table, "q10_decision_shares": bound.risk_table}


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    own = {n for n in entry.queries() if n != "pipeline" and not n.startswith("op")}  # without the optional corpus queries
    assert own <= set(entry.oracle_sql())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == entry.entry(spark).columns


@pytest.mark.parametrize("name", PLANS)
def test_plans_have_no_cross_join_and_no_python(spark, name):
    build = STORED.get(name, entry.queries()[name])
    plan = build(spark, SF)._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow"):
        assert node not in plan


def test_scans_read_only_the_needed_columns(spark):
    plan = entry.queries()["w1_lags"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan and "p_retailprice" not in plan


@pytest.mark.parametrize("name", ["w11_snapshot", "j12_knn", "c12_risk"])
def test_results_do_not_depend_on_partitions(spark, name):
    def rows():
        return sorted(map(str, entry.queries()[name](spark, SF).collect()))

    before = spark.conf.get("spark.sql.shuffle.partitions")
    one = rows()
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        assert rows() == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
