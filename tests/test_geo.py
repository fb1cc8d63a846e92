import math
import random

import pytest
from pyspark.sql import functions as F

from granary.operators import geo


def km(a, b):
    la, lo, lb, lp = (math.radians(x) for x in (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def brute(points, at, k, skip=None):
    return [i for _, i in sorted((round(km(at, p), 6), i) for i, p in points.items() if i != skip)[:k]]


def table(spark, places, key="mandi_id"):
    return spark.createDataFrame([(i, *p) for i, p in places.items()], f"{key} string, latitude double, longitude double")


def check(spark, points, queries, k):
    got = geo.nearest_join(table(spark, queries, "q"), table(spark, points), k)
    found = {}
    for r in got.orderBy("q", "rank").collect():
        found.setdefault(r["q"], []).append(r["near_id"])
    for q, at in queries.items():
        assert found[q] == brute(points, at, k), q


def test_matches_brute_force_with_a_crowded_cell(spark):
    rng = random.Random(7)
    points = {f"p{i:03}": (rng.uniform(6, 38), rng.uniform(68, 98)) for i in range(80)}
    points |= {f"c{i:03}": (19 + rng.uniform(0, 0.02), 73 + rng.uniform(0, 0.02)) for i in range(60)}
    points |= {f"s{i:03}": (21.0, 75.0) for i in range(12)}
    queries = {f"q{i}": (rng.uniform(5, 40), rng.uniform(60, 100)) for i in range(40)}
    queries |= {"in": (19.01, 73.01), "on": (21.0, 75.0), "far": (-40.0, -120.0)}
    check(spark, points, queries, 5)


def test_matches_brute_force_round_the_globe(spark):
    rng = random.Random(3)
    points = {f"p{i:03}": (rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(150)}
    queries = {"east": (10.0, 179.9), "west": (10.0, -179.9), "north": (89.5, 20.0), "south": (-89.9, -100.0)}
    queries |= {f"q{i}": (rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(40)}
    check(spark, points, queries, 3)


def test_a_query_beside_a_town_meets_few_of_its_points(spark):
    rng = random.Random(8)
    town = {f"t{i:04}": (20 + rng.gauss(0, 0.02), 75 + rng.gauss(0, 0.02)) for i in range(4000)}
    village = {f"v{i}": (21 + i / 100, 76.0) for i in range(3)}
    queries = {"beside": (20.3, 75.2), "inside": (20.001, 75.001), "far": (-30.0, 10.0)}
    points = table(spark, town | village)
    asked = table(spark, queries, "q")
    met = {(r["q_lat"], r["q_lon"]): r["count"] for r in geo.nearest_candidates(asked, points, 5).groupBy("q_lat", "q_lon").count().collect()}
    assert set(met) == set(queries.values()) and all(5 <= n <= 0.05 * 4000 for n in met.values()), met
    check(spark, town | village, queries | {"opposite": (-20.5, -104.0)}, 5)


def test_what_is_staged_does_not_grow_with_the_queries_of_a_tile(spark, monkeypatch):
    rng = random.Random(11)
    points = {f"p{i:03}": (rng.uniform(10, 20), rng.uniform(70, 80)) for i in range(200)}
    queries = {f"q{i:04}": (rng.uniform(15, 15.05), rng.uniform(75, 75.05)) for i in range(1500)}
    staged, write = {}, geo.durable

    def counting(df, name="stage"):
        out = write(df, name)
        staged[name] = max(staged.get(name, 0), out.count())
        return out

    monkeypatch.setattr(geo, "durable", counting)
    got = geo.nearest_join(table(spark, queries, "q"), table(spark, points), 3)
    found = {}
    for r in got.orderBy("q", "rank").collect():
        found.setdefault(r["q"], []).append(r["near_id"])
    assert all(found[q] == brute(points, at, 3) for q, at in queries.items())
    assert max(n for name, n in staged.items() if name != "asked") <= 12 * 200, staged


def test_a_tile_of_many_queries_is_split(spark, monkeypatch):
    monkeypatch.setattr(geo, "TILE_QUERIES", 5)
    monkeypatch.setattr(geo, "TASK_CELLS", 10)
    rng = random.Random(12)
    points = {f"p{i:02}": (rng.uniform(10, 20), rng.uniform(70, 80)) for i in range(50)} | {"pole": (90.0, 0.0)}
    queries = {f"q{i:02}": (rng.uniform(14, 16), rng.uniform(74, 76)) for i in range(60)} | {"n": (90.0, 10.0), "m": (89.0, -170.0)}
    check(spark, points, queries, 4)


def test_many_points_within_a_few_metres(spark):
    rng = random.Random(9)
    points = {f"p{i:03}": (10 + rng.uniform(0, 4e-6), 70 + rng.uniform(0, 4e-6)) for i in range(200)}
    check(spark, points, {"q": (10.0, 70.0), "r": (11.0, 70.0)}, 3)


def test_no_points_and_no_queries(spark):
    some, none = table(spark, {"a": (10.0, 70.0)}), table(spark, {"a": (10.0, 70.0)}).where("false")
    assert geo.nearest(some, none, 2).collect() == [] and geo.nearest(none, some, 2).collect() == []


def test_fewer_points_than_asked(spark):
    check(spark, {"a": (10.0, 70.0), "b": (11.0, 71.0)}, {"q": (10.0, 70.5)}, 5)


def test_self_join_leaves_out_the_own_row(spark):
    rng = random.Random(5)
    points = {f"p{i:02}": (rng.uniform(10, 12), rng.uniform(70, 72)) for i in range(30)}
    points |= {f"s{i:02}": (11.0, 71.0) for i in range(9)}
    df = table(spark, points)
    found = {}
    for r in geo.nearest_join(df, df, 4, exclude_id="mandi_id").orderBy("mandi_id", "rank").collect():
        found.setdefault(r["mandi_id"], []).append((r["rank"], r["near_id"]))
    for i, at in points.items():
        assert found[i] == list(enumerate(brute(points, at, 4, i), 1))


def test_no_cross_join(spark):
    df = table(spark, {"a": (10.0, 70.0), "b": (11.0, 71.0)})
    plan = geo.nearest_join(df, df, 1)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.fixture
def places(spark):
    return spark.createDataFrame(
        [("GOA_A_1_X", "X Town", "A", "GOA", 15.0, 74.0), ("GOA_B_2_Y", "Y", "B", "GOA", 15.5, 74.2),
         ("KER_C_3_Z", "Z", "C", "KERALA", 10.0, 76.0)],
        "mandi_id string, mandi_name string, district string, state string, latitude double, longitude double")


def test_resolution_steps(spark, places):
    asked = spark.createDataFrame(
        [("1", "goa", "B", "x-town", None, None), ("2", "Goa", "b", "none", None, None), ("3", "goa", "q", None, None, None),
         ("4", "mars", None, None, 10.1, 76.1), ("5", None, None, None, 15.49, 74.2), ("6", "mars", None, None, None, None)],
        "request_id string, state string, district string, market string, latitude double, longitude double")
    got = {r["request_id"]: (r["mandi_id"], r["resolution_type"]) for r in geo.resolve(asked, places).collect()}
    assert got == {
        "1": ("GOA_A_1_X", "exact_match"), "2": ("GOA_B_2_Y", "district_fallback"), "3": ("GOA_A_1_X", "state_fallback"),
        "4": ("KER_C_3_Z", "geo_nearest"), "5": ("GOA_B_2_Y", "geo_nearest"), "6": (None, "not_found")}


def test_lookup_falls_back_to_the_state(spark):
    snapshot = spark.createDataFrame([("UTTAR%20PRADESH_L_1_L", "wheat", "Uttar Pradesh", 10.0), ("UTTAR_PRADESH_K_22_K", "Rice", "UTTAR PRADESH", 20.0)],
                                     "mandi_id string, commodity string, state string, modal_price double")
    asked = spark.createDataFrame([("1", "UTTAR_PRADESH_L_1_L", "UTTAR PRADESH", "WHEAT"), ("2", "UTTAR_PRADESH_L_1_L", "UTTAR_PRADESH", "RICE"),
                                   ("3", "UTTAR_PRADESH_L_1_L", "UTTAR PRADESH", "ONION")],
                                  "request_id string, mandi_id string, mandi_state string, commodity string")
    got = {r["request_id"]: (r["modal_price"], r["snapshot_match"]) for r in geo.snapshot_lookup(asked, snapshot, ["modal_price"]).collect()}
    assert got == {"1": (10.0, "market"), "2": (20.0, "state"), "3": (None, "none")}


def test_only_points_with_data(spark, places):
    available = places.where("mandi_id <> 'GOA_B_2_Y'").select("mandi_id")
    asked = spark.createDataFrame([(15.5, 74.2)], "latitude double, longitude double")
    assert geo.nearest_with_data(asked, places, available).select("near_id", F.round("distance_km")).first()["near_id"] == "GOA_A_1_X"


def test_neighbour_means_have_the_days_of_the_market_itself(spark):
    places = spark.createDataFrame([("A", 10.0, 70.0), ("B", 10.1, 70.0), ("C", 10.3, 70.0), ("D", 30.0, 90.0)],
                                   "mandi_id string, latitude double, longitude double")
    rows = [("A", "X", 1, 5.0), ("B", "X", 1, 7.0), ("C", "X", 1, 9.0), ("B", "X", 2, 8.0), ("B", "Y", 1, 2.0), ("C", "X", 3, None),
            ("A", "X", 3, 4.0), ("A", None, 1, 6.0), ("B", None, 1, 3.0)]
    daily = spark.createDataFrame(rows, "mandi_id string, commodity string, date int, modal_price double")
    means = {tuple(r) for r in geo.neighbour_means(daily, places, 2).collect()}
    assert means == {("A", "X", 1, 8.0), ("B", "X", 1, 7.0), ("C", "X", 1, 6.0), ("C", "X", 3, 4.0), ("A", "X", 3, None)}
    found = {tuple(r)[:3]: r["nearest5_mandi_avg_price"] for r in geo.neighbour_average(daily, places, 2).collect()}
    assert found == {(m, c, d): {m_[:3]: m_[3] for m_ in means}.get((m, c, d)) for m, c, d, _ in rows}
