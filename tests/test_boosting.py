import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary import session
from granary.operators import trees
from granary.plans import boosting, evaluation

PARAMS = boosting.BoostParams(n_estimators=6, learning_rate=0.3, max_depth=3, subsample=0.8, rewrite_every=4)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(42)
    x = rng.uniform(0, 10, (500, 3))
    y = 2 * x[:, 0] + 0.5 * x[:, 1] + rng.normal(0, 1, 500)
    frame = pd.DataFrame({"commodity": ["A"] * 400 + ["B"] * 100, "id": range(500), "x0": x[:, 0], "x1": x[:, 1],
                          "x2": x[:, 2], "y": y})
    return spark.createDataFrame(frame)


@pytest.fixture(scope="module")
def model(data):
    return boosting.train(data, {"7d": "y"}, ["x0", "x1", "x2"], row_key=["id"], params=PARAMS)


def test_loss_falls_and_every_round_has_one(model):
    for losses in (model.training_losses(0), model.training_losses(1)):
        assert set(losses) == {("7d", 0.1), ("7d", 0.5), ("7d", 0.9)}
        for values in losses.values():
            assert len(values) == PARAMS.n_estimators and values[-1] <= values[0]


def test_predictions_are_ordered_and_follow_the_driver(data, model):
    got = boosting.predict(data, model).toPandas()
    assert (got.q10_7d <= got.q50_7d).all() and (got.q50_7d <= got.q90_7d).all()
    assert got[["x0", "q50_7d"]].corr().iloc[0, 1] > 0.8
    assert 0.6 < got.y.between(got.q10_7d, got.q90_7d).mean() < 0.95


def test_training_is_repeatable_on_other_partitions(data, model):
    again = boosting.train(data.repartition(7), {"7d": "y"}, ["x0", "x1", "x2"], row_key=["id"], params=PARAMS)
    assert (again.feature == model.feature).all() and np.allclose(again.value, model.value)


def test_spread_training_gives_the_same_trees(data, model, monkeypatch):
    monkeypatch.setattr(boosting, "TASK_ROWS", 0)
    spread = boosting.train(data.repartition(3), {"7d": "y"}, ["x0", "x1", "x2"], row_key=["id"], params=PARAMS)
    assert (spread.feature == model.feature).all() and np.allclose(spread.threshold, model.threshold)
    assert np.allclose(spread.value, model.value) and np.allclose(spread.start, model.start)
    for m in (0, 1):
        mine, theirs = spread.training_losses(m), model.training_losses(m)
        assert mine.keys() == theirs.keys() and all(np.allclose(mine[k], theirs[k]) for k in mine)


def test_spread_training_is_exact_however_many_rows(spark, monkeypatch):
    """More distinct values a leaf than a task sends: start, cuts and leaves are those of a task, to the last bit."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 12, (60_000, 3)).astype(float)
    y = x[:, 0] * x[:, 1] + rng.normal(0, 4, 60_000)
    y[::40], y[::17] = 7.0, np.nan
    frame = pd.DataFrame({"commodity": "A", "id": range(60_000), "x0": x[:, 0], "x1": x[:, 1], "x2": x[:, 2], "y": y, "z": np.round(y)})
    df = spark.createDataFrame(frame).withColumn("y", F.when(~F.isnan("y"), F.col("y"))).repartition(3).cache()
    params = boosting.BoostParams(n_estimators=3, learning_rate=0.3, max_depth=2, rewrite_every=2)
    made = []
    for most in (7_000_000, 0):
        monkeypatch.setattr(boosting, "TASK_ROWS", most)
        made.append(boosting.train(df, {"7d": "y", "30d": "z"}, ["x0", "x1", "x2"], row_key=["id"], params=params))
    for name in ("start", "feature", "threshold", "value"):
        assert (getattr(made[0], name) == getattr(made[1], name)).all()
    assert np.allclose([list(r.values()) for r in made[0].losses], [[r[k] for k in made[0].losses[0]] for r in made[1].losses])


def plain_tree(x, score, y, q, least, depth):
    """(feature, cut, left, right) or a leaf value, on raw features, by trying every cut."""
    def gain(mask):
        g = np.where(y[mask] > score[mask], q, q - 1).sum()
        return g * g / mask.sum()

    best = (1e-9, None, None)
    for f in range(x.shape[1] if depth else 0):
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            if least <= left.sum() <= len(y) - least:
                gained = round(gain(left) + gain(~left) - gain(np.ones(len(y), bool)), 9)
                best = max(best, (gained, f, cut), key=lambda b: b[0])
    if best[1] is None:
        rest = np.sort(y - score)
        return rest[int(np.ceil(q * len(rest) - 1e-9)) - 1]
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], *[plain_tree(x[m], score[m], y[m], q, least, depth - 1) for m in (left, ~left)])


def tree_of(model, slot, node=1):
    f = model.feature[0, slot, 0, node]
    if f < 0:
        return model.value[0, slot, 0, node]
    return (f, model.threshold[0, slot, 0, node], tree_of(model, slot, 2 * node), tree_of(model, slot, 2 * node + 1))


def test_a_tree_equals_the_plain_one(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (400, 3)).astype(float)
    y = x[:, 0] * x[:, 1] + rng.normal(0, 4, 400)
    frame = pd.DataFrame({"commodity": "A", "id": range(400), "x0": x[:, 0], "x1": x[:, 1], "x2": x[:, 2], "y": y})
    made = boosting.train(spark.createDataFrame(frame), {"7d": "y"}, ["x0", "x1", "x2"], row_key=["id"],
                          params=boosting.BoostParams(n_estimators=1, max_depth=3, subsample=1.0))
    for slot, (_, q) in enumerate(made.slots):
        start = np.sort(y)[int(np.ceil(q * 400 - 1e-9)) - 1]

        def flat(tree):
            return [v for part in tree for v in flat(part)] if isinstance(tree, tuple) else [float(tree)]

        assert made.start[0, slot] == start
        assert np.allclose(flat(tree_of(made, slot)), flat(plain_tree(x, np.full(400, start), y, q, 10, 3)))


def test_summaries_keep_ranks():
    rng = np.random.default_rng(6)
    parts = [rng.normal(i, 1 + i, n) for i, n in enumerate([10, 5000, 20_000, 3])]
    made = [trees.summary(p, np.ones(len(p), np.int64), 200) for p in parts]
    values, weights = trees.summary(*[np.concatenate(c) for c in zip(*made)], 200)
    whole = np.sort(np.concatenate(parts))
    assert weights.sum() == len(whole) and len(values) <= 200
    for q in (0.01, 0.1, 0.5, 0.9, 1.0):
        rank = np.searchsorted(whole, trees.summary_quantile(values, weights, q), side="right") / len(whole)
        assert abs(rank - q) <= 1 / 100
    few = trees.summary(np.array([3.0, 1.0, 2.0]), np.ones(3, np.int64), 4)
    assert trees.summary_quantile(*few, 0.5) == trees.lower_quantile(np.array([3.0, 1.0, 2.0]), 0.5) == 2.0


@pytest.mark.parametrize("features, bins, depth", [(5, 32, 4), (1, 8, 3), (4, 128, 3), (3, 100, 7)])
def test_features_counted_in_pairs_give_the_histograms_of_each(features, bins, depth):
    rng = np.random.default_rng(features)
    made = (2 * rng.integers(0, bins, (features, 3000))).astype(np.uint8)
    columns, place = trees.paired(made, bins), rng.integers(0, 2 ** (depth - 1), 3000)
    assert len(columns) == (features + 1) // 2
    root = trees.RootCounts(columns, features, bins)
    up = rng.random(3000) < 0.5
    for share in (0.8, 0.2, 1.0):
        use, up = rng.random(3000) < share, up ^ (rng.random(3000) < 0.1)
        at = np.flatnonzero(use)
        plain = trees.histogram(made[:, at], place[at], up[at], 2 ** (depth - 1), bins)
        assert (trees.pair_histogram(columns, features, place[at], up[at], 2 ** (depth - 1), bins, at) == plain).all()
        assert (root(up, use) == plain.sum(axis=0)).all()


def test_every_model_and_horizon_has_a_task_of_its_own(spark):
    blocks = spark.range(7).select(F.col("id").cast("int").alias("model"), *[F.lit(b"").alias(n) for n in ("bins", "row", "time", "y_a", "y_b", "y_c")])
    pairs = boosting._in_tasks(blocks.union(blocks), [6, 1, 3, 5, 0, 2], ["a", "b", "c"], lambda t: pa.table(
        {"rows": [t.num_rows], "pairs": [len(set(zip(*[t.column(n).to_pylist() for n in ("model", "horizon")])))], "first": [t.column("model")[0].as_py()]}),
        "rows long, pairs long, first long").withColumn("task", F.spark_partition_id()).orderBy("task").collect()
    assert [(r["rows"], r["pairs"]) for r in pairs] == [(2, 1)] * 18 and [r["first"] for r in pairs[::3]] == [6, 1, 3, 5, 0, 2]


def test_model_survives_as_a_table(spark, data, model, tmp_path):
    model.table(spark).write.parquet(str(tmp_path / "model"))
    back = boosting.BoostModel.from_table(spark.read.parquet(str(tmp_path / "model")), ["commodity"])
    assert back.features == ["x0", "x1", "x2"] and back.learning_rate == PARAMS.learning_rate
    a = boosting.predict(data, model).orderBy("id").toPandas()
    b = boosting.predict(data, back).orderBy("id").toPandas()
    assert np.allclose(a.q50_7d, b.q50_7d)


def test_parts_give_the_same_predictions(data, model, monkeypatch):
    whole = boosting.predict(data, model).orderBy("id").toPandas()
    monkeypatch.setattr(boosting, "BROADCAST_LIMIT", 1)
    parts = boosting.predict(data, model).orderBy("id").toPandas()
    assert len(parts) == 500 and np.allclose(whole.q90_7d, parts.q90_7d)


def test_unknown_keys_get_nothing(data, model):
    other = data.limit(3).withColumn("commodity", F.lit("Z"))
    assert {r["q50_7d"] for r in boosting.predict(other, model).collect()} == {None}


def test_depth_zero_is_one_leaf(data):
    flat = boosting.train(data, {"7d": "y"}, ["x0"], row_key=["id"],
                          params=boosting.BoostParams(n_estimators=1, max_depth=0, quantiles=(0.5,)))
    assert (flat.feature == -1).all()
    assert boosting.predict(data, flat).groupBy("commodity").agg(F.count_distinct("q50_7d").alias("n")).where("n <> 1").count() == 0


def test_few_rows_work(data):
    small = boosting.train(data.where("id < 30"), {"7d": "y"}, ["x0", "x1"], row_key=["id"],
                           params=boosting.BoostParams(n_estimators=2, max_depth=2, min_samples_leaf=3, quantiles=(0.5,)))
    assert boosting.predict(data.where("id < 30"), small).where("q50_7d is not null").count() == 30


def test_errors(data, model):
    with pytest.raises(RuntimeError, match="not been fitted"):
        boosting.predict(data, None)
    with pytest.raises(ValueError, match="not trained"):
        boosting.predict_quantile(data, model, "7d", 0.25)


def test_search_prefers_the_better_draw(spark):
    days = pd.date_range("2024-01-01", periods=360)
    frame = pd.DataFrame({"commodity": "A", "mandi_id": "M", "date": days.date, "x0": np.arange(360) % 30, "y": (np.arange(360) % 30) * 2.0})
    df = spark.createDataFrame(frame)
    base = boosting.BoostParams(n_estimators=2, max_depth=2, min_samples_leaf=2, quantiles=(0.5,), subsample=1.0)
    ranked = boosting.random_search(df, {"7d": "y"}, {"learning_rate": [0.01, 0.9]}, 2, ["x0"], min_train_months=6,
                                    val_months=3, base=base)
    assert [p.learning_rate for p, _ in ranked] == [0.9, 0.01]


def test_search_tries_every_fold_alike_in_one_task_and_spread(spark, monkeypatch):
    rng = np.random.default_rng(9)
    days = pd.date_range("2024-01-01", periods=330)
    frame = pd.concat([pd.DataFrame({"commodity": c, "mandi_id": "M", "date": days.date, "x0": rng.uniform(0, 9, 330),
                                     "y": rng.uniform(0, 9, 330)}) for c in "AB"])
    df = spark.createDataFrame(frame)
    df = df.union(df.limit(1).withColumn("date", F.lit(None).cast("date")))  # in no fold
    draws = boosting.random_draws({"max_depth": [1, 2], "bins": [8, 16]}, 4, base=boosting.BoostParams(
        n_estimators=2, min_samples_leaf=2, quantiles=(0.5,)))
    assert len({(p.max_depth, p.bins) for p in draws}) == 4
    bounds = boosting.fold_bounds(df, 8, 2)
    assert bounds == [(2024 * 12 + 8, 2024 * 12 + 10)]
    args = (df, {"7d": "y"}, draws[:2], bounds, ["x0"])
    small = sorted(map(tuple, boosting.search_folds(*args).drop("loss").collect()))
    assert small == sorted((c, d, 1, "7d", 0.5, 244, 61) for c in "AB" for d in (0, 1))
    losses = {(r["commodity"], r["draw"]): r["loss"] for r in boosting.search_folds(*args).collect()}
    monkeypatch.setattr(boosting, "TASK_ROWS", 0)
    assert sorted(map(tuple, boosting.search_folds(*args).drop("loss").collect())) == small
    # Both ways have the same bins, made of the rows of all months.
    spread = {(r["commodity"], r["draw"]): r["loss"] for r in boosting.search_folds(*args).collect()}
    assert spread == pytest.approx(losses, rel=1e-9)


@pytest.mark.parametrize("most", [7_000_000, 0])
def test_training_and_search_leave_no_copies_of_the_rows(spark, monkeypatch, tmp_path, most):
    written = []
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    monkeypatch.setattr(boosting, "TASK_ROWS", most)
    write = session.scratch_path
    for module in (session, boosting):
        monkeypatch.setattr(module, "scratch_path", lambda s, name: written.append(name) or write(s, name))
    days = pd.date_range("2024-01-01", periods=300)
    df = spark.createDataFrame(pd.DataFrame({"commodity": "A", "mandi_id": "M", "date": days.date, "x0": np.arange(300) % 30, "y": np.arange(300) % 7.0}))
    params = boosting.BoostParams(n_estimators=3, max_depth=1, quantiles=(0.5,), rewrite_every=2)
    boosting.train(df, {"7d": "y"}, ["x0"], params=params)
    assert set(written) == {"blocks", "scored"} - ({"scored"} if most else set()) and not list(tmp_path.iterdir())
    written.clear()
    boosting.search_folds(df, {"7d": "y"}, [params], [(2024 * 12 + 5, 2024 * 12 + 7), (2024 * 12 + 7, 2024 * 12 + 9)], ["x0"]).collect()
    assert written.count("blocks") == 1 and not {x.name[:6] for x in tmp_path.iterdir()} - {"tried-"}


def test_search_in_a_task_shares_trees_and_gives_what_each_draw_gives_alone(monkeypatch):
    """Draws that differ in the number of trees alone are trained once, on views of the rows, whatever their order in blocks."""
    drawn = np.random.default_rng(3)
    blocks = []
    for n in (700, 1, 400):
        y = drawn.gamma(2.0, 100.0, n)
        y[::50] = np.nan
        blocks.append((2 * drawn.integers(0, 8, (3, n)).astype(np.uint8), drawn.integers(0, 2**60, n), drawn.integers(0, 30, n).astype(np.int32), y))
    table = pa.table({"model": pa.array([0] * 3, pa.int32()), "horizon": pa.array([0] * 3, pa.int32()), **{
        name: pa.array([b[i].tobytes() for b in blocks], pa.binary()) for i, name in enumerate(("bins", "row", "time", "y"))}})
    params = [boosting.BoostParams(n_estimators=n, max_depth=d, learning_rate=0.3, bins=8) for n, d in ((3, 2), (3, 1), (6, 2))]
    calls = []
    monkeypatch.setattr(boosting, "boost", lambda rows, *a, **k: calls.append(len(rows.y)) or trees.boost(rows, *a, **k))
    made = boosting._tried([("a",)], list(enumerate(params)), [(10, 20), (20, 40), (40, 50)], ["h"], 3, ["commodity"])(table).to_pylist()
    assert len(made) == 3 * 2 * 3 and len(calls) == 2 * 2 * 3
    bins, row, time, y = (np.concatenate(x, axis=-1) for x in zip(*blocks))
    rows = trees.Rows(bins, y, row, time).where(~np.isnan(y))
    for r in made:
        p, (until, end) = params[r["draw"]], [(10, 20), (20, 40)][r["fold"] - 1]
        past, next_ = rows.where(rows.time < until), rows.where((rows.time >= until) & (rows.time < end))
        start, *alone, _ = trees.boost(past, r["quantile"], 8, p.n_estimators, 0.3, p.max_depth, p.min_samples_leaf, p.subsample, 42)
        loss = trees.pinball(next_.y - trees.scores(next_.bins, start, 0.3, *alone), r["quantile"]).sum()
        assert (r["n_train"], r["n_val"]) == (len(past.y), len(next_.y)) and abs(r["loss"] - loss) < 1e-6 * loss


def test_report(spark):
    rng = np.random.default_rng(1)
    days = pd.date_range("2023-01-01", periods=300)
    x = rng.uniform(0, 10, 300)
    frame = pd.DataFrame({"commodity": "A", "mandi_id": "M", "date": days.date, "x0": x, "modal_price": 100 + x,
                          **{f"target_price_{h}d": 100 + 5 * x for h in (7, 15)}})
    df = spark.createDataFrame(frame)
    rows = evaluation.evaluation_rows(df, ["x0"], [7, 15])
    assert rows.groupBy().agg(F.count_if(F.col("split_7d") == "train")).first()[0] == 211
    model = evaluation.train_on_split(rows, ["x0"], [7, 15], boosting.BoostParams(n_estimators=6, learning_rate=0.5, max_depth=3))
    got = evaluation.report(evaluation.evaluate(rows, model, [7, 15])).collect()
    assert [r["horizon_d"] for r in got] == [7, 15]
    assert all(r["rmse_lift_pct"] > 0 and r["calibration"] for r in got)


def test_the_split_copies_no_rows(spark, monkeypatch):
    frame = pd.DataFrame({"commodity": "A", "mandi_id": "M", "date": pd.date_range("2023-01-01", periods=100).date, "x0": 1.0,
                          "modal_price": np.arange(100.0), "target_price_7d": 1.0})
    gold, written = session.durable(spark.createDataFrame(frame), "gold"), []
    write = session.durable
    monkeypatch.setattr(evaluation, "durable", lambda df, name: written.append((name, df.count())) or write(df, name))
    rows = evaluation.evaluation_rows(gold, ["x0"], [7], top_n=1)
    assert written == [("largest", 1), ("cuts", 1)]
    counts = {r["split_7d"]: r["count"] for r in rows.groupBy("split_7d").count().collect()}
    assert counts == {"train": 71, "val": 15, "test": 14}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "gold-" in plan and "Exchange hash" not in plan and "SortMerge" not in plan


def test_small_commodities_are_not_evaluated(spark):
    frame = pd.DataFrame({"commodity": "A", "mandi_id": "M", "date": pd.date_range("2023-01-01", periods=50).date,
                          "x0": 1.0, "modal_price": 1.0, "target_price_7d": 1.0})
    rows = evaluation.evaluation_rows(spark.createDataFrame(frame), ["x0"], [7], min_rows=200)
    assert rows.where("split_7d is not null").count() == 0


@pytest.mark.parametrize("name", ["m4_boost", "c14_evaluation"])
def test_registered_queries_train_all_trees(monkeypatch, name):
    from bindings import queries as bound

    class Reached(Exception):
        pass

    def train(*_, params=boosting.BoostParams(), **__):
        raise Reached(params.n_estimators, params.learning_rate)

    for module, part in ((bound, "stored"), (bound, "durable"), (evaluation, "evaluation_rows")):
        monkeypatch.setattr(module, part, lambda *_: None)
    monkeypatch.setattr(boosting, "train", train)
    monkeypatch.setattr(evaluation, "train_on_split", train)
    with pytest.raises(Reached) as got:
        bound.QUERIES[name](None, "")
    assert got.value.args == (200, 0.05)
