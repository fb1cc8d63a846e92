"""Forecast model against persistence, per commodity and horizon."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import constants as K
from granary.operators.metrics import LOSSES, add_lifts, calibration_status, forecast_metrics
from granary.operators.joins import side_by_side
from granary.operators.splits import chronological_cuts
from granary.plans.boosting import BoostModel, BoostParams, predict, train
from granary.session import durable


def top_by_rows(df: DataFrame, n: int, key: str = "commodity", counted: str = "modal_price") -> DataFrame:
    return df.groupBy(key).agg(F.count(counted).alias("n_rows")).orderBy(F.desc("n_rows"), key).limit(n)


def evaluation_rows(gold: DataFrame, features: Sequence[str] = K.FEATURES, horizons: Sequence[int] = K.HORIZONS,
                    top_n: int | None = None, min_rows: int = 1) -> DataFrame:
    """Complete rows, each with its part of the 70/15/15 split per horizon.

    All commodities by default; `top_n` keeps the largest, and a horizon with fewer rows than `min_rows` gets no split. Only the
    dates of the cuts are written: the rows are `gold` read with them, so hand in a stored table.
    """
    present = [f for f in features if f in gold.columns]
    rows = gold.dropna(subset=present)
    if top_n is not None:
        largest = durable(top_by_rows(gold, top_n).select("commodity"), "largest")
        rows = rows.join(largest, "commodity", "left_semi")
    out = rows
    for h in horizons:
        target = f"target_price_{h}d"
        known = rows.where(F.col(target).isNotNull())
        enough = known.groupBy("commodity").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_rows)
        cuts = durable(chronological_cuts(known, ["commodity"]).join(enough, "commodity").select(
            "commodity", F.col("train_cut").alias(f"_train_{h}"), F.col("val_cut").alias(f"_val_{h}")), "cuts")
        out = out.join(cuts, "commodity", "left")
        date, usable = F.col("date"), F.col(target).isNotNull()
        out = out.withColumn(
            f"split_{h}d",
            F.when(usable & (date <= F.col(f"_train_{h}")), "train")
            .when(usable & (date <= F.col(f"_val_{h}")), "val")
            .when(usable & F.col(f"_val_{h}").isNotNull(), "test"))
    return out.drop(*[f"_{part}_{h}" for part in ("train", "val") for h in horizons])


def train_on_split(rows: DataFrame, features: Sequence[str] = K.FEATURES, horizons: Sequence[int] = K.HORIZONS,
                   params: BoostParams = BoostParams()) -> BoostModel:
    """All horizons train in the same jobs; a row outside a horizon's training part has no target there."""
    masked = rows.withColumns({
        f"_y_{h}d": F.when(F.col(f"split_{h}d") == "train", F.col(f"target_price_{h}d")) for h in horizons})
    return train(masked, {f"{h}d": f"_y_{h}d" for h in horizons}, features, params=params)


def last_training_values(rows: DataFrame, horizons: Sequence[int] = K.HORIZONS, of_target: bool = False) -> DataFrame:
    """Per commodity and horizon the last price seen in training (or the last target, if asked for)."""
    made = []
    for h in horizons:
        value = f"target_price_{h}d" if of_target else "modal_price"
        at = F.when((F.col(f"split_{h}d") == "train") & F.col(value).isNotNull(), F.struct("date", "mandi_id"))
        made.append(F.max_by(value, at).alias(f"naive_{h}d"))
    return rows.groupBy("commodity").agg(*made)


def score_methods(predicted: DataFrame, horizons: Sequence[int] = K.HORIZONS) -> DataFrame:
    """Long test rows: commodity, horizon, method, y, q10, q50, q90."""
    methods = []
    for h in horizons:
        for method, (low, mid, high) in {
            "quantile_gbm": (f"q10_{h}d", f"q50_{h}d", f"q90_{h}d"),
            "naive_persistence": (f"naive_{h}d",) * 3,
        }.items():
            methods.append(F.when(F.col(f"split_{h}d") == "test", F.struct(
                F.lit(h).alias("horizon_d"), F.lit(method).alias("method"),
                F.col(f"target_price_{h}d").alias("y"), F.col(low).alias("q10"), F.col(mid).alias("q50"),
                F.col(high).alias("q90"))))
    return predicted.select("commodity", F.explode(F.array(*methods)).alias("_m")).where(
        F.col("_m").isNotNull()).select("commodity", "_m.*")


def evaluate(rows: DataFrame, model: BoostModel, horizons: Sequence[int] = K.HORIZONS,
             of_target: bool = False) -> DataFrame:
    """One row per (commodity, horizon, method) with every metric and the row counts."""
    test = rows.where(" or ".join(f"split_{h}d = 'test'" for h in horizons))
    predicted = predict(test, model).join(last_training_values(rows, horizons, of_target), "commodity", "left")
    metrics = forecast_metrics(score_methods(predicted, horizons), ["commodity", "horizon_d", "method"])
    counts = rows.groupBy("commodity").agg(*[
        F.count_if(F.col(f"split_{h}d").isin("train", "val")).alias(f"{h}") for h in horizons]).unpivot(
        ["commodity"], [f"{h}" for h in horizons], "horizon_d", "n_train").withColumn(
        "horizon_d", F.col("horizon_d").cast("int"))
    return metrics.withColumnRenamed("n", "n_test").join(counts, ["commodity", "horizon_d"])


def status(gold: DataFrame, metrics: DataFrame, horizons: Sequence[int] = K.HORIZONS) -> DataFrame:
    """Every commodity and horizon of the gold rows, and whether it was evaluated or had no rows to test on."""
    wanted = gold.groupBy("commodity").agg(F.count("*").alias("n_rows")).withColumn(
        "horizon_d", F.explode(F.array(*map(F.lit, horizons))))
    tested = metrics.groupBy("commodity", "horizon_d").agg(F.max("n_test").alias("n_test"))
    return wanted.join(tested, ["commodity", "horizon_d"], "left").withColumn(
        "status", F.when(F.col("n_test") > 0, "evaluated").otherwise("no test rows"))


def report(metrics: DataFrame) -> DataFrame:
    """Model and baseline side by side with lifts, interval coverage and its status."""
    wide = side_by_side(metrics, ["commodity", "horizon_d"], "method",
                        {"quantile_gbm": "model", "naive_persistence": "naive"},
                        [*LOSSES, "coverage_80pct", "avg_interval_width", "relative_interval_width"])
    return add_lifts(wide).withColumn("calibration", calibration_status("coverage_80pct_model")).drop(
        "coverage_80pct_naive", "avg_interval_width_naive", "relative_interval_width_naive").withColumnsRenamed({
            f"{c}_model": c for c in ("coverage_80pct", "avg_interval_width", "relative_interval_width")}).orderBy(
        "commodity", "horizon_d")
