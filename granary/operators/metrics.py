"""Forecast and decision quality, profiles and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import columns as C
from granary.operators.joins import attach_scalar
from granary.operators.quantiles import exact_quantiles
from granary.session import durable

LOSSES = ("pinball_q10", "pinball_q50", "pinball_q90", "rmse", "mape")


def forecast_metrics(df: DataFrame, keys: Sequence[str], actual: str = "y", low: str = "q10",
                     middle: str = "q50", high: str = "q90") -> DataFrame:
    """Pinball per quantile, RMSE, MAPE, coverage and width of the 80% interval."""
    df = durable(df.select(*keys, *dict.fromkeys((actual, low, middle, high))), "forecasts")
    y, mid = F.col(actual), F.col(middle)
    size = F.abs(y)
    summary = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(C.pinball(actual, low, 0.1)).alias("pinball_q10"),
        F.avg(C.pinball(actual, middle, 0.5)).alias("pinball_q50"),
        F.avg(C.pinball(actual, high, 0.9)).alias("pinball_q90"),
        F.sqrt(F.avg((y - mid) * (y - mid))).alias("rmse"),
        (F.avg(F.abs(y - mid) / F.when(y.isNotNull(), F.greatest(size, F.lit(1e-6)))) * 100).alias("mape"),
        (F.avg(y.between(F.col(low), F.col(high)).cast("int")) * 100).alias("coverage_80pct"),
        F.avg(F.col(high) - F.col(low)).alias("avg_interval_width"),
    )
    middle_size = exact_quantiles(df.withColumn("_size", size), keys, "_size", {"_median": 0.5})
    joined = summary.join(middle_size, list(keys), "left") if keys else attach_scalar(summary, middle_size)
    return joined.withColumn(
        "relative_interval_width",
        F.when(F.col("_median") > 0, F.col("avg_interval_width") / F.col("_median") * 100)).drop("_median")


def lift_pct(naive: Column, model: Column) -> Column:
    return (naive - model) / C.clip(naive, low=1e-9) * 100


def add_lifts(df: DataFrame, losses: Sequence[str] = LOSSES) -> DataFrame:
    return df.withColumns({
        f"{m}_lift_pct": lift_pct(F.col(f"{m}_naive"), F.col(f"{m}_model")) for m in losses})


def calibration_status(coverage: Column | str) -> Column:
    return F.when(C.col(coverage).between(75, 85), "OK").otherwise("CALIBRATION NEEDED")


def confusion(df: DataFrame, predicted: str, actual: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts and rates of a 0/1 prediction; a rate without cases is 0."""
    p, a = F.col(predicted) == 1, F.col(actual) == 1

    def cases(condition: Column) -> Column:
        return F.coalesce(F.sum(condition.cast("long")), F.lit(0)).cast("long")

    counts = df.groupBy(*keys).agg(
        cases(p & a).alias("tp"), cases(p & ~a).alias("fp"), cases(~p & a).alias("fn"),
        cases(~p & ~a).alias("tn"), F.count("*").alias("n_samples"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rates = counts.withColumns({
        "precision": C.guarded_ratio(tp, tp + fp), "recall": C.guarded_ratio(tp, tp + fn),
        "accuracy": C.guarded_ratio(tp + tn, F.col("n_samples"))})
    return rates.withColumn("f1", C.guarded_ratio(
        F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def share_pct(condition: Column) -> Column:
    return F.avg(condition.cast("double")) * 100


def coverage_profile(df: DataFrame, key: str = "mandi_id") -> DataFrame:
    """Days and months of data per entity. Per-day rows come first, so no distinct set grows past the calendar."""
    days = df.select(key, F.col("date").cast("date").alias("date")).distinct()
    months = days.groupBy(key, C.month_start("date").alias("m")).agg(
        F.count("*").alias("days"), F.min("date").alias("lo"), F.max("date").alias("hi"))
    return months.groupBy(key).agg(
        F.count("*").alias("n_months"), F.sum("days").alias("n_days"),
        F.min("lo").alias("first_date"), F.max("hi").alias("last_date"))


def entities_per_state(df: DataFrame) -> DataFrame:
    return df.groupBy("state").agg(F.count_distinct("mandi_id").alias("n_mandis"))


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal-width counts between the smallest and largest value; the last bin is closed on both ends."""
    known = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    ends = known.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("e")).scalar()
    framed = known.withColumn("e", ends).select("v", "e.lo", "e.hi")
    width = (F.col("hi") - F.col("lo")) / bins
    index = F.least(F.floor((F.col("v") - F.col("lo")) / F.when(width > 0, width)), F.lit(bins - 1))
    counts = framed.groupBy(F.coalesce(index, F.lit(0)).cast("int").alias("bin"), "lo", "hi").agg(
        F.count("*").alias("n"))
    return counts.select(
        "bin", (F.col("lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"), "n")


def monthly_box(df: DataFrame, value: str) -> DataFrame:
    """Quartiles and extremes per calendar month."""
    months = df.withColumn("month", F.month("date"))
    ends = months.groupBy("month").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))
    return ends.join(exact_quantiles(months, ["month"], value, {"p25": 0.25, "p50": 0.5, "p75": 0.75}), "month")
