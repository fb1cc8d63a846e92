"""Forecast bands without a model, and their assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import columns as C
from granary.functions import constants as K


def band_from_history(horizon: int, mean: Column | str = "price_mean_30d",
                      std: Column | str = "price_std_30d") -> dict[str, Column]:
    """80% band around the recent mean, wider for longer horizons; a tenth of the mean stands in for no spread."""
    middle = C.col(mean)
    spread = F.coalesce(C.col(std), middle * 0.1) * F.lit(1.28 * (1.0 + horizon / 30.0 * 0.5))
    return {"low": middle - spread, "median": middle, "high": middle + spread}


def add_forecast(df: DataFrame, horizons: Sequence[int] = K.HORIZONS, has_model: Column | None = None) -> DataFrame:
    """Model quantiles where all horizons have one, else the historical band, else nothing.

    Model columns are q10_<h>d, q50_<h>d, q90_<h>d. The result is a map horizon -> (low, median, high).
    """
    modeled = has_model
    if modeled is None:
        modeled = F.lit(True)
        for h in horizons:
            modeled = modeled & (F.col(f"q50_{h}d").isNotNull() if f"q50_{h}d" in df.columns else F.lit(False))
    historical = F.col("price_mean_30d").isNotNull()
    entries = []
    for h in horizons:
        past = band_from_history(h)
        model = {"low": f"q10_{h}d", "median": f"q50_{h}d", "high": f"q90_{h}d"}

        def side(name: str) -> Column:
            own = F.col(model[name]) if model[name] in df.columns else F.lit(None).cast("double")
            return F.round(F.when(modeled, own).otherwise(past[name]), 2).alias(name)

        entries += [F.lit(f"{h}d"), F.struct(side("low"), side("median"), side("high"))]
    method = (F.when(modeled, "quantile_gbm").when(historical, "historical_percentile_fallback")
              .otherwise("insufficient_data"))
    return df.withColumn("forecast_method", method).withColumn(
        "forecast", F.when(F.col("forecast_method") != "insufficient_data", F.create_map(*entries)))


def row_mean(values: Sequence[Column]) -> Column:
    """Mean of the known entries of a row."""
    return C.array_mean(F.array(*values))


def interval_uncertainty(predictions: DataFrame) -> DataFrame:
    """Mean q10-q90 width over the horizons of a row, then per commodity."""
    highs = [c for c in predictions.columns if "q90" in c and c.replace("q90", "q10") in predictions.columns]
    if not highs:
        raise ValueError("no q10/q90 column pairs")
    widths = [F.col(c) - F.col(c.replace("q90", "q10")) for c in highs]
    return predictions.withColumn("_width", row_mean(widths)).groupBy("commodity").agg(
        F.avg("_width").alias("forecast_uncertainty"))


def risk_inputs(df: DataFrame) -> DataFrame:
    """Volatility, uncertainty, season and storage of one scored row, each with its fallback."""
    band = F.try_element_at("forecast", F.lit("7d"))
    usable = band["median"] > 0
    width = (band["high"] - band["low"]) / (F.lit(2.0) * F.when(usable, band["median"]))
    uncertainty = F.coalesce(F.when(usable, F.greatest(F.least(width, F.lit(1.0)), F.lit(0.0))), F.lit(0.3))
    ratio = F.when((F.col("price_mean_7d") > 0) & (F.col("price_std_7d") != 0),
                   F.col("price_std_7d") / F.when(F.col("price_mean_7d") > 0, F.col("price_mean_7d")))
    known_cv = F.col("price_cv") if "price_cv" in df.columns else F.lit(None).cast("double")
    stores = F.col("n_warehouses") if "n_warehouses" in df.columns else F.lit(None).cast("long")
    asked = F.col("warehouse_grade") if "warehouse_grade" in df.columns else F.lit(None).cast("string")
    grade = C.clean_text(asked)
    return df.withColumns({
        "price_cv": F.coalesce(known_cv, ratio, F.lit(0.1)),
        "forecast_uncertainty": uncertainty,
        "season": F.coalesce(C.season(F.coalesce("month", F.lit(6))), F.lit("Kharif")),
        "n_warehouses": F.coalesce(stores, F.lit(2)),
        "warehouse_grade": F.when(grade.isin("A", "B", "C"), grade).otherwise("B"),
    })
