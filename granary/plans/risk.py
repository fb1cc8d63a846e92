"""Risk score, decision, loan-to-value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import columns as C
from granary.functions import constants as K
from granary.operators.joins import attach_scalar
from granary.operators.metrics import confusion
from granary.operators.quantiles import exact_quantiles
from granary.session import durable


def tier(commodity: Column | str) -> Column:
    return C.lookup(C.commodity_category(commodity), K.CATEGORY_TIERS, K.UNKNOWN_TIER)


def risk_signals(columns: Sequence[str]) -> dict[str, Column]:
    """The six inputs on a 0-1 scale. Missing columns and NULLs take a neutral value, so a score always exists."""
    def have(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in columns else F.lit(default)

    def unit(name: str, default: float) -> Column:
        return F.greatest(F.least(have(name, default).cast("double"), F.lit(1.0)), F.lit(0.0))

    stores = F.least(have("n_warehouses", 0).cast("double"), F.lit(float(K.ENOUGH_WAREHOUSES)))
    return {
        "price_cv": unit("price_cv", 0.1),
        "forecast_uncertainty": unit("forecast_uncertainty", 0.3),
        "warehouses": F.lit(1.0) - F.greatest(stores, F.lit(0.0)) / K.ENOUGH_WAREHOUSES,
        "grade": C.lookup(C.clean_text(have("warehouse_grade", "B")), K.GRADE_RISK, 0.5),
        "perishability": tier("commodity"),
        "season": C.lookup(C.clean_text(have("season", "")), K.SEASON_RISK, 0.5),
    }


def decision(risk: Column | str) -> Column:
    r = C.col(risk)
    return F.when(r < K.APPROVE_BELOW, "APPROVE").when(r < K.REJECT_FROM, "CONDITIONAL").otherwise("REJECT")


def recommended_ltv(risk: Column | str) -> Column:
    """Falls linearly through each decision band, from 0.75 at no risk to 0.40 at full risk."""
    r = F.greatest(F.least(C.col(risk), F.lit(1.0)), F.lit(0.0))
    (a0, a1, a_top, a_low), (b0, b1, b_top, b_low), (c0, c1, c_top, c_low) = K.LTV_BANDS
    return (
        F.when(r < a1, F.lit(a_top) - (r - a0) / (a1 - a0) * (a_top - a_low))
        .when(r < b1, F.lit(b_top) - (r - b0) / (b1 - b0) * (b_top - b_low))
        .otherwise(F.lit(c_top) - (r - c0) / (c1 - c0) * (c_top - c_low)))


def score_risk(df: DataFrame, weights: Mapping[str, float] = K.RISK_WEIGHTS) -> DataFrame:
    """Adds each signal's weighted share (_feat_*), the score, the decision and the loan-to-value."""
    signals = risk_signals(df.columns)
    parts = df.withColumns({f"_feat_{n}": signals[n] * F.lit(w) for n, w in weights.items()})
    total: Column = F.lit(0.0)
    for n in weights:
        total = total + F.col(f"_feat_{n}")
    return (
        parts.withColumn("risk_score", F.greatest(F.least(total, F.lit(1.0)), F.lit(0.0)))
        .withColumns({"decision": decision("risk_score"), "recommended_ltv": recommended_ltv("risk_score")}))


def proxy_score(df: DataFrame) -> DataFrame:
    """Rule score and largest loan-to-value from volatility, storage and portfolio defaults."""
    stores = F.least(F.col("n_warehouses").cast("double"), F.lit(50.0))
    score = (
        F.coalesce("price_cv", F.lit(0.1)) * 0.4 + (F.lit(1.0) - stores / 50) * 0.3
        + F.coalesce("portfolio_default_rate", F.lit(0.06)) * 0.3)
    return df.withColumn("risk_score_proxy", score).withColumn(
        "recommended_max_ltv", C.clip(F.lit(0.75) - C.clip("risk_score_proxy", 0.0, 0.5), 0.40, 0.75))


def loan_amount(requested: Column | str, ltv: Column | str, price: Column | str, quantity: Column | str) -> Column:
    """The smaller of what is asked and what the collateral carries; NULL or zero inputs give none."""
    asked, amount = C.col(requested), C.col(quantity)
    given = (asked != 0) & (amount != 0)
    return F.when(given, F.round(F.least(asked, C.col(ltv) * C.col(price) * amount), 2))


def label_high_risk(df: DataFrame) -> DataFrame:
    """1 where volatility and uncertainty both exceed their medians."""
    df = durable(df, "unlabelled")
    medians = exact_quantiles(df, [], "price_cv", {"_m_cv": 0.5})
    out = attach_scalar(df, medians)
    if "forecast_uncertainty" in df.columns:
        out = attach_scalar(out, exact_quantiles(df, [], "forecast_uncertainty", {"_m_fu": 0.5}))
    else:
        out = out.withColumns({"forecast_uncertainty": F.lit(0.3), "_m_fu": F.lit(0.3)})
    high = (F.col("price_cv") > F.col("_m_cv")) & (F.col("forecast_uncertainty") > F.col("_m_fu"))
    return out.withColumn("synthetic_high_risk", C.flag(high)).drop("_m_cv", "_m_fu")


def evaluate_decisions(df: DataFrame) -> DataFrame:
    """Rejections against the proxy label: one row with the confusion matrix, rates and averages."""
    scored = durable(score_risk(label_high_risk(df)).withColumn(
        "predicted_high_risk", C.flag(F.col("decision") == "REJECT")), "scored")
    quality = confusion(scored, "predicted_high_risk", "synthetic_high_risk")
    averages = scored.agg(
        F.avg("risk_score").alias("avg_risk_score"), F.avg("recommended_ltv").alias("avg_recommended_ltv"),
        *[F.sum((F.col("decision") == d).cast("long")).alias(f"n_{d.lower()}")
          for d in ("APPROVE", "CONDITIONAL", "REJECT")])
    return attach_scalar(quality, averages)
