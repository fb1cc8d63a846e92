"""Read-side reports over the score table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import columns as C
from granary.functions import constants as K
from granary.operators.joins import attach_scalar
from granary.operators.metrics import share_pct
from granary.operators.quantiles import exact_quantiles
from granary.operators.shape import counts_map

SCORE_COLUMNS = ("state", "district", "commodity", "mandi_mean_price", "price_cv", "forecast_uncertainty",
                 "n_warehouses", "risk_score", "decision", "recommended_ltv")


def _avg_risk() -> Column:
    return F.round(F.avg("risk_score"), 3).alias("avg_risk")


def _avg_ltv() -> Column:
    return F.round(F.avg("recommended_ltv") * 100, 1).alias("avg_ltv")


def _count() -> Column:
    return F.count("risk_score").alias("count")


def _approve_pct() -> Column:
    return F.round(share_pct(F.col("decision") == "APPROVE"), 1).alias("approve_pct")


#: The largest page of scores and the longest lists of found states and markets; a report asks for a page, not for all.
PAGE_LIMIT, STATE_LIMIT, MARKET_LIMIT = 10_000, 30, 50


def clamp_limit(limit, default: int = 1000, most: int = PAGE_LIMIT) -> int:
    try:
        asked = int(limit)
    except (TypeError, ValueError):
        asked = default
    return max(1, min(asked, most))


def scores(df: DataFrame, commodity: str | None = None, decision: str | None = None, state: str | None = None,
           limit=1000) -> DataFrame:
    """One ordered page of filtered scores."""
    if commodity:
        df = df.where(F.col("commodity") == commodity.upper())
    if decision:
        df = df.where(F.col("decision") == decision.upper())
    if state:
        df = df.where(C.contains_text("state", state))
    page = df.orderBy("state", "district", "commodity").limit(clamp_limit(limit))
    return page.select(*[c for c in SCORE_COLUMNS if c in df.columns])


def commodity_scores(df: DataFrame, commodity: str) -> DataFrame:
    """Averages and decision counts of one commodity; no row if it is unknown."""
    rows = df.where(F.col("commodity") == commodity.upper())
    decisions = counts_map(rows, ["commodity"], "decision", "decisions")
    return rows.groupBy("commodity").agg(_count(), _avg_risk(), _avg_ltv()).join(decisions, "commodity")


def summary(df: DataFrame) -> DataFrame:
    """One row: counts, averages, decision counts, risk percentiles."""
    wanted = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}
    totals = df.agg(
        F.count("*").alias("total_rows"), F.count_distinct("commodity").alias("total_commodities"),
        F.count_distinct("state").alias("total_states"),
        F.round(F.avg("risk_score"), 3).alias("avg_risk_score"),
        F.round(F.avg("recommended_ltv") * 100, 1).alias("avg_recommended_ltv"),
        *[F.count_if(F.col("decision") == d).alias(f"n_{d.lower()}") for d in ("APPROVE", "CONDITIONAL", "REJECT")])
    quantiles = exact_quantiles(df, [], "risk_score", wanted)
    return attach_scalar(totals, quantiles.select(*[F.round(c, 3).alias(c) for c in wanted]))


def decisions_by_commodity(df: DataFrame) -> DataFrame:
    return df.groupBy("commodity", "decision").agg(F.count("*").alias("count")).orderBy("commodity", "decision")


def commodity_league(df: DataFrame) -> DataFrame:
    return df.groupBy("commodity").agg(_count(), _avg_risk(), _avg_ltv(), _approve_pct()).orderBy(
        F.desc("count"), "commodity")


def top_commodities(df: DataFrame, n: int = 20) -> DataFrame:
    return df.groupBy("commodity").agg(_count(), _avg_risk(), _avg_ltv()).orderBy(
        F.desc("count"), "commodity").limit(n)


def category_risk(df: DataFrame) -> DataFrame:
    return df.groupBy("commodity_category").agg(_avg_risk(), _count()).orderBy(
        F.desc("avg_risk"), "commodity_category")


def top_states(df: DataFrame, n: int = 15) -> DataFrame:
    return df.groupBy("state").agg(_count(), _avg_risk(), _approve_pct()).orderBy(F.desc("count"), "state").limit(n)


def overview(df: DataFrame) -> dict[str, DataFrame]:
    return {"top_commodities": top_commodities(df), "category_risk": category_risk(df), "top_states": top_states(df)}


def commodity_name(text: str) -> str:
    return text.strip().upper().replace("-", " ")


def commodity_states(df: DataFrame, commodity: str) -> DataFrame:
    rows = df.where(F.col("commodity") == commodity_name(commodity))
    return rows.groupBy("state").agg(_count(), _avg_risk(), _avg_ltv(), _approve_pct()).orderBy(
        F.desc("count"), "state")


def commodity_districts(df: DataFrame, commodity: str, n: int = 20) -> DataFrame:
    rows = df.where(F.col("commodity") == commodity_name(commodity))
    return rows.groupBy("state", "district").agg(_count(), _avg_risk(), _avg_ltv()).orderBy(
        F.desc("count"), "state", "district").limit(n)


def commodity_detail(df: DataFrame, commodity: str) -> DataFrame:
    """One row with averages, decision counts and the categories seen; the sets have a handful of entries."""
    rows = df.where(F.col("commodity") == commodity_name(commodity))
    decisions = counts_map(rows, ["commodity"], "decision", "decisions")
    return rows.groupBy("commodity").agg(
        F.count("*").alias("total"), _avg_risk(), _avg_ltv(),
        F.array_sort(F.collect_set("commodity_category")).alias("categories")).join(decisions, "commodity")


def search_states(locations: DataFrame, term: str, limit: int = 10) -> DataFrame:
    """Sorted distinct states that contain the term; an empty term finds nothing."""
    if not term.strip():
        return locations.select("state").where(F.lit(False))
    return locations.select("state").where(C.contains_text("state", term)).distinct().orderBy("state").limit(
        min(limit, STATE_LIMIT))


def search_markets(locations: DataFrame, term: str, state: str | None = None, limit: int = 15) -> DataFrame:
    """Markets whose name or district contains the term, optionally of one state."""
    hit = C.contains_text("mandi_name", term) | C.contains_text("district", term)
    rows = locations.where(hit if term.strip() else F.lit(False))
    if state:
        rows = rows.where(C.clean_text("state") == state.strip().upper())
    return rows.orderBy("mandi_id").limit(min(limit, MARKET_LIMIT)).select(
        "mandi_id", "mandi_name", "district", "state", F.round("latitude", 4).alias("latitude"),
        F.round("longitude", 4).alias("longitude"))


def risk_band(risk: Column | str) -> Column:
    return F.when(C.col(risk) < K.APPROVE_BELOW, "LOW").when(C.col(risk) < K.REJECT_FROM, "MED").otherwise("HIGH")


def decision_shares(df: DataFrame) -> DataFrame:
    """Rows and share of each decision and band."""
    counts = df.groupBy("decision", risk_band("risk_score").alias("band")).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("total"))
    return attach_scalar(counts, total).select(
        "decision", "band", "count", F.round(F.col("count") / F.col("total") * 100, 1).alias("share_pct"))
