"""Loan requests in, decisions out: one row per request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import columns as C
from granary.functions import constants as K
from granary.operators import geo
from granary.operators.dedup import keep_first
from granary.operators.joins import signal_label
from granary.operators.shape import add_forecast_features, weather_history_rows
from granary.operators.windows import recent_weather
from granary.plans.boosting import BoostModel, predict
from granary.plans.forecast import add_forecast, risk_inputs
from granary.plans.risk import loan_amount, score_risk

WEATHER_FEATURES = ("temp_mean_7d", "precip_sum_7d", "humidity_mean_7d")
OUTLOOK = ("forecast_temp_7d_avg", "forecast_precip_7d_sum", "forecast_precip_14d_sum", "forecast_humidity_7d_avg")
SIGNAL = ("modis_ndvi", "ndvi_anomaly", "ndvi_anomaly_7d_avg", "ndvi_stress_flag", "ndvi_surplus_flag")

# Request columns a caller may leave out, with their types.
OPTIONAL = {
    "state": "string", "district": "string", "market": "string", "latitude": "double", "longitude": "double",
    "quantity_kg": "double", "requested_loan_amount": "double", "warehouse_grade": "string",
}


def live_weather(payloads: DataFrame) -> DataFrame:
    """Last seven days of each request's weather payload: request_id and the weather features."""
    rows = weather_history_rows(payloads.select("request_id", "payload"))
    return recent_weather(rows, ["request_id"])


def outlook(payloads: DataFrame) -> DataFrame:
    return add_forecast_features(payloads.select("request_id", "payload"))


def score_requests(requests: DataFrame, locations: DataFrame, snapshot: DataFrame, model: BoostModel | None = None,
                   weather: DataFrame | None = None, forecast_weather: DataFrame | None = None) -> DataFrame:
    """Resolve, look up, forecast, score. `status` says why a request got no decision.

    `weather` and `forecast_weather` are per-request features (see live_weather and outlook).
    """
    asked = requests.withColumns({
        name: F.lit(None).cast(kind) for name, kind in OPTIONAL.items() if name not in requests.columns
    }).withColumn("commodity", C.clean_text("commodity"))
    located = geo.resolve(asked, locations)
    states = keep_first(locations.select("mandi_id", F.col("state").alias("mandi_state")), ["mandi_id"])
    located = located.join(states, "mandi_id", "left")

    wanted = [c for c in dict.fromkeys(
        (*K.FEATURES, "modal_price", "price_cv", "n_warehouses", *SIGNAL)) if c in snapshot.columns]
    rows = geo.snapshot_lookup(located, snapshot, wanted)
    rows = _with_weather(rows, weather)
    if forecast_weather is not None:
        rows = rows.join(forecast_weather.select("request_id", *OUTLOOK), "request_id", "left")
    else:
        rows = rows.withColumns({c: F.lit(None).cast("double") for c in OUTLOOK})
    missing = {f: F.lit(None).cast("double") for f in (*K.FEATURES, "modal_price", *SIGNAL) if f not in rows.columns}
    rows = rows.withColumns(missing)
    if model is not None:
        rows = predict(rows, model)
    rows = add_forecast(rows, has_model=None if model is not None else F.lit(False))

    place = F.col("state").isNotNull() | (F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    live = F.col("live_weather_used")
    status = (
        F.when(F.col("commodity").isNull() | (F.col("commodity") == "") | ~place, "invalid_request")
        .when(F.col("mandi_id").isNull(), "no_market")
        .when((F.col("snapshot_match") == "none") & ~live, "no_features")
        .when((F.col("forecast_method") == "insufficient_data") & ~live, "insufficient_data")
        .otherwise("ok"))
    scored = score_risk(risk_inputs(rows.withColumn("status", status)))
    return _result(scored)


def _with_weather(rows: DataFrame, weather: DataFrame | None) -> DataFrame:
    """Live readings override the snapshot's where there are any."""
    if weather is None:
        return rows.withColumn("live_weather_used", F.lit(False))
    live = weather.select("request_id", *[F.col(c).alias(f"_live_{c}") for c in WEATHER_FEATURES])
    joined = rows.join(live, "request_id", "left")
    some = F.coalesce(*[F.col(f"_live_{c}") for c in WEATHER_FEATURES]).isNotNull()
    return joined.withColumns({
        **{c: F.coalesce(F.col(f"_live_{c}"), F.col(c)) if c in rows.columns else F.col(f"_live_{c}")
           for c in WEATHER_FEATURES},
        "live_weather_used": some,
    }).drop(*[f"_live_{c}" for c in WEATHER_FEATURES])


def _result(scored: DataFrame) -> DataFrame:
    ok = F.col("status") == "ok"
    # Rounded in two steps, so that noise in the last bits does not decide a tie.
    ltv_pct = F.round(F.round(F.col("recommended_ltv") * 100, 6), 1)
    price = F.coalesce("modal_price", F.lit(0.0))
    parts = F.create_map(*[x for n in K.RISK_WEIGHTS for x in (F.lit(n), F.round(F.col(f"_feat_{n}") * 100, 1))])
    weights = F.create_map(*[x for n, w in K.RISK_WEIGHTS.items() for x in (F.lit(n), F.lit(w))])
    explanation = F.to_json(F.struct(
        F.struct(F.round("price_cv", 4).alias("price_cv"),
                 F.round("forecast_uncertainty", 4).alias("forecast_uncertainty"),
                 F.col("n_warehouses").cast("int").alias("n_warehouses"), "warehouse_grade",
                 F.round(F.col("_feat_perishability") / K.RISK_WEIGHTS["perishability"], 4).alias("commodity_tier"),
                 "season").alias("components"),
        parts.alias("feature_importance"), weights.alias("weights"),
        F.struct(F.lit(K.APPROVE_BELOW).alias("approve"), F.lit(K.REJECT_FROM).alias("reject")).alias("thresholds")))
    has_signal = F.coalesce(*[F.col(c).cast("double") for c in SIGNAL]).isNotNull()
    signal = F.to_json(F.struct(
        *[F.round(F.col(c).cast("double"), 4).alias(c) for c in SIGNAL],
        signal_label("ndvi_stress_flag", "ndvi_surplus_flag").alias("ndvi_signal")))

    def given(value):
        return F.when(ok, value)

    weather_outlook = F.coalesce(*[F.col(c) for c in OUTLOOK]).isNotNull()
    return scored.select(
        "request_id", *[c for c in ("ts",) if c in scored.columns], "status", "mandi_id", "resolution_type",
        "mandi_distance_km", "commodity", (F.col("snapshot_match") != "none").alias("used_snapshot"),
        "live_weather_used", weather_outlook.alias("forecast_weather_used"),
        given(F.col("forecast")).alias("forecast"), "forecast_method",
        given(F.round("risk_score", 4)).alias("risk_score"), given(F.col("decision")).alias("decision"),
        given(ltv_pct).alias("recommended_ltv_pct"),
        given(loan_amount("requested_loan_amount", ltv_pct / 100, price, "quantity_kg")).alias(
            "recommended_loan_amount"),
        given(F.round(price, 2)).alias("modal_price"),
        F.when(ok & has_signal, signal).alias("ndvi_anomaly"),
        given(explanation).alias("explanation"))


def prediction_log(results: DataFrame, requests: DataFrame, at=None) -> DataFrame:
    """Log records of scored requests, ready for the JSON sink."""
    fields = [f.name for f in requests.schema if not isinstance(f.dataType, T.BinaryType)]
    bodies = requests.select("request_id", F.to_json(F.struct(*fields)).alias("request"))
    return results.where("status = 'ok'").join(bodies, "request_id", "left").select(
        "request_id", (F.current_timestamp() if at is None else F.col(at)).alias("timestamp"), "request", "mandi_id",
        "resolution_type", "commodity", "forecast_method", "risk_score", "decision", "recommended_ltv_pct")
