"""The jobs of a lake, layer by layer: raw -> silver -> gold -> snapshot, model, report.

Each job reads stored tables and writes one. The driver sees file headers, split choices and the model, never rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import constants as K
from granary.operators import joins
from granary.operators.dedup import location_violations, require_no_violations
from granary.plans import boosting, clean, evaluation, features, scoring
from granary.session import durable
from granary.sources import sinks
from granary.sources.tables import lake_path, pick_file, read_csv_by_name, read_csv_text, read_dataset, read_history_csvs


class Lake:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def path(self, layer: str, table: str) -> str:
        return lake_path(self.root, layer, table)

    def read(self, layer: str, table: str) -> DataFrame:
        return read_dataset(self.spark, self.path(layer, table))

    def maybe(self, layer: str, table: str) -> DataFrame | None:
        try:
            return self.read(layer, table)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def raw(self, table: str) -> DataFrame:
        return read_csv_text(self.spark, self.path("raw", table))

    # --- silver

    def prices(self) -> None:
        sinks.write_partitioned(clean.clean_prices(self.raw("prices")), self.path("silver", "prices"))

    def price_history(self) -> None:
        raw, unreadable = read_history_csvs(self.spark, self.path("raw", "prices_manual"))
        skipped = self.spark.createDataFrame([(p,) for p in unreadable], "path string")
        sinks.write_csv(skipped, self.path("logs", "unreadable_price_files"))
        sinks.write_csv(clean.price_history(raw, self.read("silver", "locations")), self.path("raw", "prices_history"))

    def locations(self) -> None:
        master = clean.location_master(self.raw("prices"))
        require_no_violations(location_violations(master))
        sinks.write_flat(master, self.path("silver", "locations"), by=["state", "district", "mandi_name"])
        sinks.write_flat(clean.location_audit(self.raw("prices")), self.path("silver", "location_audit"))

    def weather(self) -> None:
        sinks.write_flat(clean.clean_weather(self.read("raw", "weather")), self.path("silver", "weather"))

    def signal(self) -> None:
        sinks.write_partitioned(clean.daily_signal(clean.clean_signal(self.raw("signal"))), self.path("silver", "signal"))

    def warehouses(self) -> None:
        raw = read_csv_by_name(self.spark, self.path("raw", "warehouses"), r"^[^-]*-([^./]+)\.csv", "state",
                               K.WAREHOUSE_COLUMNS)
        sinks.write_partitioned(clean.clean_warehouses(raw), self.path("silver", "warehouses"))

    def indices(self) -> None:
        sinks.write_flat(clean.clean_wholesale_index(self.raw("wpi")), self.path("silver", "wpi"), by=["commodity_name", "date"])
        sinks.write_flat(clean.clean_consumer_index(self.raw("cpi")), self.path("silver", "cpi"), by=["date", "state", "item"])

    def loans(self) -> None:
        """The table of loans; where there is none, the largest file of the loan folder. Its header says which dialect it is."""
        try:
            source = self.raw("loans")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            source = read_csv_text(self.spark, pick_file(self.spark, self.path("raw", "loan_files"), "*.csv", by="size"))
        sinks.write_flat(clean.clean_loans(source), self.path("silver", "loans"))

    def anomaly(self) -> None:
        """Current readings against the baseline years, matched to every market day."""
        current = clean.clean_signal(self.raw("signal_current"))
        baseline = clean.clean_signal(self.raw("signal_baseline"))
        sinks.write_flat(joins.baseline_table(baseline, clean.SIGNAL_DETAILS), self.path("silver", "signal_baseline"))
        scored = durable(joins.signal_anomaly(current, baseline), "anomaly")
        days = features.market_days(features.daily_panel(self.read("silver", "prices")))
        sinks.write_flat(features.market_anomaly(days, scored, self.read("silver", "locations")),
                         self.path("silver", "anomaly"))

    # --- gold and after

    def price_features(self) -> None:
        sinks.write_by_state(features.gold_prices(
            self.read("silver", "prices"), self.read("silver", "weather"), self.read("silver", "signal"),
            self.read("silver", "cpi"), self.read("silver", "wpi"), self.maybe("silver", "anomaly"),
            self.maybe("silver", "zones")), self.path("gold", "price_features"))

    def anomaly_prices(self) -> None:
        panel = features.daily_panel(self.read("silver", "prices"))
        sinks.write_flat(features.anomaly_prices(panel, self.read("silver", "anomaly")), self.path("gold", "anomaly_prices"))

    def risk_features(self) -> None:
        risk = features.gold_risk(
            self.read("silver", "prices"), self.read("silver", "warehouses"), self.read("silver", "loans"),
            self.maybe("gold", "predictions"), self.maybe("silver", "anomaly"), self.maybe("silver", "locations"))
        sinks.write_flat(features.score_table(risk), self.path("gold", "scores"))

    def snapshot(self) -> None:
        sinks.write_flat(features.serving_snapshot(self.read("gold", "price_features")), self.path("serving", "snapshot"))

    def model(self, largest: int | None = None) -> None:
        """One model per commodity, horizon and quantile; `largest` keeps only that many commodities, by rows."""
        rows = self.read("gold", "price_features")
        if largest is not None:
            rows = rows.join(evaluation.top_by_rows(rows, largest).select("commodity"), "commodity", "left_semi")
        fitted = boosting.train(rows, {f"{h}d": f"target_price_{h}d" for h in K.HORIZONS})
        sinks.write_flat(fitted.table(self.spark), self.path("serving", "model"))

    def fitted(self) -> boosting.BoostModel | None:
        table = self.maybe("serving", "model")
        return None if table is None else boosting.BoostModel.from_table(table, ["commodity"])

    def predictions(self) -> None:
        """Quantiles of every feature row in units of its median forecast, for the uncertainty of the risk table."""
        made = boosting.predict(self.read("gold", "price_features"), self.fitted())
        mid = {h: F.col(f"q50_{h}d") for h in K.HORIZONS}
        relative = [F.when(mid[h] > 0, F.col(f"q{q}_{h}d") / mid[h]).alias(f"q{q}_{h}d")
                    for h in K.HORIZONS for q in (10, 50, 90)]
        sinks.write_flat(made.select("mandi_id", "commodity", "date", *relative), self.path("gold", "predictions"))

    def report(self) -> None:
        """Train on the first 70% of the dates, test on the last 15%, against persistence."""
        gold = self.read("gold", "price_features")
        rows = evaluation.evaluation_rows(gold)
        metrics = durable(evaluation.evaluate(rows, evaluation.train_on_split(rows)), "metrics")
        sinks.write_csv(metrics, self.path("serving", "evaluation_full"))
        sinks.write_csv(evaluation.report(metrics), self.path("serving", "evaluation_report"))
        sinks.write_csv(evaluation.status(gold, metrics), self.path("serving", "evaluation_status"))

    def decisions(self) -> None:
        """Score the waiting requests and log the answers."""
        requests = self.read("raw", "requests")
        history, ahead = self.maybe("raw", "weather_history"), self.maybe("raw", "weather_outlook")
        results = scoring.score_requests(
            requests, self.read("silver", "locations"), self.read("serving", "snapshot"), self.fitted(),
            None if history is None else scoring.live_weather(history), None if ahead is None else scoring.outlook(ahead))
        sinks.write_flat(results, self.path("serving", "decisions"))
        stored = self.read("serving", "decisions")
        sinks.write_prediction_log(scoring.prediction_log(stored, requests), self.path("logs", "predictions"))


JOBS: dict[str, Callable[[Lake], None]] = {
    name: getattr(Lake, name) for name in (
        "prices", "locations", "price_history", "weather", "signal", "warehouses", "indices", "loans", "anomaly",
        "price_features", "anomaly_prices", "snapshot", "model", "predictions", "risk_features", "report", "decisions")}
