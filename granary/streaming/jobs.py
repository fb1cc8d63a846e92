"""Prediction-log counts, request-rate audit and the incremental snapshot."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from granary.operators.dedup import latest_per_key
from granary.session import remove

LOG_SCHEMA = (
    "request_id string, timestamp timestamp, duration_ms double, request string, mandi_id string, "
    "resolution_type string, commodity string, forecast_method string, risk_score double, decision string, "
    "recommended_ltv_pct double"
)


def read_prediction_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(LOG_SCHEMA + ", log_date date").option("recursiveFileLookup", "false").json(path)


def hourly_counts(rows: DataFrame, at: str = "timestamp", by: str = "decision", late: str = "1 hour",
                  size: str = "1 hour") -> DataFrame:
    """Rows per window and value. On a stream a window is final once the watermark has passed it."""
    if rows.isStreaming:
        rows = rows.withWatermark(at, late)
    return rows.groupBy(F.window(at, size), by).agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), by, "n")


def write_available(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; the checkpoint makes the Parquet sink exactly-once."""
    return (
        rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start())


def rate_audit(requests: DataFrame, client: str = "client", at: str = "ts", seconds: int = 60,
               limit: int = 30) -> DataFrame:
    """Requests of the same client in the window ending at each request, flagged above the limit.

    A client is cut into window-long stretches of time and each request also joins the next stretch, as
    context. So even a client with a third of all requests is spread over many tasks, and each count
    still sees its whole window. Requests of one instant are counted together first.
    """
    span = seconds * 1_000_000
    instants = requests.groupBy(client, F.unix_micros(F.col(at).cast("timestamp")).alias("_us")).agg(
        F.count("*").alias("_n"))
    own = F.floor(F.col("_us") / F.lit(span)).cast("long")
    stretches = instants.withColumn("_own", own).withColumn(
        "_stretch", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    window = Window.partitionBy(client, "_stretch").orderBy("_us").rangeBetween(-(span - 1), 0)
    counted = stretches.withColumn("requests_in_window", F.sum("_n").over(window)).where(
        F.col("_stretch") == F.col("_own"))
    return counted.select(
        client, F.timestamp_micros("_us").alias(at), F.col("_n").alias("requests"), "requests_in_window",
        (F.col("requests_in_window") > limit).cast("int").alias("over_limit"))


def rate_stream(requests: DataFrame, client: str = "client", at: str = "ts", seconds: int = 60, limit: int = 30,
                late: str = "1 minute", buckets: int = 256) -> DataFrame:
    """The rows of `rate_audit`, on a stream: each (client, instant) once, as soon as the watermark has reached it.

    Requests may come out of order by up to `late`; a later one is dropped and counts nowhere. State is kept for one stretch of
    one bucket of clients, with the stretch before as context, so a client with a third of all requests is many keys, and clients
    with a request now and then share one; a stretch is forgotten when the watermark has passed its end. `buckets` is fixed for
    the life of a stream. Needs the RocksDB state store, which it sets for the session.
    """
    requests.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    span = seconds * 1_000_000
    us = F.unix_micros(F.col(at).cast("timestamp"))
    own = F.floor(us / F.lit(span)).cast("long")
    # as text, since pandas turns whole numbers next to a missing one into floats
    placed = requests.withWatermark(at, late).select(
        F.pmod(F.xxhash64(client), F.lit(buckets)).alias("bucket"), F.col(client).cast("string").alias("client"),
        F.col(at).alias("at"), us.alias("us"), F.explode(F.array(own, own + 1)).alias("stretch"))
    out = placed.groupBy("bucket", "stretch").transformWithStateInPandas(
        RateWindows(span), "client string, us long, requests long, requests_in_window long", "append", "eventTime")
    return out.select(
        F.col("client").cast(requests.schema[client].dataType).alias(client), F.timestamp_micros("us").alias(at), "requests",
        "requests_in_window", (F.col("requests_in_window") > limit).cast("int").alias("over_limit"))


class RateWindows(StatefulProcessor):
    """Requests per client and instant of one bucket and stretch (its own and those of the stretch before), each given out once."""

    def __init__(self, span: int):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.instants = handle.getValueState("instants", "client array<string>, us array<long>, n array<long>, done long")

    def close(self) -> None:
        pass

    def read(self) -> tuple[pd.DataFrame, int]:
        client, us, n, done = self.instants.get() if self.instants.exists() else ([], [], [], -(2 ** 63))
        return pd.DataFrame({"client": pd.Series(list(client), dtype="object"), "us": np.array(us, dtype="int64"),
                             "n": np.array(n, dtype="int64")}), done

    def write(self, held: pd.DataFrame, done: int) -> None:
        clients = held["client"].astype("object").where(held["client"].notna(), None)
        self.instants.update((clients.tolist(), held["us"].tolist(), held["n"].tolist(), done))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, done = self.read()
        parts = [held, *[part[["client", "us"]].assign(n=1) for part in rows]]
        held = pd.concat([p for p in parts if len(p)]).groupby(["client", "us"], dropna=False, as_index=False)["n"].sum()
        self.write(held, done)
        self.handle.registerTimer(self.next_due(key, held, done))
        yield pd.DataFrame()

    def next_due(self, key, held: pd.DataFrame, done: int) -> int:
        """When the next own instant is due, in milliseconds; the end of the stretch if none is waiting."""
        begin, us = key[1] * self.span, held["us"].to_numpy()
        waiting = us[(us > done) & (us >= begin)]
        return int(-(-(int(waiting.min()) if len(waiting) else begin + self.span) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.instants.exists():
            return
        until = timerValues.getCurrentWatermarkInMs() * 1000
        held, done = self.read()
        begin = key[1] * self.span
        # one line of time, client after client, with more than a window between them
        code = pd.factorize(held["client"], use_na_sentinel=False)[0]
        held = held.assign(line=code * (4 * self.span) + held["us"].to_numpy() - begin + 2 * self.span).sort_values("line")
        us, line, upto = (held[c].to_numpy() for c in ("us", "line", "n"))
        upto = np.concatenate([[0], upto.cumsum()])
        due = np.flatnonzero((us > done) & (us >= begin) & (us <= until))
        given = held.iloc[due]
        counts = upto[due + 1] - upto[line.searchsorted(line[due] - self.span, side="right")]
        if until >= begin + self.span:
            self.instants.clear()
        else:
            if len(due):
                done = int(us[due].max())
                held = held[us > done - self.span]  # what no later window of this stretch can hold goes
                self.write(held, done)
            self.handle.registerTimer(self.next_due(key, held, done))
        if len(due):
            made = pd.DataFrame({"client": given["client"], "us": given["us"], "requests": given["n"],
                                 "requests_in_window": counts})
            yield made.sort_values("us", kind="stable").reset_index(drop=True)


def merge_snapshot(current: DataFrame | None, rows: DataFrame, keys: Sequence[str] = ("mandi_id", "commodity"),
                   at: str = "date") -> DataFrame:
    """Latest row per key of the snapshot so far and the new rows, without look-ahead columns."""
    rows = rows.drop(*[c for c in rows.columns if c.startswith("target_price_")])
    both = rows if current is None else current.unionByName(rows, allowMissingColumns=True)
    return latest_per_key(both, keys, at, [F.desc_nulls_last(c) for c in both.columns if c not in (*keys, at)])


def read_snapshot(spark: SparkSession, path: str, version: int) -> DataFrame:
    """A version of the snapshot: the folders that its manifest names, one for each bucket."""
    folders = [r["folder"] for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest/v{version}").collect()]
    return spark.read.parquet(*folders)


def last_version(query: StreamingQuery) -> int:
    """The newest version a finished refresh has written."""
    return max(p["batchId"] for p in query.recentProgress)


MANIFEST = "bucket int, version long, folder string"


def refresh_snapshot(rows: DataFrame, path: str, checkpoint: str, once: bool = True,
                     keys: Sequence[str] = ("mandi_id", "commodity"), at: str = "date", buckets: int = 64,
                     keep: int = 2) -> StreamingQuery:
    """Keep a versioned snapshot up to date. Keys fall into hash buckets, and a batch rewrites only the buckets it touches.

    A batch writes its buckets into a folder of its own number, then a manifest that names the folder of every bucket, its own
    and those of earlier batches. A repeated batch starts from the manifest before it and overwrites its own files only, so it
    gives the same version. Folders that none of the `keep` newest manifests name are deleted after the new one is written.
    `buckets` is fixed for the life of a snapshot.
    """
    if keep < 2:
        raise ValueError("a repeated batch reads the version before it")

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.hash(*keys), F.lit(buckets)).alias("bucket")
        new = batch.select("*", bucket).persist()
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())
        known = ({r["bucket"]: r for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest/v{number - 1}").collect()}
                 if number > 0 else {})
        held = [known[b]["folder"] for b in touched if b in known]
        current = spark.read.parquet(*held).withColumn("bucket", bucket) if held else None
        if touched:
            merged = merge_snapshot(current, new, (*keys, "bucket"), at)
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/v{number}")
        new.unpersist()
        rows = [(b, number, f"{path}/data/v{number}/bucket={b}") for b in touched]
        rows += [tuple(r) for b, r in known.items() if b not in set(touched)]
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v{number}")
        expire(spark, known, touched, number)

    def expire(spark: SparkSession, known: dict, touched: list[int], number: int) -> None:
        gone = number - keep
        if gone < 0:
            return
        kept = set()
        for version in range(gone + 1, number + 1):
            kept |= {r["folder"] for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest/v{version}").collect()}
        try:
            old = spark.read.schema(MANIFEST).parquet(f"{path}/manifest/v{gone}").collect()
        except AnalysisException as error:  # a repeated batch that had already got this far
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return
        for r in old:
            if r["folder"] not in kept:
                remove(spark, r["folder"])
        remove(spark, f"{path}/manifest/v{gone}")

    writer = rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
