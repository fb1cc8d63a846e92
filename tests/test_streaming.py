from datetime import datetime, timedelta

from conftest import rows_of
from pyspark.sql import functions as F

from granary.sources import sinks
from granary.streaming import jobs

T0 = datetime(2025, 1, 1)


def log_rows(spark, *records):
    return spark.createDataFrame([(str(i), t, d) for i, (t, d) in enumerate(records)],
                                 "request_id string, timestamp timestamp, decision string")


def test_log_stream_counts_closed_hours(spark, tmp_path):
    log, out, mark = (str(tmp_path / n) for n in ("log", "out", "mark"))
    sinks.write_prediction_log(log_rows(spark, (T0, "APPROVE"), (T0 + timedelta(minutes=5), "APPROVE"),
                                        (T0 + timedelta(hours=5), "REJECT")), log)
    counts = jobs.hourly_counts(jobs.read_prediction_log(spark, log))
    jobs.write_available(counts, out, mark).awaitTermination()
    got = spark.read.parquet(out).collect()
    assert [(r["window_start"], r["decision"], r["n"]) for r in got] == [(T0, "APPROVE", 2)]

    sinks.write_prediction_log(log_rows(spark, (T0 + timedelta(minutes=9), "APPROVE"), (T0 + timedelta(hours=9), "REJECT")), log)
    jobs.write_available(jobs.hourly_counts(jobs.read_prediction_log(spark, log)), out, mark).awaitTermination()
    later = rows_of(spark.read.parquet(out), "window_start")
    assert [(r["decision"], r["n"]) for r in later] == [("APPROVE", 2), ("REJECT", 1)]


def test_rate_audit_matches_a_plain_window(spark):
    import random
    rng = random.Random(1)
    at = [(rng.choice("aab"), T0 + timedelta(milliseconds=rng.randrange(0, 900_000))) for _ in range(600)] + [("a", T0)] * 40
    df = spark.createDataFrame(at, "client string, ts timestamp")
    got = rows_of(jobs.rate_audit(df, limit=30), "client", "ts")
    for row in got:
        begin = row["ts"] - timedelta(seconds=60)
        expected = sum(1 for c, t in at if c == row["client"] and begin < t <= row["ts"])
        assert row["requests_in_window"] == expected and row["over_limit"] == int(expected > 30)
    assert sum(r["requests"] for r in got) == 640


SNAPSHOT = "mandi_id string, commodity string, date date, modal_price double, target_price_7d double"


def feed(spark, tmp_path, *rows, **settings):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    spark.createDataFrame([(m, "W", d.date(), p, 1.0) for m, d, p in rows], SNAPSHOT).coalesce(1).write.mode("append").parquet(source)
    query = jobs.refresh_snapshot(spark.readStream.schema(SNAPSHOT).parquet(source), out, mark, **settings)
    query.awaitTermination()
    return out, jobs.last_version(query)


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_snapshot_keeps_the_latest(spark, tmp_path):
    feed(spark, tmp_path, ("A", T0, 1.0), ("B", T0, 2.0))
    out, version = feed(spark, tmp_path, ("A", T0 + timedelta(days=1), 3.0), ("B", T0 - timedelta(days=1), 9.0))
    got = rows_of(jobs.read_snapshot(spark, out, version), "mandi_id")
    assert version == 1 and [(r["mandi_id"], r["modal_price"]) for r in got] == [("A", 3.0), ("B", 2.0)]
    assert "target_price_7d" not in got[0]


def test_snapshot_rewrites_only_touched_buckets_and_drops_old_versions(spark, tmp_path):
    markets = [f"M{i}" for i in range(12)]
    feed(spark, tmp_path, *[(m, T0, 1.0) for m in markets], buckets=4)
    first = files(tmp_path / "out" / "data")
    out, version = feed(spark, tmp_path, ("M3", T0 + timedelta(days=1), 5.0), buckets=4)
    second = files(tmp_path / "out" / "data")
    assert first.items() <= second.items()  # the version before is whole, nothing of it was written again
    assert len({f.split("/")[1] for f in second if f.startswith("v1/")}) == 1
    latest = {r["mandi_id"]: r["modal_price"] for r in jobs.read_snapshot(spark, out, version).collect()}
    assert latest == {m: 5.0 if m == "M3" else 1.0 for m in markets}
    assert {r["modal_price"] for r in jobs.read_snapshot(spark, out, 0).collect()} == {1.0}
    out, version = feed(spark, tmp_path, ("M3", T0 + timedelta(days=2), 6.0), buckets=4)
    third = files(tmp_path / "out" / "data")
    mine = next(f.split("/")[1] for f in second if f.startswith("v1/"))
    assert version == 2 and not any(f.startswith(f"v0/{mine}/") for f in third)  # only version 0 named that bucket's first files
    assert {k: v for k, v in first.items() if f"/{mine}/" not in k}.items() <= third.items()
    assert {r["mandi_id"]: r["modal_price"] for r in jobs.read_snapshot(spark, out, 2).collect()} == latest | {"M3": 6.0}
    assert {r["mandi_id"]: r["modal_price"] for r in jobs.read_snapshot(spark, out, 1).collect()} == latest


def test_a_repeated_batch_gives_the_same_version(spark, tmp_path):
    import shutil

    feed(spark, tmp_path, ("A", T0, 1.0), ("B", T0, 2.0), buckets=4)
    out, version = feed(spark, tmp_path, ("A", T0 + timedelta(days=1), 3.0), buckets=4)
    want = sorted(map(tuple, jobs.read_snapshot(spark, out, version).collect()))
    # as if the stream had been killed after it wrote, before it noted the batch as done
    (tmp_path / "mark" / "commits" / "1").unlink()
    (tmp_path / "mark" / "commits" / ".1.crc").unlink(missing_ok=True)
    shutil.rmtree(tmp_path / "out" / "manifest" / "v1")
    stream = spark.readStream.schema(SNAPSHOT).parquet(str(tmp_path / "in"))
    jobs.refresh_snapshot(stream, out, str(tmp_path / "mark"), buckets=4).awaitTermination()
    assert sorted(map(tuple, jobs.read_snapshot(spark, out, 1).collect())) == want


def streamed(spark, tmp_path, *batches, **settings):
    """Rows that the rate stream gives out, each batch of (client, seconds) arriving as a run of its own."""
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for batch in batches:
        spark.createDataFrame([(c, T0 + timedelta(seconds=s)) for c, s in batch], "client string, ts timestamp").coalesce(1).write.mode(
            "append").parquet(source)
        stream = spark.readStream.schema("client string, ts timestamp").parquet(source)
        jobs.write_available(jobs.rate_stream(stream, **settings), out, mark).awaitTermination()
    return sorted((r["client"], (r["ts"] - T0).total_seconds(), r["requests"], r["requests_in_window"], r["over_limit"])
                  for r in spark.read.parquet(out).collect())


def test_rate_stream_counts_every_sliding_minute(spark, tmp_path):
    """31 requests from 0:05 to 1:04: no aligned minute has them all, the one that ends with the last request has."""
    rows = [("a", 5 + 59 * i / 30) for i in range(31)]
    got = streamed(spark, tmp_path, rows, [("z", 100_000)])
    assert [r[3] for r in got] == list(range(1, 32)) and [r[4] for r in got] == [0] * 30 + [1]


def test_rate_stream_agrees_with_the_audit_in_any_order(spark, tmp_path):
    import random
    rng = random.Random(4)
    rows = [(rng.choice("aab"), rng.randrange(0, 300_000) / 1000) for _ in range(300)] + [("a", 59.5)] * 5 + [("b", 0.0)]
    shuffled = sorted(rows, key=lambda r: r[1] + rng.random() * 20)  # out of order by less than the watermark's delay
    got = streamed(spark, tmp_path, shuffled[:150], shuffled[150:], [("z", 100_000)], limit=5)
    df = spark.createDataFrame([(c, T0 + timedelta(seconds=s)) for c, s in rows], "client string, ts timestamp")
    assert got == sorted((r["client"], (r["ts"] - T0).total_seconds(), r["requests"], r["requests_in_window"], r["over_limit"])
                         for r in jobs.rate_audit(df, limit=5).collect())


def test_rate_stream_drops_what_comes_too_late(spark, tmp_path):
    got = streamed(spark, tmp_path, [("a", 10), ("a", 200)], [("a", 20), ("a", 150)], [("z", 100_000)])
    assert got == [("a", 10, 1, 1, 0), ("a", 150, 1, 1, 0), ("a", 200, 1, 2, 0)]


def test_rate_stream_of_many_clients_keeps_few_states(spark, tmp_path):
    rows = [(c, T0 + timedelta(seconds=s)) for c in [None, 2 ** 60 + 1, *range(200)] for s in (1, 1, 40, 95)]
    schema = "client long, ts timestamp"
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
    spark.createDataFrame([(-1, T0 + timedelta(days=1))], schema).coalesce(1).write.mode("append").parquet(folder)
    rates = jobs.rate_stream(spark.readStream.schema(schema).parquet(folder), limit=2, buckets=4)
    query = jobs.write_available(rates, out, str(tmp_path / "mark"))
    query.awaitTermination()

    def told(df):
        return sorted(map(str, df.where("client is null or client <> -1").collect()))

    assert told(spark.read.parquet(out)) == told(jobs.rate_audit(spark.createDataFrame(rows, schema), limit=2))
    # four buckets in the stretches 0 to 2, and those of the last request; a value and a timer each
    assert max(o.numRowsTotal for p in query.recentProgress for o in p.stateOperators) <= 4 * (4 * 3 + 2)
