"""A stream that has seen all rows gives what the batch operator gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from logwarden.functions.times import micros
from logwarden.operators import correlate as C
from logwarden.operators import dedup as D
from logwarden.operators import projections as P
from logwarden.operators import windows as W
from logwarden.operators.firewall import detect_firewall
from logwarden.operators.endpoint import detect_endpoint
from logwarden.plans import views as V
from logwarden.streaming import jobs as J
from tests.conftest import SF


def as_stream(spark, df, folder, name, files=3):
    path = f"{folder}/{name}"
    df.repartitionByRange(files, "ts").write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_verdict_stream_equals_batch(spark, fresh_dir):
    fw = V.firewall(spark, SF)
    stream = detect_firewall(as_stream(spark, fw, fresh_dir, "in"))
    run(J.append_stream(stream, fresh_dir + "/out", fresh_dir + "/cp"))
    got = spark.read.parquet(fresh_dir + "/out").select("id", "threat_level", "event_details")
    want = detect_firewall(fw).select("id", "threat_level", "event_details")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_suppression_stream_equals_batch(spark, fresh_dir):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.ROCKSDB)
    events = detect_firewall(V.firewall(spark, SF)).select(
        "id", "ts", F.col("device_name").alias("agent_host"), F.lit("HIGH").alias("severity"), "mitre_technique")
    stream = as_stream(spark, events, fresh_dir, "in", files=1)
    run(J.append_stream(J.suppress_stream(stream), fresh_dir + "/out", fresh_dir + "/cp"))
    got = {(r.id, r.duplicate_count) for r in spark.read.parquet(fresh_dir + "/out").collect()}
    keyed = events.select(D.fingerprint(events).alias("fp"), micros("ts").alias("us"), "id")
    want = {(r.id, r.duplicate_count) for r in D.suppression_anchors(keyed).collect()}
    assert got == want and len(want) > 100


def test_window_verdict_stream_equals_batch(spark, fresh_dir):
    inputs = P.firewall_pass_input(detect_firewall(V.firewall(spark, SF)))
    # A last row far in the future closes every other window.
    late = inputs.orderBy(F.desc("ts")).limit(1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))
    stream = as_stream(spark, inputs.unionByName(late), fresh_dir, "in")
    run(J.pass_rows_stream(stream, fresh_dir + "/out", fresh_dir + "/cp"))
    columns = ["source_event_id", "final_severity", "final_summary", "llm_ioc_values"]
    got = spark.read.parquet(fresh_dir + "/out").select(*columns)
    batches = W.window_batches(inputs)
    want = W.pass_rows(batches, W.window_verdicts(batches)).select(*columns)
    assert want.exceptAll(got).count() == 0 and got.count() == want.count()


def test_correlation_stream_equals_batch(spark, fresh_dir):
    endpoint = P.endpoint_events(detect_endpoint(V.security(spark, SF)))
    firewall = P.firewall_events(detect_firewall(V.firewall(spark, SF)))
    e = as_stream(spark, endpoint, fresh_dir, "e", files=1)
    f = as_stream(spark, firewall, fresh_dir, "f", files=1)
    run(J.append_stream(J.correlate_stream(e, f), fresh_dir + "/out", fresh_dir + "/cp"))
    got = spark.read.parquet(fresh_dir + "/out").select("incident_key", "description")
    want = C.pair_matches(endpoint, firewall).select("incident_key", "description")
    assert want.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_closed_windows_run_once(spark, fresh_dir):
    import datetime as dt

    events = V.firewall(spark, SF).select("id", "ts")
    job = lambda rows: rows.groupBy("window_start").agg(F.count("*").alias("n"))
    half = dt.datetime.fromtimestamp(V.BASE_SECONDS + 6 * 3600 + 1, dt.timezone.utc)
    end = dt.datetime.fromtimestamp(V.BASE_SECONDS + 13 * 3600, dt.timezone.utc)
    for now in (half, half, end):
        J.run_closed_windows(spark, events, job, fresh_dir + "/ledger", fresh_dir + "/out", now)
    out = spark.read.parquet(fresh_dir + "/out")
    assert out.agg(F.sum("n")).first()[0] == events.count()
    ledger = spark.read.parquet(fresh_dir + "/ledger")
    per = ledger.groupBy("window_start").agg(F.count("*").alias("k"))
    assert {r.k for r in per.collect()} == {2}
    from logwarden.operators.windowed import latest_state

    assert {r.status for r in latest_state(ledger).collect()} == {"done"}


def test_windows_of_a_lost_or_failed_run_are_done_later(spark, fresh_dir):
    import datetime as dt

    import pytest

    events = V.firewall(spark, SF).select("id", "ts")
    paths = (fresh_dir + "/ledger", fresh_dir + "/out")
    now = dt.datetime.fromtimestamp(V.BASE_SECONDS + 13 * 3600, dt.timezone.utc)
    job = lambda rows: rows.groupBy("window_start").agg(F.count("*").alias("n"))

    def fail(rows):
        raise ValueError("once")

    def die(rows):
        raise KeyboardInterrupt

    with pytest.raises(ValueError):
        J.run_closed_windows(spark, events, fail, *paths, now)
    with pytest.raises(KeyboardInterrupt):  # nothing is written after the claim
        J.run_closed_windows(spark, events, die, *paths, now)
    J.run_closed_windows(spark, events, job, *paths, now + dt.timedelta(minutes=1))
    import os

    assert not os.path.exists(paths[1])  # the dead run's lease still holds
    J.run_closed_windows(spark, events, job, *paths, now + dt.timedelta(hours=2))
    assert spark.read.parquet(paths[1]).agg(F.sum("n")).first()[0] == events.count()
