"""Streams with state, played slice by slice, against the operators on whole tables."""

from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from logwarden.operators import correlate as C
from logwarden.streaming import bursts as B
from logwarden.streaming import jobs as J
from logwarden.streaming.bursts import brute_force_stream
from logwarden.streaming.replay import replay

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
ENDPOINT = "id long, ts timestamp, event_id string, src_ip string, agent_host string"
FIREWALL = "id long, ts timestamp, dst_port string, action string, src_ip string"
KEYED = "fp string, us long, id long, ts timestamp"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def found(incidents):
    return sorted((r.affected_ip, r.affected_host, r.evidence, r.window_start, r.window_end) for r in incidents.collect())


def test_bursts_of_a_stream_equal_those_of_the_table(spark, fresh_dir):
    logons, blocks = [], []

    def fail(ip, *seconds):
        logons.extend((len(logons), at(s), "4625", ip, f"host-{s % 3}") for s in seconds)

    def block(ip, *seconds):
        blocks.extend((len(blocks), at(s), "22", "deny", ip) for s in seconds)

    fail("long", *range(0, 9000, 30))  # one burst over all slices
    block("long", 0, 600, 601, 8000)  # the first two are in reach of its start
    fail("two", 0, 1, 2, 3, 4, 604, 605, 700, 1300, 1301, 1302, 1303, 1304)  # gap of a window less, then exactly one
    block("two", 0, 0, 1290)
    fail("ties", 5, 5, 5, 5, 5)
    block("ties", 605, 606)
    fail("few", 1, 2, 3, 4)
    block("few", 1)
    fail("unblocked", 1, 2, 3, 4, 5)
    fail("127.0.0.1", 1, 2, 3, 4, 5)
    block("127.0.0.1", 1)
    endpoint, firewall = spark.createDataFrame(logons, ENDPOINT), spark.createDataFrame(blocks, FIREWALL)
    closing = {
        "endpoint": spark.createDataFrame([(-1, at(90000), "4625", "end", "h")], ENDPOINT),
        "firewall": spark.createDataFrame([(-1, at(90000), "22", "deny", "end")], FIREWALL),
    }
    got = replay(spark, {"endpoint": endpoint, "firewall": firewall}, brute_force_stream, 4, closing, fresh_dir)
    want = found(C.brute_force(endpoint, firewall))
    assert found(got) == want
    assert {r[0] for r in want} == {"long", "two", "ties"}


def test_replay_of_empty_tables(spark, fresh_dir):
    tables = {"endpoint": spark.createDataFrame([], ENDPOINT), "firewall": spark.createDataFrame([], FIREWALL)}
    assert replay(spark, tables, brute_force_stream, folder=fresh_dir).count() == 0


@pytest.mark.parametrize("slices", [1, 4])
def test_idle_fingerprints_expire_with_their_pending_count(spark, fresh_dir, slices):
    seconds = [0, 10, 10, 299, 300, 301, 601, 602, 903, 2000]
    rows = [("a", int(at(s).timestamp()) * 1_000_000, i, at(s)) for i, s in enumerate(seconds)]
    end = spark.createDataFrame([("end", int(at(90000).timestamp()) * 1_000_000, 99, at(90000))], KEYED)
    got = replay(spark, {"keyed": spark.createDataFrame(rows, KEYED)},
                 lambda keyed: J.suppress_keyed_stream(keyed, expire=True), slices, {"keyed": end}, fresh_dir)
    base = int(START.timestamp())
    seen = sorted((r.us // 1_000_000 - base, r.id, r.duplicate_count) for r in got.where("fp = 'a'").collect() if r.id is not None)
    pending = sorted((r.us // 1_000_000 - base, r.duplicate_count) for r in got.where("id is null").collect())
    # 903 is 301 s after the last row, so what was pending at 602 is told and 903 starts anew.
    assert seen == [(0, 0, 0), (300, 4, 4), (601, 6, 2), (903, 8, 0), (2000, 9, 0)]
    assert pending == [(602, 1)]


def test_instants_are_packed_into_few_entries_of_the_state():
    rows = pd.DataFrame({"blocked": [i % 2 == 0 for i in range(25_000)], "us": range(25_000), "n": 2, "id": range(7, 25_007), "host": ["a", None] * 12_500})
    entries = B._packed(rows)
    assert len(entries) == 3 and all(isinstance(e, bytes) for e, in entries)
    back = B._unpacked(entries)
    assert [tuple(r) for r in back.itertuples(index=False)] == [tuple(r) for r in rows[back.columns].itertuples(index=False)]
    assert B._packed(rows.head(0)) == [] and len(B._unpacked([])) == 0


def test_closing_rows_are_made_of_the_written_ones(spark, fresh_dir):
    times = ["2024-01-01 00:00:00", "2024-01-01 00:10:00"]
    rows = spark.createDataFrame([(t, i) for i, t in enumerate(times)], "ts string, i int").withColumn("ts", F.col("ts").cast("timestamp"))
    read = []

    def last(written):
        read.extend(written.inputFiles())
        return written.agg(F.max("ts").alias("ts"), F.lit(9).alias("i"))

    out = replay(spark, {"rows": rows}, lambda rows: rows, closing={"rows": last}, folder=fresh_dir)
    assert sorted(r["i"] for r in out.collect()) == [0, 1, 9] and read and all("staged" in f for f in read)
