from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from logwarden.operators import correlate as C
from logwarden.operators.sweep import within_reach

M = 1_000_000


@pytest.mark.parametrize("cell", [1, 7, 120])
def test_sweep_equals_every_pair(spark, cell):
    rng = random.Random(cell)
    times = lambda: rng.choice([rng.randrange(-40 * M, 200 * M), 7 * M * rng.randrange(30)])
    points = [(rng.choice("aab"), times(), rng.choice([1, 1, 3])) for _ in range(150)] + [(None, 5, 1), ("a", None, 1)]
    probes = []
    for i in range(80):
        low = times()
        probes.append((rng.choice(["a", "b", "c"]), i, low, low + rng.choice([0, 1, 7 * M, 30 * M, -1])))
    probes += [(None, 90, 0, 10 * M), ("a", 91, None, 10 * M)]
    points = [(*p, f"t{j:03}") for j, p in enumerate(points)]
    got = within_reach(
        spark.createDataFrame(probes, "k string, probe int, low bigint, high bigint").withColumn("told", -F.col("probe")),
        spark.createDataFrame(points, "k string, us bigint, n bigint, told string"), ["k"], cell).collect()
    want = {}
    for k, i, low, high in probes:
        hit = [(us, t, n) for pk, us, n, t in points if k and pk == k and us is not None and low is not None and low <= us <= high]
        if hit:
            want[i] = (-i, sum(n for *_, n in hit), min(hit)[0], min(hit)[1], max(hit)[0])
    assert {r.probe: (r.told, r.n, r.first_us, r.first, r.last_us) for r in got} == want and len(want) > 20


def test_probes_that_are_points(spark):
    rng = random.Random(1)
    rows = [(k, us, 1 + us % 3) for k in "ab" for us in rng.sample(range(0, 300 * M, M // 2), 60)]
    frame = spark.createDataFrame(rows, "k string, us bigint, n bigint")
    got = within_reach(frame.select("k", F.struct("k", "us").alias("probe"), F.col("us").alias("told"), "n",
                                    (F.col("us") - 20 * M).alias("low"), F.col("us").alias("high")), None, ["k"], 10).collect()
    want = {}
    for k, us, _ in rows:
        hit = [(at, n) for pk, at, n in rows if pk == k and us - 20 * M <= at <= us]
        want[k, us] = (us, sum(n for _, n in hit), min(hit)[0], min(hit)[0], us)
    assert {tuple(r.probe): (r.told, r.n, r.first_us, r.first, r.last_us) for r in got} == want


def test_sweep_of_nothing(spark):
    probes = spark.createDataFrame([("a", 1, 0, 9, 0)], "k string, probe int, low bigint, high bigint, told int")
    points = spark.createDataFrame([("a", 5, 1, 0)], "k string, us bigint, n bigint, told int")
    assert within_reach(probes, points, ["k"]).count() == 1
    assert within_reach(probes.limit(0), points, ["k"]).count() == 0 == within_reach(probes, points.limit(0), ["k"]).count()


def _side(spark, n, **columns):
    names = ["src_ip", "dst_ip", "agent_host", "mitre_technique", "event_details", "logon_type", "event_id", "dst_port",
             "sent_bytes", "action", "source"]
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp()
    at = F.timestamp_micros(F.lit(int(start) * M) + F.pmod(F.xxhash64("id"), F.lit(600 * M)))
    return spark.range(n).select("id", at.alias("ts"), *[F.lit(columns.get(c, "")).alias(c) for c in names])


def test_busy_address_is_counted_without_pairs(spark):
    """100,000 x 100,000 rows of one address in ten minutes are 10^10 pairs of one rule."""
    n = 100_000
    w = _side(spark, n, src_ip="10.0.0.1", agent_host="h", event_id="4624", logon_type="3", mitre_technique="T1021")
    f = _side(spark, n, src_ip="10.0.0.1", dst_port="445", action="ALLOW")
    got = C.pair_incidents(w, f, [C.LATERAL]).agg(
        F.count("*").alias("n"), F.sum(F.regexp_extract("description", r"and (\d+) more", 1).cast("bigint")).alias("more")).first()
    assert (got.n, got.more) == (n, n * (n - 1))


def test_incidents_equal_their_pairs(spark):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    names = ["id", "ts", "src_ip", "dst_ip", "agent_host", "mitre_technique", "event_details", "logon_type", "event_id", "dst_port",
             "sent_bytes", "action", "source"]
    text = "id bigint, ts timestamp, " + ", ".join(f"{c} string" for c in names[2:])

    def rows(n):
        pick = rng.choice
        return [(i, start + dt.timedelta(seconds=rng.randrange(4000)), pick(["a", "b", "", None]), pick(["x", "y", "", None]),
                 pick(["a", "h", None]), pick(["T1571", "T1003", "", None]), "", pick(["3", "2"]), pick(["4624", "1"]),
                 pick(["4444", "445", "80", None]), pick(["10000000", "5", ""]), pick(["ALLOW", "DROP", None]), "s") for i in range(n)]

    w, f = spark.createDataFrame(rows(150), text), spark.createDataFrame(rows(200), text)
    for mode in ("intent", "reference"):
        pairs = C._pairs(w, f, None, None, mode, 1).groupBy("kind", "w_id").agg(
            F.count("*").alias("n"), F.min("right_ts").alias("first"), F.max("right_ts").alias("last"), F.first("left_ts").alias("left_ts"))
        want = sorted((r.kind, r.n, min(r.left_ts, r.first), max(r.left_ts, r.last)) for r in pairs.collect())
        more = F.coalesce(F.regexp_extract("description", r"and (\d+) more", 1).try_cast("bigint"), F.lit(0)) + 1
        told = C.pair_incidents(w, f, mode=mode).select("incident_type", F.when(F.col("description").isNotNull(), more).alias("n"),
                                                        "window_start", "window_end").collect()
        assert sorted((k, s, e) for k, _, s, e in want) == sorted((r[0], r[2], r[3]) for r in told)
        assert {k for k, *_ in want} == set(C.PAIR_RULES)
        assert sorted((r[0], r[1]) for r in told if r[1]) and all((r[0], r[1], r[2], r[3]) in set(want) for r in told if r[1])
