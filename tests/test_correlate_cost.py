"""What the correlation rules work out and sort."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from logwarden.operators import correlate as C
from logwarden.operators import projections as P
from logwarden.operators.sweep import within_reach


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_address_is_worked_out_once(spark):
    texts = [c for c in P.EVENT_COLUMNS if c not in ("id", "ts", "src_ip", "action", "dst_port")]
    rows = spark.createDataFrame([(0, 1, "Drop", "22"), (1, 2, "allow", "22"), (2, 3, "none", "22"), (3, None, "Deny", "22"), (4, 4, None, None)],
                                 "id long, n int, action string, dst_port string")
    firewall = rows.select("id", F.timestamp_seconds("id").alias("ts"), "action", "dst_port", F.concat(F.lit("10.9.9."), F.col("n").cast("string")).alias("src_ip"),
                           *[F.lit("").alias(c) for c in texts])
    side = C._firewall_side(firewall, C.PAIR_RULES, None, "intent")
    assert sorted((r["f_id"], r["key"], r["__f0"], r["__f1"], r["__f2"], r["__f3"]) for r in side.collect()) == [
        (0, "10.9.9.1", False, False, False, True), (1, "10.9.9.2", True, False, True, False)]
    assert _plan(side).count("concat(10.9.9.") == 1


def test_a_cell_is_sorted_once(spark):
    probes = spark.createDataFrame([(0, "a", 10, 40), (1, "a", 30, 30), (2, "a", 31, 39), (3, "a", 0, 500_000_000), (4, "b", 0, 9)],
                                   "probe long, key string, low long, high long").withColumn("told", F.col("key"))
    points = spark.createDataFrame([("a", 10, 1, "z"), ("a", 30, 2, "y"), ("a", 30, 1, None), ("a", 40, 1, "x"), ("a", 400_000_000, 5, "w"), (None, 5, 1, "v")],
                                   "key string, us long, n long, told string")
    found = within_reach(probes, points, ["key"])
    assert sorted((r["probe"], r["n"], r["first_us"], r["first"], r["last_us"]) for r in found.collect()) == [
        (0, 5, 10, "z", 40), (1, 3, 30, None, 30), (3, 10, 10, "z", 400_000_000)]
    orders = set(re.findall(r"us#\d+L? (ASC|DESC)", "\n".join(line for line in _plan(found).splitlines() if "Window [" in line)))
    assert orders == {"ASC"}


def test_incidents_tell_what_is_asked_for(spark):
    details = F.concat(F.lit("told "), F.col("id").cast("string"))
    common = [F.timestamp_seconds(F.col("id") % 900).alias("ts"), F.lit("h").alias("agent_host"), details.alias("event_details")]
    rows = spark.range(60).unionAll(spark.range(30)).withColumn("src_ip", F.concat(F.lit("10.0.0."), (F.col("id") % 3).cast("string")))
    ids = F.when(F.col("id") % 7 > 0, F.col("id") % 20).alias("id")  # repeated and absent
    endpoint = rows.select(ids, "src_ip", F.lit("x").alias("dst_ip"), *common, F.lit("T1003,T1571").alias("mitre_technique"),
                           F.when(F.col("id") % 2 == 0, "4624").otherwise("1").alias("event_id"), F.lit("3").alias("logon_type"))
    firewall = rows.select(ids, "src_ip", F.lit("x").alias("dst_ip"), *common, F.lit("T1").alias("mitre_technique"), F.lit("22").alias("dst_port"),
                           F.when(F.col("id") % 2 == 0, "ALLOW").otherwise("DROP").alias("action"), F.lit("20000000").alias("sent_bytes"))
    whole = C.pair_incidents(endpoint, firewall).cache()
    assert whole.select("incident_type").distinct().count() == 4 and whole.columns == C.INCIDENT_COLUMNS
    small = ["incident_type", "affected_ip", "window_start"]
    for columns in (small, ["incident_key", "affected_host", "mitre_techniques", "window_end"]):
        asked = C.pair_incidents(endpoint, firewall, columns=columns)
        assert asked.columns == columns and sorted(asked.collect()) == sorted(whole.select(*columns).collect())
    assert "told " not in _plan(C.pair_incidents(endpoint, firewall, columns=small)) and "told " in _plan(C.pair_incidents(endpoint, firewall))


def test_alerts_of_pass_rows_are_looked_for_once(spark):
    from logwarden.plans.windowing import correlate_pass_rows
    from tests.conftest import SF

    plan = [re.sub(r"#\d+L?", "", line.lstrip(" :+-")) for line in _plan(correlate_pass_rows(spark, SF)).splitlines()]
    read = set()
    for i, line in enumerate(plan):
        if line.startswith("Aggregate") and "min_by(struct(ts" in line:
            end = next(j for j in range(i, len(plan)) if "Relation [" in plan[j])
            read.add("\n".join(plan[i + 1 : end + 1]))
    assert len(read) == 2  # both uses of the alerts of a source read the same rows in the same way
