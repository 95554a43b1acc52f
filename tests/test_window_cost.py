"""What the window and payload steps read and carry."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F

from logwarden.operators import windows as W
from logwarden.sources import payloads as S

_COLUMNS = ["agent_host", "event_id", "rule_severity", "mitre_technique", "detection_module", "event_details", "src_ip", "dst_ip", "dst_port",
            "process_name", "command_line", "action", "sent_bytes"]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _inputs(spark, *rows):
    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    filled = [(i, "windows", at + dt.timedelta(seconds=s), *[row.get(c, "x") for c in _COLUMNS]) for i, (s, row) in enumerate(rows)]
    return spark.createDataFrame(filled, "source_event_id long, source_type string, ts timestamp, " + ", ".join(f"{c} string" for c in _COLUMNS))


def test_payloads_are_read_once(spark):
    given = spark.createDataFrame([(0, ' [{"src_ip":"a"},{"src_ip":"b"}] '), (1, '{"src_ip":"c"}'), (2, "{broken"), (3, None), (4, "[]"), (5, "7")], "id int, value string")
    rows = S.firewall_events(given.withColumn("ingest_ts", F.lit("2024-01-02").cast("timestamp")))
    assert sorted((r["id"], r["src_ip"]) for r in rows.collect()) == [(0, "a"), (0, "b"), (1, "c")]
    assert len(re.findall(r"from_json\(", _plan(rows))) == 2  # an array and an object, each in one place


def test_an_alert_is_carried_once(spark):
    inputs = _inputs(spark, (1, {"agent_host": None}), (2, {"agent_host": ""}), (0, {"agent_host": "", "dst_ip": "y", "src_ip": None}), (3, {"agent_host": "h"}), (6, {}))
    batches = W.window_batches(inputs)
    found = {r["source_event_id"]: r for r in batches.collect()}
    assert sorted(found) == [0, 2, 3, 4] and batches.columns == W.assign_windows(inputs).columns
    assert found[0]["agent_host"] is None and found[2]["agent_host"] == "" and found[2]["src_ip"] is None
    whole = {r["source_event_id"]: r for r in W.assign_windows(inputs).collect()}
    assert all(found[i] == whole[i] for i in found)
    carried = re.search(r"min_by\(struct\((.*?)\), struct", _plan(batches))
    assert carried and "command_line" in carried[1] and "process_name," not in carried[1] and "fingerprint" not in carried[1]


def test_sorts_compare_a_number_first(spark):
    batches = W.window_batches(_inputs(spark, (0, {}), (1, {"dst_ip": "y"})))
    for steps in (batches, W.window_verdicts(batches), W.window_texts(batches)):
        plan = steps._jdf.queryExecution().executedPlan().toString()
        grouping = re.findall(r"SortAggregate\(key=\[(\w+)", plan) + re.findall(r"ObjectHashAggregate\(keys?=\[(\w+)", plan)
        assert grouping and set(grouping) <= {"__h", "_groupingexpression"}


def test_only_the_technique_of_a_row_carries_its_details(spark):
    inputs = _inputs(
        spark, (2, {"mitre_technique": "T2", "event_details": " late ", "src_ip": " "}), (1, {"mitre_technique": "", "event_details": "first", "dst_ip": None, "dst_port": ""}),
        (0, {"mitre_technique": None, "event_details": " ", "rule_severity": "high"}), (3, {"mitre_technique": "T1", "event_details": None, "agent_host": "h"}), (4, {"mitre_technique": "T2"}))
    batches = W.window_batches(inputs)
    got = W.window_verdicts(batches).first().asDict()
    assert (got["verdict"], got["reasoning"], got["iocs"], got["ioa"], got["rows"]) == ("Critical", "first", 2, ["mitre:T2", "mitre:T1"], 4)  # the last is the first once more
    found = {(r["kind"], r["value"]): (r["rows"], r["first_us"] % 5_000_000) for r in W.window_evidence(batches).collect()}
    assert found == {("ioc", "x"): (6, 0), ("ioc", "port:x"): (3, 0), ("ioa", "mitre:T2"): (1, 2_000_000), ("ioa", "mitre:T1"): (1, 3_000_000)}
    plan = _plan(W.window_verdicts(batches))
    assert re.search(r"CASE WHEN \(i#\d+ = 3\) THEN details#\d+ END AS details", plan)
