"""Lines are read once, however many values they have and however many of them are asked for."""

from __future__ import annotations

import json
import time

from pyspark.sql import functions as F

from logwarden.operators import profiles as P


def _seconds(run):
    start = time.monotonic()
    return run(), time.monotonic() - start


def test_wide_and_deep_json(spark):
    wide = {f"k{i}": {"v": str(i), "t": '{"x":1}'} for i in range(300)}
    deep: dict = {"end": 1}
    for _ in range(40):
        deep = {"d": deep}
    lines = spark.createDataFrame([(0, json.dumps(wide)), (1, json.dumps(deep)), (2, None), (3, '{"a":{}}'), (4, '{"a":1,"a":2}')], "id int, raw_log string")
    names = ["k0_v", "k299_v", "k7_t", "_".join(["d"] * 40) + "_end"]

    def run():
        parsed = P.parse_json(lines, {"k0_v": "k299_v"}, {"field": "k5_v", "format": "epoch"}, flatten=True)
        return {r["id"]: r for r in parsed.select("id", "error", "fields", *[F.try_element_at("fields", F.lit(n)).alias(n) for n in names]).collect()}

    found, seconds = _seconds(run)
    assert (found[0]["k0_v"], found[0]["k299_v"], found[0]["k7_t"], len(found[0]["fields"])) == (None, "299", '{"x":1}', 600)
    assert found[1][names[3]] == "1" and found[2]["error"] == P.JSON_ERROR and found[3]["fields"] == {} and found[4]["error"] == P.JSON_ERROR
    assert seconds < 30  # minutes where each value is read anew for each other one


def test_cef_with_many_pairs(spark):
    pairs = " ".join(f"k{i}=v{i}" for i in range(400))
    rows = [(0, f"CEF:01|a|b|c|d|e|5|{pairs} k3=last"), (1, "CEF:0|a|b|c|d|e|5|x=1|y=2\n"), (2, "CEF:x|a|b|c|d|e|5|x=1"), (3, None), (4, "CEF:1|||||||"),
            (5, "CEF:1|a\nb|b|c|d|e|5|x=1"), (6, "CEF:1|a|b|c|d|e|5|x=1\ny=2")]
    lines = spark.createDataFrame(rows, "id int, raw_log string")
    many = spark.range(7, 107, 1, 4).select(F.col("id").cast("int"), F.lit(rows[0][1]).alias("raw_log"))
    found, seconds = _seconds(lambda: {r["id"]: r for r in P.parse_cef(lines.union(many), {"name": "log"}).collect()})
    assert (found[0]["fields"]["ext_k3"], found[0]["fields"]["cef_version"], found[0]["fields"]["log"], len(found[0]["fields"])) == ("last", "1", "e", 408)
    assert found[1]["fields"]["extension"] == "x=1|y=2" and found[1]["fields"]["ext_x"] == "1|y=2"
    assert found[2]["error"] == P.CEF_ERROR and found[3]["error"] is None and found[3]["fields"] is None
    assert found[4]["fields"]["extension"] == "" and found[5]["fields"]["device_vendor"] == "a\nb" and found[6]["error"] == P.CEF_ERROR
    assert found[106]["fields"] == found[0]["fields"] and seconds < 15


def test_a_cef_line_is_matched_once(spark):
    lines = spark.createDataFrame([("CEF:1|a|b|c|d|e|5|x=1",)], "raw_log string")
    plan = P.parse_cef(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract(" not in plan and plan.count("RLIKE") <= 1


def test_lines_of_one_row_group_are_dealt_to_all_tasks(spark, tmp_path):
    from logwarden.plans import ingest

    rows = spark.range(40).selectExpr(
        "CASE WHEN id % 8 < 7 THEN id END AS event_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts", "id % 9 AS user_id",
        "'click' AS event_type", "1.0D AS value", "'{}' AS props")
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    for read in (ingest.parse_json_lines, ingest.parse_cef_lines, ingest.parse_json_depths):
        parsed = read(spark, str(tmp_path))
        plan = parsed._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("RepartitionByExpression") > max(plan.find("from_json"), plan.find("RLIKE"))  # parsed after rows are dealt
        assert len(parsed.collect()) == 40
