"""Parsing by stored profile and evidence of the analyzers."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from logwarden.operators import analyzers as A
from logwarden.operators import ingest as N
from logwarden.operators import profiles as P
from logwarden.operators.registry import SEED_PROFILES

PROFILE = "parser_id string, parser_name string, format_type string, parsing_rules string, field_mappings string, timestamp_config string, validation_rules string"


def profiles(spark, *rows):
    names = [c.split()[0] for c in PROFILE.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], PROFILE)


def parsed(spark, parsers, lines):
    df = spark.createDataFrame(lines, "parser_id string, raw_log string").withColumn("ingest_ts", F.lit("2024-01-02 00:00:00"))
    return {r["raw_log"]: r for r in N.parse_by_profile(df, parsers).collect()}


def test_seed_profiles_are_rows(spark):
    cells = "2024-01-02 03:04:05,comp,sub,u,1,r,2,n,in,out,10.0.0.1,10.0.0.2,1,2,TCP,t,l,hello,1"
    line = '{"src_ip":"10.0.0.9","message":"m","a":{"b":{"c":1}}}'
    out = parsed(spark, profiles(spark, *SEED_PROFILES), [("sophos-fw-csv-v1", cells), ("generic-json-v1", line), ("none", "x"), ("generic-json-v1", None),
                                                          ("sophos-fw-csv-v1", "a,b"), ("generic-json-v1", "  "), ("generic-json-v1", "[1]")])
    csv = out[cells]["fields"]
    assert (csv["timestamp"], csv["source_ip"], csv["log"]) == ("2024-01-02T03:04:05", "10.0.0.1", "hello")
    assert out[line]["fields"] == {"source_ip": "10.0.0.9", "log": "m", "a_b_c": "1"}
    assert out["x"]["error"] == N.NO_PARSER and out[None]["error"] == N.EMPTY_LINE and out["  "]["error"] == N.EMPTY_LINE
    assert out["a,b"]["error"] == P.COLUMN_ERROR and out["[1]"]["error"] == P.JSON_ERROR


def test_delimiters_and_separators_are_data(spark):
    rows, lines = [], []
    for i, d in enumerate([",", ";", "|", "\t", "^", "]", "."]):
        rows.append({"parser_id": f"c{i}", "parser_name": "c", "format_type": "csv", "parsing_rules": json.dumps({"delimiter": d, "columns": ["a", "b", "c"]})})
        lines.append((f"c{i}", f'x{i}{d}"y{d}""z"""{d}'))
    rows.append({"parser_id": "k", "parser_name": "k", "format_type": "KEY_VALUE",
                 "parsing_rules": json.dumps({"pair_delimiter": "&", "key_value_separator": "=>", "quote_char": "'"}), "field_mappings": '{"u":"user"}'})
    lines.append(("k", "u=>'a & b'&v=>2&u=>last"))
    out = parsed(spark, profiles(spark, *rows), lines)
    for i, d in enumerate([",", ";", "|", "\t", "^", "]", "."]):
        assert out[lines[i][1]]["fields"] == {"a": f"x{i}", "b": f'y{d}"z"', "c": None}, d
    assert out[lines[-1][1]]["fields"] == {"user": "last", "v": "2"}


def test_layouts_are_data(spark):
    layouts = {
        "%a %b %d %H:%M:%S %Y": ("Fri Oct 13 13:15:37 2023", "2023-10-13T13:15:37"), "%c": ("Sat Oct 14 13:15:37 2023", "2023-10-14T13:15:37"),
        "%A, %d %B %Y %X": ("Friday, 13 October 2023 01:02:03", "2023-10-13T01:02:03"), "%x": ("10/13/23", "2023-10-13T00:00:00"),
        "%Y-%m-%d %H:%M:%S %Z": ("2023-10-13 01:02:03 UTC", "2023-10-13T01:02:03"), "%a %d": ("13 Oct", "13 Oct"), "%U": ("41", "41"),
        "%d/%b/%Y:%H:%M:%S %z": ("10/Oct/2023:13:55:36 -0730", "2023-10-10T13:55:36-07:30"), "%Y-%m-%dT%H:%M:%S.%f": ("2024-02-03T04:05:06.25", "2024-02-03T04:05:06.250000"),
        "epoch": ("1704067200", "2024-01-01T00:00:00"), "epoch_ms": ("1704067200123", "2024-01-01T00:00:00.123000"),
    }
    rows = [{"parser_id": k, "parser_name": k, "format_type": "CSV", "parsing_rules": '{"delimiter":"\\t","columns":["when","rest"]}',
             "timestamp_config": json.dumps({"field": "when", "format": k})} for k in layouts]
    out = parsed(spark, profiles(spark, *rows), [(k, f"{v}\tr") for k, (v, _) in layouts.items()])
    assert {k: out[f"{v}\tr"]["fields"]["timestamp"] for k, (v, _) in layouts.items()} == {k: iso for k, (_, iso) in layouts.items()}
    for k, (v, iso) in layouts.items():  # the version with a literal layout says the same
        assert spark.range(1).select(P.profile_time(F.lit(v), k)).first()[0] == iso


def test_violations_follow_the_profile(spark):
    rules = json.dumps({"required_fields": ["a"], "ip_fields": ["ip"], "port_fields": ["port"], "numeric_fields": ["n"], "timestamp_fields": ["t"]})
    rows = [{"parser_id": "k", "parser_name": "k", "format_type": "KEY_VALUE", "validation_rules": rules},
            {"parser_id": "free", "parser_name": "f", "format_type": "KEY_VALUE"}]
    lines = [("k", "a=1 ip=1.2.3.4 port=80 n=1.5 t=1704067200 action=deny"), ("k", "ip=x port=0 n=y t=z action=dance"), ("free", "ip=x port=0 n=y"), ("gone", "q")]
    df = spark.createDataFrame(lines, "parser_id string, raw_log string").withColumn("ingest_ts", F.lit("2024-01-02 00:00:00"))
    out = {r["raw_log"]: r["violations"] for r in N.profile_violations(N.parse_by_profile(df, profiles(spark, *rows))).collect()}
    assert out[lines[0][1]] == [] and out[lines[2][1]] == [] and out["q"] == []
    assert sorted(out[lines[1][1]]) == ["ip:ip", "numeric:n", "port:port", "required:a", "timestamp:t", "value:action"]


def test_evidence_has_all_peers_and_ports(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start, "fw", "dev", "10.0.0.1", f"10.1.{i // 200}.{i % 200}", 1000 + i, None, "deny", None, "x") for i in range(300)]
    logs = spark.createDataFrame(rows, "id long, ts timestamp, source_type string, source_system string, source_ip string, dest_ip string, dst_port int, "
                                       "username string, action string, status_code int, log string")
    found = A.port_scans(logs).first()
    assert len(json.loads(found["indicators"])["scanned_ports"]) == A.LISTED_PORTS
    rows = A.evidence(logs).groupBy("analyzer", "window_start", "key", "kind").count().collect()
    assert {r["count"] for r in rows if r["analyzer"] == "port_scans" and r["kind"] == "port"} == {300}
    assert {r["count"] for r in rows if r["key"] == "10.0.0.1" and r["kind"] == "dest"} == {300}
