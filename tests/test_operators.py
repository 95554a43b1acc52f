from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from logwarden.operators import chains as H
from logwarden.operators import correlate as C
from logwarden.operators import dedup as D
from logwarden.operators import formats as M
from logwarden.operators import prefilter as R
from logwarden.operators import profiles as P
from logwarden.operators import projections as J
from logwarden.operators import registry as G
from logwarden.operators import syslog as L
from logwarden.operators import taxonomy as T
from logwarden.operators import windowed as X
from logwarden.operators import windows as W
from logwarden.sources import payloads as S
from logwarden.sources import sinks

UTC = dt.timezone.utc
T0 = dt.datetime(2024, 1, 1, tzinfo=UTC)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


# ------------------------------------------------------------- firewall lines

LINES = [
    '<134>date=2024-02-29 time=08:15:30 devname="edge-7" devid="D-4471" logid="77" type="session" subtype="local" level="info" '
    'srcip=172.16.5.9 srcport=50123 srcintf="dmz1" srcintfrole="dmz" dstip=198.51.100.20 dstport=8443 dstintf="up0" '
    'dstintfrole="wan" proto=6 action="close" policyid=42 service="web" sentbyte=512 rcvdbyte=2048 sentpkt=4 rcvdpkt=6 msg="done"',
    '<11>2024-03-03T23:59:59+01:00 gate log_type="Filter" action="REJECT" src_ip="172.16.0.8" dst_ip="203.0.113.9" dst_port=25 '
    'protocol="udp" message="no mail from here"',
    "CEF:0|Maker|Box|1.4|S-9|some event|7|src=172.16.0.1 dst=203.0.113.77 spt=40000 dpt=22 proto=6 act=DENY",
    "   ",
    'a="unclosed b=2 c= d="" e="x y" e=last',
]


def test_firewall_lines(spark):
    df = spark.createDataFrame([(i, t, "192.0.2.1", T0) for i, t in enumerate(LINES)], "i int, raw_log string, sensor_ip string, ingest_ts timestamp")
    rows = {r.i: r for r in L.normalize_firewall(df).collect()}
    a, b, c = rows[0], rows[1], rows[2]
    assert (a.device_name, a.log_type, a.log_subtype, a.src_ip, a.dst_ip, a.protocol, a.fw_rule_id, a.sent_bytes, a.recv_bytes) == (
        "edge-7", "session", "local", "172.16.5.9", "198.51.100.20", "TCP", "42", "512", "2048")
    assert (a.log_date, a.log_time, a.src_zone, a.dst_zone_type) == ("", "", "dmz1", "wan")
    assert (b.log_type, b.action, b.dst_port, b.protocol) == ("Filter", "REJECT", "25", "udp")
    assert (c.log_component, c.src_ip, c.dst_ip) == ("S-9", "172.16.0.1", "203.0.113.77")
    assert 3 not in rows


def test_pairs_last_wins_and_empty_values_are_skipped(spark):
    df = spark.createDataFrame([(LINES[4],)], "t string").select(L.pairs(F.col("t")).alias("p"))
    found = [(p["key"], p["value"]) for p in df.first().p]
    assert found == [("e", "last"), ("e", "x y"), ("a", "unclosed b=2 c= d=")]


# ------------------------------------------------------------------ suppression


def greedy(rows, window):
    out, anchor, dropped = [], None, 0
    for us, ident in sorted(rows):
        if anchor is not None and us - anchor < window:
            dropped += 1
            continue
        out.append((us, ident, 0 if anchor is None else dropped + 1))
        anchor, dropped = us, 0
    return out


def anchors(spark, rows, **kw):
    df = spark.createDataFrame(rows, "fp string, us long, id long")
    return {(r.fp, r.us, r.id, r.duplicate_count) for r in D.suppression_anchors(df, **kw).collect()}


def test_suppression_worked_example(spark):
    offsets = [0, 60, 299, 300, 599, 600]
    got = anchors(spark, [("a", s * 1_000_000, i) for i, s in enumerate(offsets)])
    assert {(us // 1_000_000, n) for _, us, _, n in got} == {(0, 0), (300, 3), (600, 2)}


@pytest.mark.parametrize("seed, span, count", [(1, 4000, 600), (2, 400_000, 900), (3, 100, 500)])
def test_suppression_equals_greedy_walk(spark, seed, span, count):
    rng = random.Random(seed)
    rows = [(rng.choice("aaaab"), rng.randrange(span) * 1_000_000 + rng.choice([0, 1]), i) for i in range(count)]
    want = {(fp, *r) for fp in "ab" for r in greedy([(u, i) for f, u, i in rows if f == fp], 300_000_000)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # groups are cut by batches
    try:
        assert anchors(spark, rows, chunk_seconds=1200) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_plain_info_rows_bypass_suppression(spark):
    rows = [(1, "h", "INFO", "", at(0)), (2, "h", "INFO", "", at(1)), (3, "h", "INFO", "T1", at(2)), (4, "h", "INFO", "T1", at(3))]
    df = spark.createDataFrame(rows, "id long, agent_host string, severity string, mitre_technique string, ts timestamp")
    assert {r.id for r in D.suppress_repeats(df).collect()} == {1, 2, 3}


# ------------------------------------------------------------------ correlation

E = {"id": 1, "ts": at(0), "source": "windows", "event_id": "3", "src_ip": "10.0.0.1", "dst_ip": "9.9.9.9", "dst_port": "1",
     "agent_host": "h", "mitre_technique": "T1571", "severity": "HIGH", "event_details": "e", "action": "", "sent_bytes": "",
     "command_line": "", "image_path": "", "granted_access": "", "logon_type": ""}
FW = {**E, "source": "firewall", "event_id": "x/y", "dst_port": "4444", "action": "ALLOW", "sent_bytes": "10000000",
      "agent_host": "", "event_details": "f", "dst_ip": "8.8.8.8"}
SCHEMA = "id long, ts timestamp, " + ", ".join(f"{c} string" for c in J.EVENT_COLUMNS[2:])


def events(spark, base, *changes):
    rows = [{**base, "id": i + 1, **c} for i, c in enumerate(changes)]
    return spark.createDataFrame([tuple(r[c] for c in J.EVENT_COLUMNS) for r in rows], SCHEMA)


def kinds(incidents):
    return sorted(r.incident_type for r in incidents.collect())


@pytest.mark.parametrize("fw, hits", [
    ({"ts": at(600)}, 1), ({"ts": at(-600)}, 1), ({"ts": at(600) + dt.timedelta(microseconds=1)}, 0),
    ({"action": "allow"}, 1), ({"action": "DROP"}, 0), ({"dst_port": "80"}, 0), ({"dst_port": "80", "dst_ip": "9.9.9.9"}, 1),
    ({"src_ip": "h"}, 1), ({"src_ip": "other"}, 0),
])
def test_c2_beacon(spark, fw, hits):
    got = C.c2_beacon(events(spark, E, {}), events(spark, FW, {"ts": at(0), **fw}))
    assert got.count() == hits


def test_c2_beacon_matches_empty_addresses_only_in_reference_mode(spark):
    w, f = events(spark, E, {"src_ip": ""}), events(spark, FW, {"src_ip": ""})
    assert C.c2_beacon(w, f, mode="reference").count() == 1
    assert C.c2_beacon(w, f).count() == 0


@pytest.mark.parametrize("gap, sent, hits", [
    (0, "10000000", 1), (600, "10000000", 1), (601, "10000000", 0), (-1, "10000000", 0), (5, "9999999", 0), (5, "abc", 0)])
def test_credential_dump_exfil(spark, gap, sent, hits):
    w = events(spark, E, {"mitre_technique": "T1003.001"})
    assert C.credential_dump_exfil(w, events(spark, FW, {"ts": at(gap), "sent_bytes": sent})).count() == hits


@pytest.mark.parametrize("gap, hits", [(0, 0), (1, 1), (600, 1), (601, 0), (-5, 0)])
def test_firewall_bypass_needs_a_later_logon(spark, gap, hits):
    w = events(spark, E, {"event_id": "4624", "mitre_technique": "", "ts": at(gap)})
    assert C.firewall_bypass(w, events(spark, FW, {"action": "Deny"})).count() == hits


@pytest.mark.parametrize("logon, ip, hits", [("10", "10.0.0.1", 1), ("3", "10.0.0.1", 1), ("2", "10.0.0.1", 0), ("10", "-", 0)])
def test_lateral_movement(spark, logon, ip, hits):
    w = events(spark, E, {"event_id": "4624", "logon_type": logon, "src_ip": ip, "mitre_technique": "T1021.001"})
    got = C.lateral_movement(w, events(spark, FW, {"dst_port": "445", "src_ip": ip})).collect()
    assert len(got) == hits
    if hits:
        assert got[0].mitre_techniques == "T1021,T1021.001"


@pytest.mark.parametrize("failures, hits", [(4, 0), (5, 1)])
def test_brute_force_needs_five_failures(spark, failures, hits):
    w = events(spark, E, *[{"event_id": "4625", "ts": at(i * 60)} for i in range(failures)])
    f = events(spark, FW, {"dst_port": "3389", "action": "DROP", "ts": at(590)}, {"dst_port": "80", "action": "DROP"})
    for as_of in (None, at(600)):
        got = C.brute_force(w, f, as_of).collect()
        assert len(got) == hits
        if hits:
            assert got[0].description == "Brute force confirmed: 10.0.0.1 caused 5 Windows logon failures + 1 firewall blocks"


def test_salting_and_partitioning_do_not_change_the_result(spark):
    rng = random.Random(5)
    w = events(spark, E, *[{"ts": at(rng.randrange(4000)), "src_ip": rng.choice(["a", "a", "b"])} for _ in range(60)])
    f = events(spark, FW, *[{"ts": at(rng.randrange(4000)), "src_ip": rng.choice(["a", "a", "b"])} for _ in range(80)])
    want = {r.incident_key for r in C.correlate_all(w, f).collect()}
    near = [[abs((a.ts - b.ts).total_seconds()) <= 600 and a.src_ip == b.src_ip for b in f.collect()] for a in w.collect()]
    assert len(want) == sum(map(any, near)) and C.pair_matches(w, f).count() == sum(map(sum, near))
    told = [r.description for r in C.correlate_all(w, f).collect()]
    assert sum(int(t.split("(and ")[1].split()[0]) + 1 if "(and " in t else 1 for t in told) == sum(map(sum, near))
    assert {r.incident_key for r in C.correlate_all(w.repartition(7), f.repartition(3), salt=4).collect()} == want


def test_incidents_are_added_once(spark, fresh_dir):
    found = C.c2_beacon(events(spark, E, {}), events(spark, FW, {}, {"ts": at(9)}))
    for _ in range(2):
        sinks.append_new_incidents(found, fresh_dir + "/incidents")
    assert spark.read.parquet(fresh_dir + "/incidents").count() == 1


def test_pass_rows_correlate_after_their_source_fields_are_added(spark):
    w = events(spark, E, {"event_id": "4624", "logon_type": "10", "mitre_technique": "T1021.001"})
    f = events(spark, FW, {"dst_port": "445"})
    as_pass = lambda df: df.withColumn("action", F.lit("")).withColumn("logon_type", F.lit(""))
    assert C.lateral_movement(as_pass(w), as_pass(f)).count() == 0
    assert C.lateral_movement(J.with_source_fields(as_pass(w), w), J.with_source_fields(as_pass(f), f)).count() == 1


# ------------------------------------------------------------- window verdicts

INPUT = ("source_event_id long, source_type string, ts timestamp, agent_host string, event_id string, rule_severity string, "
         "mitre_technique string, detection_module string, event_details string, src_ip string, dst_ip string, dst_port string, "
         "process_name string, command_line string, action string, sent_bytes string")


def window_input(spark, *rows):
    return spark.createDataFrame([
        (i, "windows", at(s), "h", "1", sev, mitre, "m", details, src, "", "", f"p{i}", "", "", "")
        for i, (s, sev, mitre, details, src) in enumerate(rows)], INPUT)


def test_low_row_of_a_critical_window_ends_critical(spark):
    df = window_input(spark, (0, "LOW", "", "first", "1.1.1.1"), (1, "HIGH", "T1", "second", "2.2.2.2"), (7, "LOW", "T2", "", ""))
    rows = {r.source_event_id: r for r in W.rule_pass_rows(W.window_batches(df)).collect()}
    assert rows[0].final_severity == "CRITICAL" and rows[0].llm_confidence == 0.9
    assert rows[0].final_summary == "first | IOA: mitre:T1" and rows[0].llm_ioc_values == "1.1.1.1" and rows[0].llm_is_ioc
    assert rows[2].final_severity == "MEDIUM" and rows[2].final_summary == "No malicious activity detected. | IOA: mitre:T2"


def test_only_critical_row_of_a_busy_window_is_the_last(spark):
    many = spark.range(100_000).select(
        F.col("id").alias("source_event_id"), F.lit("windows").alias("source_type"),
        (F.lit(at(0)).cast("timestamp") + F.make_dt_interval(secs=F.col("id") / 25_000)).alias("ts"), F.lit("h").alias("agent_host"),
        F.lit("1").alias("event_id"), F.when(F.col("id") == 99_999, "CRITICAL").otherwise("LOW").alias("rule_severity"),
        F.lit("").alias("mitre_technique"), F.lit("m").alias("detection_module"), F.lit("d").alias("event_details"),
        F.concat(F.lit("10.0."), F.col("id").cast("string")).alias("src_ip"), F.lit("").alias("dst_ip"), F.lit("").alias("dst_port"),
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("process_name"), F.lit("").alias("command_line"),
        F.lit("").alias("action"), F.lit("").alias("sent_bytes"))
    (got,) = W.window_verdicts(W.window_batches(many)).collect()
    assert (got.verdict, got.rows, got.iocs, got.ioa) == ("Critical", 100_000, 100_000, [])
    texts = W.window_texts(W.window_batches(many.limit(1000)))
    assert texts.count() == 20 and texts.agg(F.max(F.length("text"))).first()[0] < 20_000


def test_scorer_answers_and_falls_back(spark):
    df = window_input(spark, (0, "LOW", "T1", "a", ""), (10, "LOW", "T2", "b", ""), (20, "LOW", "T3", "c", ""))

    def scorer(text):
        if "T2" in text:
            raise RuntimeError("down")
        if "T3" in text:
            return "no json here"
        return 'Sure: {"verdict": " CRITICAL ", "reasoning": "", "ioc": ["x"], "ioa": []} done'

    got = {r.window_ts.second: r for r in W.score_windows(W.window_batches(df), scorer).collect()}
    assert (got[0].verdict, got[0].reasoning, got[0].iocs, got[0].model) == ("Critical", W.NOTHING, 1, "scorer")
    assert (got[10].verdict, got[10].model) == ("Warning", "passthrough")
    assert (got[20].verdict, got[20].model) == ("Warning", "passthrough")


# ------------------------------------------------------- windowed correlation


def test_last_closed_window():
    start, end = X.last_closed_window(dt.datetime(2024, 1, 1, 10, 29, 59, tzinfo=UTC))
    assert (start.minute, end.minute) == (10, 20)


@pytest.mark.parametrize("answer, label, confidence", [
    ('{"label": "Malicious", "score": "0.5"}', "malicious", 0.5), ('{"verdict": " malicious ", "probability": 0.2}', "malicious", 0.2),
    ('{"score": 1}', "benign", 1.0), ('{"classification": "Benign"}', "benign", 0.0)])
def test_tolerant_answers(spark, answer, label, confidence):
    r = spark.createDataFrame([(answer,)], "a string").select(X.read_label(F.col("a")), X.read_confidence(F.col("a"))).first()
    assert tuple(r) == (label, confidence)


def test_user_classifier_gates_by_confidence(spark):
    df = spark.createDataFrame([(1, "evil 0.30"), (2, "evil 0.29")], "id long, final_summary string")
    got = X.classify(df, lambda texts: [json.dumps({"label": "malicious", "score": float(t.split()[1])}) for t in texts])
    assert {r.id: r.classification for r in got.collect()} == {1: "malicious", 2: "benign"}


def test_assessment_and_incidents_of_answers(spark):
    counts = spark.createDataFrame([(at(0), 1, 0, 1, 0, 0), (at(600), 1, 1, 0, 0, 0), (at(1200), 0, 0, 0, 2, 0)],
                                   "window_start timestamp, windows_total long, windows_malicious long, windows_benign long, firewall_total long, scada_total long")
    answer = json.dumps({"overall_assessment": " MALICIOUS", "confidence": 0.8, "incident_candidates": [
        {"incident_type": "X", "affected_host": " ", "mitre_techniques": ["T1", "T2"], "evidence": ["a"]}]})
    answers = spark.createDataFrame([(at(600), at(1200), "note " + answer)], "window_start timestamp, window_end timestamp, answer string")
    clean = answers.withColumn("answer", F.regexp_extract("answer", r"(\{.*\})", 1))
    got = {r.window_start.minute: (r.assessment, r.assessment_confidence) for r in X.assess(counts, clean).collect()}
    assert got == {0: ("healthy", 1.0), 10: ("malicious", 0.8), 20: ("suspicious", 0.0)}
    i = X.incidents_from_answers(answers).first()
    assert (i.affected_host, i.mitre_techniques, i.evidence, i.source_count) == (None, "T1,T2", '{"evidence":["a"]}', 3)


def test_an_answered_error_fails_the_window(spark):
    df = spark.createDataFrame([(1, "x")], "id long, final_summary string")
    with pytest.raises(Exception, match="classifier error: down"):
        X.classify(df, lambda texts: ['{"error": " down ", "label": "benign"}' for _ in texts]).collect()


def test_ledger_opens_failed_and_expired_windows(spark):
    w = spark.createDataFrame([(at(0), at(600))], "window_start timestamp, window_end timestamp")

    def when(seconds):
        return F.lit(at(seconds)).cast("timestamp")

    claim = X.claim_rows(w, when(700), run="a")
    assert X.open_windows(w, claim, when(800)).count() == 0 and X.open_windows(w, claim, when(5000)).count() == 1
    failed = claim.unionByName(X.failure_rows(w, when(701), F.lit("e" * 2000), run="a"))
    r = X.latest_state(failed).first()
    assert r.status == "failed" and len(r.error_text) == 2000
    assert X.open_windows(w, failed, when(702)).count() == 1
    done = claim.unionByName(X.ledger_rows(w, "done", when(701), run="a")).unionByName(X.claim_rows(w, when(900), run="b"))
    assert X.open_windows(w, done, when(9000)).count() == 0
    both = claim.unionByName(X.claim_rows(w, when(700), run="b"))
    assert X.won_windows(both, "a", when(701)).count() == 1 and X.won_windows(both, "b", when(701)).count() == 0


def test_payload_and_chain_json(spark):
    rows = [(1, at(0), "h", "Microsoft-Windows-Sysmon", "1", "{c}", "{p}", "5", "4"), (2, at(1), "h", "Microsoft-Windows-Sysmon", "5", "{c}", "", "5", "")]
    df = spark.createDataFrame(rows, "id long, ts timestamp, agent_host string, providername_0 string, eventid_0 string, processguid_2 string, parentprocessguid_2 string, processid_2 string, parentprocessid_2 string")
    hosts = spark.createDataFrame([(at(0), "h"), (at(0), "idle")], "window_start timestamp, host string")
    got = {(r.host, r.chain_type): r for r in H.process_chains(H.process_rows(df), hosts).collect()}
    tree = json.loads(got["h", "creation_tree"].chain_json)
    assert tree["{c}"] == {"last_seen": "2024-01-01T00:00:01Z", "process_id": "5", "children": None, "parents": ["{p}"]}
    assert tree["{p}"]["children"] == ["{c}"] and tree["{p}"]["process_id"] == "4"
    assert got["idle", "creation_tree"].chain_json == "{}" and got["h", "source_target_tree"].nodes == 0


# ------------------------------------------------------------------- parsing

SAMPLES = {
    "csv": ["2025-10-13 13:15:37,Firewall,Allowed,192.168.0.62,162.159.61.3,443,TCP"] * 3,
    "json": ['{"timestamp":"2025-10-13T13:15:37Z","src_ip":"192.168.0.62","dst_ip":"162.159.61.3","action":"Allowed"}'] * 2,
    "syslog": ["<134>Oct 13 13:15:37 firewall kernel: DROP IN=eth0 OUT= SRC=192.168.0.62 DST=162.159.61.3"] * 2,
    "kv": ["time=2025-10-13T13:15:37 src_ip=192.168.0.62 dst_ip=162.159.61.3 action=Allowed protocol=TCP"] * 2,
    "header": ["Time,Src IP,Bytes", "2025-10-13 13:15:37,10.0.0.1,5", "2025-10-13 13:15:38,10.0.0.2,6"],
    "one": ["a,b,c"], "half": ['{"a":1}', "x", '{"a":2}'],
    "late": ['{"a":1}'] * 12 + ["junk"] * 300, "texts": ['{"k":"[x]"}'] * 2, "deep": ['{"k":[1]}'] * 2,
}


def test_format_samples(spark):
    rows = [(s, i, t) for s, lines in SAMPLES.items() for i, t in enumerate(lines)]
    df = spark.createDataFrame(rows, "source string, line_no long, raw_log string")
    got = {r.source: r for r in M.profile_sources(df).collect()}
    assert {s: r.format_type for s, r in got.items()} == {
        "csv": "CSV", "json": "JSON", "syslog": "SYSLOG", "kv": "KEY_VALUE", "header": "CSV", "one": "RAW", "half": "RAW",
        "late": "RAW", "texts": "JSON", "deep": "JSON"}
    assert not got["texts"].nested and got["deep"].nested and got["late"].lines == 312
    assert got["header"].has_header and got["header"].keys == ["Time", "Src IP", "Bytes"]
    assert (got["header"].timestamp_field, got["header"].timestamp_format) == ("Time", "%Y-%m-%d %H:%M:%S")
    assert got["header"].ip_columns == ["Src IP"] and not got["csv"].has_header
    assert got["json"].timestamp_field == "timestamp" and got["json"].nested is False


def test_millisecond_times_are_taken_for_seconds(spark):
    assert spark.range(1).select(M.timestamp_layout(F.lit("1697289337000"))).first()[0] == "epoch"


def test_profile_time_keeps_what_it_cannot_read(spark):
    r = spark.range(1).select(
        P.profile_time(F.lit("13/10/2025"), "%d/%m/%Y"), P.profile_time(F.lit("x"), "epoch"), P.profile_time(F.lit("0"), "epoch_ms")).first()
    assert tuple(r) == ("2025-10-13T00:00:00", "x", "1970-01-01T00:00:00")


def test_collection_filter_joins_pairs_with_or(spark):
    rows = [(1, "Sysmon", "3", "C:\\x.exe", "10.1.1.1"), (2, "Sysmon", "3", "C:\\Windows\\System32\\svchost.exe", "8.8.8.8"),
            (3, "Sysmon", "3", "C:\\x.exe", "8.8.8.8"), (4, "Security", "3", "", "10.1.1.1"), (5, "Sysmon", "99", "", "")]
    df = spark.createDataFrame(rows, "id long, logsource_5 string, eventid_0 string, image_2 string, destinationip_2 string")
    assert {r.id for r in R.collection_filter(df).collect()} == {3, 4, 5}
    assert sum(len(v) for *_, v in R.RULES) < 200


def test_taxonomy_prefers_exact_over_alias_over_part(spark):
    names = ["Source IP", "srcIP", "the_src_ip_col", "priority", "nothing"]
    df = T.map_keys(spark.createDataFrame([(n,) for n in names], "key string"))
    assert [r.standard for r in df.collect()] == ["source_ip", "source_ip", "source_ip", "severity", None]


def test_parser_statistics_example(spark):
    p = spark.createDataFrame([("p", 0, None, None, None)], "parser_id string, logs_processed long, parse_success_rate double, avg_parse_time_ms long, last_used timestamp")
    u = spark.createDataFrame([("p", T0, 100, 95, 1500)], "parser_id string, timestamp timestamp, logs_count long, success_count long, parse_time_ms long")
    r = G.merge_statistics(p, G.usage_rows(u)).first()
    assert (r.logs_processed, r.parse_success_rate, r.avg_parse_time_ms) == (100, 95.0, 15)


def test_payloads_reject_what_is_not_json(spark):
    values = ['[{"LogSource_5":"Sysmon","EventID_0":"1","TimeCreated_0":"2024-01-01T05:30:00.1234567+05:30"}]', "[1", "text", '{"EventID_0":"2"}']
    df = spark.createDataFrame([(v, T0) for v in values], "value string, ingest_ts timestamp")
    rows = {r.eventid_0: r.event_time.isoformat() for r in S.endpoint_events(df).select("eventid_0", "event_time").collect()}
    assert rows["1"].endswith("00:00:00.123456") and rows["2"].endswith("00:00:00")
    from logwarden.schemas import ENDPOINT_WIRE

    assert S.rejected_payloads(df, ENDPOINT_WIRE).count() == 2


def test_rows_are_partitioned_by_day(spark, fresh_dir):
    df = spark.createDataFrame([(1, at(0)), (2, at(90_000))], "id long, ts timestamp")
    sinks.append_events(df, fresh_dir + "/t", "ts")
    back = spark.read.parquet(fresh_dir + "/t").filter(F.col("event_date") == "2024-01-02")
    assert [r.id for r in back.collect()] == [2]
    assert "PartitionFilters: [isnotnull(event_date" in back._jdf.queryExecution().executedPlan().toString()


def test_replacing_windows_keeps_the_others(spark, fresh_dir):
    df = spark.createDataFrame([(at(0), 1), (at(600), 1)], "window_start timestamp, n int")
    sinks.replace_windows(df, fresh_dir + "/w")
    sinks.replace_windows(df.limit(1).withColumn("n", F.lit(2)), fresh_dir + "/w")
    assert sorted(r.n for r in spark.read.parquet(fresh_dir + "/w").collect()) == [1, 2]
