from __future__ import annotations

import pytest

from logwarden.functions import patterns as N
from logwarden.operators.endpoint import detect_endpoint
from logwarden.operators.endpoint_rules import ALL_RULES
from logwarden.operators.firewall import detect_firewall
from logwarden.plans import templates as T

#: Never reached: upper-case patterns, events the rule is not called for, or
#: an earlier rule with a wider condition.
DEAD = {"EP-030", "EP-059", "EP-074", "EP-082", "EP-085", "EP-106", "EP-112", "EP-123"}


@pytest.fixture(scope="module")
def verdicts(spark):
    names = ", ".join(["tid", *T.FIELDS])
    df = spark.sql(f"SELECT *, '10.0.0.9' AS ipaddress_3 FROM ({T.template_values(True)}) AS t({names})")
    return {r.tid: r for r in detect_endpoint(df).collect()}


def test_every_template_gets_its_expected_verdict(verdicts):
    wrong = []
    for tid, (row, want, _) in enumerate(T.TEMPLATES):
        r = verdicts[tid]
        if (r.rule_id, r.severity, r.mitre_technique, r.detection_module) != want:
            wrong.append((row["eventid_0"], row["commandline_2"], want, r.rule_id))
    assert wrong == []


def test_every_rule_is_hit_or_known_to_be_dead():
    hit = {want[0] for _, want, _ in T.TEMPLATES}
    assert {r.rule_id for r in ALL_RULES} - hit == DEAD
    assert len(ALL_RULES) == 133


def by_rule(verdicts, rule_id):
    return next(r for r in verdicts.values() if r.rule_id == rule_id)


@pytest.mark.parametrize("rule_id, details, context", [
    ("EP-001", "Encoded PowerShell command detected", "Base64 encoded command execution is commonly used to evade detection"),
    ("EP-018", "Connection to suspicious port: 4444", "Non-standard port may indicate C2 communication"),
    ("EP-019", "PowerShell network connection", "PowerShell connecting to 203.0.113.10:443"),
    ("EP-036", "Remote thread creation in system process", "c:\\a.exe -> c:\\w\\explorer.exe"),
    ("EP-037", "RDP logon detected", "User: alice, Source: 10.0.0.9"),
    ("EP-043", "Suspicious service installation", "Upd: c:\\temp\\u.exe"),
    ("EP-051", "RDP session connected", "User: al, Client: W1"),
    ("EP-108", "Automated exfiltration activity", "Scheduled data transmission detected to 203.0.113.20"),
    ("EP-109", "C2 exfiltration channel detected", "Data transmission over C2"),
    ("EP-131", "Drive-by compromise detected", "Compromised website infection spawned from browser: c:\\chrome.exe"),
    ("EP-132", "Public-facing app exploitation", "Web application vulnerability exploitation from parent: c:\\w3wp.exe"),
])
def test_details_and_context(verdicts, rule_id, details, context):
    r = by_rule(verdicts, rule_id)
    assert (r.event_details, r.additional_context) == (details, context)


def test_ransom_extension_is_the_first_listed(spark):
    df = spark.createDataFrame([("Sysmon", "23", "x.encrypted")], "logsource_5 string, eventid_0 string, targetfilename_2 string")
    assert detect_endpoint(df).first().additional_context == "Ransomware file extension: encrypted"


def test_intent_mode_lets_upper_case_alternatives_match(spark):
    df = spark.createDataFrame([("Sysmon", "1", "Get-Clipboard")], "logsource_5 string, eventid_0 string, commandline_2 string")
    assert detect_endpoint(df).first().rule_id == ""
    assert detect_endpoint(df, mode="intent").first().rule_id == "EP-063"


def test_null_fields_count_as_empty(spark):
    df = spark.createDataFrame([(None, None, None)], "logsource_5 string, eventid_0 string, commandline_2 string")
    assert detect_endpoint(df).first().severity == "INFO"


@pytest.mark.parametrize("pattern, words", [
    (r"xcopy.*[d-z]:\\", ["xcopy", ":\\"]), (r"net\s+(user|group)", ["net"]), (r"^[a-z0-9]{8,20}\.(com|net)$", []),
    (r"-e(nc)?[\s]+[a-z]{20,}", ["-e"]), (r"ab?cd+e", ["cd"]),
])
def test_required_words(pattern, words):
    assert N.required_words(pattern) == words


def test_required_words_never_exclude_a_match():
    import random
    import re

    rng = random.Random(7)
    patterns = [r"copy.*\\temp\\", r"ms\d{2}-\d{3}", r"7z\.exe.*a.*-p", r"net\s+(user|group)", r"ping.*-t.*-l.*65500"]
    pieces = ["copy", "\\temp\\", "ms17-010", "7z.exe", " a ", "-p", "net user", "ping", "-t", "-l", "65500", "x"]
    for _ in range(2000):
        text = "".join(rng.choice(pieces) for _ in range(6))
        for p in patterns:
            if re.search(p, text):
                assert all(w in text for w in N.required_words(p))


def test_shares_pattern_keeps_its_backslash():
    assert N.java_regex(r"copy.*\\shares\s$") == r"(?d)copy.*\\shares[\t\n\f\r ]\z"


def test_dollar_means_end_of_text(spark):
    df = spark.createDataFrame([("a.tk",), ("a.tk\n",)], "q string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(N.matches(F.col("q"), r"\.(tk|ml)$")).collect()] == [True, False]


@pytest.mark.parametrize("row, want", [
    (dict(log_type="IDP ips", severity="Critical"), ("CRITICAL", "IDS_IPS_ALERT", "T1190")),
    (dict(log_component="Intrusion x"), ("HIGH", "IDS_IPS_ALERT", "T1190")),
    (dict(dst_port="4444", action="drop"), ("HIGH", "C2_PORT_OUTBOUND", "T1571")),
    (dict(dst_port="4444", action="ALLOW"), ("CRITICAL", "C2_PORT_OUTBOUND", "T1571")),
    (dict(dst_port="22", src_zone_type="wan", dst_zone_type="lan", action="allow"), ("HIGH", "EXTERNAL_ACCESS_SENSITIVE_PORT", "T1021.001")),
    (dict(dst_port="445", src_zone_type="wan", dst_zone_type="lan"), ("MEDIUM", "EXTERNAL_ACCESS_SENSITIVE_PORT", "T1133")),
    (dict(dst_port="445", src_zone_type="lan", dst_zone_type="lan"), ("MEDIUM", "LATERAL_MOVEMENT_INDICATOR", "T1021")),
    (dict(sent_bytes="50000001", src_zone_type="lan", dst_zone_type="wan"), ("MEDIUM", "LARGE_OUTBOUND_TRANSFER", "T1041")),
    (dict(sent_bytes="50000000", src_zone_type="lan", dst_zone_type="wan"), ("INFO", "", "")),
    (dict(sent_bytes="abc", src_zone_type="lan", dst_zone_type="wan"), ("INFO", "", "")),
    (dict(dst_port="53", protocol="tcp"), ("MEDIUM", "DNS_OVER_TCP", "T1071.004")),
    (dict(dst_port="80", protocol="udp"), ("LOW", "PROTOCOL_ANOMALY", "T1571")),
    (dict(dst_port="80", protocol=""), ("INFO", "", "")),
    (dict(action="Reject"), ("LOW", "FIREWALL_DENY", "")),
])
def test_firewall_rules(spark, row, want):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    r = detect_firewall(df).first()
    assert (r.threat_level, r.threat_type, r.mitre_technique) == want
