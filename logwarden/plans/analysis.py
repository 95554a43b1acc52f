"""Analyzer, windowed-correlation, process-chain and hunting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from logwarden.functions.times import micros, parse_scada_time
from logwarden.operators import analyzers as A
from logwarden.operators import chains as H
from logwarden.operators import correlate as C
from logwarden.operators import hunting as U
from logwarden.operators import windowed as X
from logwarden.plans import views as V
from logwarden.plans.catalog import query
from logwarden.plans.correlation import ALL_SQL, BOTH, BURST_CTE, sides
from logwarden.plans.detection import SEC, firewall_verdicts, security_verdicts
from logwarden.plans.windowing import PASS_CTE, WINDOW_SQL, pass_table

# ------------------------------------------------------------------ analyzers

_SLOTS = """
p0 AS (
  SELECT *, lower(coalesce(action, '')) AS act, us // 10000000 AS slot FROM parsed
),
p AS (
  SELECT *, act IN ('deny','block','reject') AS denied,
         act IN ('deny','fail','error') OR coalesce(status_code, 0) >= 400 AS failed,
         act IN ('allow','success') OR coalesce(status_code, 200) < 300 AS okish
  FROM p0
),
pw AS (SELECT p.*, p.slot - s.k AS w FROM p, (SELECT unnest([0,1,2,3,4,5]) AS k) s)"""
PARSED = V.with_views(V.SQL_PARSED, _SLOTS)

IP_SQL = """
ipw AS (SELECT source_ip AS ip, * FROM pw WHERE source_ip IS NOT NULL UNION ALL SELECT dest_ip, * FROM pw WHERE dest_ip IS NOT NULL),
ipa AS (
  SELECT w, ip, count(*) AS n, count(*) FILTER (WHERE denied) AS denied, count(DISTINCT dest_ip) AS dests, count(DISTINCT dst_port) AS ports,
         count(DISTINCT source_type) AS types, min(us) AS first_us, max(us) AS last_us,
         string_agg(DISTINCT source_system, ',' ORDER BY source_system) AS sources, count(DISTINCT source_system) AS n_sources,
         coalesce(string_agg(DISTINCT username, ',' ORDER BY username), '') AS users,
         list_sort(list_distinct(list(dest_ip) FILTER (WHERE dest_ip IS NOT NULL AND dest_ip <> ip))) AS peers
  FROM ipw GROUP BY ALL HAVING count(*) >= 5
),
ipc AS (
  SELECT w, ip, string_agg('''' || action || ''': ' || k, ', ' ORDER BY action) AS listed
  FROM (SELECT w, ip, action, count(*) AS k FROM ipw WHERE action IS NOT NULL GROUP BY ALL) GROUP BY ALL
),
ips AS (
  SELECT ipa.*, coalesce(peers, []) AS peers2, coalesce(listed, '') AS listed, CASE WHEN denied > 10 OR dests > 20 OR ports > 50 THEN 'CRITICAL'
         WHEN denied > 5 OR dests > 10 OR types > 2 THEN 'WARNING' END AS severity
  FROM ipa LEFT JOIN ipc USING (w, ip)
),
r_ip AS (
  SELECT 'ip_' || replace(ip, '.', '_') || '_' || (w * 10) AS correlation_id, 'ip_activity' AS correlation_type, severity,
         'Suspicious IP Activity: ' || ip AS title,
         'IP ' || ip || ' generated ' || n || ' events across ' || n_sources || ' sources. Actions: {' || listed || '}. '
           || CASE WHEN len(peers2) > 0 THEN 'Contacted ' || len(peers2) || ' unique destinations.' ELSE '' END AS description,
         w * 10000000 AS window_us, first_us, last_us, sources,
         array_to_string(list_concat([ip], peers2[1:10]), ',') AS ips, users, n AS event_count,
         CASE severity WHEN 'CRITICAL' THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence_score
  FROM ips WHERE severity IS NOT NULL
)"""
USER_SQL = """
ua AS (
  SELECT w, username, count(*) AS n, count(*) FILTER (WHERE failed) AS failed, count(DISTINCT source_ip) AS addresses,
         count(DISTINCT source_type) AS types, min(us) AS first_us, max(us) AS last_us,
         string_agg(DISTINCT source_system, ',' ORDER BY source_system) AS sources, count(DISTINCT source_system) AS n_sources,
         coalesce(string_agg(DISTINCT source_ip, ',' ORDER BY source_ip), '') AS ips
  FROM pw WHERE username IS NOT NULL GROUP BY ALL HAVING count(*) >= 3
),
r_user AS (
  SELECT 'user_' || username || '_' || (w * 10) AS correlation_id, 'user_activity' AS correlation_type,
         CASE WHEN failed > 5 OR addresses > 5 THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
         'Suspicious User Activity: ' || username AS title,
         'User ' || username || ' generated ' || n || ' events across ' || n_sources || ' sources from ' || addresses || ' IP(s).' AS description,
         w * 10000000 AS window_us, first_us, last_us, sources, ips, username AS users, n AS event_count,
         CASE WHEN failed > 5 OR addresses > 5 THEN 0.6 ELSE 0.4 END::DOUBLE AS confidence_score
  FROM ua WHERE failed > 5 OR addresses > 5 OR failed > 2 OR types > 2
)"""
SCAN_SQL = """
r_scan AS (
  SELECT 'portscan_' || replace(source_ip, '.', '_') || '_' || (w * 10) AS correlation_id, 'attack_sequence' AS correlation_type,
         'CRITICAL' AS severity, 'Port Scanning Detected: ' || source_ip AS title,
         'IP ' || source_ip || ' attempted to access ' || count(DISTINCT dst_port) || ' different ports, indicating possible port scanning.' AS description,
         w * 10000000 AS window_us, min(us) AS first_us, max(us) AS last_us,
         string_agg(DISTINCT source_system, ',' ORDER BY source_system) AS sources, source_ip AS ips, '' AS users,
         count(*) AS event_count, 0.9::DOUBLE AS confidence_score
  FROM pw WHERE source_ip IS NOT NULL AND dst_port IS NOT NULL GROUP BY w, source_ip HAVING count(DISTINCT dst_port) > {minimum}
)"""
LOGIN_SQL = """
la AS (
  SELECT w, source_ip, username, count(*) AS n, count(*) FILTER (WHERE failed) AS failed, count(*) FILTER (WHERE NOT failed) AS ok,
         min(us) AS first_us, max(us) AS last_us, string_agg(DISTINCT source_system, ',' ORDER BY source_system) AS sources
  FROM pw WHERE source_ip IS NOT NULL AND username IS NOT NULL AND (failed OR okish) GROUP BY ALL
),
r_login AS (
  SELECT 'bruteforce_' || source_ip || '_' || username || '_' || (w * 10) AS correlation_id, 'attack_sequence' AS correlation_type,
         CASE WHEN ok > 0 THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
         'Brute Force Attack: ' || source_ip || ' → ' || username || CASE WHEN ok > 0 THEN ' (SUCCESSFUL)' ELSE '' END AS title,
         'IP ' || source_ip || ' made ' || failed || ' failed authentication attempts for user ' || username || '. '
           || CASE WHEN ok > 0 THEN ok || ' successful login(s) detected.' ELSE 'No successful login.' END AS description,
         w * 10000000 AS window_us, first_us, last_us, sources, source_ip AS ips, username AS users, n AS event_count,
         CASE WHEN ok > 0 THEN 0.95 ELSE 0.75 END::DOUBLE AS confidence_score
  FROM la WHERE failed > {minimum}
)"""


def _flat(results):
    return results.select(
        "correlation_id", "correlation_type", "severity", "title", "description", micros("window_start").alias("window_us"),
        micros("start_time").alias("first_us"), micros("end_time").alias("last_us"),
        F.array_join("involved_sources", ",").alias("sources"), F.array_join("involved_ips", ",").alias("ips"),
        F.array_join("involved_users", ",").alias("users"), "event_count", "confidence_score",
    )


@query("analyze_ip_activity", PARSED + "," + IP_SQL + " SELECT * FROM r_ip")
def analyze_ip_activity(spark, sf):
    return _flat(A.ip_activity(V.parsed(spark, sf)))


@query("analyze_user_activity", PARSED + "," + USER_SQL + " SELECT * FROM r_user")
def analyze_user_activity(spark, sf):
    return _flat(A.user_activity(V.parsed(spark, sf)))


@query("analyze_port_scans", PARSED + "," + SCAN_SQL.format(minimum=14) + " SELECT * FROM r_scan")
def analyze_port_scans(spark, sf):
    return _flat(A.port_scans(V.parsed(spark, sf), minimum=14))


@query("analyze_login_attacks", PARSED + "," + LOGIN_SQL.format(minimum=1) + " SELECT * FROM r_login")
def analyze_login_attacks(spark, sf):
    return _flat(A.login_attacks(V.parsed(spark, sf), minimum=1))


ALL_ANALYZERS_SQL = PARSED + "," + ",".join([
    IP_SQL, USER_SQL, SCAN_SQL.format(minimum=20), LOGIN_SQL.format(minimum=5),
    """results AS (SELECT * FROM r_ip UNION ALL SELECT * FROM r_user UNION ALL SELECT * FROM r_scan UNION ALL SELECT * FROM r_login)"""])


@query("analyze_all", ALL_ANALYZERS_SQL + " SELECT * FROM results")
def analyze_all(spark, sf):
    return _flat(A.run_analyzers(V.parsed(spark, sf)))


@query("analyzer_first_events", PARSED + "," + USER_SQL + """,
rk AS (SELECT pw.w, pw.username, pw.id, row_number() OVER (PARTITION BY pw.w, pw.username ORDER BY us, id) AS rn FROM pw
  JOIN r_user r ON r.window_us = pw.w * 10000000 AND r.users = pw.username)
SELECT w * 10000000 AS window_us, username, string_agg(id, ',' ORDER BY rn) AS ids FROM rk WHERE rn <= 20 GROUP BY ALL""")
def analyzer_first_events(spark, sf):
    logs = V.parsed(spark, sf)
    found = A.user_activity(logs).select("window_start", F.col("involved_users")[0].alias("username"))
    listed = A.first_events(logs.withColumn("log", F.col("id").cast("string")), found, "username", ["log"])
    ids = F.transform(F.from_json("events", "array<struct<log:string>>"), lambda e: e["log"])
    return listed.select(micros("window_start").alias("window_us"), "username", F.array_join(ids, ",").alias("ids"))


_SIDES = " UNION ALL ".join(
    f"SELECT w, {key} AS key, '{name}' AS analyzer, '{kind}' AS kind, CAST({column} AS VARCHAR) AS value, us FROM {table} WHERE {key} IS NOT NULL{more}"
    for name, table, key, more, kinds in (
        ("ip_activity", "pw2", "ip", "", {"type": "source_type", "dest": "dest_ip", "port": "dst_port", "source": "source_system", "user": "username", "action": "action"}),
        ("user_activity", "pw", "username", "", {"type": "source_type", "ip": "source_ip", "source": "source_system"}),
        ("port_scans", "pw", "source_ip", " AND dst_port IS NOT NULL", {"port": "dst_port", "source": "source_system"}),
    ) for kind, column in kinds.items())


@query("analyzer_evidence", PARSED + "," + IP_SQL + "," + USER_SQL + "," + SCAN_SQL.format(minimum=14) + f""",
pw2 AS (SELECT *, unnest(list_filter([source_ip, dest_ip], lambda x: x IS NOT NULL)) AS ip FROM pw),
sides AS ({_SIDES}),
hit AS (
  SELECT window_us, string_split(ips, ',')[1] AS key, 'ip_activity' AS analyzer FROM r_ip
  UNION ALL SELECT window_us, users, 'user_activity' FROM r_user UNION ALL SELECT window_us, ips, 'port_scans' FROM r_scan
)
SELECT analyzer, window_us, key, kind, value, count(*) AS events, min(us) AS first_us, max(us) AS last_us
FROM sides JOIN hit USING (analyzer, key) WHERE w * 10000000 = window_us AND value IS NOT NULL GROUP BY ALL""")
def analyzer_evidence(spark, sf):
    found = A.evidence(V.parsed(spark, sf), {"port_scans": {"minimum": 14}})
    return found.select("analyzer", micros("window_start").alias("window_us"), "key", "kind", "value", "events",
                        micros("first_seen").alias("first_us"), micros("last_seen").alias("last_us"))


# ------------------------------------------------------------ process chains

_EDGE = """
ed AS (SELECT *, us // 600000000 * 600000000 AS w FROM edges WHERE is_sysmon),
cn AS (
  SELECT w, host, pg AS guid, us, id, 0 AS i, pid FROM ed WHERE pg <> ''
  UNION ALL SELECT w, host, ppg, us, id, 1, ppid FROM ed WHERE ev = '1' AND ppg <> ''
),
ce AS (SELECT w, host, pg AS child, ppg AS parent, min((us, id)) AS o FROM ed WHERE ev = '1' AND pg <> '' AND ppg <> '' GROUP BY ALL),
sn AS (
  SELECT w, host, sg AS guid, us, id, 0 AS i, sid AS pid FROM ed WHERE ev IN ('8','10') AND sg <> ''
  UNION ALL SELECT w, host, tg, us, id, 1, tpid FROM ed WHERE ev IN ('8','10') AND tg <> ''
),
se AS (SELECT w, host, sg AS src, tg AS dst, min((us, id)) AS o FROM ed WHERE ev IN ('8','10') AND sg <> '' AND tg <> '' GROUP BY ALL),
ct AS (
  SELECT n.w, n.host, n.guid, max(us) AS last_us, arg_min(pid, (us, id, i)) AS process_id FROM cn n GROUP BY ALL
),
stt AS (
  SELECT n.w, n.host, n.guid, max(us) AS last_us, arg_min(pid, (us, id, i)) AS process_id FROM sn n GROUP BY ALL
)"""
EDGES = V.with_views(V.SQL_EDGES, _EDGE)


def _flat_nodes(nodes, a, b):
    return nodes.select(
        micros("window_start").alias("w"), "host", "guid", micros("last_seen").alias("last_us"), "process_id",
        F.coalesce(F.array_join(a, ","), F.lit("")).alias(a), F.coalesce(F.array_join(b, ","), F.lit("")).alias(b),
    )


@query("process_creation_tree", EDGES + """,
k AS (SELECT w, host, parent AS guid, string_agg(child, ',' ORDER BY o) AS children FROM ce GROUP BY ALL),
q AS (SELECT w, host, child AS guid, string_agg(parent, ',' ORDER BY o) AS parents FROM ce GROUP BY ALL)
SELECT ct.*, coalesce(children, '') AS children, coalesce(parents, '') AS parents
FROM ct LEFT JOIN k USING (w, host, guid) LEFT JOIN q USING (w, host, guid)""")
def process_creation_tree(spark, sf):
    return _flat_nodes(H.creation_nodes(H.process_rows(V.process_edges(spark, sf))), "children", "parents")


@query("process_source_target_tree", EDGES + """,
k AS (SELECT w, host, src AS guid, string_agg(dst, ',' ORDER BY o) AS outgoing FROM se GROUP BY ALL),
q AS (SELECT w, host, dst AS guid, string_agg(src, ',' ORDER BY o) AS incoming FROM se GROUP BY ALL)
SELECT stt.*, coalesce(outgoing, '') AS outgoing, coalesce(incoming, '') AS incoming
FROM stt LEFT JOIN k USING (w, host, guid) LEFT JOIN q USING (w, host, guid)""")
def process_source_target_tree(spark, sf):
    return _flat_nodes(H.source_target_nodes(H.process_rows(V.process_edges(spark, sf))), "outgoing", "incoming")


@query("process_chain_rows", EDGES + """,
hosts AS (SELECT DISTINCT w, host FROM (SELECT us // 600000000 * 600000000 AS w, host, id FROM edges) WHERE id % 3 = 0 AND host <> 'host-7'),
u AS (SELECT 'creation_tree' AS chain_type, w, host, count(*) AS nodes FROM ct GROUP BY ALL
      UNION ALL SELECT 'source_target_tree', w, host, count(*) FROM stt GROUP BY ALL)
SELECT h.w, h.host, t.chain_type, coalesce(u.nodes, 0) AS nodes, coalesce(u.nodes, 0) = 0 AS is_empty
FROM hosts h CROSS JOIN (VALUES ('creation_tree'), ('source_target_tree')) t(chain_type)
LEFT JOIN u ON u.w = h.w AND u.host = h.host AND u.chain_type = t.chain_type""")
def process_chain_rows(spark, sf):
    edges = V.process_edges(spark, sf)
    host = F.coalesce(F.nullif("agent_host", F.lit("")), F.nullif("computer_0", F.lit("")), F.lit("unknown"))
    hosts = X.in_windows(edges.filter(F.col("id") % 3 == 0).select(host.alias("host"), "ts"), "ts").filter(
        F.col("host") != "host-7"
    )
    rows = H.process_chains(H.process_rows(edges), hosts)
    return rows.select(
        micros("window_start").alias("w"), "host", "chain_type", "nodes", (F.col("chain_json") == "{}").alias("is_empty")
    )


# ------------------------------------------------------ windowed correlation


def scada_events(spark, sf):
    s = V.scada(spark, sf)
    return s.withColumn("timestamp", parse_scada_time(F.col("timestamp"), F.col("received_at")))


_CV2 = PASS_CTE + """,
dec AS (
  SELECT *, window_us // 600000000 * 600000000 AS w, CASE WHEN final_severity = 'CRITICAL' THEN 'malicious' ELSE 'benign' END AS classification
  FROM passed WHERE source_type = 'windows'
),
fww AS (SELECT *, us // 600000000 * 600000000 AS w FROM fwv),
scw AS (
  SELECT *, ts_us // 600000000 * 600000000 AS w FROM (SELECT *, coalesce(parsed_s * 1000000, us) AS ts_us FROM scada)
),
cnt AS (
  SELECT w, sum(a) AS windows_total, sum(b) AS windows_malicious, sum(a) - sum(b) AS windows_benign, sum(c) AS firewall_total, sum(d) AS scada_total
  FROM (SELECT w, 1 AS a, CASE WHEN classification = 'malicious' THEN 1 ELSE 0 END AS b, 0 AS c, 0 AS d FROM dec
        UNION ALL SELECT w, 0, 0, 1, 0 FROM fww UNION ALL SELECT w, 0, 0, 0, 1 FROM scw) GROUP BY ALL
)"""
CV2 = WINDOW_SQL.replace("WITH ", f"WITH {V.SQL_SCADA.strip()}, ", 1) + _CV2


@query("window_decisions", CV2 + """
SELECT source_event_id AS id, w, classification, CASE final_severity WHEN 'CRITICAL' THEN 0.9 WHEN 'MEDIUM' THEN 0.25 ELSE 0.9 END::DOUBLE AS confidence FROM dec""")
def window_decisions(spark, sf):
    return X.classify(X.window_pass_events(pass_table(spark, sf))).select(
        "id", micros("window_start").alias("w"), "classification", "confidence"
    )


def _counts(spark, sf):
    decisions = X.classify(X.window_pass_events(pass_table(spark, sf)))
    return X.window_counts(
        decisions, X.window_firewall_events(firewall_verdicts(spark, sf)), X.window_scada_events(scada_events(spark, sf))
    )


@query("window_assessment", CV2 + """
SELECT w, windows_total::BIGINT AS windows_total, windows_malicious::BIGINT AS windows_malicious, windows_benign::BIGINT AS windows_benign,
       firewall_total::BIGINT AS firewall_total, scada_total::BIGINT AS scada_total,
       CASE WHEN windows_malicious + firewall_total + scada_total = 0 THEN 'healthy' ELSE 'suspicious' END AS assessment FROM cnt""")
def window_assessment(spark, sf):
    return X.assess(_counts(spark, sf)).withColumn("w", micros("window_start")).drop("window_start", "assessment_confidence")


@query("window_claims", V.with_views(V.SQL_FIREWALL) + """,
w AS (SELECT DISTINCT us // 600000000 AS n FROM fw)
SELECT n * 600000000 AS start_us, (n + 1) * 600000000 AS end_us FROM w WHERE n % 3 <> 0""")
def window_claims(spark, sf):
    windows = X.in_windows(V.firewall(spark, sf).select("ts"), "ts").select("window_start", "window_end").distinct()
    now = F.lit("2024-01-02").cast("timestamp")
    ledger = X.claim_rows(windows.filter(F.unix_seconds("window_start") % 1800 == 0), now)
    open_ = X.open_windows(windows, ledger, now)
    return open_.select(micros("window_start").alias("start_us"), micros("window_end").alias("end_us"))


@query("window_ledger_states", V.with_views(V.SQL_FIREWALL) + """,
w AS (SELECT DISTINCT us // 600000000 AS n FROM fw),
state AS (
  SELECT n, CASE n % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'held' WHEN 2 THEN 'expired' WHEN 3 THEN 'failed' ELSE 'new' END AS state FROM w
)
SELECT n * 600000000 AS start_us, state IN ('expired', 'failed', 'new') AS open FROM state""")
def window_ledger_states(spark, sf):
    """Done, held, expired, failed and new windows: who is open."""
    windows = X.in_windows(V.firewall(spark, sf).select("ts"), "ts").select("window_start", "window_end").distinct()
    now = F.lit("2024-01-02").cast("timestamp")
    kind = (F.unix_seconds("window_start") / 600).cast("long") % 5

    def at(seconds):
        return now - F.expr(f"INTERVAL {seconds} SECONDS")

    ledger = X.claim_rows(windows.filter(kind == 1), at(60))
    for part in (
        X.claim_rows(windows.filter(kind.isin(0, 2, 3)), at(7200)), X.ledger_rows(windows.filter(kind == 0), "done", at(7000)),
        X.failure_rows(windows.filter(kind == 3), at(7000), F.lit("lost")),
    ):
        ledger = ledger.unionByName(part)
    open_ = X.open_windows(windows, ledger, now).withColumn("open", F.lit(True))
    return windows.join(open_, ["window_start", "window_end"], "left").select(
        micros("window_start").alias("start_us"), F.coalesce("open", F.lit(False)).alias("open")
    )


# Answers of a classifier in all the shapes that it may have, drawn by event.
_ANSWERS = [
    '{"classification":"","label":"malicious","score":0.9}', '{"label":" Malicious ","confidence":"0.4"}', '{"classification":5,"verdict":"malicious","probability":0.31}',
    '{"result":"malicious","score":0.1}', '{"label":null,"result":"MALICIOUS!","confidence":1}', '{"score":0.9}', 'no json', '{"label":"benign","confidence":true,"score":0.7}',
]
_SAID = [("benign", 0.9), ("malicious", 0.4), ("malicious", 0.31), ("malicious", 0.1), ("malicious!", 1.0), ("benign", 0.9), ("benign", 0.0), ("benign", 0.7)]


@query("classifier_answers", "WITH said(k, label, confidence) AS (VALUES " + ", ".join(
    f"({k}, '{label}', {confidence}::DOUBLE)" for k, (label, confidence) in enumerate(_SAID)) + """)
SELECT event_id, label, confidence, contains(label, 'malicious') AND confidence >= 0.3 AS malicious FROM events JOIN said ON k = event_id % 8""")
def classifier_answers(spark, sf):
    answer = F.element_at(F.array(*[F.lit(a) for a in _ANSWERS]), (F.col("event_id") % 8 + 1).cast("int"))
    rows = V.table(spark, sf, "events").select("event_id", answer.alias("raw_response"))
    label, confidence = X.read_label(F.col("raw_response")), X.read_confidence(F.col("raw_response"))
    return rows.select(
        "event_id", label.alias("label"), confidence.alias("confidence"),
        (label.contains("malicious") & (confidence >= X.MALICIOUS_CONFIDENCE)).alias("malicious"),
    )


# ------------------------------------------------------------------- hunting

INCIDENTS = BOTH + "," + BURST_CTE + f", inc AS ({ALL_SQL}) "


@query("hunt_critical_alerts", SEC + f"""
SELECT id, us, agent_host, detection_module, mitre_technique, event_details FROM sec
WHERE severity = 'CRITICAL' AND us > {(V.BASE_SECONDS + 11 * 3600) * 1_000_000}""")
def hunt_critical(spark, sf):
    import datetime as dt

    as_of = dt.datetime.fromtimestamp(V.BASE_SECONDS + 12 * 3600, dt.timezone.utc)
    return U.critical_alerts(security_verdicts(spark, sf), as_of).withColumn("us", micros("ts")).drop("ts")


@query("hunt_incidents", INCIDENTS + """
SELECT incident_key, incident_type, severity, affected_ip, end_us FROM inc ORDER BY severity DESC, end_us DESC""")
def hunt_incidents(spark, sf):
    return U.confirmed_incidents(C.correlate_all(*sides(spark, sf))).select(
        "incident_key", "incident_type", "severity", "affected_ip", micros("window_end").alias("end_us")
    )


@query("hunt_top_blocked_sources", V.with_views(V.SQL_FIREWALL) + """
SELECT src_ip, count(*) AS attempts, string_agg(DISTINCT dst_port, ',' ORDER BY dst_port) AS ports_tried
FROM fw WHERE action IN ('DROP','DENY','REJECT') GROUP BY src_ip HAVING count(*) > 10""")
def hunt_blocked(spark, sf):
    return U.top_blocked_sources(V.firewall(spark, sf)).withColumn("ports_tried", F.array_join("ports_tried", ","))


@query("hunt_technique_heatmap", SEC + """
SELECT mitre_technique, detection_module, count(*) AS hits, max(severity) AS max_severity,
       CASE max(CASE severity WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 2 ELSE 1 END)
         WHEN 5 THEN 'CRITICAL' WHEN 4 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' WHEN 2 THEN 'LOW' ELSE 'INFO' END AS top
FROM sec WHERE mitre_technique <> '' GROUP BY ALL""")
def hunt_heatmap(spark, sf):
    return U.technique_heatmap(security_verdicts(spark, sf)).withColumnRenamed("top_severity", "top")


@query("hunt_credential_access", SEC + """
SELECT id, us, agent_host, image_2, grantedaccess_2 FROM sec WHERE mitre_technique LIKE '%T1003%'""")
def hunt_credential(spark, sf):
    return U.credential_access_hosts(security_verdicts(spark, sf)).withColumn("us", micros("ts")).drop("ts")


@query("hunt_large_transfers", V.with_views(V.SQL_FIREWALL) + """
SELECT id, us, src_ip, dst_ip, dst_port, sent_bytes, app_name, TRY_CAST(sent_bytes AS BIGINT) AS bytes FROM fw
WHERE TRY_CAST(sent_bytes AS BIGINT) > 10000000 AND action = 'ALLOW'""")
def hunt_transfers(spark, sf):
    return U.large_transfers(V.firewall(spark, sf)).withColumn("us", micros("ts")).drop("ts")


@query("hunt_table_counts", V.with_views(V.SQL_FIREWALL, V.SQL_PARSED, V.SQL_SCADA) + """
SELECT 'firewall' AS table_name, count(*) AS rows FROM fw UNION ALL SELECT 'parsed', count(*) FROM parsed
UNION ALL SELECT 'scada', count(*) FROM scada""")
def hunt_counts(spark, sf):
    return U.table_counts({
        "firewall": V.firewall(spark, sf), "parsed": V.parsed(spark, sf), "scada": V.scada(spark, sf)})


@query("hunt_newest_events", V.with_views(V.SQL_FIREWALL) + """
SELECT id, us, src_ip, action FROM fw ORDER BY us DESC, id DESC LIMIT 20""")
def hunt_newest(spark, sf):
    return U.newest(V.firewall(spark, sf)).select("id", micros("ts").alias("us"), "src_ip", "action")


@query("hunt_events_per_hour", V.with_views(V.SQL_FIREWALL) + """
SELECT us // 3600000000 * 3600000000 AS hour_us, count(*) AS events FROM fw GROUP BY ALL""")
def hunt_hours(spark, sf):
    return U.events_per_hour(V.firewall(spark, sf)).select(micros("hour").alias("hour_us"), "events")


@query("hunt_logs_per_source", V.with_views(V.SQL_PARSED) + """
SELECT 'system' AS kind, source_system AS name, count(*) AS logs, max(us) AS latest_us FROM parsed GROUP BY ALL
UNION ALL SELECT 'type', source_type, count(*), NULL FROM parsed GROUP BY ALL""")
def hunt_sources(spark, sf):
    logs = V.parsed(spark, sf)
    a = U.logs_per_source(logs).select(
        F.lit("system").alias("kind"), F.col("source_system").alias("name"), "logs", micros("latest").alias("latest_us"))
    b = U.logs_per_type(logs).select(
        F.lit("type").alias("kind"), F.col("source_type").alias("name"), "logs", F.lit(None).cast("bigint").alias("latest_us"))
    return a.unionByName(b)


@query("hunt_findings", ALL_ANALYZERS_SQL + """
SELECT f.correlation_type, f.severity, f.findings, round(t.avg_confidence, 6) AS avg_confidence, t.latest_us FROM
 (SELECT correlation_type, severity, count(*) AS findings FROM results GROUP BY ALL) f
 JOIN (SELECT correlation_type, avg(confidence_score) AS avg_confidence, max(window_us) AS latest_us FROM results GROUP BY ALL) t USING (correlation_type)""")
def hunt_findings(spark, sf):
    results = A.run_analyzers(V.parsed(spark, sf))
    t = U.results_by_confidence(results).select(
        "correlation_type", F.round("avg_confidence", 6).alias("avg_confidence"), micros("latest").alias("latest_us"))
    return U.findings_by_type(results).join(t, "correlation_type")


@query("hunt_attack_types", PARSED + "," + SCAN_SQL.format(minimum=14) + "," + LOGIN_SQL.format(minimum=1) + """
SELECT attack_type, count(*) AS findings FROM (
  SELECT unnest(['port_scanning', 'reconnaissance']) AS attack_type FROM r_scan
  UNION ALL SELECT unnest(['brute_force', 'credential_stuffing']) FROM r_login) GROUP BY attack_type""")
def hunt_attack_types(spark, sf):
    logs = V.parsed(spark, sf)
    found = A.port_scans(logs, minimum=14).unionByName(A.login_attacks(logs, minimum=1))
    return U.attack_types(found)


@query("hunt_results_involving", ALL_ANALYZERS_SQL + """
SELECT correlation_id, 'ip' AS kind FROM results WHERE list_contains(string_split(ips, ','), '10.0.0.3')
UNION ALL SELECT correlation_id, 'user' FROM results WHERE list_contains(string_split(users, ','), 'user4')""")
def hunt_involving(spark, sf):
    results = A.run_analyzers(V.parsed(spark, sf))
    a = U.involving_address(results, "10.0.0.3").select("correlation_id", F.lit("ip").alias("kind"))
    return a.unionByName(U.involving_user(results, "user4").select("correlation_id", F.lit("user").alias("kind")))


@query("hunt_events_per_log_source", SEC + """
SELECT logsource_5, count(*) AS events FROM sec GROUP BY ALL""")
def hunt_log_sources(spark, sf):
    return U.events_per_log_source(V.security(spark, sf))
