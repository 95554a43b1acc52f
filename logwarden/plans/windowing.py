"""Suppression and window-verdict queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from logwarden.functions.text import computed_once
from logwarden.functions.times import micros
from logwarden.operators import correlate as C
from logwarden.operators import dedup as D
from logwarden.operators import projections as P
from logwarden.operators import windows as W
from logwarden.plans import views as V
from logwarden.plans.catalog import ORACLES, query
from logwarden.plans.detection import firewall_verdicts, security_verdicts
from logwarden.streaming import jobs as J
from logwarden.streaming.replay import replay

_FP = "sha256(concat_ws('|', agent_host, eventid_0, mitre_technique, detection_module, image_2, destinationip_2, destinationport_2))"


@query("alert_fingerprints", V.with_views(V.SQL_SECURITY) + f"""
SELECT {_FP} AS fp, count(*) AS alerts, min(us) AS first_us FROM sec WHERE NOT (severity = 'INFO' AND mitre_technique = '') GROUP BY 1""")
def alert_fingerprints(spark, sf):
    df = security_verdicts(spark, sf)
    return df.filter(~D.is_bypassed(df)).groupBy(D.fingerprint(df).alias("fp")).agg(
        F.count("*").alias("alerts"), F.min(micros("ts")).alias("first_us")
    )


# One fingerprint per source address keeps the groups dense.
_NOISE = """keyed AS (SELECT id, us, src_ip || '>' || dst_port AS fp FROM fwv WHERE threat_level <> 'INFO')"""
_GREEDY = """
rn AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY us, id) AS rn FROM keyed),
walk AS (
  SELECT fp, id, us, us AS anchor, rn, CAST(0 AS BIGINT) AS dropped, CAST(0 AS BIGINT) AS duplicate_count, true AS passed FROM rn WHERE rn = 1
  UNION ALL
  SELECT r.fp, r.id, r.us, CASE WHEN r.us - w.anchor < 300000000 THEN w.anchor ELSE r.us END, r.rn,
         CASE WHEN r.us - w.anchor < 300000000 THEN w.dropped + 1 ELSE 0 END,
         CASE WHEN r.us - w.anchor < 300000000 THEN 0 ELSE w.dropped + 1 END,
         NOT (r.us - w.anchor < 300000000)
  FROM walk w JOIN rn r ON r.fp = w.fp AND r.rn = w.rn + 1
)"""


def _noisy(spark, sf):
    return firewall_verdicts(spark, sf).filter(F.col("threat_level") != "INFO").select(
        F.concat("src_ip", F.lit(">"), "dst_port").alias("fp"), micros("ts").alias("us"), "id"
    )


def _recursive(*ctes):
    return V.with_views(*ctes).replace("WITH ", "WITH RECURSIVE ", 1)


@query("alert_suppression", _recursive(V.SQL_FIREWALL, V.SQL_FIREWALL_VERDICT, _NOISE, _GREEDY) + """
SELECT fp, id, us, duplicate_count FROM walk WHERE passed""")
def alert_suppression(spark, sf):
    return D.suppression_anchors(_noisy(spark, sf)).drop("suppressed")


@query("alert_suppression_by_source", _recursive(
    V.SQL_FIREWALL, V.SQL_FIREWALL_VERDICT,
    "keyed AS (SELECT id, us, device_name AS fp FROM fwv WHERE threat_level <> 'INFO')", _GREEDY) + """
SELECT fp, id, us, duplicate_count FROM walk WHERE passed""")
def alert_suppression_by_source(spark, sf):
    return D.suppression_anchors(
        firewall_verdicts(spark, sf).filter(F.col("threat_level") != "INFO")
        .select(F.col("device_name").alias("fp"), micros("ts").alias("us"), "id")
    ).drop("suppressed")


@query("endpoint_suppression", _recursive(V.SQL_SECURITY, f"""
keyed AS (SELECT id, us, {_FP} AS fp FROM sec WHERE NOT (severity = 'INFO' AND mitre_technique = ''))""", _GREEDY) + """
SELECT id, duplicate_count FROM walk WHERE passed
UNION ALL SELECT id, 0 FROM sec WHERE severity = 'INFO' AND mitre_technique = ''""")
def endpoint_suppression(spark, sf):
    return D.suppress_repeats(security_verdicts(spark, sf)).select("id", "duplicate_count")


@query("noise_reduction", _recursive(V.SQL_SECURITY, f"""
keyed AS (SELECT id, us, {_FP} AS fp FROM sec WHERE NOT (severity = 'INFO' AND mitre_technique = ''))""", _GREEDY) + """
SELECT count(*) AS seen, count(*) FILTER (WHERE NOT passed) AS suppressed,
       round(count(*) FILTER (WHERE NOT passed) / count(*) * 100, 4) AS percent FROM walk""")
def noise_reduction(spark, sf):
    return D.noise_reduction(security_verdicts(spark, sf)).withColumn("percent", F.round("percent", 4))


_INPUTS = """
inp AS (
  SELECT id, us, 'windows' AS source_type, agent_host, eventid_0 AS event_id, severity, mitre_technique, detection_module,
         event_details, sourceip_2 AS src_ip, destinationip_2 AS dst_ip, destinationport_2 AS dst_port, image_2 AS process_name,
         commandline_2 AS command_line, '' AS action, '' AS sent_bytes
  FROM sec WHERE severity IN ('LOW','MEDIUM','HIGH','CRITICAL')
  UNION ALL
  SELECT id, us, 'firewall', device_name, log_type, threat_level, mitre_technique, detection_module, event_details,
         src_ip, dst_ip, dst_port, '', '', action, sent_bytes
  FROM fwv WHERE threat_level IN ('LOW','MEDIUM','HIGH','CRITICAL')
),
win AS (
  SELECT *, us // 5000000 * 5000000 AS window_us,
         left(sha256(concat_ws('|', agent_host, event_id, mitre_technique, detection_module, process_name, dst_ip, dst_port)), 16) AS fingerprint
  FROM inp
),
fetched AS (SELECT * FROM win QUALIFY row_number() OVER (PARTITION BY source_type, window_us ORDER BY us, id) <= {fetch}),
dedup AS (SELECT * FROM fetched QUALIFY row_number() OVER (PARTITION BY source_type, window_us, agent_host, event_id, mitre_technique, detection_module, process_name, dst_ip, dst_port ORDER BY us, id) = 1),
batch AS (SELECT * FROM dedup QUALIFY row_number() OVER (PARTITION BY source_type, window_us ORDER BY us, id) <= {keep})"""
_VERDICTS = """
evi AS (
  SELECT source_type, window_us, kind, v AS value, count(*) AS rows, min((us, id, k)) AS o FROM (
    SELECT source_type, window_us, us, id, unnest([trim(src_ip), trim(dst_ip), CASE WHEN dst_port <> '' THEN 'port:' || trim(dst_port) ELSE '' END,
             CASE WHEN mitre_technique <> '' THEN 'mitre:' || trim(mitre_technique) ELSE '' END]) AS v,
           unnest(['ioc', 'ioc', 'ioc', 'ioa']) AS kind, unnest([1, 2, 3, 4]) AS k FROM batch
  ) WHERE v <> '' GROUP BY ALL
),
lists AS (
  SELECT source_type, window_us, count(*) FILTER (WHERE kind = 'ioc') AS iocs, string_agg(value, ',' ORDER BY o) FILTER (WHERE kind = 'ioa') AS ioa,
         string_agg(value, '; ' ORDER BY o) FILTER (WHERE kind = 'ioa') AS ioa_text
  FROM evi GROUP BY ALL
),
ver0 AS (
  SELECT source_type, window_us, count(*) AS n,
         max(CASE WHEN severity IN ('CRITICAL','HIGH') THEN 3 WHEN severity IN ('MEDIUM','LOW') THEN 2 ELSE 1 END) AS rank,
         arg_min(trim(event_details), (us, id)) FILTER (WHERE trim(event_details) <> '') AS details
  FROM batch GROUP BY ALL
),
ver AS (
  SELECT v.source_type, v.window_us, v.n, CASE rank WHEN 3 THEN 'Critical' WHEN 2 THEN 'Warning' ELSE 'Info' END AS verdict,
         coalesce(details, 'No malicious activity detected.') AS reasoning,
         coalesce(iocs, 0) AS iocs, coalesce(ioa, '') AS ioa, ioa_text
  FROM ver0 v LEFT JOIN lists USING (source_type, window_us)
)"""
_ALL_ROWS = _INPUTS.format(fetch=10**15, keep=10**15)
WINDOW_SQL = V.with_views(V.SQL_SECURITY, V.SQL_FIREWALL, V.SQL_FIREWALL_VERDICT, _ALL_ROWS, _VERDICTS)
PASS_CTE = """,
passed AS (
  SELECT b.id AS source_event_id, b.source_type, b.window_us, nullif(b.agent_host, '') AS agent_host, nullif(b.event_id, '') AS event_id,
         nullif(b.src_ip, '') AS src_ip, nullif(b.dst_ip, '') AS dst_ip, nullif(b.dst_port, '') AS dst_port,
         b.severity AS rule_severity, b.mitre_technique <> '' AS rule_is_ioa,
         CASE verdict WHEN 'Critical' THEN 'CRITICAL' WHEN 'Warning' THEN 'MEDIUM' ELSE 'INFO' END AS final_severity,
         CASE verdict WHEN 'Critical' THEN 0.9 WHEN 'Warning' THEN 0.7 ELSE 0.4 END::DOUBLE AS llm_confidence,
         reasoning || CASE WHEN ioa <> '' THEN ' | IOA: ' || ioa_text ELSE '' END AS final_summary,
         nullif(b.mitre_technique, '') AS final_mitre,
         nullif(concat_ws(',', nullif(trim(src_ip), ''), CASE WHEN trim(dst_ip) <> trim(src_ip) THEN nullif(trim(dst_ip), '') END,
                          CASE WHEN dst_port <> '' THEN 'port:' || trim(dst_port) END), '') AS llm_ioc_values
  FROM batch b JOIN ver USING (source_type, window_us)
)"""


def window_sources(spark, sf):
    """Input of the window verdicts by source; a window belongs to one of them."""
    return {"windows": P.endpoint_pass_input(security_verdicts(spark, sf)), "firewall": P.firewall_pass_input(firewall_verdicts(spark, sf))}


def window_inputs(spark, sf):
    sources = window_sources(spark, sf)
    return sources["windows"].unionByName(sources["firewall"])


@query("window_dedup_counts", WINDOW_SQL + """,
counts AS (SELECT source_type, window_us, count(*) AS kept FROM batch GROUP BY ALL)
SELECT c.source_type, c.window_us, c.kept, r.rows FROM counts c JOIN (
  SELECT source_type, window_us, count(*) AS rows FROM win GROUP BY ALL) r USING (source_type, window_us)""")
def window_dedup_counts(spark, sf):
    windowed = W.assign_windows(window_inputs(spark, sf))
    total = windowed.groupBy("source_type", "window_ts").agg(F.count("*").alias("rows"))
    kept = W.window_batches(window_inputs(spark, sf)).groupBy("source_type", "window_ts").agg(F.count("*").alias("kept"))
    return total.join(kept, ["source_type", "window_ts"]).withColumn("window_us", micros("window_ts")).drop("window_ts")


@query("window_batches_small_cap", V.with_views(V.SQL_SECURITY, V.SQL_FIREWALL, V.SQL_FIREWALL_VERDICT,
                                                 _INPUTS.format(fetch=8, keep=2)) + """
SELECT id AS source_event_id, source_type, window_us, fingerprint FROM batch""")
def window_batches_small_cap(spark, sf):
    return W.window_batches(window_inputs(spark, sf), batch=2).select(
        "source_event_id", "source_type", micros("window_ts").alias("window_us"), "fingerprint"
    )


@query("window_verdicts", WINDOW_SQL + """
SELECT source_type, window_us, verdict, reasoning, iocs, ioa, n AS rows FROM ver""")
def window_verdicts(spark, sf):
    return W.window_verdicts(W.window_batches(window_inputs(spark, sf), columns=W.VERDICT_COLUMNS)).select(
        "source_type", micros("window_ts").alias("window_us"), "verdict", "reasoning", "iocs",
        F.array_join("ioa", ",").alias("ioa"), "rows",
    )


query("window_verdicts_uncapped", ORACLES["window_verdicts"])(window_verdicts)  # its earlier name; no path has a cap any more


@query("window_evidence", WINDOW_SQL + """
SELECT source_type, window_us, kind, value, rows, o[1] AS first_us FROM evi""")
def window_evidence(spark, sf):
    return W.window_evidence(W.window_batches(window_inputs(spark, sf), columns=W.EVIDENCE_COLUMNS)).select(
        "source_type", micros("window_ts").alias("window_us"), "kind", "value", "rows", "first_us"
    )


def pass_table(spark, sf):
    return W.rule_pass_rows(W.window_batches(window_inputs(spark, sf), columns=W.VERDICT_COLUMNS))


PASS_COLUMNS = [
    "source_event_id", "source_type", "agent_host", "event_id", "src_ip", "dst_ip", "dst_port", "rule_severity",
    "rule_is_ioa", "final_severity", "llm_confidence", "final_summary", "final_mitre", "llm_ioc_values",
]


@query("window_pass_rows", WINDOW_SQL + PASS_CTE + " SELECT * FROM passed")
def window_pass_rows(spark, sf):
    return pass_table(spark, sf).select(*PASS_COLUMNS, micros("window_ts").alias("window_us"))


@query("window_texts", WINDOW_SQL + """,
doc AS (
  SELECT source_type, window_us, part, us, id, row_number() OVER (PARTITION BY source_type, window_us, part ORDER BY us, id) - 1 AS i,
    'source=' || source_type || ' host="' || agent_host || '" event_id="' || event_id || '" rule_severity=' || severity
    || ' mitre="' || mitre_technique || '" module="' || detection_module || '"' || chr(10) || '    rule_detail="' || event_details || '"' || chr(10)
    || CASE WHEN src_ip <> '' OR dst_ip <> '' THEN '    network: ' || src_ip || ' -> ' || dst_ip || ':' || dst_port || chr(10) ELSE '' END
    || CASE WHEN process_name <> '' THEN '    process: "' || replace(process_name, '\\', '\\\\') || '"' || chr(10) ELSE '' END
    || CASE WHEN command_line <> '' THEN '    cmdline: "' || replace(command_line, '\\', '\\\\') || '"' || chr(10) ELSE '' END
    || CASE WHEN action <> '' THEN '    fw_action: ' || action || ' sent_bytes: ' || sent_bytes || chr(10) ELSE '' END || chr(10) AS line
  FROM (SELECT *, ('0x' || left(md5(id::VARCHAR), 8))::BIGINT % ceil(count(*) OVER (PARTITION BY source_type, window_us) / 50)::BIGINT AS part FROM batch)
)
SELECT source_type, window_us, part, string_agg('[' || i || '] ' || line, '' ORDER BY us, id) AS text FROM doc GROUP BY ALL""")
def window_texts(spark, sf):
    return W.window_texts(W.window_batches(window_inputs(spark, sf))).select(
        "source_type", micros("window_ts").alias("window_us"), "part", "text"
    )


_PASS_SIDES = """
w AS (
  SELECT id, us // 5000000 * 5000000 AS us, eventid_0 AS event_id,
         CASE WHEN sourceip_2 <> '' THEN sourceip_2 ELSE ipaddress_3 END AS src_ip, destinationip_2 AS dst_ip,
         agent_host, mitre_technique, event_details, logontype_3 AS logon_type
  FROM sec WHERE id IN (SELECT id FROM batch WHERE source_type = 'windows')
),
f AS (
  SELECT id, us // 5000000 * 5000000 AS us, src_ip, dst_ip, dst_port, mitre_technique, event_details, action, sent_bytes
  FROM fwv WHERE id IN (SELECT id FROM batch WHERE source_type = 'firewall')
)"""


def _pass_sql() -> str:
    from logwarden.plans.correlation import BYPASS_SQL, C2_SQL, DUMP_SQL, LATERAL_SQL

    found = " UNION ALL ".join([C2_SQL, DUMP_SQL, LATERAL_SQL, BYPASS_SQL])
    return WINDOW_SQL + "," + _PASS_SIDES + f""", found AS ({found})
SELECT incident_type, affected_ip, count(*) AS incidents, min(start_us) AS first_us FROM found GROUP BY ALL"""


@query("correlate_pass_rows", _pass_sql())
def correlate_pass_rows(spark, sf):
    """Pair rules over window-verdict rows, completed from the rows they came from.

    Each source is judged by itself: of both together, Spark would judge the windows of both for each side.  What is asked
    of the time of a window later must not reach one of the two uses of its alerts alone, or Spark would look for alerts twice.
    """
    rows = {}
    for name, inputs in window_sources(spark, sf).items():
        batches = computed_once(W.window_batches(inputs, columns=W.VERDICT_COLUMNS), "window_ts")
        rows[name] = P.pass_events(W.rule_pass_rows(batches), name)
    endpoint = P.with_source_fields(rows["windows"], P.endpoint_events(security_verdicts(spark, sf)))
    firewall = P.with_source_fields(rows["firewall"], P.firewall_events(firewall_verdicts(spark, sf)))
    found = C.pair_incidents(endpoint, firewall, columns=["incident_type", "affected_ip", "window_start"])
    return found.groupBy("incident_type", "affected_ip").agg(
        F.count("*").alias("incidents"), F.min(micros("window_start")).alias("first_us")
    )


def _replayed_noise(spark, sf, expire):
    keyed = _noisy(spark, sf).withColumn("ts", F.timestamp_micros("us"))
    # A key of its own moves the watermark past all others.
    end = keyed.agg(F.max("us").alias("us")).where(F.col("us").isNotNull()).select(
        F.lit("replay-end").alias("fp"), (F.col("us") + 86_400_000_000).alias("us"), F.lit(0).cast("bigint").alias("id")
    ).withColumn("ts", F.timestamp_micros("us"))
    out = replay(spark, {"keyed": keyed}, lambda keyed: J.suppress_keyed_stream(keyed, expire=expire), closing={"keyed": end})
    return out.where(F.col("fp") != "replay-end")


@query("alert_suppression_stream", ORACLES["alert_suppression"])
def alert_suppression_stream(spark, sf):
    return _replayed_noise(spark, sf, expire=False)


@query("alert_suppression_expiry", _recursive(V.SQL_FIREWALL, V.SQL_FIREWALL_VERDICT, _NOISE, _GREEDY) + """,
idle AS (SELECT *, us - lag(us) OVER o > 300000000 AS anew, lead(us) OVER o - us AS ahead FROM walk WINDOW o AS (PARTITION BY fp ORDER BY rn))
SELECT fp, us, id, CASE WHEN anew THEN 0 ELSE duplicate_count END AS duplicate_count FROM idle WHERE passed
UNION ALL SELECT fp, us, NULL, dropped FROM idle WHERE dropped > 0 AND coalesce(ahead > 300000000, true)""")
def alert_suppression_expiry(spark, sf):
    return _replayed_noise(spark, sf, expire=True)
