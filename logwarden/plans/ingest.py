"""Normalization, parsing, profiling and registry queries.

Lines and payloads are rendered from the given tables and parsed back; the SQL
twins know the expected values from the table columns and never parse.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from logwarden.functions.text import nz
from logwarden.functions.times import micros, migrate_text_time, parse_scada_time
from logwarden.operators import formats as M
from logwarden.operators import prefilter as R
from logwarden.operators import profiles as P
from logwarden.operators import registry as G
from logwarden.operators import syslog as L
from logwarden.operators import taxonomy as T
from logwarden.plans import views as V
from logwarden.plans.catalog import query
from logwarden.plans.detection import SEC
from logwarden.sources import payloads as S

INGEST = "2024-01-02 00:00:00"


def _s(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


# ------------------------------------------------------------ firewall lines

RAW_KINDS = [
    'concat(\'<189>date=2024-01-15 time=13:37:42 devname="FW-\', device_name, \'" type="traffic" subtype="forward" level="notice" srcip=\', src_ip, \' srcport=1234 dstip=\', dst_ip, \' dstport=\', dst_port, \' proto=\', CASE WHEN protocol = \'udp\' THEN \'17\' ELSE \'6\' END, \' action="\', action, \'" policyid=7 service="HTTPS" sentbyte=\', sent_bytes, \' msg="Allowed \', message, \'"\')',
    'concat(\'<14>2024-01-15T10:30:00+05:30 fw01 log_type="Firewall" action="\', action, \'" src_ip="\', src_ip, \'" dst_ip="\', dst_ip, \'" dst_port=\', dst_port, \' protocol="tcp" message="Denied \', message, \'" date=2024-01-15 srczone="LAN1" connid=\', fw_rule_id)',
    'concat(\'CEF:0|Fortinet|FortiGate|7.2|000\', classification, \'|traffic event|5|src=\', src_ip, \' dst=\', dst_ip, \' spt=12345 dpt=\', dst_port, \' proto=\', CASE WHEN protocol = \'udp\' THEN \'47\' ELSE \'tcp\' END, \' act=\', action)',
    'concat(\'  \', message, \' arrived \')',
    'concat(\'<34>1 2024-01-15T10:30:00Z host app 77 ID1 src_ip=\', src_ip, \' action=\', action, \' message="first \', message, \'" message=last\')',
    'concat(\'device=\', device_name, \' log_type=IPS status=Blocked url=/a?b=1 user="joe smith" group=g note= bytes_sent=55\')',
]
_RAW_CASE = "CASE id % 6 " + " ".join(f"WHEN {i} THEN {text}" for i, text in enumerate(RAW_KINDS)) + " END"


def raw_lines(spark, sf):
    return V.firewall(spark, sf).select(
        "id", F.expr(_RAW_CASE).alias("raw_log"), F.lit(" 192.0.2.1 ").alias("sensor_ip"),
        F.lit(INGEST).cast("timestamp").alias("ingest_ts"),
    )


FIELDS = ["device_name", "log_date", "log_id", "log_type", "log_component", "log_subtype", "priority", "action", "src_ip",
          "src_zone", "dst_ip", "dst_port", "protocol", "conn_event", "conn_id", "sent_bytes", "recv_bytes", "fw_rule_id",
          "user", "user_group", "app_name", "message", "severity", "classification", "url", "fw_type"]


def _expected(rows: dict[str, list[str]]) -> str:
    """CASE per field: one SQL value per kind of line."""
    out = []
    for name in FIELDS:
        values = rows.get(name, ["''"] * 6)
        out.append("CASE id % 6 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + f" END AS {name}")
    return ", ".join(out)


_E = "''"
_UNIVERSAL = {
    "device_name": ["'FW-' || device_name", _E, _E, _E, _E, "device_name"],
    "log_date": [_E, "'2024-01-15'", _E, _E, _E, _E],
    "log_id": [_E, _E, "'7.2'", _E, _E, _E],
    "log_type": ["'traffic'", "'Firewall'", _E, _E, _E, "'IPS'"],
    "log_component": ["'traffic'", "'Firewall'", "'000' || classification", _E, _E, "'IPS'"],
    "log_subtype": ["'forward'", _E, _E, _E, _E, _E],
    "priority": ["'notice'", _E, "'5'", _E, _E, _E],
    "severity": ["'notice'", _E, "'5'", _E, _E, _E],
    "action": ["action", "action", "action", _E, "action", "'Blocked'"],
    "src_ip": ["src_ip", "src_ip", "src_ip", _E, "src_ip", _E],
    "src_zone": [_E, "'LAN1'", _E, _E, _E, _E],
    "dst_ip": ["dst_ip", "dst_ip", "dst_ip", _E, _E, _E],
    "dst_port": ["dst_port", "dst_port", "dst_port", _E, _E, _E],
    "protocol": ["CASE WHEN protocol = 'udp' THEN 'UDP' ELSE 'TCP' END", "'tcp'",
                 "CASE WHEN protocol = 'udp' THEN '47' ELSE 'TCP' END", _E, _E, _E],
    "conn_event": ["action", "action", _E, _E, "action", _E],
    "conn_id": [_E, "fw_rule_id", _E, _E, _E, _E],
    "sent_bytes": ["sent_bytes", "'0'", "'0'", "'0'", "'0'", "'55'"],
    "recv_bytes": ["'0'"] * 6,
    "fw_rule_id": ["'7'", _E, _E, _E, _E, _E],
    "user": [_E, _E, _E, _E, _E, "'joe smith'"],
    "user_group": [_E, _E, _E, _E, _E, "'g'"],
    "app_name": ["'HTTPS'", _E, _E, _E, _E, _E],
    "message": ["'Allowed ' || message", "'Denied ' || message", "'traffic event'", "message || ' arrived'", "'last'", _E],
    "classification": ["'forward'", _E, _E, _E, _E, _E],
    "url": [_E, _E, _E, _E, _E, "'/a?b=1'"],
    "fw_type": ["'traffic'", _E, _E, _E, _E, _E],
}
_DEVICE = {
    "log_date": [_E, "'2024-01-15'", _E, _E, _E, _E],
    "log_type": [_E, "'Firewall'", _E, _E, _E, "'IPS'"],
    "log_component": [_E, _E, "'traffic event'", _E, _E, _E],
    "action": [_E, "action", _E, _E, _E, "'Blocked'"],
    "src_ip": [_E, "src_ip", _E, _E, _E, _E],
    "src_zone": [_E, "'LAN1'", _E, _E, _E, _E],
    "dst_ip": [_E, "dst_ip", _E, _E, _E, _E],
    "dst_port": [_E, "dst_port", _E, _E, _E, _E],
    "protocol": [_E, "'tcp'", _E, _E, _E, _E],
    "conn_id": [_E, "fw_rule_id", _E, _E, _E, _E],
    "sent_bytes": ["'0'"] * 6,
    "recv_bytes": ["'0'"] * 6,
    "user": [_E, _E, _E, _E, _E, "'joe smith'"],
    "message": [f"trim({RAW_KINDS[0]})", "'Denied ' || message", _E, "message || ' arrived'", f"trim({RAW_KINDS[4]})", _E],
    "url": [_E, _E, _E, _E, _E, "'/a?b=1'"],
}
FW = V.with_views(V.SQL_FIREWALL)


@query("normalize_firewall_lines", FW + f" SELECT id, '192.0.2.1' AS sensor_ip, {_expected(_UNIVERSAL)} FROM fw")
def normalize_universal(spark, sf):
    return L.normalize_firewall(raw_lines(spark, sf)).select("id", "sensor_ip", *FIELDS)


@query("normalize_device_lines", FW + f" SELECT id, ' 192.0.2.1 ' AS sensor_ip, {_expected(_DEVICE)} FROM fw")
def normalize_device(spark, sf):
    return L.normalize_firewall(raw_lines(spark, sf), flavour="device").select("id", "sensor_ip", *FIELDS)


# ------------------------------------------------------------------ payloads

PAR = V.with_views(V.SQL_PARSED)


def _payloads(spark, sf):
    ev = V.security(spark, sf)
    one = F.struct(_s("id").alias("EventRecordID_0"), F.col("logsource_5").alias("LogSource_5"),
                   F.col("eventid_0").alias("EventID_0"), F.col("commandline_2").alias("CommandLine_2"),
                   F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0Z'").alias("TimeCreated_0"), F.lit(1).alias("unknown_key"))
    text = (
        F.when(F.col("id") % 4 == 0, F.to_json(F.array(one, one.withField("EventRecordID_0", F.concat(F.lit("x"), _s("id"))))))
        .when(F.col("id") % 4 == 1, F.to_json(one)).when(F.col("id") % 4 == 2, F.concat(F.lit("{broken"), _s("id")))
        .otherwise(F.to_json(F.array(one.withField("TimeCreated_0", F.lit("")))))
    )
    return ev.select(text.alias("value"), F.lit(INGEST).cast("timestamp").alias("ingest_ts"))


@query("read_endpoint_payloads", SEC + """
SELECT CAST(id AS VARCHAR) AS record, logsource_5, eventid_0, commandline_2,
       CASE WHEN id % 4 = 3 THEN 1704153600000000 ELSE us END AS us FROM sec WHERE id % 4 <> 2
UNION ALL SELECT 'x' || id, logsource_5, eventid_0, commandline_2, us FROM sec WHERE id % 4 = 0""")
def read_endpoint_payloads(spark, sf):
    return S.endpoint_events(_payloads(spark, sf)).select(
        F.col("eventrecordid_0").alias("record"), "logsource_5", "eventid_0", nz("commandline_2").alias("commandline_2"),
        micros("event_time").alias("us"),
    )


@query("read_rejected_payloads", SEC + " SELECT '{broken' || id AS value FROM sec WHERE id % 4 = 2")
def read_rejected(spark, sf):
    from logwarden.schemas import ENDPOINT_WIRE

    return S.rejected_payloads(_payloads(spark, sf), ENDPOINT_WIRE).select("value")


@query("read_firewall_payloads", FW + """
SELECT id, src_ip, action, CASE WHEN id % 2 = 0 THEN us ELSE 1704153600000000 END AS us FROM fw""")
def read_firewall_payloads(spark, sf):
    f = V.firewall(spark, sf)
    received = F.when(F.col("id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    body = F.to_json(F.array(F.struct(received.alias("received_at"), "src_ip", "action")))
    rows = S.firewall_events(f.select("id", body.alias("value"), F.lit(INGEST).cast("timestamp").alias("ingest_ts")))
    return rows.select("id", "src_ip", "action", micros("received_at").alias("us"))


@query("read_scada_payloads", V.with_views(V.SQL_SCADA) + """
SELECT id, CASE WHEN source = '' THEN 'Unknown_SCADA' ELSE source END AS source, tag, coalesce(parsed_s * 1000000, us) AS us FROM scada
WHERE tag <> '' AND id % 6 <> 4""")
def read_scada_payloads(spark, sf):
    s = V.scada(spark, sf)
    stamp = F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("received_at")
    body = F.to_json(F.struct(stamp, *[F.col(c) for c in s.columns if c not in ("id", "received_at")]))
    rows = S.scada_events(
        s.select("id", body.alias("value"), F.lit(INGEST).cast("timestamp").alias("ingest_ts")), payload_id="id")
    return rows.select("id", "source", "tag", micros("event_time").alias("us"))


@query("scada_event_times", V.with_views(V.SQL_SCADA) + """
SELECT id, coalesce(parsed_s * 1000000, us) AS us,
       CASE WHEN id % 6 IN (0, 1) THEN us // 1000000 * 1000000 WHEN id % 6 = 2 THEN parsed_s * 1000000 ELSE us END AS migrated_us FROM scada""")
def scada_event_times(spark, sf):
    s = V.scada(spark, sf)
    return s.select(
        "id", micros(parse_scada_time(F.col("timestamp"), F.col("received_at"))).alias("us"),
        micros(migrate_text_time(F.col("timestamp"), F.col("received_at"))).alias("migrated_us"),
    )


@query("read_windows_xml", SEC + """
SELECT id, logsource_5, eventid_0, nullif(image_2, '') AS image_2, nullif(commandline_2, '') AS commandline_2,
       nullif(targetfilename_2, '') AS targetfilename_2, nullif(image_2, '') AS process_name,
       CASE WHEN logsource_5 = 'Sysmon' AND eventid_0 = '1' THEN 'Process Creation'
            WHEN logsource_5 = 'Sysmon' AND eventid_0 = '22' THEN 'DNSEvent (DNS query)'
            WHEN logsource_5 = 'Security' AND eventid_0 = '4625' THEN 'Failed Logon' ELSE 'other' END AS category
FROM sec WHERE logsource_5 <> 'Unknown'""")
def read_windows_xml(spark, sf):
    ev = V.security(spark, sf).filter(F.col("logsource_5") != "Unknown")

    def esc(c):
        return F.replace(F.replace(F.replace(nz(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def datum(name, c):
        return F.concat(F.lit(f'<Data Name="{name}">'), esc(c), F.lit("</Data>"))

    channel = F.when(F.col("logsource_5") == "Sysmon", "Microsoft-Windows-Sysmon/Operational").otherwise(F.col("logsource_5"))
    xml = F.concat(
        F.lit('<Event><System><Provider Name="p"/><EventID>'), "eventid_0", F.lit("</EventID><Channel>"), channel,
        F.lit("</Channel><Computer>"), "computer_0", F.lit("</Computer></System><EventData>"), datum("Image", "image_2"),
        datum("CommandLine", "commandline_2"), datum("TargetFilename", "targetfilename_2"), F.lit("</EventData></Event>"),
    )
    rows = S.windows_xml_events(ev.select("id", xml.alias("value")))
    known = F.col("eventcategory_5").isin("Process Creation", "DNSEvent (DNS query)", "Failed Logon") & F.concat(
        "logsource_5", F.lit("/"), "eventid_0").isin("Sysmon/1", "Sysmon/22", "Security/4625")
    return rows.select(
        "id", "logsource_5", "eventid_0", "image_2", "commandline_2", "targetfilename_2", "process_name",
        F.when(known, F.col("eventcategory_5")).otherwise("other").alias("category"),
    )


@query("read_standardized_logs", PAR + """
SELECT id, CASE WHEN id % 2 = 0 THEN source_system ELSE 'unknown' END AS source_system, source_type, source_ip, dst_port, username, status_code, us FROM parsed""")
def read_standardized_logs(spark, sf):
    p = V.parsed(spark, sf)
    body = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "source_type", "source_system",
        F.when(F.col("id") % 2 == 0, F.col("source_system")).alias("source"), "source_ip", "dst_port",
        F.col("username").alias("user"), "status_code"))
    rows = S.standardized_logs(p.select("id", body.alias("value"), F.lit(INGEST).cast("timestamp").alias("ingest_ts")))
    return rows.select("id", "source_system", "source_type", "source_ip", "dst_port", "username", "status_code",
                       micros("timestamp").alias("us"))


# ------------------------------------------------------------ profile parsers


def _field(name):
    return F.try_element_at("fields", F.lit(name)).alias(name)


def _lines(spark, sf, text):
    return V.parsed(spark, sf, spread=True).select("id", text.alias("raw_log"), F.lit(INGEST).cast("timestamp").alias("ingest_ts"))


def _csv_text():
    when = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    msg = F.concat(F.lit('"say ""hi"", '), "log", F.lit('"'))
    full = F.concat_ws(",", when, nz("action"), nz("source_ip"), nz(_s("dst_port")), msg)
    return F.when(F.col("id") % 10 == 9, F.concat(full, F.lit(",extra"))).otherwise(full)


CSV_COLUMNS = ["Time", "Action", "Src IP", "Dst port", "Message"]
CSV_MAPPING = {"Time": "timestamp", "Action": "action", "Src IP": "source_ip", "Dst port": "dst_port", "Message": "log"}
_ISO_SECONDS = "strftime(make_timestamp(us // 1000000 * 1000000), '%Y-%m-%dT%H:%M:%S')"


@query("parse_csv_lines", PAR + f"""
SELECT id, CASE WHEN id % 10 = 9 THEN 'Column count mismatch' END AS error,
  CASE WHEN id % 10 <> 9 THEN {_ISO_SECONDS} END AS "timestamp", CASE WHEN id % 10 <> 9 THEN action END AS action,
  CASE WHEN id % 10 <> 9 THEN source_ip END AS source_ip, CASE WHEN id % 10 <> 9 THEN CAST(dst_port AS VARCHAR) END AS dst_port,
  CASE WHEN id % 10 <> 9 THEN 'say "hi", ' || log END AS log FROM parsed""")
def parse_csv_lines(spark, sf):
    parsed = P.parse_csv(_lines(spark, sf, _csv_text()), CSV_COLUMNS, mapping=CSV_MAPPING,
                         timestamp={"field": "Time", "format": "%Y-%m-%d %H:%M:%S"})
    return parsed.select("id", "error", *[_field(n) for n in ("timestamp", "action", "source_ip", "dst_port", "log")])


# Lines that are easy to get wrong, with the cells that they have; drawn by id.
_CSV_EDGES = [
    (",", ',"x, y",z', ["", "x, y", "z"]), (",", '"a ""b"", c",,', ['a "b", c', "", ""]), (",", "1,2,3", ["1", "2", "3"]),
    (";", '"p;q";r;', ["p;q", "r", ""]), ("\t", 'a\t"b\tc"\td', ["a", "b\tc", "d"]), ("|", '|"m|n"|o', ["", "m|n", "o"]),
]


def _sql_text(text):
    return "NULL" if not text else "'" + text.replace("'", "''").replace("\t", "' || chr(9) || '") + "'"


@query("parse_csv_edges", "WITH e(k, a, b, c) AS (VALUES " + ", ".join(
    f"({k}, {', '.join(_sql_text(c) for c in cells)})" for k, (_, _, cells) in enumerate(_CSV_EDGES)) + """)
SELECT event_id AS id, a, b, c, CAST(NULL AS VARCHAR) AS error FROM events JOIN e ON k = event_id % 6""")
def parse_csv_edges(spark, sf):
    out = None
    events = V.table(spark, sf, "events").select(F.col("event_id").alias("id"))
    for k, (delimiter, line, _) in enumerate(_CSV_EDGES):
        own = events.filter(F.col("id") % len(_CSV_EDGES) == k).withColumn("raw_log", F.lit(line))
        part = P.parse_csv(own, ["a", "b", "c"], delimiter).select("id", *[_field(n) for n in "abc"], "error")
        out = part if out is None else out.union(part)
    return out


@query("parse_json_depths", """
SELECT event_id AS id, 'v' || event_id AS a_b_c_d_e_f, '{"b":1}' AS text, '[{"x":1}]' AS list, '{"k":"}"}' AS n_t, CAST(NULL AS VARCHAR) AS nothing
FROM events""")
def parse_json_depths(spark, sf):
    """Six levels, texts that look like objects, arrays, null."""
    text = F.concat(F.lit('{"a":{"b":{"c":{"d":{"e":{"f":"v'), F.col("event_id").cast("string"),
                    F.lit('"}}}}},"text":"{\\"b\\":1}","list":[{"x":1}],"n":{"t":"{\\"k\\":\\"}\\"}"},"nothing":null}'))
    lines = V.dealt(V.table(spark, sf, "events"), "event_id", "ts", "user_id").select(F.col("event_id").alias("id"), text.alias("raw_log"))
    parsed = P.parse_json(lines, flatten=True)
    return parsed.select("id", *[_field(n) for n in ("a_b_c_d_e_f", "text", "list", "n_t", "nothing")])


# Layouts with a value and its ISO text.
_LAYOUTS = [
    ("%d/%b/%Y:%H:%M:%S %z", "10/Oct/2023:13:55:36 -0730", "2023-10-10T13:55:36-07:30"), ("%Y-%m-%dT%H:%M:%S.%f", "2024-02-03T04:05:06.25", "2024-02-03T04:05:06.250000"),
    ("%y%m%d %I:%M %p", "240102 03:04 PM", "2024-01-02T15:04:00"), ("%Y day %j", "2024 day 032", "2024-02-01T00:00:00"),
    ("%Y-%m-%dT%H:%M:%S%z", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05+00:00"), ("%c", "kept as it is", "kept as it is"), ("%H:%M", "not a time", "not a time"),
]


@query("profile_time_layouts", "WITH t(k, iso) AS (VALUES " + ", ".join(f"({k}, '{iso}')" for k, (_, _, iso) in enumerate(_LAYOUTS)) + f""")
SELECT event_id AS id, iso FROM events JOIN t ON k = event_id % {len(_LAYOUTS)}""")
def profile_time_layouts(spark, sf):
    out = F.lit(None).cast("string")
    for k, (layout, text, _) in enumerate(_LAYOUTS):
        out = F.when(F.col("event_id") % len(_LAYOUTS) == k, P.profile_time(F.lit(text), layout)).otherwise(out)
    return V.table(spark, sf, "events").select(F.col("event_id").alias("id"), out.alias("iso"))


def _json_text():
    body = F.to_json(F.struct(
        F.struct(F.col("source_ip").alias("ip"), F.struct(F.col("dst_port").alias("dst")).alias("port")).alias("net"),
        F.col("log").alias("message"), F.unix_seconds("ts").alias("when"), F.array("source_type").alias("tags")))
    return F.when(F.col("id") % 10 == 9, F.concat(F.lit("{"), body)).otherwise(body)


@query("parse_json_lines", PAR + f"""
SELECT id, CASE WHEN id % 10 = 9 THEN 'JSON parse error' END AS error, CASE WHEN id % 10 <> 9 THEN source_ip END AS source_ip,
  CASE WHEN id % 10 <> 9 THEN CAST(dst_port AS VARCHAR) END AS net_port_dst, CASE WHEN id % 10 <> 9 THEN log END AS log,
  CASE WHEN id % 10 <> 9 THEN {_ISO_SECONDS} END AS "timestamp",
  CASE WHEN id % 10 <> 9 THEN '["' || source_type || '"]' END AS tags FROM parsed""")
def parse_json_lines(spark, sf):
    parsed = P.parse_json(_lines(spark, sf, _json_text()), {"net_ip": "source_ip", "message": "log"},
                          {"field": "when", "format": "epoch"}, flatten=True)
    return parsed.select("id", "error", *[_field(n) for n in ("source_ip", "net_port_dst", "log", "timestamp", "tags")])


@query("parse_key_value_lines", PAR + f"""
SELECT id, {_ISO_SECONDS} AS "timestamp", source_ip, log, 'b' AS x, CAST(NULL AS VARCHAR) AS error FROM parsed""")
def parse_key_value_lines(spark, sf):
    text = F.concat(F.lit("time="), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" x=a"),
                    F.coalesce(F.concat(F.lit(" src="), "source_ip"), F.lit("")), F.lit(' msg="'), "log", F.lit('" x=b'))
    parsed = P.parse_key_value(_lines(spark, sf, text), {"src": "source_ip", "msg": "log", "time": "timestamp"},
                               {"field": "time", "format": "%Y-%m-%dT%H:%M:%S"})
    return parsed.select("id", "error", *[_field(n) for n in ("timestamp", "source_ip", "log", "x")])


@query("parse_syslog_lines", PAR + """
SELECT id, CASE WHEN id % 7 <> 0 THEN '134' END AS priority, CASE WHEN id % 7 <> 0 THEN source_system END AS source_system,
       CASE WHEN id % 7 <> 0 THEN 'kernel' END AS app_name, CASE WHEN id % 7 <> 0 THEN log || ': x' END AS log,
       CASE WHEN id % 7 <> 0 THEN '77' END AS process_id, CASE WHEN id % 7 <> 0 THEN 'm ' || log END AS log5424,
       id % 7 = 0 AS failed FROM parsed""")
def parse_syslog_lines(spark, sf):
    bad = F.col("id") % 7 == 0
    old = F.when(bad, F.col("log")).otherwise(F.concat(
        F.lit("<134>Oct 13 13:15:37 "), "source_system", F.lit(" kernel: "), "log", F.lit(": x")))
    new = F.when(bad, F.col("log")).otherwise(F.concat(
        F.lit("<134>1 2024-01-01T00:00:00Z "), "source_system", F.lit(" kernel 77 ID3 - m "), "log"))
    a = P.parse_syslog(_lines(spark, sf, old)).select("id", *[_field(n) for n in ("priority", "source_system", "app_name", "log")])
    b = P.parse_syslog(_lines(spark, sf, new), "RFC5424", mode="intent").select(
        F.col("id").alias("id5"), _field("process_id"), F.try_element_at("fields", F.lit("log")).alias("log5424"),
        F.col("error").isNotNull().alias("failed"))
    return a.join(b, a["id"] == b["id5"]).drop("id5")


@query("parse_cef_lines", PAR + """
SELECT id, CASE WHEN id % 7 = 0 THEN 'Failed to parse CEF format' END AS error, CASE WHEN id % 7 <> 0 THEN '1' END AS cef_version,
  CASE WHEN id % 7 <> 0 THEN 'V' END AS source_system, CASE WHEN id % 7 <> 0 THEN log END AS log,
  CASE WHEN id % 7 <> 0 THEN source_type END AS ext_kind, CASE WHEN id % 7 <> 0 THEN '2' END AS ext_a FROM parsed""")
def parse_cef_lines(spark, sf):
    text = F.concat(F.lit("CEF:01|V|P|1|sig|"), "log", F.lit("|5|a=1 kind="), "source_type", F.lit(" a=2"))
    text = F.when(F.col("id") % 7 == 0, F.concat(F.lit("x"), text)).otherwise(text)
    parsed = P.parse_cef(_lines(spark, sf, text), {"name": "log", "device_vendor": "source_system"})
    return parsed.select("id", "error", *[_field(n) for n in ("cef_version", "source_system", "log", "ext_kind", "ext_a")])


@query("parse_raw_documents", """
SELECT doc_id, length(trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')) AS n, '2024-01-02T00:00:00' AS "timestamp"
FROM documents WHERE trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') <> ''""")
def parse_raw_documents(spark, sf):
    docs = V.table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("raw_log"), F.lit(INGEST).cast("timestamp").alias("ingest_ts"))
    parsed = P.parse_raw(P.parsable(docs))
    return parsed.select("doc_id", F.length(F.try_element_at("fields", F.lit("log"))).cast("bigint").alias("n"), _field("timestamp"))


@query("parse_quality_report", PAR + """
SELECT source_type AS parser_id, count(*) AS total, count(*) FILTER (WHERE id % 10 <> 9) AS success, count(*) FILTER (WHERE id % 10 = 9) AS failed,
  round(count(*) FILTER (WHERE id % 10 <> 9) / count(*), 6) AS success_rate,
  CASE WHEN count(*) FILTER (WHERE id % 10 = 9) > 0 THEN 'Column count mismatch' ELSE '' END AS errors, CAST(3 AS BIGINT) AS samples,
  CASE WHEN count(*) FILTER (WHERE id % 10 <> 9) > 0 THEN 'success' ELSE 'failed' END AS status FROM parsed GROUP BY ALL""")
def parse_quality_report(spark, sf):
    logs = V.parsed(spark, sf)
    parsed = P.parse_csv(logs.select(F.col("source_type").alias("parser_id"), F.col("id").alias("line_no"), _csv_text().alias("raw_log")),
                         CSV_COLUMNS, mapping=CSV_MAPPING)
    status = P.ingest_summary(parsed.drop("source_type"), "parser_id").select("parser_id", "status")
    return P.quality_report(parsed).select(
        "parser_id", "total", "success", "failed", F.round("success_rate", 6).alias("success_rate"),
        F.array_join("errors", ",").alias("errors"), F.size("samples").cast("bigint").alias("samples")).join(status, "parser_id")


# ----------------------------------------------------------- format profiles


def _source_lines(spark, sf):
    """Six formats; each (format, device) is a source."""
    p = V.parsed(spark, sf)
    when = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    kind = F.col("id") % 6
    text = (
        F.when(kind == 0, F.to_json(F.struct(when.alias("eventTime"), F.coalesce("source_ip", F.lit("-")).alias("src_ip"),
                                              F.col("log").alias("message"))))
        .when(kind == 1, F.concat(F.lit("<13>Oct 13 13:15:37 "), "source_system", F.lit(" app: "), "log"))
        .when(kind == 2, F.concat(F.lit("CEF:0|a|b|c|d|"), "log", F.lit("|5|x=1")))
        .when(kind == 3, F.concat(F.lit("src_ip="), nz("source_ip"), F.lit("x user=u level=3 seen="), F.unix_seconds("ts").cast("string")))
        .when(kind == 4, F.concat_ws(",", when, F.lit("10.1.2.3"), nz(_s("dst_port")), "log"))
        .otherwise("log")
    )
    return p.select(F.concat(_s(kind), F.lit("/"), "source_system").alias("source"), F.col("id").alias("line_no"), text.alias("raw_log"))


@query("profile_log_formats", PAR + """,
src AS (SELECT DISTINCT id % 6 AS k, source_system AS s FROM parsed),
few AS (SELECT id % 6 AS k, source_system AS s, count(*) AS lines FROM parsed GROUP BY ALL)
SELECT CAST(k AS VARCHAR) || '/' || s AS source, f.lines,
  ['JSON','SYSLOG','CEF','KEY_VALUE','CSV','RAW'][k + 1] AS format_type, CASE k WHEN 5 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence,
  CASE k WHEN 1 THEN 'RFC3164' END AS rfc_version, CASE k WHEN 4 THEN ',' END AS delimiter, CASE k WHEN 4 THEN 4 END::BIGINT AS column_count,
  CASE k WHEN 4 THEN false END AS has_header, CASE k WHEN 0 THEN 'eventTime,message,src_ip' WHEN 3 THEN 'level,seen,src_ip,user'
    WHEN 4 THEN 'column_1,column_2,column_3,column_4' END AS keys,
  CASE k WHEN 0 THEN 'eventTime' END AS timestamp_field, CASE k WHEN 0 THEN '%Y-%m-%d %H:%M:%S' END AS timestamp_format
FROM src JOIN few f USING (k, s)""")
def profile_log_formats(spark, sf):
    return M.profile_sources(_source_lines(spark, sf)).select(
        "source", "lines", "format_type", "confidence", "rfc_version", "delimiter", F.col("column_count").cast("bigint").alias("column_count"),
        "has_header", F.array_join("keys", ",").alias("keys"), "timestamp_field", "timestamp_format")


@query("profile_key_targets", PAR + """,
src AS (SELECT DISTINCT id % 6 AS k, source_system AS s FROM parsed),
want(k, "key", target) AS (VALUES (0, 'eventTime', 'timestamp'), (0, 'message', 'log'), (0, 'src_ip', 'source_ip'),
  (3, 'level', 'severity'), (3, 'src_ip', 'source_ip'), (3, 'user', 'user'))
SELECT CAST(k AS VARCHAR) || '/' || s AS source, "key", target FROM src JOIN want USING (k)""")
def profile_key_targets(spark, sf):
    return M.suggested_mappings(M.profile_sources(_source_lines(spark, sf))).select("source", "key", "target")


@query("profile_document_sources", """
SELECT source, 'RAW' AS format_type, 0.5::DOUBLE AS confidence FROM documents GROUP BY 1""")
def profile_document_sources(spark, sf):
    docs = V.table(spark, sf, "documents").select("source", F.col("doc_id").alias("line_no"), F.col("text").alias("raw_log"))
    return M.profile_sources(docs).select("source", "format_type", "confidence")


# ------------------------------------------------------------------- filters


@query("collection_filter", SEC + """
SELECT id FROM sec WHERE logsource_5 <> 'Sysmon' OR CASE
  WHEN eventid_0 = '3' THEN NOT (destinationip_2 IN ('127.0.0.1','::1') OR destinationip_2 LIKE '10.%' OR destinationip_2 LIKE '192.168.%')
  WHEN eventid_0 = '5' THEN false
  WHEN eventid_0 = '7' THEN regexp_matches(lower(imageloaded_2), 'samlib|user32|\\\\temp\\\\')
  WHEN eventid_0 = '11' THEN regexp_matches(lower(targetfilename_2), '\\.(exe|dll|docx)$')
  WHEN eventid_0 IN ('12','13','14') THEN regexp_matches(lower(targetobject_2), 'currentversion\\\\run|\\\\services\\\\')
  WHEN eventid_0 IN ('17','18') THEN false
  WHEN eventid_0 = '23' THEN regexp_matches(lower(targetfilename_2), 'defender|\\.exe$')
  ELSE true END""")
def collection_filter(spark, sf):
    return R.collection_filter(V.security(spark, sf)).select("id")


@query("collected_events", SEC + """
SELECT logsource_5, eventid_0, count(*) AS events FROM sec
WHERE (logsource_5 = 'Sysmon' AND eventid_0 <> '5') OR (logsource_5 = 'Security' AND eventid_0 NOT IN ('4740', '1'))
   OR logsource_5 IN ('System', 'Application') GROUP BY ALL""")
def collected_events(spark, sf):
    return R.collected_events(V.security(spark, sf)).groupBy("logsource_5", "eventid_0").agg(F.count("*").alias("events"))


# ------------------------------------------------------------------ taxonomy


@query("standard_field_names", PAR + """,
n(k, name, standard) AS (VALUES (0, 'SRC IP', 'source_ip'), (1, 'eventTime', 'timestamp'), (2, 'my_hostname_x', 'source_system'),
  (3, 'Dest_Port', 'dst_port'), (4, 'zzz', NULL), (5, 'user', 'user'), (6, 'status code', 'status_code'))
SELECT name, standard, count(*) AS rows FROM parsed JOIN n ON n.k = id % 7 GROUP BY ALL""")
def standard_field_names(spark, sf):
    names = ["SRC IP", "eventTime", "my_hostname_x", "Dest_Port", "zzz", "user", "status code"]
    keyed = V.parsed(spark, sf).select(F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 7 + 1).cast("int")).alias("name"))
    return T.map_keys(keyed.groupBy("name").agg(F.count("*").alias("rows")), "name")


@query("value_violations", PAR + """,
v AS (SELECT unnest([CASE WHEN source_ip IS NULL THEN 'required:source_ip' END, CASE WHEN id % 50 = 0 THEN 'ip:peer' END,
  CASE WHEN dst_port IS NOT NULL AND dst_port > 1060 THEN 'port:port' END, CASE WHEN id % 9 = 0 THEN 'numeric:amount' END]) AS violation FROM parsed)
SELECT violation, count(*) AS rows FROM v WHERE violation IS NOT NULL GROUP BY ALL""")
def value_violations(spark, sf):
    logs = V.parsed(spark, sf).select(
        "source_ip", F.when(F.col("id") % 50 == 0, "not-an-ip").otherwise(F.col("dest_ip")).alias("peer"),
        F.when(F.col("dst_port") > 1060, 70000).otherwise(F.col("dst_port")).alias("port"),
        F.when(F.col("id") % 9 == 0, "n/a").otherwise("1.5").alias("amount"))
    return T.violation_counts(T.value_checks(logs, ["source_ip"], ["peer"], ["port"], ["amount"]))


# ------------------------------------------------------------------ registry


def _parsers(spark, sf):
    k = F.col("p_partkey")
    return V.table(spark, sf, "part").select(
        F.concat(F.lit("p"), _s("p_partkey")).alias("parser_id"), F.concat("p_name", F.lit(" "), _s("p_partkey")).alias("parser_name"),
        F.lit("rule-based").alias("mode"), F.element_at(F.array(*map(F.lit, ["CSV", "JSON", "SYSLOG", "CEF", "KEY_VALUE"])), (k % 5 + 1).cast("int")).alias("format_type"),
        F.col("p_brand").alias("vendor"), F.when(k % 3 == 0, F.concat(F.lit("src"), _s(k))).alias("source_identifier"),
        (F.col("p_size") % 4 != 0).alias("active"), (F.col("p_retailprice") * 10).cast("bigint").alias("logs_processed"),
        F.lit(90.0).alias("parse_success_rate"), F.lit(4).cast("bigint").alias("avg_parse_time_ms"),
        F.lit(None).cast("timestamp").alias("last_used"), F.timestamp_seconds(F.lit(V.BASE_SECONDS) + k).alias("created_at"))


_PARSERS = """
pp AS (SELECT 'p' || p_partkey AS parser_id, p_partkey AS k, p_name || ' ' || p_partkey AS parser_name, ['CSV','JSON','SYSLOG','CEF','KEY_VALUE'][p_partkey % 5 + 1] AS format_type,
  p_brand AS vendor, CASE WHEN p_partkey % 3 = 0 THEN 'src' || p_partkey END AS source_identifier, p_size % 4 <> 0 AS active,
  CAST(trunc(p_retailprice * 10) AS BIGINT) AS logs_processed FROM part)"""


@query("choose_parsers", "WITH " + _PARSERS + """,
act AS (SELECT * FROM pp WHERE active),
b1 AS (SELECT source_identifier, max((logs_processed, parser_id)) AS b FROM act GROUP BY 1),
b2 AS (SELECT vendor, format_type, max((logs_processed, parser_id)) AS b FROM act GROUP BY 1, 2),
b3 AS (SELECT format_type, max((logs_processed, parser_id)) AS b FROM act GROUP BY 1),
b4 AS (SELECT max((logs_processed, parser_id)) AS b FROM act),
req AS (SELECT c_custkey, 'src' || c_custkey AS source, 'Brand#' || (c_custkey % 27) AS vendor, ['CSV','JSON','SYSLOG','CEF','KEY_VALUE','RAW'][c_custkey % 6 + 1] AS format_type FROM customer)
SELECT c_custkey, coalesce(b1.b[2], b2.b[2], b3.b[2], b4.b[2]) AS parser_id,
  CASE WHEN b1.b IS NOT NULL THEN 1 WHEN b2.b IS NOT NULL THEN 2 WHEN b3.b IS NOT NULL THEN 3 ELSE 4 END::BIGINT AS matched_by
FROM req LEFT JOIN b1 ON b1.source_identifier = req.source LEFT JOIN b2 ON b2.vendor = req.vendor AND b2.format_type = req.format_type
LEFT JOIN b3 ON b3.format_type = req.format_type, b4""")
def choose_parsers(spark, sf):
    k = F.col("c_custkey")
    req = V.table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit("src"), _s(k)).alias("source"), F.concat(F.lit("Brand#"), _s(k % 27)).alias("vendor"),
        F.element_at(F.array(*map(F.lit, ["CSV", "JSON", "SYSLOG", "CEF", "KEY_VALUE", "RAW"])), (k % 6 + 1).cast("int")).alias("format_type"))
    return G.choose_parsers(req, _parsers(spark, sf)).select("c_custkey", "parser_id", F.col("matched_by").cast("bigint").alias("matched_by"))


def _usage(spark, sf):
    k = F.col("o_orderkey")
    return G.usage_rows(V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("p"), _s(F.col("o_custkey") % 400)).alias("parser_id"),
        F.timestamp_seconds(F.lit(V.BASE_SECONDS) + k).alias("timestamp"), (k % 50 + 1).alias("logs_count"),
        (k % 50 + 1 - k % 3).alias("success_count"), (k % 900).alias("parse_time_ms")))


@query("parser_statistics", "WITH " + _PARSERS + f""",
us AS (SELECT 'p' || (o_custkey % 400) AS parser_id, sum(o_orderkey % 50 + 1) AS n, sum(o_orderkey % 50 + 1 - o_orderkey % 3) AS ok, sum(o_orderkey % 900) AS ms,
  max({V.BASE_SECONDS} + o_orderkey) AS last_s FROM orders GROUP BY 1)
SELECT pp.parser_id, CAST(logs_processed + coalesce(n, 0) AS BIGINT) AS logs_processed,
  round(CASE WHEN n IS NULL THEN 90.0 ELSE (90.0 * logs_processed + ok * 100.0) / (logs_processed + n) END::DOUBLE, 6) AS parse_success_rate,
  CAST(CASE WHEN n IS NULL THEN 4 ELSE floor((4 * logs_processed + ms) / (logs_processed + n)) END AS BIGINT) AS avg_parse_time_ms, last_s
FROM pp LEFT JOIN us USING (parser_id)""")
def parser_statistics(spark, sf):
    return G.merge_statistics(_parsers(spark, sf), _usage(spark, sf)).select(
        "parser_id", "logs_processed", F.round("parse_success_rate", 6).alias("parse_success_rate"), "avg_parse_time_ms",
        F.unix_seconds("last_used").alias("last_s"))


@query("parser_recent_usage", f"""
SELECT parser_id, rn, last_s, failure_count FROM (
  SELECT 'p' || (o_custkey % 400) AS parser_id, {V.BASE_SECONDS} + o_orderkey AS last_s, o_orderkey % 3 AS failure_count,
    row_number() OVER (PARTITION BY o_custkey % 400 ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn <= 10""")
def parser_recent_usage(spark, sf):
    return G.recent_usage(_usage(spark, sf)).select("parser_id", F.col("rn").cast("bigint").alias("rn"), F.unix_seconds("timestamp").alias("last_s"), "failure_count")


@query("parser_listing", "WITH " + _PARSERS + """
SELECT parser_id, vendor FROM pp WHERE active AND format_type = 'JSON'""")
def parser_listing(spark, sf):
    return G.list_parsers(_parsers(spark, sf), format_type="JSON").select("parser_id", "vendor")


@query("parser_maintenance", "WITH " + _PARSERS + """
SELECT parser_id, CASE WHEN k % 10 = 1 THEN 'New' ELSE vendor END AS vendor, active FROM pp WHERE k % 10 <> 0""")
def parser_maintenance(spark, sf):
    p = _parsers(spark, sf)
    number = F.substring("parser_id", 2, 20).cast("bigint")
    changed = G.update_parsers(p, p.filter(number % 10 == 1).select("parser_id", F.lit("New").alias("vendor")))
    return G.delete_parsers(changed, p.filter(number % 10 == 0)).select("parser_id", "vendor", "active")


@query("parser_import", "WITH " + _PARSERS + """
SELECT parser_name, vendor, lower(replace(replace(vendor || '-' || parser_name, ' ', '-'), '_', '-')) || '-' ||
  left(md5(parser_name || '-' || vendor || '-' || strftime(make_timestamp((1704067200 + k) * 1000000), '%Y-%m-%dT%H:%M:%S')), 6) AS parser_id
FROM pp WHERE k % 2 = 0""")
def parser_import(spark, sf):
    p = _parsers(spark, sf)
    number = F.substring("parser_id", 2, 20).cast("bigint")
    documents = G.export_parsers(p.filter(number % 2 == 0))
    kept = p.filter(number % 2 == 1)
    return G.import_parsers(kept, documents).join(kept.select("parser_id"), "parser_id", "left_anti").select(
        "parser_name", "vendor", "parser_id")
