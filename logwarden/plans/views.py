"""Security-log views over the given tables, for Spark and as SQL text.

The given tables hold no security logs, so these views project their rows to
endpoint events, firewall events, standardized logs, SCADA events, process
edges and raw lines.  They are narrow projections: column pruning and filters
still reach the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.functions.times import whole_division
from logwarden.plans import templates as T

BASE_SECONDS = 1_704_067_200  # 2024-01-01T00:00:00Z
BASE_US = BASE_SECONDS * 1_000_000

PORTS = [
    "4444", "443", "80", "53", "3389", "445", "22", "5985", "135", "9001", "8080", "25", "1433", "5432", "139", "5986",
]
_PORT_LIST = ", ".join(f"'{p}'" for p in PORTS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt to all tasks by a hash of ``columns``, before dear work on each: one row group of a file is one task's."""
    return rows.repartition(*columns)


def _lit_if(cond: Column, value: str, other: Column | str) -> Column:
    return F.when(cond, F.lit(value)).otherwise(other)


def _str(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _ip(number: Column) -> Column:
    """10.0.x.y of a number."""
    return F.concat(
        F.lit("10.0."), _str(whole_division(number, 250)), F.lit("."), _str(number % 250 + 1)
    )


def _compressed(ts: str, factor: int) -> Column:
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    return F.timestamp_micros(F.lit(BASE_US) + whole_division(us - F.lit(BASE_US), factor))


def templates(spark: SparkSession) -> DataFrame:
    columns = ", ".join(["tid", *T.FIELDS])
    return spark.sql(f"SELECT * FROM ({T.template_values(True)}) AS t({columns})")


def security(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoint events: each row of ``events`` shaped by one template.

    The template list has a fixed size (under 200 rows), so it is broadcast.
    """
    ev = table(spark, sf_dir, "events").withColumn(
        "tid",
        F.when(F.col("event_type") == "error", F.lit(T.LOGON_FAILURE).cast("bigint")).otherwise(
            F.col("event_id") % len(T.TEMPLATES)
        ),
    )
    joined = ev.join(F.broadcast(templates(spark)), "tid")
    src = F.when(F.col("event_type") == "error", _ip(F.col("user_id") % 7)).otherwise(_ip(F.col("user_id")))
    sysmon = F.col("logsource_5") == "Sysmon"
    return joined.select(
        F.col("event_id").alias("id"),
        F.col("tid"),
        _compressed("ts", 60).alias("ts"),
        _lit_if(F.col("event_id") % 11 == 0, "", F.concat(F.lit("host-"), _str("user_id"))).alias("agent_host"),
        F.concat(F.lit("pc-"), _str("user_id")).alias("computer_0"),
        F.when(sysmon, "Microsoft-Windows-Sysmon").otherwise("").alias("providername_0"),
        F.when(sysmon, src).otherwise("").alias("sourceip_2"),
        F.when(sysmon, "").otherwise(src).alias("ipaddress_3"),
        *T.FIELDS,
    )


def firewall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firewall events: one per row of ``lineitem``."""
    ok, ln, pk, sk = (F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    seconds = (ok * 7 + ln * 13) % 43200
    src = (
        F.when(ok % 211 == 0, F.lit(""))
        .when(ok % 23 == 0, F.concat(F.lit("host-"), _str(sk % 150)))
        .otherwise(_ip(sk % 150))
    )
    action = (
        F.when((ok + ln) % 6 == 0, "ALLOW").when((ok + ln) % 6 == 1, "DROP").when((ok + ln) % 6 == 2, "ALLOW")
        .when((ok + ln) % 6 == 3, "Deny").when((ok + ln) % 6 == 4, "allow").otherwise("REJECT")
    )
    kilobytes = F.floor("l_extendedprice").cast("bigint")
    return table(spark, sf_dir, "lineitem").select(
        ((ok * 10 + ln) * 100_000_000 + F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("id"),
        F.timestamp_seconds(F.lit(BASE_SECONDS) + seconds).alias("ts"),
        F.concat(F.lit("fw-"), _str(sk % 5)).alias("device_name"),
        F.when(pk % 101 == 0, "IDP ips").otherwise("Firewall").alias("log_type"),
        F.when(pk % 103 == 0, "Advanced Threat").otherwise("Rule").alias("log_component"),
        action.alias("action"),
        src.alias("src_ip"),
        F.concat(F.lit("203.0.113."), _str(pk % 30)).alias("dst_ip"),
        F.element_at(F.array(*[F.lit(p) for p in PORTS]), (pk % 16 + 1).cast("int")).alias("dst_port"),
        F.when(ok % 17 == 0, "").when(F.col("l_linestatus") == "O", "TCP").otherwise("udp").alias("protocol"),
        F.when(F.col("l_returnflag") == "A", "wan").otherwise("LAN").alias("src_zone_type"),
        F.when(F.col("l_returnflag") == "N", "Wan").otherwise("lan").alias("dst_zone_type"),
        F.when(ok % 97 == 0, "abc").otherwise(_str(kilobytes * 1000)).alias("sent_bytes"),
        F.when(sk % 5 == 0, "Critical").otherwise("notice").alias("severity"),
        F.concat(F.lit("part "), _str(pk)).alias("message"),
        F.concat(F.lit("c"), _str(ln)).alias("classification"),
        F.concat(F.lit("app"), _str(ln)).alias("app_name"),
        _str(sk % 40).alias("fw_rule_id"),
    )


def parsed(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Standardized logs: one per row of ``events``, 30 days pressed into one hour; where ``spread``, dealt to all tasks."""
    events = table(spark, sf_dir, "events")
    if spread:
        events = dealt(events, "event_id", "ts", "user_id")
    n, u = F.col("event_id"), F.col("user_id")
    action = (
        F.when(F.col("event_type") == "error", "deny").when(F.col("event_type") == "signup", "Block")
        .when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "click", "allow")
    )
    return events.select(
        n.alias("id"),
        _compressed("ts", 720).alias("ts"),
        F.when(n % 3 == 0, "firewall").when(n % 3 == 1, "web_server").otherwise("application").alias("source_type"),
        F.concat(F.lit("dev-"), _str(u % 6)).alias("source_system"),
        F.when(n % 19 == 0, F.lit(None)).otherwise(_ip(u % 12)).alias("source_ip"),
        F.when(n % 17 == 0, F.lit(None)).otherwise(F.concat(F.lit("198.51.100."), _str(n * 7 % 40))).alias("dest_ip"),
        F.when(n % 13 == 0, F.lit(None)).otherwise((n * 31 % 70 + 1000).cast("int")).alias("dst_port"),
        F.when(n % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("user"), _str(u % 9))).alias("username"),
        action.alias("action"),
        F.when(n % 5 == 0, F.lit(None)).when(n % 5 == 1, 404).when(n % 5 == 2, 301).otherwise(200).cast("int")
        .alias("status_code"),
        F.concat(F.lit("event "), _str(n)).alias("log"),
    )


def scada(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCADA events whose time text comes in several layouts, some broken."""
    n = F.col("event_id")
    t = _compressed("ts", 60)
    whole = F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    iso = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    text = (
        F.when(n % 6 == 0, whole).when(n % 6 == 1, F.concat(iso, F.lit("Z")))
        .when(n % 6 == 2, F.concat(iso, F.lit("+0530"))).when(n % 6 == 3, F.concat(F.lit(" "), iso, F.lit("-02:00")))
        .when(n % 6 == 4, "").otherwise("yesterday")
    )
    return table(spark, sf_dir, "events").select(
        n.alias("id"),
        t.alias("received_at"),
        F.when(n % 10 == 0, "").otherwise(F.concat(F.lit("plc-"), _str(F.col("user_id") % 8))).alias("source"),
        text.alias("timestamp"),
        F.when(n % 29 == 0, "").otherwise(F.concat(F.lit("TAG"), _str(n % 50))).alias("tag"),
        F.concat(F.lit("valve "), _str(F.col("user_id"))).alias("name"),
        F.col("event_type").alias("message"),
        F.when(F.col("event_type") == "error", "ALARM").otherwise("OK").alias("state"),
    )


def process_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process events: creation, remote thread, access and termination rows."""
    ok, ln, sk = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")
    guid = F.concat(F.lit("{"), _str(ok % 40), F.lit("-"), _str(ln), F.lit("}"))
    parent = F.when(ok % 9 == 0, "").otherwise(F.concat(F.lit("{"), _str(ok % 40), F.lit("-"), _str(ln - 1), F.lit("}")))
    kind = F.col("l_partkey") % 5
    event = F.when(kind < 2, "1").when(kind == 2, "8").when(kind == 3, "10").otherwise("5")
    linked = event.isin("8", "10")
    return table(spark, sf_dir, "lineitem").select(
        ((ok * 10 + ln) * 100_000_000 + F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("id"),
        F.timestamp_seconds(F.lit(BASE_SECONDS) + (ok * 7 + ln * 13) % 43200).alias("ts"),
        F.when(sk % 10 == 3, "").otherwise(F.concat(F.lit("host-"), _str(sk % 10))).alias("agent_host"),
        F.when(sk % 10 == 3, F.when(ok % 2 == 0, "pc-3").otherwise("")).otherwise("pc").alias("computer_0"),
        F.when(F.col("l_linestatus") == "O", "Microsoft-Windows-Sysmon").otherwise("Other").alias("providername_0"),
        event.alias("eventid_0"),
        F.when(linked, "").otherwise(guid).alias("processguid_2"),
        F.when(event == "1", parent).otherwise("").alias("parentprocessguid_2"),
        _str(ok % 5000).alias("processid_2"),
        _str(ok % 4999).alias("parentprocessid_2"),
        F.when(linked, guid).otherwise("").alias("sourceprocessguid_2"),
        _str(ok % 4000).alias("sourceprocessid_2"),
        F.when(linked & (ok % 13 != 0), F.concat(F.lit("{"), _str((ok * 3) % 40), F.lit("-1}"))).otherwise("")
        .alias("targetprocessguid_2"),
        _str(ok % 3000).alias("targetprocessid_2"),
    )


# --------------------------------------------------------------------------
# The same views as SQL.  Times are microseconds since the epoch ("us").
# --------------------------------------------------------------------------

_IP = "('10.0.' || CAST(({0}) // 250 AS VARCHAR) || '.' || CAST(({0}) % 250 + 1 AS VARCHAR))"

SQL_SECURITY = f"""
tmpl(tid, {", ".join(T.FIELDS)}) AS ({T.template_values(False)}),
want(tid, w_rule, w_severity, w_technique, w_module, w_details) AS ({T.expectation_values()}),
sec AS (
  SELECT e.event_id AS id, e.tid AS tid, e.us AS us,
         CASE WHEN e.event_id % 11 = 0 THEN '' ELSE 'host-' || CAST(e.user_id AS VARCHAR) END AS agent_host,
         'pc-' || CAST(e.user_id AS VARCHAR) AS computer_0,
         CASE WHEN t.logsource_5 = 'Sysmon' THEN 'Microsoft-Windows-Sysmon' ELSE '' END AS providername_0,
         CASE WHEN t.logsource_5 = 'Sysmon' THEN e.src ELSE '' END AS sourceip_2,
         CASE WHEN t.logsource_5 = 'Sysmon' THEN '' ELSE e.src END AS ipaddress_3,
         {", ".join("t." + f for f in T.FIELDS)},
         w.w_rule AS rule_id, w.w_severity AS severity, w.w_technique AS mitre_technique,
         w.w_module AS detection_module, w.w_details AS event_details
  FROM (SELECT *, CASE WHEN event_type = 'error' THEN {T.LOGON_FAILURE} ELSE event_id % {len(T.TEMPLATES)} END AS tid,
               CASE WHEN event_type = 'error' THEN {_IP.format("user_id % 7")} ELSE {_IP.format("user_id")} END AS src,
               {BASE_US} + (epoch_us(ts) - {BASE_US}) // 60 AS us
        FROM events) e
  JOIN tmpl t ON t.tid = e.tid JOIN want w ON w.tid = e.tid
)"""

_ACTION = (
    "CASE (l_orderkey + l_linenumber) % 6 WHEN 0 THEN 'ALLOW' WHEN 1 THEN 'DROP' WHEN 2 THEN 'ALLOW' "
    "WHEN 3 THEN 'Deny' WHEN 4 THEN 'allow' ELSE 'REJECT' END"
)
SQL_FIREWALL = f"""
fw AS (
  SELECT (l_orderkey * 10 + l_linenumber) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS id,
         ({BASE_SECONDS} + (l_orderkey * 7 + l_linenumber * 13) % 43200) * 1000000 AS us,
         'fw-' || CAST(l_suppkey % 5 AS VARCHAR) AS device_name,
         CASE WHEN l_partkey % 101 = 0 THEN 'IDP ips' ELSE 'Firewall' END AS log_type,
         CASE WHEN l_partkey % 103 = 0 THEN 'Advanced Threat' ELSE 'Rule' END AS log_component,
         {_ACTION} AS action,
         CASE WHEN l_orderkey % 211 = 0 THEN '' WHEN l_orderkey % 23 = 0 THEN 'host-' || CAST(l_suppkey % 150 AS VARCHAR)
              ELSE {_IP.format("l_suppkey % 150")} END AS src_ip,
         '203.0.113.' || CAST(l_partkey % 30 AS VARCHAR) AS dst_ip,
         [{_PORT_LIST}][l_partkey % 16 + 1] AS dst_port,
         CASE WHEN l_orderkey % 17 = 0 THEN '' WHEN l_linestatus = 'O' THEN 'TCP' ELSE 'udp' END AS protocol,
         CASE WHEN l_returnflag = 'A' THEN 'wan' ELSE 'LAN' END AS src_zone_type,
         CASE WHEN l_returnflag = 'N' THEN 'Wan' ELSE 'lan' END AS dst_zone_type,
         CASE WHEN l_orderkey % 97 = 0 THEN 'abc'
              ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) * 1000 AS VARCHAR) END AS sent_bytes,
         CASE WHEN l_suppkey % 5 = 0 THEN 'Critical' ELSE 'notice' END AS severity,
         'part ' || CAST(l_partkey AS VARCHAR) AS message,
         'c' || CAST(l_linenumber AS VARCHAR) AS classification,
         'app' || CAST(l_linenumber AS VARCHAR) AS app_name,
         CAST(l_suppkey % 40 AS VARCHAR) AS fw_rule_id
  FROM lineitem
)"""

SQL_FIREWALL_VERDICT = """
fwn AS (
  SELECT *, upper(action) AS ua, upper(protocol) AS up, upper(src_zone_type) AS zf, upper(dst_zone_type) AS zt,
         coalesce(TRY_CAST(sent_bytes AS BIGINT), 0) AS nbytes
  FROM fw
),
fwk AS (
  SELECT *, CASE
      WHEN lower(log_type) LIKE '%ids%' OR lower(log_type) LIKE '%ips%' OR lower(log_type) LIKE '%atp%'
        OR lower(log_type) LIKE '%sandbox%' OR lower(log_component) LIKE '%intrusion%'
        OR lower(log_component) LIKE '%advanced threat%' THEN 'ids'
      WHEN dst_port IN ('4444','4445','5555','6666','7777','1337','31337','9001','9030','6667','6697') THEN 'c2'
      WHEN zf = 'WAN' AND zt = 'LAN' AND dst_port IN ('22','3389','5985','5986','445','135','137','139','1433','3306',
           '5432','27017','6379','9200') THEN 'external'
      WHEN zf = 'LAN' AND zt = 'LAN' AND dst_port IN ('445','3389','5985','22','135','5986') THEN 'lateral'
      WHEN zf = 'LAN' AND zt = 'WAN' AND nbytes > 50000000 THEN 'exfil'
      WHEN dst_port = '53' AND up = 'TCP' THEN 'dns'
      WHEN dst_port IN ('80','443') AND up <> 'TCP' AND up <> '' THEN 'proto'
      WHEN ua IN ('DROP','DENY','REJECT') THEN 'deny'
      ELSE 'info' END AS kind
  FROM fwn
),
fwv AS (
  SELECT *, CASE kind
      WHEN 'ids' THEN CASE WHEN lower(severity) = 'critical' THEN 'CRITICAL' ELSE 'HIGH' END
      WHEN 'c2' THEN CASE WHEN ua IN ('DROP','DENY','REJECT') THEN 'HIGH' ELSE 'CRITICAL' END
      WHEN 'external' THEN CASE WHEN ua = 'ALLOW' THEN 'HIGH' ELSE 'MEDIUM' END
      WHEN 'lateral' THEN 'MEDIUM' WHEN 'exfil' THEN 'MEDIUM' WHEN 'dns' THEN 'MEDIUM'
      WHEN 'proto' THEN 'LOW' WHEN 'deny' THEN 'LOW' ELSE 'INFO' END AS threat_level,
    CASE kind WHEN 'ids' THEN 'IDS_IPS_ALERT' WHEN 'c2' THEN 'C2_PORT_OUTBOUND'
      WHEN 'external' THEN 'EXTERNAL_ACCESS_SENSITIVE_PORT' WHEN 'lateral' THEN 'LATERAL_MOVEMENT_INDICATOR'
      WHEN 'exfil' THEN 'LARGE_OUTBOUND_TRANSFER' WHEN 'dns' THEN 'DNS_OVER_TCP' WHEN 'proto' THEN 'PROTOCOL_ANOMALY'
      WHEN 'deny' THEN 'FIREWALL_DENY' ELSE '' END AS threat_type,
    CASE kind WHEN 'ids' THEN 'T1190' WHEN 'c2' THEN 'T1571'
      WHEN 'external' THEN CASE WHEN dst_port IN ('22','3389') THEN 'T1021.001' ELSE 'T1133' END
      WHEN 'lateral' THEN 'T1021' WHEN 'exfil' THEN 'T1041' WHEN 'dns' THEN 'T1071.004' WHEN 'proto' THEN 'T1571'
      ELSE '' END AS mitre_technique,
    CASE kind WHEN 'ids' THEN 'Firewall_IDS' WHEN 'c2' THEN 'Firewall_C2' WHEN 'external' THEN 'Firewall_ExternalAccess'
      WHEN 'lateral' THEN 'Firewall_LateralMovement' WHEN 'exfil' THEN 'Firewall_Exfil' WHEN 'dns' THEN 'Firewall_DNSTunnel'
      WHEN 'proto' THEN 'Firewall_Anomaly' WHEN 'deny' THEN 'Firewall_Policy' ELSE '' END AS detection_module,
    CASE kind
      WHEN 'ids' THEN 'Sophos IDS/ATP: ' || message || ' | class=' || classification || ' src=' || src_ip
      WHEN 'c2' THEN 'Connection to known C2 port ' || dst_port || ': ' || src_ip || ' → ' || dst_ip || ' [' || ua || ']'
      WHEN 'external' THEN 'External → internal ' || CASE dst_port WHEN '22' THEN 'SSH' WHEN '3389' THEN 'RDP'
          WHEN '5985' THEN 'WinRM-HTTP' WHEN '5986' THEN 'WinRM-HTTPS' WHEN '445' THEN 'SMB' WHEN '135' THEN 'RPC'
          WHEN '137' THEN 'NetBIOS' WHEN '139' THEN 'NetBIOS-Session' WHEN '1433' THEN 'MSSQL' WHEN '3306' THEN 'MySQL'
          WHEN '5432' THEN 'PostgreSQL' WHEN '27017' THEN 'MongoDB' WHEN '6379' THEN 'Redis' ELSE 'Elasticsearch' END
          || ' (' || dst_port || '): ' || src_ip || ' → ' || dst_ip || ' [' || ua || ']'
      WHEN 'lateral' THEN 'Internal host using ' || CASE dst_port WHEN '445' THEN 'SMB' WHEN '3389' THEN 'RDP'
          WHEN '5985' THEN 'WinRM' WHEN '22' THEN 'SSH' WHEN '135' THEN 'RPC' ELSE 'WinRM-HTTPS' END
          || ' to reach another internal host: ' || src_ip || ' → ' || dst_ip
      WHEN 'exfil' THEN 'Large outbound from ' || src_ip || ': ' || sent_bytes || ' bytes → ' || dst_ip || ' [' || app_name || ']'
      WHEN 'dns' THEN 'DNS over TCP from ' || src_ip || ' – possible tunneling'
      WHEN 'proto' THEN 'Non-TCP traffic on port ' || dst_port || ' proto=' || up || ' from ' || src_ip
      WHEN 'deny' THEN 'Blocked: ' || src_ip || ' → ' || dst_ip || ':' || dst_port || ' [' || up || '] rule=' || fw_rule_id
      ELSE '' END AS event_details
  FROM fwk
)"""

SQL_PARSED = f"""
parsed AS (
  SELECT event_id AS id, {BASE_US} + (epoch_us(ts) - {BASE_US}) // 720 AS us,
         CASE event_id % 3 WHEN 0 THEN 'firewall' WHEN 1 THEN 'web_server' ELSE 'application' END AS source_type,
         'dev-' || CAST(user_id % 6 AS VARCHAR) AS source_system,
         CASE WHEN event_id % 19 = 0 THEN NULL ELSE {_IP.format("user_id % 12")} END AS source_ip,
         CASE WHEN event_id % 17 = 0 THEN NULL ELSE '198.51.100.' || CAST(event_id * 7 % 40 AS VARCHAR) END AS dest_ip,
         CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id * 31 % 70 + 1000 AS INTEGER) END AS dst_port,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'user' || CAST(user_id % 9 AS VARCHAR) END AS username,
         CASE event_type WHEN 'error' THEN 'deny' WHEN 'signup' THEN 'Block' WHEN 'purchase' THEN 'success'
              WHEN 'click' THEN 'allow' END AS action,
         CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 404 WHEN 2 THEN 301 ELSE 200 END AS status_code,
         'event ' || CAST(event_id AS VARCHAR) AS log
  FROM events
)"""

SQL_SCADA = f"""
scada0 AS (SELECT *, {BASE_US} + (epoch_us(ts) - {BASE_US}) // 60 AS us FROM events),
scada AS (
  SELECT event_id AS id, us,
         CASE WHEN event_id % 10 = 0 THEN '' ELSE 'plc-' || CAST(user_id % 8 AS VARCHAR) END AS source,
         CASE event_id % 6 WHEN 0 THEN us // 1000000 WHEN 1 THEN us // 1000000 WHEN 2 THEN us // 1000000 - 19800
              WHEN 3 THEN us // 1000000 + 7200 END AS parsed_s,
         CASE WHEN event_id % 29 = 0 THEN '' ELSE 'TAG' || CAST(event_id % 50 AS VARCHAR) END AS tag,
         'valve ' || CAST(user_id AS VARCHAR) AS name, event_type AS message,
         CASE WHEN event_type = 'error' THEN 'ALARM' ELSE 'OK' END AS state
  FROM scada0
)"""

SQL_EDGES = f"""
edges0 AS (
  SELECT *, CASE WHEN l_partkey % 5 < 2 THEN '1' WHEN l_partkey % 5 = 2 THEN '8' WHEN l_partkey % 5 = 3 THEN '10' ELSE '5' END AS ev,
         '{{' || CAST(l_orderkey % 40 AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '}}' AS guid,
         CASE WHEN l_orderkey % 9 = 0 THEN '' ELSE '{{' || CAST(l_orderkey % 40 AS VARCHAR) || '-' || CAST(l_linenumber - 1 AS VARCHAR) || '}}' END AS parent
  FROM lineitem
),
edges AS (
  SELECT (l_orderkey * 10 + l_linenumber) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS id,
         ({BASE_SECONDS} + (l_orderkey * 7 + l_linenumber * 13) % 43200) * 1000000 AS us,
         CASE WHEN l_suppkey % 10 = 3 THEN CASE WHEN l_orderkey % 2 = 0 THEN 'pc-3' ELSE 'unknown' END
              ELSE 'host-' || CAST(l_suppkey % 10 AS VARCHAR) END AS host,
         l_linestatus = 'O' AS is_sysmon, ev,
         CASE WHEN ev IN ('8','10') THEN '' ELSE guid END AS pg,
         CASE WHEN ev = '1' THEN parent ELSE '' END AS ppg,
         CAST(l_orderkey % 5000 AS VARCHAR) AS pid, CAST(l_orderkey % 4999 AS VARCHAR) AS ppid,
         CASE WHEN ev IN ('8','10') THEN guid ELSE '' END AS sg, CAST(l_orderkey % 4000 AS VARCHAR) AS sid,
         CASE WHEN ev IN ('8','10') AND l_orderkey % 13 <> 0 THEN '{{' || CAST((l_orderkey * 3) % 40 AS VARCHAR) || '-1}}' ELSE '' END AS tg,
         CAST(l_orderkey % 3000 AS VARCHAR) AS tpid
  FROM edges0
)"""


def with_views(*views: str) -> str:
    return "WITH " + ",".join(v.strip() for v in views)
