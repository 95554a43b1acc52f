"""Small pieces of SQL text used by several twins."""

from __future__ import annotations


def iso(us: str) -> str:
    """ISO text of microseconds, fraction only when there is one."""
    whole = f"strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S')"
    return (
        f"(CASE WHEN ({us}) % 1000000 = 0 THEN {whole} || 'Z' "
        f"ELSE {whole} || '.' || rtrim(lpad(CAST(({us}) % 1000000 AS VARCHAR), 6, '0'), '0') || 'Z' END)"
    )


def key(*parts: str) -> str:
    return "sha256(" + " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"


def evidence(*rows: tuple[str, str, str, str]) -> str:
    items = []
    for src, us, details, ip in rows:
        items.append(
            f"'{{\"src\":\"{src}\",\"ts\":\"' || {iso(us)} || '\",\"details\":\"' || {details} || '\"' || "
            f"CASE WHEN {ip} = '' THEN '' ELSE ',\"ip\":\"' || {ip} || '\"' END || '}}'"
        )
    return "'[' || " + " || ',' || ".join(items) + " || ']'"


#: Endpoint and firewall rows in the common correlation shape.
EVENTS = """
w AS (
  SELECT id, us, eventid_0 AS event_id,
         CASE WHEN sourceip_2 <> '' THEN sourceip_2 ELSE ipaddress_3 END AS src_ip,
         destinationip_2 AS dst_ip, destinationport_2 AS dst_port,
         CASE WHEN agent_host <> '' THEN agent_host ELSE computer_0 END AS agent_host,
         mitre_technique, severity, event_details, logontype_3 AS logon_type
  FROM sec WHERE severity NOT IN ('INFO', '')
),
f AS (
  SELECT id, us, log_type || '/' || threat_type AS event_id, src_ip, dst_ip, dst_port, mitre_technique,
         threat_level AS severity, event_details, action, sent_bytes
  FROM fwv WHERE threat_level NOT IN ('INFO', '')
)"""
