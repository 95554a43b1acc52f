"""Firewall verdicts: nine ordered rules, first match wins."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.functions.text import computed_once, field, has, pick, to_long

# Ports and service names.
C2_PORTS = ["4444", "4445", "5555", "6666", "7777", "1337", "31337", "9001", "9030", "6667", "6697"]
SENSITIVE_PORTS = {
    "22": "SSH", "3389": "RDP", "5985": "WinRM-HTTP", "5986": "WinRM-HTTPS", "445": "SMB", "135": "RPC",
    "137": "NetBIOS", "139": "NetBIOS-Session", "1433": "MSSQL", "3306": "MySQL", "5432": "PostgreSQL",
    "27017": "MongoDB", "6379": "Redis", "9200": "Elasticsearch",
}
LATERAL_PORTS = {"445": "SMB", "3389": "RDP", "5985": "WinRM", "22": "SSH", "135": "RPC", "5986": "WinRM-HTTPS"}
BLOCKED = ["DROP", "DENY", "REJECT"]
LARGE_TRANSFER_BYTES = 50_000_000

# Rules in order; level and technique of some depend on the row and are refined below.
RULES = [  # number, level, type, technique, module
    (0, "INFO", "", "", ""),
    (1, "HIGH", "IDS_IPS_ALERT", "T1190", "Firewall_IDS"),
    (2, "CRITICAL", "C2_PORT_OUTBOUND", "T1571", "Firewall_C2"),
    (3, "MEDIUM", "EXTERNAL_ACCESS_SENSITIVE_PORT", "T1133", "Firewall_ExternalAccess"),
    (4, "MEDIUM", "LATERAL_MOVEMENT_INDICATOR", "T1021", "Firewall_LateralMovement"),
    (5, "MEDIUM", "LARGE_OUTBOUND_TRANSFER", "T1041", "Firewall_Exfil"),
    (6, "MEDIUM", "DNS_OVER_TCP", "T1071.004", "Firewall_DNSTunnel"),
    (7, "LOW", "PROTOCOL_ANOMALY", "T1571", "Firewall_Anomaly"),
    (8, "LOW", "FIREWALL_DENY", "", "Firewall_Policy"),
]

VERDICT_COLUMNS = ["threat_level", "threat_type", "mitre_technique", "detection_module", "event_details"]


def _service(port: Column, names: dict[str, str]) -> Column:
    chain = None
    for number, name in names.items():
        chain = F.when(port == number, name) if chain is None else chain.when(port == number, name)
    return chain


def detect_firewall(df: DataFrame) -> DataFrame:
    """Add level, type, technique, module and details to firewall events."""
    f = {n: field(df, n) for n in (
        "action", "dst_port", "src_ip", "dst_ip", "protocol", "log_type", "log_component", "src_zone_type",
        "dst_zone_type", "severity", "message", "classification", "sent_bytes", "app_name", "fw_rule_id",
    )}
    e = SimpleNamespace(**f)
    action, protocol = F.upper(e.action), F.upper(e.protocol)
    log_type, component = F.lower(e.log_type), F.lower(e.log_component)
    zone_from, zone_to = F.upper(e.src_zone_type), F.upper(e.dst_zone_type)
    blocked = action.isin(BLOCKED)

    number = (
        F.when(has(log_type, "ids", "ips", "atp", "sandbox") | has(component, "intrusion", "advanced threat"), 1)
        .when(e.dst_port.isin(C2_PORTS), 2)
        .when(e.dst_port.isin(list(SENSITIVE_PORTS)) & (zone_from == "WAN") & (zone_to == "LAN"), 3)
        .when(e.dst_port.isin(list(LATERAL_PORTS)) & (zone_from == "LAN") & (zone_to == "LAN"), 4)
        .when((zone_from == "LAN") & (zone_to == "WAN") & (to_long(e.sent_bytes) > LARGE_TRANSFER_BYTES), 5)
        .when((e.dst_port == "53") & (protocol == "TCP"), 6)
        .when(e.dst_port.isin("80", "443") & (protocol != "TCP") & (protocol != ""), 7)
        .when(blocked, 8)
        .otherwise(0)
    )
    base = [c for c in df.columns if c not in VERDICT_COLUMNS]
    numbered = computed_once(df.select(*base, number.alias("__fw_n")), "__fw_n")
    n = F.col("__fw_n")
    _, levels, types, techniques, modules = (list(column) for column in zip(*RULES, strict=True))
    level = (
        F.when((n == 1) & (F.lower(e.severity) == "critical"), "CRITICAL")
        .when((n == 2) & blocked, "HIGH")
        .when((n == 3) & (action == "ALLOW"), "HIGH")
        .otherwise(pick(levels, n + 1))
    )
    technique = F.when((n == 3) & e.dst_port.isin("22", "3389"), "T1021.001").otherwise(pick(techniques, n + 1))
    arrow = F.concat(e.src_ip, F.lit(" → "), e.dst_ip)
    details = (
        F.when(n == 1, F.concat(F.lit("Sophos IDS/ATP: "), e.message, F.lit(" | class="), e.classification,
                                F.lit(" src="), e.src_ip))
        .when(n == 2, F.concat(F.lit("Connection to known C2 port "), e.dst_port, F.lit(": "), arrow, F.lit(" ["),
                               action, F.lit("]")))
        .when(n == 3, F.concat(F.lit("External → internal "), _service(e.dst_port, SENSITIVE_PORTS), F.lit(" ("),
                               e.dst_port, F.lit("): "), arrow, F.lit(" ["), action, F.lit("]")))
        .when(n == 4, F.concat(F.lit("Internal host using "), _service(e.dst_port, LATERAL_PORTS),
                               F.lit(" to reach another internal host: "), arrow))
        .when(n == 5, F.concat(F.lit("Large outbound from "), e.src_ip, F.lit(": "), e.sent_bytes, F.lit(" bytes → "),
                               e.dst_ip, F.lit(" ["), e.app_name, F.lit("]")))
        .when(n == 6, F.concat(F.lit("DNS over TCP from "), e.src_ip, F.lit(" – possible tunneling")))
        .when(n == 7, F.concat(F.lit("Non-TCP traffic on port "), e.dst_port, F.lit(" proto="), protocol,
                               F.lit(" from "), e.src_ip))
        .when(n == 8, F.concat(F.lit("Blocked: "), arrow, F.lit(":"), e.dst_port, F.lit(" ["), protocol,
                               F.lit("] rule="), e.fw_rule_id))
        .otherwise("")
    )
    return numbered.select(
        *base,
        level.alias("threat_level"),
        pick(types, n + 1).alias("threat_type"),
        technique.alias("mitre_technique"),
        pick(modules, n + 1).alias("detection_module"),
        details.alias("event_details"),
    )
