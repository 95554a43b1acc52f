"""Firewall syslog lines to firewall events, as column expressions.

Two field mappings exist: the ``universal`` one with alias lists, and the
``device`` one with single names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.functions.text import first_filled, strip
from logwarden.functions.times import as_timestamp

# Line patterns.
HEADER = r"^<\d+>\S+\s+\S+\s+"
PAIR = r'\w+=(?:"[^"]*"|\S*)'
FRAMED = r"^<[^>]*>\s*[12] "

# Target column -> source keys, first filled one wins.
UNIVERSAL_FIELDS = {
    "device_name": ["device_name", "devname", "device"],
    "device_id": ["device_id", "devid"],
    "log_date": ["log_date", "date"],
    "log_time": ["log_time", "time"],
    "timezone": ["timezone", "tz"],
    "log_id": ["log_id", "logid", "cef_signature_id"],
    "log_type": ["log_type", "type"],
    "log_component": ["log_component", "log_type", "type"],
    "log_subtype": ["log_subtype", "subtype"],
    "status": ["status"],
    "priority": ["priority", "level", "cef_severity"],
    "action": ["action", "act", "status"],
    "src_ip": ["src_ip", "srcip", "src"],
    "src_port": ["src_port", "srcport", "spt"],
    "src_mac": ["src_mac", "srcmac"],
    "src_country_code": ["src_country_code", "srccountry"],
    "src_zone": ["src_zone", "srcintf", "srcinterface", "srczone"],
    "src_zone_type": ["src_zone_type", "srcintfrole", "srczonetype"],
    "src_trans_ip": ["src_trans_ip", "transip"],
    "dst_ip": ["dst_ip", "dstip", "dst", "dstaddr"],
    "dst_port": ["dst_port", "dstport", "dpt"],
    "dst_country_code": ["dst_country_code", "dstcountry"],
    "dst_zone": ["dst_zone", "dstintf", "dstinterface", "dstzone"],
    "dst_zone_type": ["dst_zone_type", "dstintfrole", "dstzonetype"],
    "protocol": ["protocol"],
    "ether_type": ["ether_type"],
    "conn_event": ["conn_event", "event", "action"],
    "conn_id": ["conn_id", "connid", "sessionid", "session_id"],
    "sent_bytes": ["sent_bytes", "sentbyte", "bytes_sent"],
    "recv_bytes": ["recv_bytes", "rcvdbyte", "bytes_received"],
    "sent_pkts": ["sent_pkts", "sentpkt"],
    "recv_pkts": ["recv_pkts", "rcvdpkt"],
    "fw_rule_id": ["fw_rule_id", "policyid", "ruleid"],
    "nat_rule_id": ["nat_rule_id"],
    "fw_type": ["fw_type", "type"],
    "user": ["user", "usr", "dstuser", "srcuser"],
    "user_group": ["user_group", "group"],
    "app_name": ["app_name", "service", "app", "appid"],
    "app_risk": ["app_risk", "apprisk", "appcat"],
    "message": ["message", "msg", "cef_name"],
    "severity": ["severity", "level", "cef_severity"],
    "classification": ["classification", "appcat", "subtype"],
    "url": ["url", "hostname", "dsthost"],
}
# The device mapping differs from "same name" only here.
DEVICE_NAMES = {
    "log_date": ["date"], "log_time": ["time"], "action": ["action", "status"], "src_zone": ["srczone"],
    "src_zone_type": ["srczonetype"], "dst_zone": ["dstzone"], "dst_zone_type": ["dstzonetype"],
    "conn_event": ["connevent"], "conn_id": ["connid"], "fw_type": ["type"], "url": ["url", "dst_host"],
}
COUNTERS = ["sent_bytes", "recv_bytes", "sent_pkts", "recv_pkts"]
PROTOCOLS = {"TCP": ["6", "tcp"], "UDP": ["17", "udp"], "ICMP": ["1", "icmp"]}


def strip_header(raw: Column) -> Column:
    """Drop the first ``<pri>timestamp host `` of a line."""
    return F.regexp_replace(raw, HEADER, "")


def strip_any_header(raw: Column) -> Column:
    """As :func:`strip_header`, and the seven leading fields of lines that
    carry a protocol version after the priority."""
    simple = strip(strip_header(raw))
    after = strip(F.regexp_extract(raw, r"^<[^>]*>([\s\S]*)$", 1))
    parts = F.split(after, " ", 7)
    framed = raw.rlike(FRAMED) & (F.size(parts) == 7)
    return F.when(simple == "", raw).when(framed, strip(F.get(parts, F.lit(6)))).otherwise(simple)


def pairs(text: Column) -> Column:
    """``key=value`` and ``key="value"`` pairs as an array of structs, last
    first, without empty values.  One regex pass over the line."""
    def one(token: Column) -> Column:
        key = F.substring_index(token, "=", 1)
        value = F.substring(token, F.length(key) + 2, F.length(token))
        quoted = (F.length(value) >= 2) & value.startswith('"') & value.endswith('"')
        return F.struct(key.alias("key"), F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
                        .alias("value"))

    tokens = F.regexp_extract_all(text, F.lit("(" + PAIR + ")"), F.lit(1))
    return F.reverse(F.filter(F.transform(tokens, one), lambda p: p["value"] != ""))


def lookup(keys: Column, values: Column, key: str) -> Column:
    """Value at the first position of ``key``, NULL when it is absent."""
    return F.get(values, (F.array_position(keys, key) - 1).cast("int"))


def protocol_name(value: Column) -> Column:
    """Protocol numbers 6, 17 and 1 by name; other integers stay, words go upper-case."""
    v = strip(value)
    chain = None
    for name, spellings in PROTOCOLS.items():
        hit = F.lower(v).isin(spellings)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.when(v.rlike(r"^[+-]?\d+$"), F.coalesce(v.try_cast("bigint").cast("string"), F.upper(v))).otherwise(F.upper(v))


# Names of the CEF header parts.  The universal reader counts
# them from the part that still holds the "CEF:" prefix, the device reader
# from the one after it.
CEF_UNIVERSAL = ["cef_device_vendor", "cef_device_product", "cef_device_version", "cef_signature_id", "log_component",
                 "cef_name", "cef_severity"]
CEF_DEVICE = [None, "cef_device_vendor", "cef_device_product", "cef_device_version", "cef_signature_id", "log_component",
              "cef_severity"]


def normalize_firewall(lines: DataFrame, flavour: str = "universal", raw_col: str = "raw_log",
                       sensor_col: str = "sensor_ip", ingest_col: str = "ingest_ts") -> DataFrame:
    """Firewall events of raw lines; other columns of ``lines`` are kept.

    Blank lines are dropped.  ``flavour`` is ``universal`` or ``device``.
    """
    universal = flavour == "universal"
    kept = [c for c in lines.columns if c not in (raw_col, sensor_col, ingest_col)]
    raw = strip(F.col(raw_col))
    staged = lines.withColumn("__raw", raw).filter(F.col("__raw") != "").withColumn(
        "__body", strip_any_header(F.col("__raw")) if universal else F.col("__raw")
    )
    body = F.col("__body")
    cef_line = body.startswith("CEF:")
    if universal:
        kind = F.when(cef_line, "cef").when(body.contains("="), "kv").otherwise("text")
        names, kv_text = CEF_UNIVERSAL, body
    else:
        kind = F.when(body.contains("log_type=") | body.contains("device="), "kv").when(cef_line, "cef").otherwise("text")
        names, kv_text = CEF_DEVICE, strip_header(body)
    staged = staged.withColumn("__kind", kind)
    is_kv, is_cef, is_text = (F.col("__kind") == k for k in ("kv", "cef", "text"))
    parts = F.split(F.when(is_cef, body), r"\|", 8)
    whole = F.size(parts) >= 7
    staged = staged.withColumn("__parts", F.when(whole, parts)).withColumn(
        "__pairs", pairs(F.when(is_kv, kv_text).otherwise(F.coalesce(F.get("__parts", F.lit(7)), F.lit(""))))
    )
    staged = staged.withColumn("__keys", F.transform("__pairs", lambda p: p["key"])).withColumn(
        "__values", F.transform("__pairs", lambda p: p["value"])
    )

    def source(key: str) -> Column:
        value = lookup(F.col("__keys"), F.col("__values"), key)
        if key in names:
            header = F.get("__parts", F.lit(names.index(key)))
            if key == "cef_device_vendor" and universal:
                header = F.regexp_replace(header, "^CEF:", "")
            value = F.coalesce(value, header)
        if key == "message":
            value = F.when(is_text, body).otherwise(value)
        return value

    def target(name: str) -> Column:
        default = "0" if name in COUNTERS else ""
        if universal:
            candidates = [source(k) for k in UNIVERSAL_FIELDS[name]]
            if name == "protocol":
                candidates.append(protocol_name(source("proto")))
            return first_filled(*candidates, default=default)
        return F.coalesce(*[source(k) for k in DEVICE_NAMES.get(name, [name])], F.lit(default))

    return staged.select(
        *kept,
        as_timestamp(ingest_col).alias("received_at"),
        strip(F.col(sensor_col)).alias("sensor_ip") if universal else F.col(sensor_col).alias("sensor_ip"),
        F.col("__raw").alias("raw_log"),
        *[target(name).alias(name) for name in UNIVERSAL_FIELDS],
    )
