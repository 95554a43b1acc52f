"""The common event shape that correlation and window verdicts work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.functions.text import field, first_present, nz
from logwarden.functions.times import as_timestamp

EVENT_COLUMNS = [
    "id", "ts", "source", "event_id", "src_ip", "dst_ip", "dst_port", "agent_host", "mitre_technique", "severity",
    "event_details", "action", "sent_bytes", "command_line", "image_path", "granted_access", "logon_type",
]


def severity_filter(severity: Column, include_info: bool = False) -> Column:
    """Rows worth a look: not INFO and not blank."""
    levels = ["LOW", "MEDIUM", "HIGH", "CRITICAL"] + (["INFO"] if include_info else [])
    return nz(severity).isin(levels)


def not_info(severity: Column) -> Column:
    return ~F.coalesce(severity, F.lit("INFO")).isin("INFO", "")


def endpoint_events(df: DataFrame, id_col: str = "id", ts_col: str = "ts") -> DataFrame:
    """Endpoint rows with a verdict, non-INFO, in the common shape."""
    return df.filter(not_info(F.col("severity"))).select(
        F.col(id_col).alias("id"),
        as_timestamp(ts_col).alias("ts"),
        F.lit("windows").alias("source"),
        nz("eventid_0").alias("event_id"),
        first_present(field(df, "sourceip_2"), field(df, "ipaddress_3")).alias("src_ip"),
        field(df, "destinationip_2").alias("dst_ip"),
        field(df, "destinationport_2").alias("dst_port"),
        first_present(field(df, "agent_host"), field(df, "computer_0")).alias("agent_host"),
        nz("mitre_technique").alias("mitre_technique"),
        F.col("severity"),
        nz("event_details").alias("event_details"),
        F.lit("").alias("action"),
        F.lit("").alias("sent_bytes"),
        field(df, "commandline_2").alias("command_line"),
        field(df, "image_2").alias("image_path"),
        field(df, "grantedaccess_2").alias("granted_access"),
        field(df, "logontype_3").alias("logon_type"),
    )


def firewall_events(df: DataFrame, id_col: str = "id", ts_col: str = "ts") -> DataFrame:
    """Firewall rows with a verdict, non-INFO, in the common shape."""
    return df.filter(not_info(F.col("threat_level"))).select(
        F.col(id_col).alias("id"),
        as_timestamp(ts_col).alias("ts"),
        F.lit("firewall").alias("source"),
        F.concat(nz("log_type"), F.lit("/"), nz("threat_type")).alias("event_id"),
        nz("src_ip").alias("src_ip"),
        nz("dst_ip").alias("dst_ip"),
        nz("dst_port").alias("dst_port"),
        F.lit("").alias("agent_host"),
        nz("mitre_technique").alias("mitre_technique"),
        F.col("threat_level").alias("severity"),
        nz("event_details").alias("event_details"),
        nz("action").alias("action"),
        F.coalesce(F.col("sent_bytes"), F.lit("0")).alias("sent_bytes"),
        F.lit("").alias("command_line"),
        F.lit("").alias("image_path"),
        F.lit("").alias("granted_access"),
        F.lit("").alias("logon_type"),
    )


def pass_events(rows: DataFrame, source_type: str) -> DataFrame:
    """Window-verdict rows of one source as correlation input.

    Such rows carry no action, byte count or logon type, so the correlation
    rules find nothing in them until ``with_source_fields`` adds those.
    """
    return rows.filter((F.col("source_type") == source_type) & not_info(F.col("final_severity"))).select(
        F.col("source_event_id").alias("id"),
        as_timestamp("window_ts").alias("ts"),
        F.lit(source_type).alias("source"),
        nz("event_id").alias("event_id"),
        nz("src_ip").alias("src_ip"),
        nz("dst_ip").alias("dst_ip"),
        nz("dst_port").alias("dst_port"),
        nz("agent_host").alias("agent_host"),
        nz("final_mitre").alias("mitre_technique"),
        F.col("final_severity").alias("severity"),
        nz("final_summary").alias("event_details"),
        *[F.lit("").alias(c) for c in EVENT_COLUMNS[11:]],
    )


def with_source_fields(events: DataFrame, source_rows: DataFrame) -> DataFrame:
    """Fill action, bytes, logon type, … of window-verdict events from the rows
    they were made of, matched by id (``source_rows`` in the common shape)."""
    kept = [c for c in EVENT_COLUMNS if c not in EVENT_COLUMNS[11:] + ["src_ip"]]
    extra = source_rows.select("id", "src_ip", *EVENT_COLUMNS[11:])
    return events.select(*kept).join(extra, "id").select(*EVENT_COLUMNS)


def endpoint_pass_input(df: DataFrame, id_col: str = "id", ts_col: str = "ts", include_info: bool = False) -> DataFrame:
    """Endpoint rows as window-verdict input (twelve columns and the row id)."""
    return df.filter(severity_filter(F.col("severity"), include_info)).select(
        F.col(id_col).alias("source_event_id"),
        F.lit("windows").alias("source_type"),
        as_timestamp(ts_col).alias("ts"),
        field(df, "agent_host").alias("agent_host"),
        nz("eventid_0").alias("event_id"),
        nz("severity").alias("rule_severity"),
        nz("mitre_technique").alias("mitre_technique"),
        nz("detection_module").alias("detection_module"),
        nz("event_details").alias("event_details"),
        field(df, "sourceip_2").alias("src_ip"),
        field(df, "destinationip_2").alias("dst_ip"),
        field(df, "destinationport_2").alias("dst_port"),
        field(df, "image_2").alias("process_name"),
        field(df, "commandline_2").alias("command_line"),
        F.lit("").alias("action"),
        F.lit("").alias("sent_bytes"),
    )


def firewall_pass_input(df: DataFrame, id_col: str = "id", ts_col: str = "ts", include_info: bool = False) -> DataFrame:
    """Firewall rows as window-verdict input: device as host, log type as event id."""
    return df.filter(severity_filter(F.col("threat_level"), include_info)).select(
        F.col(id_col).alias("source_event_id"),
        F.lit("firewall").alias("source_type"),
        as_timestamp(ts_col).alias("ts"),
        nz("device_name").alias("agent_host"),
        nz("log_type").alias("event_id"),
        nz("threat_level").alias("rule_severity"),
        nz("mitre_technique").alias("mitre_technique"),
        nz("detection_module").alias("detection_module"),
        nz("event_details").alias("event_details"),
        nz("src_ip").alias("src_ip"),
        nz("dst_ip").alias("dst_ip"),
        nz("dst_port").alias("dst_port"),
        F.lit("").alias("process_name"),
        F.lit("").alias("command_line"),
        nz("action").alias("action"),
        nz("sent_bytes").alias("sent_bytes"),
    )


def events_by_ip(events: DataFrame) -> DataFrame:
    """Each event once under its source and, when different, its destination."""
    keys = F.filter(F.array_distinct(F.array("src_ip", "dst_ip")), lambda ip: ip != "")
    return events.select(F.explode(keys).alias("ip"), *events.columns)


def severity_rank(severity: Column) -> Column:
    """CRITICAL 5, HIGH 4, MEDIUM 3, LOW 2, anything else 1."""
    s = F.upper(severity)
    return F.when(s == "CRITICAL", 5).when(s == "HIGH", 4).when(s == "MEDIUM", 3).when(s == "LOW", 2).otherwise(1)


def highest_severity(severity: Column) -> Column:
    """Aggregate: the highest severity of a group, at least LOW."""
    top = F.max_by(severity, severity_rank(severity))
    return F.when(severity_rank(top) > 2, top).otherwise("LOW")
