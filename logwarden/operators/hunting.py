"""Hunting queries over verdict, incident, parser and result tables.

``as_of`` and ``hours`` give the time range, so that a run is repeatable; the
range filter reaches the scan, and partitions by day are pruned.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.functions.text import to_long
from logwarden.operators.projections import severity_rank

BLOCKED = ["DROP", "DENY", "REJECT"]


def recent(df: DataFrame, ts_col: str, as_of: dt.datetime | None, hours: int) -> DataFrame:
    """Rows newer than ``as_of - hours``; everything when ``as_of`` is None."""
    if as_of is None:
        return df
    return df.filter(F.col(ts_col) > F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS"))


def critical_alerts(events: DataFrame, as_of=None, hours: int = 1) -> DataFrame:
    return recent(events.filter(F.col("severity") == "CRITICAL"), "ts", as_of, hours).select(
        "id", "ts", "agent_host", "detection_module", "mitre_technique", "event_details"
    ).orderBy(F.desc("ts"))


def confirmed_incidents(incidents: DataFrame, as_of=None, hours: int = 24, time_col: str = "window_end") -> DataFrame:
    """Severity is ordered as text, highest text first."""
    return recent(incidents, time_col, as_of, hours).orderBy(F.desc("severity"), F.desc(time_col))


def top_blocked_sources(firewall: DataFrame, as_of=None, hours: int = 24, minimum: int = 10) -> DataFrame:
    """Sources with more than ``minimum`` blocked connections and the ports tried."""
    return (
        recent(firewall.filter(F.col("action").isin(BLOCKED)), "ts", as_of, hours)
        .groupBy("src_ip").agg(F.count("*").alias("attempts"), F.array_sort(F.collect_set("dst_port")).alias("ports_tried"))
        .filter(F.col("attempts") > minimum).orderBy(F.desc("attempts"))
    )


def technique_heatmap(events: DataFrame, as_of=None, hours: int = 168) -> DataFrame:
    """Hits per technique and module.  ``max_severity`` is the last one in text
    order, as ``MAX`` of a text is; ``top_severity`` is the truly highest."""
    return (
        recent(events.filter(F.col("mitre_technique") != ""), "ts", as_of, hours)
        .groupBy("mitre_technique", "detection_module").agg(
            F.count("*").alias("hits"), F.max("severity").alias("max_severity"),
            F.max_by("severity", severity_rank(F.col("severity"))).alias("top_severity"))
        .orderBy(F.desc("hits"))
    )


def credential_access_hosts(events: DataFrame) -> DataFrame:
    names = [c for c in ("image_2", "grantedaccess_2", "calltrace_2") if c in events.columns]
    return events.filter(F.col("mitre_technique").contains("T1003")).select("id", "ts", "agent_host", *names).orderBy(F.desc("ts"))


def large_transfers(firewall: DataFrame, minimum: int = 10_000_000) -> DataFrame:
    return firewall.withColumn("bytes", to_long("sent_bytes")).filter(
        (F.col("bytes") > minimum) & (F.col("action") == "ALLOW")
    ).select("id", "ts", "src_ip", "dst_ip", "dst_port", "sent_bytes", "app_name", "bytes").orderBy(F.desc("bytes"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def newest(df: DataFrame, time_col: str = "ts", k: int = 20, tie: str = "id") -> DataFrame:
    return df.orderBy(F.desc(time_col), F.desc(tie)).limit(k)


def events_per_hour(df: DataFrame, as_of=None, hours: int = 24, ts_col: str = "ts") -> DataFrame:
    return recent(df, ts_col, as_of, hours).groupBy(F.date_trunc("hour", ts_col).alias("hour")).agg(F.count("*").alias("events"))


def logs_per_source(logs: DataFrame) -> DataFrame:
    return logs.groupBy("source_system").agg(F.count("*").alias("logs"), F.max("ts").alias("latest"))


def logs_per_type(logs: DataFrame) -> DataFrame:
    return logs.groupBy("source_type").agg(F.count("*").alias("logs"))


def findings_by_type(results: DataFrame) -> DataFrame:
    return results.groupBy("correlation_type", "severity").agg(F.count("*").alias("findings"))


def results_by_confidence(results: DataFrame) -> DataFrame:
    return results.groupBy("correlation_type").agg(
        F.count("*").alias("findings"), F.avg("confidence_score").alias("avg_confidence"),
        F.max("window_start").alias("latest"),
    )


def attack_types(results: DataFrame) -> DataFrame:
    """Findings per attack type named in the indicators."""
    names = F.from_json(F.get_json_object("indicators", "$.attack_type"), "array<string>")
    return results.filter(F.col("correlation_type") == "attack_sequence").select(
        F.explode(names).alias("attack_type")
    ).groupBy("attack_type").agg(F.count("*").alias("findings"))


def involving_address(results: DataFrame, ip: str) -> DataFrame:
    return results.filter(F.array_contains("involved_ips", ip))


def involving_user(results: DataFrame, user: str) -> DataFrame:
    return results.filter(F.array_contains("involved_users", user))


def events_per_log_source(events: DataFrame) -> DataFrame:
    return events.groupBy("logsource_5").agg(F.count("*").alias("events"))
