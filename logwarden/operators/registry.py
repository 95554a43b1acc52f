"""Parser profiles as tables: choice, statistics, usage, maintenance.

The profile table is small by nature (one row per parser).  It is joined
without a forced broadcast; Spark broadcasts it while it is under its size
threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def choose_parsers(requests: DataFrame, parsers: DataFrame, key: str = "source") -> DataFrame:
    """Best active parser for each request (columns: key, vendor, format_type).

    Order: same source identifier, same vendor and format, same format, any;
    inside one step the parser that has processed most lines.

    The candidates of a step are reduced to one parser per join value first,
    so each of the four joins is by key and adds at most one row per request.
    """
    active = parsers.filter("active")
    best = F.struct(F.col("logs_processed"), F.col("parser_id"))

    def top(*keys: str) -> DataFrame:
        renamed = [F.col(k).alias("__" + k) for k in keys]
        return active.groupBy(*renamed).agg(F.max_by("parser_id", best).alias("__p"))

    by_source = top("source_identifier").withColumnRenamed("__p", "p1")
    by_vendor = top("vendor", "format_type").withColumnRenamed("__p", "p2")
    by_format = top("format_type").withColumnRenamed("__p", "p3")
    anyone = active.agg(F.max_by("parser_id", best))
    r = requests
    out = (
        r.join(by_source, r[key] == F.col("__source_identifier"), "left").drop("__source_identifier")
        .join(by_vendor, (F.col("vendor") == F.col("__vendor")) & (F.col("format_type") == F.col("__format_type")), "left")
        .drop("__vendor", "__format_type")
        .join(by_format, F.col("format_type") == F.col("__format_type"), "left").drop("__format_type")
        .withColumn("p4", anyone.scalar())
    )
    step = F.when(F.col("p1").isNotNull(), 1).when(F.col("p2").isNotNull(), 2).when(F.col("p3").isNotNull(), 3).when(
        F.col("p4").isNotNull(), 4)
    return out.select(*requests.columns, F.coalesce("p1", "p2", "p3", "p4").alias("parser_id"), step.alias("matched_by"))


def usage_rows(batches: DataFrame) -> DataFrame:
    """Usage log rows of ingest batches (parser_id, timestamp, logs_count,
    success_count, parse_time_ms)."""
    return batches.select(
        "parser_id", "timestamp", "logs_count", "success_count",
        (F.col("logs_count") - F.col("success_count")).alias("failure_count"), "parse_time_ms",
    )


def merge_statistics(parsers: DataFrame, usage: DataFrame) -> DataFrame:
    """Profile statistics after the usage rows: line-weighted means."""
    new = usage.groupBy("parser_id").agg(
        F.sum("logs_count").alias("n"), F.sum("success_count").alias("ok"), F.sum("parse_time_ms").alias("ms"),
        F.max("timestamp").alias("at"),
    )
    before, n = F.col("logs_processed"), F.coalesce("n", F.lit(0))
    after = before + n
    used = n > 0
    rate = (F.coalesce(F.col("parse_success_rate") * before, F.lit(0)) + F.col("ok") * 100.0) / after
    mean = (F.coalesce(F.col("avg_parse_time_ms") * before, F.lit(0)) + F.col("ms")) / after
    changed = {"logs_processed": after, "parse_success_rate": F.when(used, rate).otherwise(F.col("parse_success_rate")),
               "avg_parse_time_ms": F.when(used, F.floor(mean)).otherwise(F.col("avg_parse_time_ms")),
               "last_used": F.coalesce("at", "last_used")}
    return parsers.join(new, "parser_id", "left").select(
        *[changed[c].alias(c) if c in changed else F.col(c) for c in parsers.columns]
    )


def recent_usage(usage: DataFrame, k: int = 10) -> DataFrame:
    """The newest ``k`` usage rows of each parser."""
    w = Window.partitionBy("parser_id").orderBy(F.desc("timestamp"), *[F.desc(c) for c in usage.columns if c == "id"])
    return usage.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def list_parsers(parsers: DataFrame, vendor: str | None = None, format_type: str | None = None, mode: str | None = None,
                 active_only: bool = True, limit: int | None = None) -> DataFrame:
    """Profiles by filters, the newest first; ``limit`` shows the first ones only."""
    out = parsers
    for name, value in (("vendor", vendor), ("format_type", format_type), ("mode", mode)):
        if value:
            out = out.filter(F.col(name) == value)
    if active_only:
        out = out.filter("active")
    ordered = out.orderBy(F.desc("created_at"), F.desc("parser_id"))
    return ordered if limit is None else ordered.limit(limit)


def parser_id(name: Column, vendor: Column, created_at: Column) -> Column:
    """``vendor-name`` in lower case with dashes, and six digits of a hash."""
    who = F.coalesce(F.nullif(vendor, F.lit("")), F.lit("generic"))
    base = F.translate(F.lower(F.concat(who, F.lit("-"), name)), " _", "--")
    stamp = F.date_format(created_at.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    tail = F.md5(F.concat_ws("-", name, F.coalesce(vendor, F.lit("")), stamp))
    return F.concat(base, F.lit("-"), F.substring(tail, 1, 6))


# Columns an update may change.
UPDATABLE = ["parser_name", "mode", "format_type", "parsing_rules", "field_mappings", "timestamp_config",
             "validation_rules", "source_identifier", "vendor", "log_type", "active", "version"]


def create_parsers(parsers: DataFrame, new: DataFrame) -> DataFrame:
    """Add profiles whose name is not taken; ids come from :func:`parser_id`."""
    fresh = new.join(parsers.select("parser_name"), "parser_name", "left_anti").dropDuplicates(["parser_name"])
    given = fresh.withColumn("parser_id", parser_id(F.col("parser_name"), F.col("vendor"), F.col("created_at")))
    return parsers.unionByName(given, allowMissingColumns=True)


def update_parsers(parsers: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply the non-NULL cells of ``changes`` (parser_id and some columns)."""
    names = [c for c in changes.columns if c in UPDATABLE]
    c = changes.select(F.col("parser_id"), *[F.col(n).alias("__" + n) for n in names])
    return parsers.join(c, "parser_id", "left").select(
        *[F.coalesce(F.col("__" + n), F.col(n)).alias(n) if n in names else F.col(n) for n in parsers.columns]
    )


def set_active(parsers: DataFrame, ids: list[str], active: bool) -> DataFrame:
    return parsers.withColumn("active", F.when(F.col("parser_id").isin(ids), active).otherwise(F.col("active")))


def delete_parsers(parsers: DataFrame, gone: DataFrame) -> DataFrame:
    return parsers.join(gone.select("parser_id"), "parser_id", "left_anti")


def export_parsers(parsers: DataFrame) -> DataFrame:
    """One JSON document per profile, without id and statistics."""
    names = [c for c in parsers.columns if c not in ("parser_id", "logs_processed", "parse_success_rate", "avg_parse_time_ms", "last_used")]
    return parsers.select("parser_id", F.to_json(F.struct(*names)).alias("document"))


def import_parsers(parsers: DataFrame, documents: DataFrame, value: str = "document") -> DataFrame:
    """Read exported documents back; every profile gets a new id."""
    names = [f for f in parsers.schema if f.name not in ("parser_id", "logs_processed", "parse_success_rate", "avg_parse_time_ms", "last_used")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names)
    new = documents.select(F.from_json(value, schema).alias("p")).select("p.*").withColumn("logs_processed", F.lit(0).cast("bigint"))
    return create_parsers(parsers, new)


# The two profiles every registry starts with.
SEED_PROFILES = [
    {
        "parser_id": "sophos-fw-csv-v1", "parser_name": "Sophos Firewall CSV", "mode": "rule-based", "format_type": "CSV",
        "parsing_rules": '{"delimiter": ",", "has_header": false, "columns": ["Time", "Log comp", "Log subtype", "Username", '
                         '"Firewall rule", "Firewall rule name", "NAT rule", "NAT rule name", "In interface", "Out interface", '
                         '"Src IP", "Dst IP", "Src port", "Dst port", "Protocol", "Rule type", "Live PCAP", "Message", '
                         '"Log occurrence"], "skip_lines": 0}',
        "field_mappings": '{"Time": "timestamp", "Log comp": "log_comp", "Log subtype": "log_subtype", "Src IP": "source_ip", '
                          '"Dst IP": "dest_ip", "Src port": "src_port", "Dst port": "dst_port", "Protocol": "protocol", '
                          '"Message": "log"}',
        "timestamp_config": '{"field": "Time", "format": "%Y-%m-%d %H:%M:%S", "timezone": "UTC"}',
        "validation_rules": '{"required_fields": ["timestamp", "source_ip", "log"], "ip_fields": ["source_ip", "dest_ip"]}',
        "source_identifier": "sophos", "vendor": "Sophos", "log_type": "firewall", "active": True, "version": "1.0",
    },
    {
        "parser_id": "generic-json-v1", "parser_name": "Generic JSON Logs", "mode": "rule-based", "format_type": "JSON",
        "parsing_rules": '{"nested_fields": true, "flatten": true}',
        "field_mappings": '{"timestamp": "timestamp", "src_ip": "source_ip", "dst_ip": "dest_ip", "message": "log", '
                          '"severity": "severity"}',
        "timestamp_config": None, "validation_rules": '{"required_fields": ["timestamp", "log"]}',
        "source_identifier": "json", "vendor": "Generic", "log_type": "mixed", "active": True, "version": "1.0",
    },
]
