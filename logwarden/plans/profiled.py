"""Ingest by stored profile: lines of many sources, each read by the profile of its source."""

from __future__ import annotations

from pyspark.sql import functions as F

from logwarden.functions.text import computed_once, nz
from logwarden.operators import ingest as N
from logwarden.operators import profiles as P
from logwarden.plans import views as V
from logwarden.plans.catalog import query
from logwarden.plans.ingest import _ISO_SECONDS, INGEST, PAR

KINDS = ["JSON", "SYSLOG", "CEF", "KEY_VALUE", "CSV"]
DELIMITERS = [",", ";", "|", "\t"]


def _device():
    """A number of the device, by which the profiles of one format differ."""
    return F.ascii(F.substring("source_system", -1, 1)) % 4


def _source():
    return F.concat((F.col("id") % 6).cast("string"), F.lit("/"), "source_system")


def _lines(spark, sf):
    """Lines in five formats and plain text; delimiters, separators and layouts differ from device to device."""
    kind, d, bad = F.col("id") % 6, _device(), F.col("id") % 10 == 9
    even = d % 2 == 0
    when = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    cut = F.element_at(F.array(*map(F.lit, DELIMITERS)), (d + 1).cast("int"))
    stamp = F.when(even, when).otherwise(F.date_format("ts", "EEE MMM dd HH:mm:ss yyyy"))
    cells = F.concat_ws("", stamp, cut, nz("source_ip"), cut, F.lit('"a'), cut, F.lit(' ""b"" '), "log", F.lit('"'), cut, nz("action"))
    body = F.to_json(F.struct(F.struct(F.col("source_ip").alias("ip")).alias("net"), F.col("log").alias("message"), F.unix_seconds("ts").alias("when"), "action"))
    old = F.concat(F.lit("<134>Oct 13 13:15:37 "), "source_system", F.lit(" kernel: "), "log")
    new = F.concat(F.lit("<134>1 2024-01-01T00:00:00Z "), "source_system", F.lit(" kernel 77 ID3 - "), "log")
    sign, gap = F.when(even, "=").otherwise(":"), F.when(even, " ").otherwise(";")
    pairs = F.concat(F.lit("at"), sign, F.date_format("ts", "yyyy-MM-dd'T'HH_mm_ss"), gap, F.lit("src"), sign, nz("source_ip"), F.lit("_"), gap,
                     F.lit("msg"), sign, F.lit('"'), "log", F.lit('"'))
    text = (
        F.when(kind == 0, F.when(bad, F.concat(F.lit("{"), body)).otherwise(body))
        .when(kind == 1, F.when(bad, F.col("log")).otherwise(F.when(even, old).otherwise(new)))
        .when(kind == 2, F.concat(F.when(bad, "x").otherwise(""), F.lit("CEF:01|V|P|1|sig|"), "log", F.lit("|5|kind="), "source_type"))
        .when(kind == 3, F.when(bad, "   ").otherwise(pairs)).when(kind == 4, F.when(bad, F.concat(cells, cut, F.lit("extra"))).otherwise(cells))
        .otherwise(F.col("log"))
    )
    lines = V.parsed(spark, sf).select("id", _source().alias("source"), F.concat(F.lit("v"), kind.cast("string")).alias("vendor"), F.col("id").alias("line_no"),
                                      text.alias("raw_log"), F.lit(INGEST).cast("timestamp").alias("ingest_ts"))
    return computed_once(lines, "raw_log")  # a line is a column here, as it is where lines are read


def _documents(spark, sf):
    """One profile for each source in a known format, as JSON documents."""
    sources = V.parsed(spark, sf).select((F.col("id") % 6).alias("kind"), "source_system").distinct().where("kind < 5")
    kind, d = F.col("kind"), _device()
    even = d % 2 == 0
    rules = (
        F.when(kind == 0, F.to_json(F.struct(F.lit(True).alias("flatten"))))
        .when(kind == 1, F.to_json(F.struct(F.when(even, "RFC3164").otherwise("RFC5424").alias("rfc_version"))))
        .when(kind == 3, F.to_json(F.struct(F.when(even, " ").otherwise(";").alias("pair_delimiter"), F.when(even, "=").otherwise(":").alias("key_value_separator"))))
        .when(kind == 4, F.to_json(F.struct(F.element_at(F.array(*map(F.lit, DELIMITERS)), (d + 1).cast("int")).alias("delimiter"),
                                            F.array(*map(F.lit, ["Time", "Src IP", "Message", "Action"])).alias("columns"))))
    )

    def pairs(**names):
        return F.to_json(F.create_map(*[F.lit(x) for k, v in names.items() for x in (k.replace("__", " "), v)]))

    mapping = (
        F.when(kind == 0, pairs(net_ip="source_ip", message="log")).when(kind == 2, pairs(name="log", device_vendor="source_system"))
        .when(kind == 3, pairs(src="source_ip", msg="log")).when(kind == 4, pairs(Time="timestamp", Src__IP="source_ip", Message="log", Action="action"))
    )
    field = F.when(kind == 0, "when").when(kind == 3, "at").when(kind == 4, "Time")
    layout = F.when(kind == 0, "epoch").when(kind == 3, "%Y-%m-%dT%H_%M_%S").when(even, "%Y-%m-%d %H:%M:%S").otherwise("%c")
    checks = F.to_json(F.struct(F.array(*map(F.lit, ["source_ip", "log"])).alias("required_fields"), F.array(F.lit("source_ip")).alias("ip_fields"),
                                F.array(F.lit("timestamp")).alias("timestamp_fields"), F.array(F.lit("ext_kind")).alias("numeric_fields")))
    return sources.select(
        F.concat(F.lit("p"), kind.cast("string"), F.lit("-"), "source_system").alias("parser_id"), F.concat(F.lit("profile of "), "source_system").alias("parser_name"),
        F.element_at(F.array(*map(F.lit, KINDS)), (kind + 1).cast("int")).alias("format_type"), F.concat(kind.cast("string"), F.lit("/"), "source_system").alias("source_identifier"),
        F.concat(F.lit("v"), kind.cast("string")).alias("vendor"), F.lit(True).alias("active"), rules.alias("parsing_rules"), mapping.alias("field_mappings"),
        F.when(field.isNotNull(), F.to_json(F.struct(field.alias("field"), layout.alias("format")))).alias("timestamp_config"), checks.alias("validation_rules"),
        F.when(kind == 0, 1000).otherwise(10).cast("bigint").alias("logs_processed"), F.lit(90.0).alias("parse_success_rate"),
        F.lit(4).cast("bigint").alias("avg_parse_time_ms"), F.lit(None).cast("timestamp").alias("last_used"))


def _parsed(spark, sf):
    profiles = _documents(spark, sf)
    return N.parse_by_profile(N.choose_for_sources(_lines(spark, sf), profiles), profiles)


def _field(name):
    return F.try_element_at("fields", F.lit(name)).alias(name)


_WANT = PAR + f""",
ln AS (
  SELECT *, id % 6 AS k, id % 10 = 9 AS bad, ascii(right(source_system, 1)) % 4 AS d, {_ISO_SECONDS} AS iso,
    CASE id % 6 WHEN 5 THEN (SELECT max('p0-' || source_system) FROM parsed WHERE id % 6 = 0) ELSE 'p' || id % 6 || '-' || source_system END AS parser_id
  FROM parsed
), want AS (
  SELECT id, k, d, bad, iso, (id % 6) || '/' || source_system AS source, parser_id,
    CASE k WHEN 5 THEN 'json' ELSE lower(['JSON','SYSLOG','CEF','KEY_VALUE','CSV'][k + 1]) END AS source_type,
    CASE WHEN trim(log) = '' AND (k = 5 OR (k = 1 AND bad)) THEN 'Empty line' WHEN k = 5 OR (k = 0 AND bad) THEN 'JSON parse error' WHEN k = 2 AND bad THEN 'Failed to parse CEF format'
      WHEN k = 3 AND bad THEN 'Empty line' WHEN k = 4 AND bad THEN 'Column count mismatch' END AS error,
    CASE WHEN bad THEN NULL WHEN k IN (0, 3, 4) THEN iso WHEN k = 1 THEN CASE WHEN d % 2 = 0 THEN 'Oct 13 13:15:37' ELSE '2024-01-01T00:00:00Z' END END AS "timestamp",
    CASE WHEN bad THEN NULL WHEN k IN (0, 4) THEN nullif(source_ip, '') WHEN k = 3 THEN coalesce(source_ip, '') || '_' END AS source_ip,
    CASE WHEN bad THEN NULL WHEN k < 4 THEN log WHEN k = 4 THEN 'a' || [',', ';', '|', chr(9)][d + 1] || ' "b" ' || log END AS log,
    CASE WHEN bad THEN NULL WHEN k IN (0, 4) THEN action END AS action, CASE WHEN k = 2 AND NOT bad THEN source_type END AS ext_kind
  FROM ln
)"""


@query("ingest_by_profile", _WANT + """
SELECT id, source, parser_id, source_type, error, "timestamp", source_ip, log, action, ext_kind FROM want""")
def ingest_by_profile(spark, sf):
    return _parsed(spark, sf).select("id", "source", "parser_id", "source_type", "error", *[_field(n) for n in ("timestamp", "source_ip", "log", "action", "ext_kind")])


@query("ingest_batches", _WANT + """
SELECT source, count(*) AS logs_received, count(*) FILTER (WHERE error IS NULL) AS logs_parsed, count(*) FILTER (WHERE error IS NOT NULL) AS logs_failed,
  CASE WHEN count(*) FILTER (WHERE error IS NULL) > 0 THEN 'success' ELSE 'failed' END AS status FROM want GROUP BY source""")
def ingest_batches(spark, sf):
    return P.ingest_summary(_parsed(spark, sf), "source")


@query("ingest_statistics", _WANT + """,
us AS (SELECT parser_id, count(*) AS n, count(*) FILTER (WHERE error IS NULL) AS ok FROM want GROUP BY 1),
pr AS (SELECT DISTINCT 'p' || id % 6 || '-' || source_system AS parser_id, CASE id % 6 WHEN 0 THEN 1000 ELSE 10 END AS before FROM parsed WHERE id % 6 < 5)
SELECT parser_id, (before + coalesce(n, 0))::BIGINT AS logs_processed,
  round(CASE WHEN n IS NULL THEN 90.0 ELSE (90.0 * before + ok * 100.0) / (before + n) END::DOUBLE, 6) AS parse_success_rate FROM pr LEFT JOIN us USING (parser_id)""")
def ingest_statistics(spark, sf):
    merged = N.ingest_statistics(_parsed(spark, sf), _documents(spark, sf))
    return merged.select("parser_id", "logs_processed", F.round("parse_success_rate", 6).alias("parse_success_rate"))


@query("profile_violations", _WANT + """,
v AS (SELECT source, unnest([
    CASE WHEN coalesce(source_ip, '') = '' THEN 'required:source_ip' END, CASE WHEN coalesce(log, '') = '' THEN 'required:log' END,
    CASE WHEN source_ip LIKE '%\\_' ESCAPE '\\' THEN 'ip:source_ip' END,
    CASE WHEN ext_kind IS NOT NULL AND try_cast(ext_kind AS DOUBLE) IS NULL THEN 'numeric:ext_kind' END,
    CASE WHEN k = 2 THEN 'value:severity' END,
    CASE WHEN coalesce(action, '') <> '' AND upper(action) NOT IN ('ALLOW', 'ALLOWED', 'DENY', 'DENIED', 'DROP', 'BLOCK', 'REJECT', 'ACCEPT') THEN 'value:action' END
  ]) AS violation FROM want WHERE error IS NULL)
SELECT source, violation, count(*) AS rows FROM v WHERE violation IS NOT NULL GROUP BY ALL""")
def profile_violations(spark, sf):
    checked = N.profile_violations(_parsed(spark, sf))
    return checked.select("source", F.explode("violations").alias("violation")).groupBy("source", "violation").agg(F.count("*").alias("rows"))
