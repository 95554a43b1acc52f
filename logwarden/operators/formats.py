"""Format profile per log source, from all lines of each source.

Every share is a number of lines that pass a test, so a profile is a few
counters per source and the different keys of its lines.  Only the question
whether there is a header looks at single lines: the first two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.functions.text import computed_once, has, strip
from logwarden.operators.profiles import csv_cells

# Threshold, patterns, keyword lists.
THRESHOLD = 0.80
FORMATS = ["JSON", "SYSLOG", "CEF", "KEY_VALUE", "CSV"]
RFC3164_LINE = r"^<\d{1,3}>\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+\S+:"
RFC5424_LINE = r"^<\d{1,3}>\d+\s+\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"
CEF_LINE = r"^CEF:\d+\|[^|]*\|[^|]*\|[^|]*\|[^|]*\|[^|]*\|[^|]*\|"
PAIR_STYLES = [r"(\w+)=([^\s]+)", r"(\w+):([^\s]+)", r'(\w+)="([^"]*)"']
DELIMITERS = [",", "\t", ";", "|"]
NUMBER = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$|^\s*[+-]?(?i:nan|inf|infinity)\s*$"
TIME_LAYOUTS = [
    (r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}", "%Y-%m-%d %H:%M:%S"),
    (r"\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}:\d{2}", "%m/%d/%Y %H:%M:%S"),
    (r"\d{2}-\d{2}-\d{4}\s+\d{2}:\d{2}:\d{2}", "%d-%m-%Y %H:%M:%S"),
    (r"\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}", "%b %d %H:%M:%S"),
    (r"\d{10}", "epoch"),
    (r"\d{13}", "epoch_ms"),
]
CSV_TARGETS = {
    "source_ip": ["src ip", "source ip", "src_ip", "source_ip", "srcip", "sourceip"],
    "dest_ip": ["dst ip", "dest ip", "dst_ip", "dest_ip", "dstip", "destip", "destination ip"],
    "src_port": ["src port", "source port", "src_port", "source_port", "srcport"],
    "dst_port": ["dst port", "dest port", "dst_port", "dest_port", "dstport"],
    "protocol": ["protocol", "proto"],
    "severity": ["severity", "level", "priority", "action"],
    "log": ["message", "msg", "log", "description", "event"],
    "user": ["user", "username", "account"],
}
KEY_TARGETS = {
    "timestamp": ["timestamp", "time", "date", "@timestamp", "eventTime"],
    "source_ip": ["src_ip", "source_ip", "srcIP", "sourceIP", "clientIP"],
    "dest_ip": ["dst_ip", "dest_ip", "dstIP", "destIP", "serverIP"],
    "severity": ["severity", "level", "priority", "logLevel"],
    "log": ["message", "msg", "log", "event", "description"],
    "user": ["user", "username", "account", "userId"],
}


def first_lines(lines: DataFrame, k: int, source: str = "source", order: str = "line_no") -> DataFrame:
    """The first ``k`` lines of each source, numbered from 1 as ``n``; profile these where a sample is enough."""
    w = Window.partitionBy(source).orderBy(order)
    return lines.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k)


def timestamp_layout(value: Column) -> Column:
    """Layout of the first pattern found in a value.  Ten digits are tried
    before thirteen, so a millisecond time counts as seconds."""
    chain = None
    for pattern, layout in TIME_LAYOUTS:
        hit = value.rlike(pattern)
        chain = F.when(hit, layout) if chain is None else chain.when(hit, layout)
    return chain


def is_time_name(name: Column) -> Column:
    return has(F.lower(name), "time", "date", "timestamp", "when")


def is_address_column(name: Column, value: Column) -> Column:
    """Name hints at an address and the value starts with an IPv4 address."""
    return has(F.lower(name), "ip", "addr", "host") & value.rlike(r"^\b(?:\d{1,3}\.){3}\d{1,3}\b")


def suggest_target(name: Column, targets: dict[str, list[str]], exact: bool = False) -> Column:
    """First target one of whose patterns occurs in the lower-cased name."""
    low, chain = F.lower(name), None
    for target, patterns in targets.items():
        hit = has(low, *patterns)
        chain = F.when(hit, target) if chain is None else chain.when(hit, target)
    return chain


def profile_sources(lines: DataFrame, source: str = "source", order: str = "line_no", raw: str = "raw_log",
                    threshold: float = THRESHOLD) -> DataFrame:
    """One row per source: format, confidence and what the format needs.

    Columns: source, lines, format_type, confidence, warning, rfc_version,
    pair_style, delimiter, has_header, column_count, nested, keys,
    timestamp_field, timestamp_format.
    """
    text = F.col(raw)
    trimmed = strip(text)
    json_ok = F.try_parse_json(trimmed).isNotNull()
    tested = lines.select(
        source, F.col(order).alias("n"), raw,
        json_ok.alias("json_ok"), (json_ok & trimmed.startswith("{")).alias("json_object"),
        text.rlike(RFC5424_LINE).alias("r5424"), text.rlike(RFC3164_LINE).alias("r3164"), text.rlike(CEF_LINE).alias("cef"),
        *[(F.size(F.regexp_extract_all(text, F.lit(p), F.lit(1))) >= 3).alias(f"kv{i}") for i, p in enumerate(PAIR_STYLES)],
        *[(F.length(text) - F.length(F.replace(text, F.lit(d), F.lit("")))).alias(f"d{i}") for i, d in enumerate(DELIMITERS)],
        *[F.size(csv_cells(text, d)).alias(f"w{i}") for i, d in enumerate(DELIMITERS)],
    )
    counts = tested.groupBy(source).agg(
        F.count("*").alias("lines"),
        F.count_if("json_ok").alias("json"), F.count_if("r5424").alias("r5424"), F.count_if("r3164").alias("r3164"),
        F.count_if("cef").alias("cef"), *[F.count_if(f"kv{i}").alias(f"kv{i}") for i in range(3)],
        *[F.coalesce(F.sum(f"d{i}"), F.lit(0)).alias(f"dsum{i}") for i in range(4)],
        *[F.min(f"d{i}").alias(f"dmin{i}") for i in range(4)],
        *[f(f"w{i}").alias(f"w{name}{i}") for i in range(4) for f, name in ((F.min, "min"), (F.max, "max"))],
        F.min_by(raw, F.when(F.col("json_object"), F.col("n"))).alias("first_object"),
    )
    two = first_lines(lines, 2, source, order).groupBy(source).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", raw))), lambda s: s[raw]).alias("head"))
    counts = counts.join(two, source, "left").join(_line_keys(lines, source, raw), source, "left")
    total = F.col("lines")
    best_delimiter = F.greatest(*[F.col(f"dsum{i}") for i in range(4)])
    which = F.coalesce(*[F.when(F.col(f"dsum{i}") == best_delimiter, F.lit(i)) for i in range(4)])
    staged = counts.withColumn("di", which)
    cells = F.transform("head", lambda s: _cells_by(F.col("di"), s))
    staged = staged.withColumn("cells", cells)
    least, width, widest = (_pick_by(F.col("di"), [F.col(f"{c}{i}") for i in range(4)]) for c in ("dmin", "wmin", "wmax"))
    csv_hit = (total >= 2) & (least >= 2) & (width == widest) & (width >= 3)
    first_row, second_row = F.get("cells", F.lit(0)), F.get("cells", F.lit(1))
    numeric = lambda row: F.exists(row, lambda v: v.rlike(NUMBER))
    header = ~numeric(first_row) & numeric(second_row)
    kv_best = F.greatest("kv0", "kv1", "kv2")
    style = F.coalesce(*[F.when(F.col(f"kv{i}") == kv_best, F.lit(i)) for i in range(3)])
    sys_hits = F.when(F.col("r5424") > 0, F.col("r5424")).otherwise(F.col("r3164"))
    confidence = {
        "JSON": F.col("json") / total, "SYSLOG": sys_hits / total, "CEF": F.col("cef") / total, "KEY_VALUE": kv_best / total,
        # All rows of a detected CSV source have one width; "," and tab earn a bonus, capped at 1.
        "CSV": F.lit(1.0),
    }
    detected = {name: c >= threshold for name, c in confidence.items()}
    detected["CSV"] = csv_hit
    options = F.array_compact(F.array(*[
        F.when(detected[name] & (confidence[name] > 0), F.struct(
            (confidence[name] >= threshold).alias("valid"), confidence[name].alias("confidence"), F.lit(-i).alias("rank"),
            F.lit(name).alias("format_type")))
        for i, name in enumerate(FORMATS)
    ]))
    chosen = staged.withColumn("best", F.array_max(options)).withColumn("header", header).withColumn("style", style)
    fmt = F.coalesce("best.format_type", F.lit("RAW"))
    columns = F.when(F.col("header"), first_row).otherwise(
        F.transform(first_row, lambda _, i: F.concat(F.lit("column_"), (i + 1).cast("string"))))
    data_row = F.when(F.col("header"), second_row).otherwise(first_row)
    object_map = F.from_json("first_object", "map<string,string>")
    keys = (
        F.when(fmt == "JSON", F.coalesce("json_keys", F.array().cast("array<string>")))
        .when(fmt == "KEY_VALUE", _pick_by(F.col("style"), [F.col(f"kv{i}_keys") for i in range(3)])).when(fmt == "CSV", columns)
    )
    kinds = F.map_values(F.from_json("first_object", "map<string,variant>"))
    pairs = F.when(fmt == "CSV", F.arrays_zip(columns.alias("key"), data_row.alias("value"))).when(
        fmt == "JSON", F.transform(F.map_entries(object_map), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    timed = F.get(F.filter(pairs, lambda p: is_time_name(p["key"]) & timestamp_layout(F.coalesce(p["value"], F.lit(""))).isNotNull()), F.lit(0))
    profile = chosen.select(source, F.struct(
        "lines", fmt.alias("format_type"), F.coalesce("best.confidence", F.lit(0.5)).alias("confidence"),
        F.when(F.col("best").isNotNull() & ~F.col("best.valid"), "confidence below threshold").alias("warning"),
        F.when(fmt == "SYSLOG", F.when(F.col("r5424") > 0, "RFC5424").otherwise("RFC3164")).alias("rfc_version"),
        F.when(fmt == "KEY_VALUE", _pick_by(F.col("style"), [F.lit("="), F.lit(":"), F.lit("=")])).alias("separator"),
        F.when(fmt == "CSV", _pick_by(F.col("di"), [F.lit(d) for d in DELIMITERS])).alias("delimiter"),
        F.when(fmt == "CSV", F.col("header")).alias("has_header"), F.when(fmt == "CSV", width).alias("column_count"),
        F.when(fmt == "JSON", F.coalesce(F.exists(kinds, lambda v: F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)")), F.lit(False)))
        .alias("nested"),
        keys.alias("keys"), timed["key"].alias("timestamp_field"),
        timestamp_layout(timed["value"]).alias("timestamp_format"),
        F.when(fmt == "CSV", F.transform(F.filter(pairs, lambda p: is_address_column(p["key"], p["value"])), lambda p: p["key"]))
        .alias("ip_columns"),
    ).alias("profile"))
    return computed_once(profile, "profile").select(source, "profile.*")


def _pick_by(index: Column, options: list[Column]) -> Column:
    chain = None
    for i, option in enumerate(options):
        chain = F.when(index == i, option) if chain is None else chain.when(index == i, option)
    return chain


def _cells_by(index: Column, line: Column) -> Column:
    return _pick_by(index, [csv_cells(line, d) for d in DELIMITERS])


def _line_keys(lines: DataFrame, source: str, raw: str) -> DataFrame:
    """The different keys of each source's lines: of JSON objects, and of pairs in each style."""
    def keys(kind: str, found: Column) -> Column:
        return F.transform(found, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))

    styles = [keys(f"kv{i}", F.regexp_extract_all(F.col(raw), F.lit(p), F.lit(1))) for i, p in enumerate(PAIR_STYLES)]
    objects = keys("json", F.coalesce(F.map_keys(F.from_json(raw, "map<string,string>")), F.array().cast("array<string>")))
    each = lines.select(source, F.explode(F.array_distinct(F.concat(objects, *styles))).alias("k")).select(source, "k.*").distinct()
    return each.groupBy(source).agg(*[
        F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("key")))).alias(f"{kind}_keys")
        for kind in ("json", "kv0", "kv1", "kv2")
    ])


def suggested_mappings(profiles: DataFrame, source: str = "source") -> DataFrame:
    """One row per key of a profile that has a standard target."""
    each = profiles.filter(F.col("format_type").isin("CSV", "JSON", "KEY_VALUE")).select(
        source, "format_type", "timestamp_field", F.explode("keys").alias("key")
    )
    csv = F.when(F.col("key") == F.col("timestamp_field"), "timestamp").otherwise(suggest_target(F.col("key"), CSV_TARGETS))
    target = F.when(F.col("format_type") == "CSV", csv).otherwise(suggest_target(F.col("key"), KEY_TARGETS))
    return each.select(source, "format_type", "key", target.alias("target")).filter(F.col("target").isNotNull())
