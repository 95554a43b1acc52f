"""Parse lines by parser profile: CSV, JSON, key=value, syslog, CEF, raw.

Every parser returns the input columns plus ``fields`` (map of target name to
text), ``source_type`` and ``error`` (NULL when parsed).  Blank lines are
dropped by :func:`parsable`.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.functions.text import computed_once, named_once, strip

# Line patterns.
RFC3164 = r"^<(\d{1,3})>(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+):\s*(.*)$"
RFC5424 = r"^<(\d{1,3})>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(.*)$"
CEF = r"^CEF:(\d+)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$"
SYSLOG_FIELDS = {
    RFC3164: ["priority", "timestamp", "source_system", "app_name", "log"],
    RFC5424: ["priority", "version", "timestamp", "source_system", "app_name", "process_id", "message_id",
              "structured_data", "log"],
}
CEF_FIELDS = ["cef_version", "device_vendor", "device_product", "device_version", "signature_id", "name", "severity",
              "extension"]
SYSLOG_ERROR = "Failed to parse syslog format"
CEF_ERROR = "Failed to parse CEF format"
COLUMN_ERROR = "Column count mismatch"
JSON_ERROR = "JSON parse error"

# Strptime letters and their Spark twins.
_LETTERS = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "b": "MMM", "B": "MMMM", "p": "a",
    "f": "SSSSSS", "j": "DDD", "z": "xx", "%": "'%'", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm",
}
# strptime's composed layouts, and what it reads without using it.
COMPOSED = {"%c": "%a %b %d %H:%M:%S %Y", "%x": "%m/%d/%y", "%X": "%H:%M:%S"}
UNUSED = {
    "%a": r"\b(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\b",
    "%A": r"\b(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)\b",
    "%Z": r"\b(?:UTC|GMT)\b",
}
_OFFSET = r"([+-])(\d{2}):?(\d{2})"


def parsable(lines: DataFrame, raw: str = "raw_log") -> DataFrame:
    return lines.filter(strip(F.col(raw)) != "")


def spark_layout(layout: str) -> str | None:
    """``%Y-%m-%d %H:%M:%S`` as ``yyyy-MM-dd HH:mm:ss``; None where a letter has no twin."""
    out, literal = [], ""
    for part in re.findall(r"%.|[^%]+|%$", layout):
        if part[0] == "%" and len(part) == 2:
            if part[1] not in _LETTERS:
                return None
            out.append(_LETTERS[part[1]])
        else:  # letters and quotes have a meaning in Spark's patterns
            literal = re.sub(r"[A-Za-z\[\]{}#]+", lambda m: f"'{m.group()}'", part.replace("'", "\'\'"))
            out.append(literal)
    return "".join(out)


def profile_time(value: Column, layout: str) -> Column:
    """ISO text of a value in the given layout, with fractions and offset where it has them; other values stay as they are."""
    seconds, micro = "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

    def iso(t: Column) -> Column:
        return F.when(F.unix_micros(t) % 1_000_000 == 0, F.date_format(t, seconds)).otherwise(F.date_format(t, micro))

    if layout in ("epoch", "epoch_ms"):
        number = value.try_cast("bigint")
        return F.coalesce(iso(F.timestamp_seconds(number) if layout == "epoch" else F.timestamp_millis(number)), value)
    for letter, full in COMPOSED.items():
        layout = layout.replace(letter, full)
    given = value
    for letter, names in UNUSED.items():
        if letter in layout:  # read, and then of no use
            value = F.when(F.regexp_extract(value, names, 0) != "", F.regexp_replace(value, names, ""))
            layout = layout.replace(letter, "")
    pattern = spark_layout(layout)
    if pattern is None:
        return given
    # A fraction may have fewer digits than the pattern asks for.
    padded = F.regexp_replace(value, r"\.(\d{1,5})(?!\d)", ".$1" + "0" * 5) if "%f" in layout else value
    cut = F.regexp_replace(padded, r"\.(\d{6})\d*", ".$1") if "%f" in layout else value
    if "%z" not in layout:
        return F.coalesce(iso(F.try_to_timestamp(cut, F.lit(pattern))), given)
    # Z is an offset of nothing, and a colon in the offset is allowed.
    plain = F.regexp_replace(F.regexp_replace(cut, r"([+-]\d{2}):(\d{2})$", "$1$2"), "Z$", "+0000")
    parsed = F.try_to_timestamp(plain, F.lit(pattern))
    sign = F.when(F.regexp_extract(plain, _OFFSET, 1) == "-", -1).otherwise(1)
    hours, minutes = (F.regexp_extract(plain, _OFFSET, i) for i in (2, 3))
    shift = sign * (hours.try_cast("int") * 3600 + minutes.try_cast("int") * 60)
    local = F.timestamp_micros(F.unix_micros(parsed) + shift.cast("bigint") * 1_000_000)
    return F.coalesce(F.concat(iso(local), F.regexp_extract(plain, _OFFSET, 1), hours, F.lit(":"), minutes), given)


def _named(name: Column, mapping: dict[str, str]) -> Column:
    chain = None
    for source, target in mapping.items():
        chain = F.when(name == source, target) if chain is None else chain.when(name == source, target)
    return name if chain is None else chain.otherwise(name)


def _last_per_key(entries: Column) -> Column:
    """Map of (key, value) entries; the last entry of a repeated key stays."""
    def last(found: Column, keys: Column) -> Column:
        size = F.size(keys)
        repeated = F.filter(
            found, lambda e, i: F.array_position(F.slice(keys, i + 2, F.greatest(size - i - 1, F.lit(0))), e["key"]) == 0
        )
        # Keys differ in nearly every line.
        return F.map_from_entries(F.when(F.size(F.array_distinct(keys)) == size, found).otherwise(repeated))

    return named_once(entries, lambda found: named_once(F.transform(found, lambda e: e["key"]), lambda keys: last(found, keys)))


def _timed(df: DataFrame, mapping: dict[str, str], timestamp: dict | None) -> DataFrame:
    """``fields`` with the time of the profile as ISO text under ``timestamp``."""
    if not timestamp:
        return df
    name = mapping.get(timestamp["field"], timestamp["field"])
    fields = F.col("fields")
    value = F.struct(F.try_element_at(fields, F.lit(name)).alias("text"))
    staged = computed_once(df.withColumn("__time", F.when(F.map_contains_key(fields, name), value)), "__time")
    rest = F.map_filter(fields, lambda k, _: k != "timestamp")
    fixed = F.map_concat(rest, F.create_map(F.lit("timestamp"), profile_time(F.col("__time.text"), timestamp["format"])))
    return staged.withColumn("fields", F.when(F.col("__time").isNotNull(), fixed).otherwise(fields)).drop("__time")


def _result(df: DataFrame, fields: Column, source_type: str, error: Column | None = None, columns: list[str] | None = None,
            mapping: dict[str, str] | None = None, timestamp: dict | None = None) -> DataFrame:
    """``columns`` of ``df`` (all by default) and the result; the map is made once, however many of its keys are read."""
    error = F.lit(None).cast("string") if error is None else error
    kept = df.columns if columns is None else columns
    read = df.select(*kept, error.alias("error"), F.when(error.isNull(), fields).alias("fields"))
    timed = _timed(computed_once(read, "fields"), mapping or {}, timestamp)
    return timed.select(*kept, "fields", F.lit(source_type).alias("source_type"), "error")


def parse_csv(lines: DataFrame, columns: list[str], delimiter: str = ",", mapping: dict[str, str] | None = None,
              timestamp: dict | None = None, raw: str = "raw_log") -> DataFrame:
    """Delimited lines with quotes; a wrong number of values is an error."""
    mapping = mapping or {}
    cells = csv_cells(F.col(raw), delimiter)
    staged = computed_once(lines.withColumn("__cells", cells), "__cells")
    names = [mapping.get(c, c) for c in columns]
    entries = F.array(*[
        F.struct(F.lit(n).alias("key"), F.nullif(strip(F.get("__cells", F.lit(i))), F.lit("")).alias("value"))
        for i, n in enumerate(names)
    ])
    error = F.when(F.size("__cells") != len(columns), COLUMN_ERROR)
    return _result(staged, _last_per_key(entries), "csv", error, lines.columns, mapping, timestamp)


def bare_cell(c: Column) -> Column:
    """A cell without its quotes."""
    quoted = (F.length(c) >= 2) & c.startswith('"') & c.endswith('"')
    return F.when(quoted, F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)


def csv_cells(line: Column, delimiter: str) -> Column:
    """Cells of one line; quoted cells may hold the delimiter and doubled quotes."""
    d = re.escape(delimiter)
    outside = "\\" + delimiter if delimiter in "|^]\\" else delimiter
    # Every cell ends with a delimiter once the line does.
    cell = rf'("(?:[^"]|"")*"|[^{outside}]*){d}'
    found = F.regexp_extract_all(F.concat(line, F.lit(delimiter)), F.lit(cell), F.lit(1))
    quoted_line = F.transform(found, bare_cell)
    # Lines without a quote, nearly all, are a plain split.
    return F.when(line.contains('"'), quoted_line).otherwise(F.split(line, d, -1))


_TEXTS, _VALUES = "map<string,string>", "map<string,variant>"


def _json_entries(text: Column, prefix: Column | None = None) -> Column:
    """Entries of a JSON object: key, value as text, and whether the value is an object (and not a text that looks like one)."""
    def entry(e: Column, nested: Column) -> Column:
        key = e["key"] if prefix is None else F.concat(prefix, F.lit("_"), e["key"])
        return F.struct(key.alias("key"), e["value"].alias("value"), nested.alias("nested"))

    def looks_nested(e: Column) -> Column:
        return F.coalesce(F.startswith(e["value"], F.lit("{")), F.lit(False))

    def told_apart(texts: Column) -> Column:
        return named_once(F.from_json(text, _VALUES), lambda kinds: F.transform(texts, lambda e: entry(e, looks_nested(e) & F.coalesce(
            F.startswith(F.schema_of_variant(F.try_element_at(kinds, e["key"])), F.lit("OBJECT")), F.lit(False)))))

    # What kind a value is, is asked only where one begins like an object.
    return named_once(F.map_entries(F.from_json(text, _TEXTS)), lambda texts: F.when(F.exists(texts, looks_nested), told_apart(texts))
                      .otherwise(F.transform(texts, lambda e: entry(e, F.lit(False)))))


def flat_json_entries(document: Column, flatten: Column) -> Column:
    """Entries of a JSON object; where ``flatten`` holds, those of nested objects under joined keys.  A null document has none."""
    none = F.array().cast("array<struct<key:string,value:string,nested:boolean>>")

    def level(found: Column) -> Column:
        return F.struct(found.alias("found"), F.exists(found, lambda e: e["nested"]).alias("more"))

    def once(found: Column) -> Column:
        return F.flatten(F.transform(found, lambda e: F.when(
            e["nested"], _json_entries(e["value"], e["key"])).otherwise(F.array(e))))

    def flat(entries: Column) -> Column:
        # A text cannot be nested deeper than it has braces; where nothing is nested any more, nothing changes.
        braces = F.length(document) - F.length(F.replace(document, F.lit("{"), F.lit("")))
        depth = F.sequence(F.lit(1), F.greatest(F.coalesce(braces, F.lit(1)), F.lit(1)))
        return F.aggregate(depth, level(entries), lambda s, _: F.when(s["more"], named_once(once(s["found"]), level)).otherwise(s))["found"]

    return named_once(F.coalesce(_json_entries(document), none), lambda entries: F.when(
        flatten & F.exists(entries, lambda e: e["nested"]), flat(entries)).otherwise(entries))


def parse_json(lines: DataFrame, mapping: dict[str, str] | None = None, timestamp: dict | None = None,
               flatten: bool = False, raw: str = "raw_log") -> DataFrame:
    """JSON objects.  ``flatten`` joins the keys of nested objects with ``_``, as deep as they go; arrays keep their JSON
    text, and so do texts that look like JSON."""
    mapping = mapping or {}
    text = strip(F.col(raw))
    valid = F.when(F.try_parse_json(text).isNotNull() & text.startswith("{"), text)
    staged = computed_once(lines.withColumn("__json", valid), "__json")
    entries = flat_json_entries(F.col("__json"), F.lit(flatten))
    renamed = F.transform(entries, lambda e: F.struct(_named(e["key"], mapping).alias("key"), e["value"].alias("value")))
    error = F.when(F.col("__json").isNull(), JSON_ERROR)
    return _result(staged, _last_per_key(renamed), "json", error, lines.columns, mapping, timestamp)


def parse_key_value(lines: DataFrame, mapping: dict[str, str] | None = None, timestamp: dict | None = None,
                    pair_delimiter: str = " ", separator: str = "=", quote: str = '"', raw: str = "raw_log") -> DataFrame:
    """``key<separator>value`` pairs; never fails."""
    mapping = mapping or {}
    s, q, d = re.escape(separator), re.escape(quote), re.escape(pair_delimiter)
    pattern = rf"(\w+{s}(?:{q}[^{q}]*{q}|[^{d}]+))"
    edge = F.lit(quote)

    def one(token: Column) -> Column:
        key = F.regexp_extract(token, r"^(\w+)", 1)
        value = strip(F.trim(F.substring(token, F.length(key) + len(separator) + 1, F.length(token)), edge))
        return F.struct(_named(key, mapping).alias("key"), value.alias("value"))

    tokens = F.regexp_extract_all(F.col(raw), F.lit(pattern), F.lit(1))
    return _result(lines, _last_per_key(F.transform(tokens, one)), "key_value", mapping=mapping, timestamp=timestamp)


def parse_syslog(lines: DataFrame, version: str = "RFC3164", mapping: dict[str, str] | None = None,
                 raw: str = "raw_log", mode: str = "reference") -> DataFrame:
    """Syslog lines.  A line that does not match has no fields and still counts
    as parsed; ``mode="intent"`` reports it as an error."""
    mapping = mapping or {}
    pattern = RFC3164 if version == "RFC3164" else RFC5424
    names = [mapping.get(n, n) for n in SYSLOG_FIELDS[pattern]]
    # "." stops only at a line feed.
    hit = F.col(raw).rlike("(?d)" + pattern)
    entries = []
    for i, n in enumerate(names):
        value = F.regexp_extract(raw, "(?d)" + pattern, i + 1)
        if n in ("priority", "version"):
            value = value.try_cast("int").cast("string")
        entries += [F.lit(n), value]
    fields = F.when(hit, F.create_map(*entries)).otherwise(F.create_map().cast("map<string,string>"))
    error = F.when(~hit, SYSLOG_ERROR) if mode == "intent" else None
    return _result(lines, fields, "syslog", error)


def cef_cells(line: Column) -> Column:
    """The seven header cells of a CEF line, without ``CEF:``, and its extension; null for other lines.  The line is matched once."""
    cells = F.split(line, r"\|", len(CEF_FIELDS))
    plain = F.transform(cells, lambda c, i: F.when(i == 0, F.substring(c, 5, F.length(c))).when(
        i == len(CEF_FIELDS) - 1, F.regexp_replace(c, r"\n\z", "")).otherwise(c))
    return F.when(line.rlike("(?d)" + CEF), plain)


def parse_cef(lines: DataFrame, mapping: dict[str, str] | None = None, raw: str = "raw_log") -> DataFrame:
    """CEF lines; extension pairs become ``ext_<key>``."""
    mapping = mapping or {}
    staged = computed_once(lines.withColumn("__cef", cef_cells(F.col(raw))), "__cef")
    cell = [F.get("__cef", F.lit(i)) for i in range(len(CEF_FIELDS))]
    header = F.array(*[
        F.struct(F.lit(mapping.get(n, n)).alias("key"), (c.try_cast("int").cast("string") if i == 0 else c).alias("value"))
        for i, (n, c) in enumerate(zip(CEF_FIELDS, cell, strict=True))
    ])
    tokens = F.regexp_extract_all(cell[-1], F.lit(r"(\w+=[^\s]+)"), F.lit(1))
    extension = F.transform(tokens, lambda t: F.struct(
        _named(F.concat(F.lit("ext_"), F.substring_index(t, "=", 1)), mapping).alias("key"),
        F.substring(t, F.length(F.substring_index(t, "=", 1)) + 2, F.length(t)).alias("value")))
    error = F.when(F.col("__cef").isNull() & F.col(raw).isNotNull(), CEF_ERROR)
    return _result(staged, _last_per_key(F.concat(header, extension)), "cef", error, lines.columns)


def parse_raw(lines: DataFrame, ingest_col: str = "ingest_ts", raw: str = "raw_log") -> DataFrame:
    """The whole line as message, received time as timestamp."""
    stamp = F.date_format(F.col(ingest_col).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    return _result(lines, F.create_map(F.lit("log"), strip(F.col(raw)), F.lit("timestamp"), stamp), "raw")


def quality_report(parsed: DataFrame, key: str = "parser_id", order: str = "line_no", samples: int = 3) -> DataFrame:
    """Lines, successes, failures, success rate and the first parsed samples.

    Errors are counted per text; a text is one of a handful of fixed messages.
    """
    good = F.col("error").isNull()
    counts = parsed.groupBy(key).agg(
        F.count("*").alias("total"), F.count_if(good).alias("success"), F.count_if(~good).alias("failed"),
        F.array_sort(F.collect_set("error")).alias("errors"),
    ).withColumn("success_rate", F.col("success") / F.col("total"))
    from pyspark.sql import Window

    first = Window.partitionBy(key).orderBy(order)
    top = parsed.filter(good).withColumn("__rn", F.row_number().over(first)).filter(F.col("__rn") <= samples)
    sample = top.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__rn", F.to_json("fields").alias("j")))), lambda s: s["j"]).alias("samples")
    )
    return counts.join(sample, key, "left")


def ingest_summary(parsed: DataFrame, key: str = "batch") -> DataFrame:
    """Received, parsed and failed lines per batch and its status."""
    return parsed.groupBy(key).agg(
        F.count("*").alias("logs_received"), F.count_if(F.col("error").isNull()).alias("logs_parsed"),
        F.count_if(F.col("error").isNotNull()).alias("logs_failed"),
    ).withColumn("status", F.when(F.col("logs_parsed") > 0, "success").otherwise("failed"))
