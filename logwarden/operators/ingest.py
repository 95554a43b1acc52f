"""Parsing by stored profile: lines of many sources in one pass, each by the profile of its source.

A profile is a row of documents: format, parsing rules, field mappings, time layout, validation rules.  The documents
are read once per profile (:func:`compiled`), so delimiters, patterns, layouts and mappings are columns of a small table
that is joined to the lines; what parses a line is one expression over these columns.  No format has a scan of its own,
and a new profile needs no new code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.functions.text import computed_once, strip
from logwarden.operators import profiles as P
from logwarden.operators import taxonomy
from logwarden.operators.formats import profile_sources
from logwarden.operators.registry import choose_parsers, merge_statistics, usage_rows

# Documents of a profile.
RULES = (
    "delimiter string, columns array<string>, flatten boolean, pair_delimiter string, key_value_separator string, "
    "quote_char string, rfc_version string"
)
MAPPING = "map<string,string>"
TIMESTAMP = "field string, format string"
VALIDATION = (
    "required_fields array<string>, ip_fields array<string>, port_fields array<string>, numeric_fields array<string>, "
    "timestamp_fields array<string>"
)
NO_PARSER = "No suitable parser found. Please create a parser first."
EMPTY_LINE = "Empty line"

_FIELDS = "map<string,string>"
_ENTRIES = "array<struct<key:string,value:string>>"


def _escaped(text: Column) -> Column:
    """``text`` as part of a pattern, also inside brackets."""
    return F.regexp_replace(text, r"([^A-Za-z0-9])", r"\\$1")


def _layout(layout: Column) -> Column:
    """A strptime layout as a Spark pattern; null where a letter has no twin."""
    letters = F.create_map(*[F.lit(x) for k, v in P._LETTERS.items() for x in (f"%{k}", v)])
    tokens = F.regexp_extract_all(layout, F.lit(r"(%.|[^%]+|%$)"), F.lit(1))

    def one(token: Column) -> Column:
        quoted = F.regexp_replace(F.replace(token, F.lit("'"), F.lit("''")), r"([A-Za-z\[\]{}#]+)", "'$1'")
        return F.when(token.startswith("%") & (F.length(token) == 2), F.try_element_at(letters, token)).otherwise(quoted)

    parts = F.transform(tokens, one)
    return F.when(~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, ""))


def compiled(parsers: DataFrame) -> DataFrame:
    """``parser_id, parser_name, p``: the documents of each profile as one struct of what a line needs."""
    read = F.struct(
        F.from_json("parsing_rules", RULES).alias("rules"), F.from_json("timestamp_config", TIMESTAMP).alias("stamp"),
        F.coalesce(F.from_json("field_mappings", MAPPING), F.create_map().cast(_FIELDS)).alias("mapping"),
        F.from_json("validation_rules", VALIDATION).alias("validation"),
    )
    documents = computed_once(parsers.select("parser_id", "parser_name", "format_type", read.alias("d")), "d")
    rules, stamp, mapping = (F.col(f"d.{c}") for c in ("rules", "stamp", "mapping"))
    layout = reduce(lambda x, item: F.replace(x, F.lit(item[0]), F.lit(item[1])), P.COMPOSED.items(), stamp["format"])
    plain = reduce(lambda x, letter: F.replace(x, F.lit(letter), F.lit("")), P.UNUSED, layout)
    unused = [F.when(layout.contains(letter), names) for letter, names in P.UNUSED.items()]
    delimiter = F.coalesce(rules["delimiter"], F.lit(","))
    pair, sign, quote = (F.coalesce(rules[c], F.lit(d)) for c, d in (
        ("pair_delimiter", " "), ("key_value_separator", "="), ("quote_char", '"')))
    named = lambda key: F.coalesce(F.try_element_at(mapping, key), key)
    cell = F.concat(F.lit(r'("(?:[^"]|"")*"|[^'), _escaped(delimiter), F.lit("]*)"), _escaped(delimiter))
    pairs = F.concat(F.lit(r"(\w+"), _escaped(sign), F.lit("(?:"), _escaped(quote), F.lit("[^"), _escaped(quote), F.lit("]*"), _escaped(quote),
                     F.lit("|[^"), _escaped(pair), F.lit("]+))"))
    needed = F.struct(
        F.upper("format_type").alias("format"), mapping.alias("mapping"), delimiter.alias("delimiter"), _escaped(delimiter).alias("split"),
        cell.alias("cell"), F.transform(rules["columns"], named).alias("targets"), F.coalesce(rules["flatten"], F.lit(False)).alias("flatten"),
        pairs.alias("pairs"), F.length(sign).alias("sign_length"), quote.alias("quote"),
        F.coalesce(rules["rfc_version"], F.lit("RFC3164")).alias("rfc"), named(stamp["field"]).alias("time_name"), stamp["format"].alias("layout"),
        _layout(plain).alias("pattern"), F.array_compact(F.array(*unused)).alias("unused"),
        F.col("d.validation").alias("validation"),
    )
    return computed_once(documents.select("parser_id", "parser_name", needed.alias("p")), "p")


def _time(value: Column, p: Column) -> Column:
    """ISO text of ``value`` by the layout of the profile; other values stay as they are."""
    def iso(t: Column) -> Column:
        whole = F.unix_micros(t) % 1_000_000 == 0
        return F.when(whole, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))

    number = value.try_cast("bigint")
    fraction = p["layout"].contains("%f")
    # what is read and not used must be there
    there = F.forall(p["unused"], lambda names: F.regexp_instr(value, names) > 0)
    bare = F.when(there, F.aggregate(p["unused"], value, lambda v, names: F.regexp_replace(v, names, F.lit(""))))
    padded = F.when(fraction, F.regexp_replace(F.regexp_replace(bare, r"\.(\d{1,5})(?!\d)", ".$100000"), r"\.(\d{6})\d*", ".$1")).otherwise(bare)
    plain = F.regexp_replace(F.regexp_replace(padded, r"([+-]\d{2}):(\d{2})$", "$1$2"), "Z$", "+0000")
    offset = F.regexp_extract(plain, P._OFFSET, 0)
    sign, hours, minutes = (F.regexp_extract(plain, P._OFFSET, i) for i in (1, 2, 3))
    shift = F.when(sign == "-", -1).otherwise(1) * (hours.try_cast("int") * 3600 + minutes.try_cast("int") * 60)
    moved = F.timestamp_micros(F.unix_micros(F.try_to_timestamp(plain, p["pattern"])) + shift.cast("bigint") * 1_000_000)
    with_offset = F.when(offset != "", F.concat(iso(moved), sign, hours, F.lit(":"), minutes))
    found = (
        F.when(p["layout"] == "epoch", iso(F.timestamp_seconds(number))).when(p["layout"] == "epoch_ms", iso(F.timestamp_millis(number)))
        .when(p["layout"].contains("%z"), with_offset).otherwise(iso(F.try_to_timestamp(padded, p["pattern"])))
    )
    return F.coalesce(found, value)


def _csv(line: Column, p: Column) -> tuple[Column, Column]:
    cells = F.when(line.contains('"'), F.transform(F.regexp_extract_all(F.concat(line, p["delimiter"]), p["cell"], F.lit(1)), P.bare_cell)).otherwise(
        F.split(line, p["split"], -1))
    entries = F.transform(p["targets"], lambda name, i: F.struct(name.alias("key"), F.nullif(strip(F.get(cells, i)), F.lit("")).alias("value")))
    return entries, F.when(F.size(cells) != F.size(p["targets"]), P.COLUMN_ERROR)


def _renamed(entries: Column, p: Column) -> Column:
    return F.transform(entries, lambda e: F.struct(F.coalesce(F.try_element_at(p["mapping"], e["key"]), e["key"]).alias("key"), e["value"].alias("value")))


def _json(line: Column, p: Column) -> tuple[Column, Column]:
    text = strip(line)
    document = F.when(F.try_parse_json(text).isNotNull() & text.startswith("{"), text)
    flat = P.flat_json_entries(document, p["flatten"])
    return _renamed(flat, p), F.when(document.isNull(), P.JSON_ERROR)


def _key_value(line: Column, p: Column) -> tuple[Column, Column]:
    def one(token: Column) -> Column:
        key = F.regexp_extract(token, r"^(\w+)", 1)
        value = strip(F.trim(F.substring(token, F.length(key) + p["sign_length"] + 1, F.length(token)), p["quote"]))
        return F.struct(key.alias("key"), value.alias("value"))

    return _renamed(F.transform(F.regexp_extract_all(line, p["pairs"], F.lit(1)), one), p), F.lit(None).cast("string")


def _header(line: Column, pattern: str, names: list[str], numbers: set[str]) -> Column:
    values = [F.regexp_extract(line, "(?d)" + pattern, i + 1) for i in range(len(names))]
    return F.array(*[F.struct(F.lit(n).alias("key"), (v.try_cast("int").cast("string") if n in numbers else v).alias("value"))
                     for n, v in zip(names, values, strict=True)])


def _syslog(line: Column, p: Column) -> tuple[Column, Column]:
    """A line that does not match has no fields and still counts as parsed."""
    def by(pattern: str) -> Column:
        return F.when(line.rlike("(?d)" + pattern), _header(line, pattern, P.SYSLOG_FIELDS[pattern], {"priority", "version"}))

    found = F.when(p["rfc"] == "RFC5424", by(P.RFC5424)).otherwise(by(P.RFC3164))
    return F.coalesce(_renamed(found, p), F.array().cast(_ENTRIES)), F.lit(None).cast("string")


def _cef(line: Column, p: Column) -> tuple[Column, Column]:
    tokens = F.regexp_extract_all(F.regexp_extract(line, "(?d)" + P.CEF, 8), F.lit(r"(\w+=[^\s]+)"), F.lit(1))
    extension = F.transform(tokens, lambda t: F.struct(
        F.concat(F.lit("ext_"), F.substring_index(t, "=", 1)).alias("key"),
        F.substring(t, F.length(F.substring_index(t, "=", 1)) + 2, F.length(t)).alias("value")))
    entries = F.concat(_header(line, P.CEF, P.CEF_FIELDS, {"cef_version"}), extension)
    return _renamed(entries, p), F.when(~line.rlike("(?d)" + P.CEF), P.CEF_ERROR)


def parse_by_profile(lines: DataFrame, parsers: DataFrame, raw: str = "raw_log", ingest_col: str = "ingest_ts") -> DataFrame:
    """``lines`` (with ``parser_id``) with ``fields``, ``source_type``, ``error`` and ``parser_name``.

    A line without a profile, an empty one and one that its profile cannot read are error rows; a null line is empty.
    The profile table is joined by key and broadcast while it is under Spark's threshold.
    """
    rows = lines.join(compiled(parsers), "parser_id", "left")
    line, p = F.col(raw), F.col("p")
    kinds = {"CSV": _csv(line, p), "JSON": _json(line, p), "KEY_VALUE": _key_value(line, p), "SYSLOG": _syslog(line, p), "CEF": _cef(line, p)}
    stamp = F.date_format(F.col(ingest_col).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    entries = F.array(F.struct(F.lit("log").alias("key"), strip(line).alias("value")), F.struct(F.lit("timestamp").alias("key"), stamp.alias("value")))
    error = F.lit(None).cast("string")
    for kind, (found, wrong) in kinds.items():
        entries = F.when(p["format"] == kind, found).otherwise(entries)
        error = F.when(p["format"] == kind, wrong).otherwise(error)
    blank = F.coalesce(strip(line), F.lit("")) == ""
    error = F.when(p.isNull(), NO_PARSER).when(blank, EMPTY_LINE).otherwise(error)
    # each step is evaluated once, however often the next one names it
    read = computed_once(rows.withColumn("__read", F.struct(entries.alias("entries"), error.alias("error"))), "__read")
    fields = F.when(F.col("__read.error").isNull(), P._last_per_key(F.col("__read.entries")))
    found = computed_once(read.withColumn("__found", F.struct(fields.alias("fields"))), "__found")
    own = F.col("__found.fields")
    timed = p["format"].isin("CSV", "JSON", "KEY_VALUE") & F.map_contains_key(own, F.coalesce(p["time_name"], F.lit("")))
    value = F.when(timed, F.struct(F.try_element_at(own, p["time_name"]).alias("text")))
    staged = computed_once(found.withColumn("__time", value), "__time")
    rest = F.map_filter(own, lambda k, _: k != "timestamp")
    stamped = F.map_concat(rest, F.create_map(F.lit("timestamp"), _time(F.col("__time.text"), p)))
    return staged.select(
        *rows.columns, F.col("__read.error").alias("error"), F.when(F.col("__time").isNotNull(), stamped).otherwise(own).alias("fields"),
        F.lower(p["format"]).alias("source_type"),
    )


def profile_violations(parsed: DataFrame) -> DataFrame:
    """Rows of :func:`parse_by_profile` with ``violations``: the checks of their profile that they fail.

    Required, address, port, number and time fields come from the profile's ``validation_rules``; fields with a fixed set
    of values (severity, action, …) are held against it, without case.
    """
    rules = F.col("p.validation")

    def text(name: Column) -> Column:
        return F.coalesce(F.try_element_at("fields", name), F.lit(""))

    def failing(kind: str, of: str, wrong) -> Column:
        names = F.coalesce(rules[of], F.array().cast("array<string>"))
        return F.transform(F.filter(names, lambda n: wrong(text(n))), lambda n: F.concat(F.lit(f"{kind}:"), n))

    def port(v: Column) -> Column:
        return (v != "") & ~F.coalesce(v.try_cast("bigint").between(1, 65535), F.lit(False))

    def no_time(v: Column) -> Column:
        return (v != "") & ~reduce(lambda a, b: a | b, [v.rlike(t) for t in taxonomy.TIMES])

    sets = F.array_compact(F.array(*[
        F.when((text(F.lit(name)) != "") & ~F.upper(text(F.lit(name))).isin([v.upper() for v in values]), F.lit(f"value:{name}"))
        for name, values in taxonomy.VALUES.items()
    ]))
    found = F.concat(
        failing("required", "required_fields", lambda v: v == ""), failing("ip", "ip_fields", lambda v: (v != "") & ~v.rlike(taxonomy.IP)),
        failing("port", "port_fields", port), failing("numeric", "numeric_fields", lambda v: (v != "") & v.try_cast("double").isNull()),
        failing("timestamp", "timestamp_fields", no_time), sets,
    )
    return parsed.withColumn("violations", F.when(F.col("error").isNull(), found).otherwise(F.array().cast("array<string>")))


def choose_for_sources(lines: DataFrame, parsers: DataFrame, source: str = "source", vendor: str = "vendor") -> DataFrame:
    """``lines`` with the ``parser_id`` of their source: its own profile, else one for vendor and format, for the format that
    its lines show, or any.  Sources are one row each before they meet the profiles."""
    formats = profile_sources(lines).select(source, "format_type")
    requests = formats.join(lines.groupBy(source).agg(F.max(vendor).alias("vendor")), source)
    chosen = choose_parsers(requests, parsers, source).select(source, "parser_id", "matched_by")
    return lines.join(chosen, source, "left")


def ingest_statistics(parsed: DataFrame, parsers: DataFrame, source: str = "source", ingest_col: str = "ingest_ts", ms_col: str | None = None) -> DataFrame:
    """The profile table after the lines of ``parsed``: one usage row per source and profile, merged by weight."""
    ms = F.sum(ms_col) if ms_col else F.lit(0).cast("bigint")
    used = parsed.where(F.col("parser_id").isNotNull()).groupBy(source, "parser_id").agg(
        F.max(ingest_col).cast("timestamp").alias("timestamp"), F.count("*").alias("logs_count"),
        F.count_if(F.col("error").isNull()).alias("success_count"), ms.alias("parse_time_ms"),
    )
    return merge_statistics(parsers, usage_rows(used))
