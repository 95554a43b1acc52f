"""Verdicts of short tumbling windows, one window per five seconds and source."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.functions.text import blank_to_null, nz, strip
from logwarden.functions.times import bucket, bucket_start, micros

WINDOW_SECONDS = 5
#: Rows of one text for a scorer, whose input is limited; a window has as many texts as it needs.
TEXT_ROWS = 50

# Verdict texts, ranks and confidences.
NOTHING = "No malicious activity detected."
VERDICT_SEVERITY = {"Critical": "CRITICAL", "Warning": "MEDIUM", "Info": "INFO"}
VERDICT_CONFIDENCE = {"Critical": 0.90, "Warning": 0.70, "Info": 0.40}

_KEYS = ["source_type", "window_ts"]
_IDENTITY = ["agent_host", "event_id", "mitre_technique", "detection_module", "process_name", "dst_ip", "dst_port"]
#: Columns of the inputs that evidence, and those that verdicts and their rows are made of.
EVIDENCE_COLUMNS = ["source_event_id", "source_type", "ts", *_IDENTITY, "src_ip"]
VERDICT_COLUMNS = [*EVIDENCE_COLUMNS, "rule_severity", "event_details"]


def assign_windows(inputs: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Add the window start and the 16-digit fingerprint, which is a label: rows are told apart by the columns themselves.

    Windows are ``[start, end)`` on the epoch grid.
    """
    return inputs.select("*", bucket_start(bucket("ts", seconds), seconds).alias("window_ts"), _fingerprint())


def _fingerprint() -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[nz(c) for c in _IDENTITY]), 256), 1, 16).alias("fingerprint")


def _top(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("ts", "source_event_id")
    return df.withColumn("__rn", F.row_number().over(order)).filter(F.col("__rn") <= k).drop("__rn")


def _led(*keys: Column | str) -> list[Column | str]:
    """Keys to group by, led by a number made of the window and a hash: sorts compare it, and texts only where it is equal."""
    return [(micros("window_ts") + F.pmod(F.xxhash64(*keys), F.lit(1_000_000))).alias("__h"), *keys]


def dedupe_in_window(windowed: DataFrame) -> DataFrame:
    """First row of each alert (equal identity columns) inside its window.

    What the rows of an alert share is their key and is not carried a second time; the fingerprint is made of it afterwards.
    """
    same = [nz(c).alias(f"__i{i}") for i, c in enumerate(_IDENTITY)]
    order = ["ts", "source_event_id"]
    carried = [c for c in windowed.columns if c not in (*_KEYS, *_IDENTITY, *order, "fingerprint")]
    absent = [F.col(c).isNull().alias(f"__n{i}") for i, c in enumerate(_IDENTITY)]  # null and empty are one alert
    first = windowed.groupBy(*_led(*_KEYS, *same)).agg(F.min_by(F.struct(*order, *carried, *absent), F.struct(*order)).alias("r"))
    shared = [F.when(~F.col(f"r.__n{i}"), F.col(f"__i{i}")).alias(c) for i, c in enumerate(_IDENTITY)]
    rows = first.select(*_KEYS, *[F.col("r")[c].alias(c) for c in [*order, *carried]], *shared)
    return rows.select("*", *([_fingerprint()] if "fingerprint" in windowed.columns else [])).select(*windowed.columns)


def window_batches(inputs: DataFrame, seconds: int = WINDOW_SECONDS, batch: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """What one window verdict looks at: every row of the window, without repeated alerts.

    ``columns`` are those of ``inputs`` that are carried along (all by default), such as :data:`VERDICT_COLUMNS`.
    ``batch`` looks at a part only: of the oldest ``4 * batch`` rows of a window at most ``batch`` different ones.
    """
    windowed = assign_windows(inputs if columns is None else inputs.select(*columns), seconds)
    if batch is None:
        return dedupe_in_window(windowed)
    return _top(dedupe_in_window(_top(windowed, _KEYS, batch * 4)), _KEYS, batch)


def _rank(severity: Column) -> Column:
    s = F.upper(strip(severity))
    return F.when(s.isin("CRITICAL", "HIGH"), 3).when(s.isin("MEDIUM", "LOW"), 2).otherwise(1)


def _indicators() -> list[Column]:
    """Source, destination and port of a row as indicators of compromise, empty or null where it has none."""
    return [strip("src_ip"), strip("dst_ip"), strip(F.when(F.col("dst_port") != "", F.concat(F.lit("port:"), F.col("dst_port"))))]


def _value_rows(batches: DataFrame, judged: bool = True) -> DataFrame:
    """One row for each different value of a window: how often, and where first.

    Where ``judged``, rows without a technique are one more value of kind ``ioa``, the empty one, and techniques have the
    rank and the first details of their rows.  Only the technique of a row carries these, its indicators do not.
    """
    technique = nz(strip(F.when(F.col("mitre_technique") != "", F.concat(F.lit("mitre:"), F.col("mitre_technique")))))
    iocs = _indicators()
    filled = sum((nz(c) != "").cast("int") for c in iocs)
    said = [_rank(F.col("rule_severity")).alias("rank"), F.nullif(strip("event_details"), F.lit("")).alias("details")] if judged else []
    is_ioa = F.col("i") == len(iocs)
    each = batches.select(
        *_KEYS, micros("ts").alias("us"), "source_event_id", filled.alias("k"), *said, F.array(*iocs, technique).alias("values")
    ).select("*", F.posexplode("values").alias("i", "v")).where((F.col("v") != "") | (is_ioa & F.lit(judged))).select(
        *_KEYS, "us", "source_event_id", F.when(is_ioa, F.col("k")).alias("k"), F.when(is_ioa, "ioa").otherwise("ioc").alias("kind"), "v",
        *([F.when(is_ioa, F.col(c)).alias(c) for c in ("rank", "details")] if judged else []),
    )
    order = F.struct("us", "source_event_id")
    told = F.when(F.col("details").isNotNull(), F.struct(order.alias("o"), "details"))
    return each.groupBy(*_led(*_KEYS, "kind", "v")).agg(
        F.count("*").alias("rows"), F.min(F.struct("us", "source_event_id", "k")).alias("o"),
        *([F.max("rank").alias("rank"), F.min(told).alias("d")] if judged else []),
    ).drop("__h")


def window_evidence(batches: DataFrame) -> DataFrame:
    """Indicators of compromise and attack of each window, one row each: kind, value, rows, first_us."""
    return _value_rows(batches, judged=False).select(
        *_KEYS, "kind", F.col("v").alias("value"), "rows", F.col("o")["us"].alias("first_us")
    )


def window_verdicts(batches: DataFrame) -> DataFrame:
    """Rule verdict of each (source, window): verdict, reasoning, iocs, ioa, rows.

    ``iocs`` is the number of different indicators of compromise, which :func:`window_evidence` lists; ``ioa`` holds the
    techniques in order of first appearance and is as long as the rule set allows.  Values are counted before anything is
    listed, in one pass over the rows.
    """
    is_ioa = F.col("kind") == "ioa"
    base = _value_rows(batches).groupBy(*_led(*_KEYS)).agg(
        F.max("rank").alias("rank"), F.sum(F.when(is_ioa, F.col("rows"))).alias("rows"),
        F.min("d")["details"].alias("first_details"), F.count_if(~is_ioa).alias("iocs"),
        F.transform(F.sort_array(F.collect_list(F.when(is_ioa & (F.col("v") != ""), F.struct("o", "v")))), lambda s: s["v"]).alias("ioa"),
    )
    quiet = (F.col("rank") == 1) & (F.col("iocs") == 0) & (F.size("ioa") == 0)
    return base.select(
        *_KEYS,
        F.when(F.col("rank") == 3, "Critical").when(F.col("rank") == 2, "Warning").otherwise("Info").alias("verdict"),
        F.when(quiet, NOTHING).otherwise(F.coalesce("first_details", F.lit(NOTHING))).alias("reasoning"),
        "iocs", "ioa", F.lit("passthrough").alias("model"), "rows",
    )


def rule_pass_rows(batches: DataFrame) -> DataFrame:
    """:func:`pass_rows` with the rule verdict."""
    return pass_rows(batches, window_verdicts(batches))


def _by_verdict(verdict: Column, values: dict) -> Column:
    chain = None
    for name, value in values.items():
        chain = F.when(verdict == name, value) if chain is None else chain.when(verdict == name, value)
    return chain


def pass_rows(batches: DataFrame, verdicts: DataFrame, scored: bool = False) -> DataFrame:
    """Every row of a window with the verdict of its window and the indicators that the row itself adds."""
    v = verdicts.select(*_KEYS, "verdict", "reasoning", "iocs", "ioa", "model")
    return _pass_columns(batches.withColumn("ioc", F.array_distinct(F.filter(F.array(*_indicators()), lambda v: v != ""))).join(v, _KEYS[::-1]), scored)


def _pass_columns(judged: DataFrame, scored: bool) -> DataFrame:
    text = F.coalesce(blank_to_null(strip("reasoning")), F.lit(NOTHING))
    summary = F.when(
        F.size("ioa") > 0, F.concat(text, F.lit(" | IOA: "), F.array_join("ioa", "; "))
    ).otherwise(strip("reasoning"))
    severity = _by_verdict(F.col("verdict"), VERDICT_SEVERITY)
    rows = judged.select(
        "source_event_id", "source_type", "window_ts",
        *[blank_to_null(c).alias(c) for c in ("agent_host", "src_ip", "dst_ip", "dst_port", "event_id")],
        blank_to_null("event_details").alias("raw_summary"),
        blank_to_null("rule_severity").alias("rule_severity"),
        blank_to_null("mitre_technique").alias("rule_mitre"),
        (F.col("mitre_technique") != "").alias("rule_is_ioa"),
        severity.alias("llm_severity"),
        blank_to_null(summary).alias("llm_short_summary"),
        (F.size("ioa") > 0).alias("llm_is_ioa"),
        (F.col("iocs") > 0).alias("llm_is_ioc"),
        blank_to_null(F.array_join("ioc", ",")).alias("llm_ioc_values"),
        blank_to_null(F.array_join("ioa", ",")).alias("llm_ioa_values"),
        F.lit(None).cast("string").alias("llm_mitre_technique"),
        _by_verdict(F.col("verdict"), VERDICT_CONFIDENCE).alias("llm_confidence"),
        F.col("model").alias("llm_model"),
        F.lit(None).cast("bigint").alias("llm_latency_ms"),
        F.lit(scored).alias("llm_enabled"),
    )
    return rows.select(
        "*",
        F.coalesce("llm_severity", "rule_severity").alias("final_severity"),
        F.coalesce("llm_short_summary", "raw_summary").alias("final_summary"),
        F.coalesce("llm_mitre_technique", "rule_mitre").alias("final_mitre"),
    )


def _quoted(c: str) -> Column:
    escaped = F.replace(F.replace(nz(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def window_texts(batches: DataFrame, preamble: str = "", rows: int = TEXT_ROWS) -> DataFrame:
    """Documents of a window for a scorer: its rows as numbered lines in time order, about ``rows`` of them in each ``part``.

    The rows of a window are dealt to parts by a hash of their id, so a busy window has more texts and not a longer one.
    """
    lines = F.concat(
        F.lit("source="), "source_type", F.lit(" host="), _quoted("agent_host"), F.lit(" event_id="), _quoted("event_id"),
        F.lit(" rule_severity="), "rule_severity", F.lit(" mitre="), _quoted("mitre_technique"), F.lit(" module="),
        _quoted("detection_module"), F.lit("\n    rule_detail="), _quoted("event_details"), F.lit("\n"),
        F.when((F.col("src_ip") != "") | (F.col("dst_ip") != ""),
               F.concat(F.lit("    network: "), "src_ip", F.lit(" -> "), "dst_ip", F.lit(":"), "dst_port", F.lit("\n")))
        .otherwise(""),
        F.when(F.col("process_name") != "", F.concat(F.lit("    process: "), _quoted("process_name"), F.lit("\n")))
        .otherwise(""),
        F.when(F.col("command_line") != "", F.concat(F.lit("    cmdline: "), _quoted("command_line"), F.lit("\n"))).otherwise(""),
        F.when(F.col("action") != "", F.concat(F.lit("    fw_action: "), "action", F.lit(" sent_bytes: "), "sent_bytes",
                                               F.lit("\n"))).otherwise(""),
        F.lit("\n"),
    )
    number = F.conv(F.substring(F.md5(F.col("source_event_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    parts = batches.groupBy(*_KEYS).agg(F.ceil(F.count("*") / rows).alias("parts"))
    ordered = batches.select(
        *_KEYS, number.alias("h"), F.struct(micros("ts"), F.col("source_event_id")).alias("o"), lines.alias("line")
    ).join(parts, _KEYS[::-1]).withColumn("part", F.col("h") % F.col("parts"))
    numbered = F.transform(
        F.sort_array(F.collect_list(F.struct("o", "line"))),
        lambda s, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), s["line"]),
    )
    return ordered.groupBy(*_led(*_KEYS, "part")).agg(F.concat(F.lit(preamble), F.array_join(numbered, "")).alias("text")).drop("__h")


def score_windows(batches: DataFrame, scorer: Callable[[str], str], preamble: str = "") -> DataFrame:
    """Window verdicts by a user-supplied model, the rule verdict where it fails.

    ``scorer`` maps the text of one part of a window to a JSON answer with verdict, reasoning, ioc and ioa, possibly
    wrapped in other text; it runs on the executors.  The worst answer of a window's parts decides (the first part of
    equal ones); indicators are counted over all parts.
    """

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = []
            for text in frame["text"]:
                try:
                    answers.append(scorer(text))
                except Exception:  # any failure means: use the rule verdict
                    answers.append(None)
            yield frame[[*_KEYS, "part"]].assign(answer=answers)

    texts = window_texts(batches, preamble)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.select(*_KEYS, "part").schema) + ", answer string"
    word = F.lower(strip(nz("a.verdict")))
    none = F.array().cast("array<string>")
    answered = texts.mapInPandas(call, schema).withColumn("a", read_answer(F.col("answer"))).where("a IS NOT NULL").select(
        *_KEYS, "part", F.when(word == "critical", 3).when(word == "warning", 2).otherwise(1).alias("level"),
        F.coalesce(blank_to_null("a.reasoning"), F.lit(NOTHING)).alias("reasoning"),
        F.size(F.array_distinct(F.coalesce("a.ioc", none))).alias("iocs"), F.coalesce("a.ioa", none).alias("ioa"),
    )
    worst = F.struct(-F.col("level"), F.col("part"))
    parsed = answered.groupBy(*_KEYS).agg(
        F.max("level").alias("s_level"), F.min_by("reasoning", worst).alias("s_reasoning"), F.sum("iocs").alias("s_iocs"),
        F.min_by("ioa", worst).alias("s_ioa"),
    )
    ok = F.col("s_level").isNotNull()
    verdict = F.when(F.col("s_level") == 3, "Critical").when(F.col("s_level") == 2, "Warning").otherwise("Info")
    return window_verdicts(batches).join(parsed, _KEYS, "left").select(
        *_KEYS,
        F.when(ok, verdict).otherwise(F.col("verdict")).alias("verdict"),
        F.coalesce("s_reasoning", "reasoning").alias("reasoning"),
        F.coalesce("s_iocs", "iocs").alias("iocs"),
        F.coalesce("s_ioa", "ioa").alias("ioa"),
        F.when(ok, "scorer").otherwise(F.col("model")).alias("model"),
        "rows",
    )


def read_answer(answer: Column) -> Column:
    """JSON object from the first ``{`` to the last ``}`` of a model answer."""
    body = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    schema = "verdict string, reasoning string, ioc array<string>, ioa array<string>, _bad string"
    parsed = F.from_json(body, schema, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    return F.when((body != "") & parsed["_bad"].isNull(), parsed)
