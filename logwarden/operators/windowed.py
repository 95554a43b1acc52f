"""Ten-minute correlation windows over verdict rows, firewall and SCADA events."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.functions.text import blank_to_null, nz, strip
from logwarden.functions.times import as_timestamp, bucket, bucket_start, iso_text

# Window length, classifier threshold, known answers.
WINDOW_MINUTES = 10
MALICIOUS_CONFIDENCE = 0.30
ASSESSMENTS = ["malicious", "suspicious", "healthy", "safe"]
ENGINE = "correlationengine_v2"
#: After this time a claimed window that has neither succeeded nor failed can be claimed again.
LEASE_SECONDS = 3600


def last_closed_window(now: dt.datetime, minutes: int = WINDOW_MINUTES) -> tuple[dt.datetime, dt.datetime]:
    """Start and end of the last window that is over at ``now`` (UTC)."""
    width = dt.timedelta(minutes=minutes if minutes > 0 else WINDOW_MINUTES)
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    end = now.astimezone(dt.timezone.utc)
    end -= (end - epoch) % width
    return end - width, end


def in_windows(df: DataFrame, ts: Column | str, minutes: int = WINDOW_MINUTES) -> DataFrame:
    """Add ``window_start`` and ``window_end`` of the tumbling UTC window."""
    start = bucket_start(bucket(ts, minutes * 60), minutes * 60)
    return df.select("*", start.alias("window_start")).withColumn(
        "window_end", F.col("window_start") + F.expr(f"INTERVAL {minutes} MINUTES")
    )


def oldest_per_window(df: DataFrame, order: list[str], cap: int | None) -> DataFrame:
    """The first ``cap`` rows of each window; everything with ``cap=None``."""
    if cap is None:
        return df
    w = Window.partitionBy("window_start").orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= cap).drop("__rn")


def window_pass_events(rows: DataFrame, minutes: int = WINDOW_MINUTES, cap: int | None = None) -> DataFrame:
    """Endpoint verdict rows by ``window_ts``, or ``created_at`` where that is missing."""
    when = F.coalesce("window_ts", "created_at") if "created_at" in rows.columns else F.col("window_ts")
    picked = rows.filter(F.col("source_type") == "windows").select(
        F.col("source_event_id").alias("id"), as_timestamp(when).alias("ts"),
        *[nz(c).alias(c) for c in (
            "agent_host", "src_ip", "dst_ip", "dst_port", "event_id", "final_severity", "final_summary", "final_mitre")],
    )
    return oldest_per_window(in_windows(picked, "ts", minutes), ["ts", "id"], cap)


def window_firewall_events(rows: DataFrame, ts_col: str = "ts", minutes: int = WINDOW_MINUTES,
                           cap: int | None = None) -> DataFrame:
    """Firewall rows of every level by receive time."""
    picked = rows.select(
        "id", as_timestamp(ts_col).alias("ts"),
        *[nz(c).alias(c) for c in (
            "src_ip", "dst_ip", "dst_port", "action", "threat_level", "mitre_technique", "event_details")],
    )
    return oldest_per_window(in_windows(picked, "ts", minutes), ["ts", "id"], cap)


def window_scada_events(rows: DataFrame, ts_col: str = "timestamp", minutes: int = WINDOW_MINUTES,
                        cap: int | None = None) -> DataFrame:
    """SCADA rows by event time."""
    names = [c for c in ("source", "tag", "name", "message", "state", "classification", "username", "userlocation",
                         "raw_log") if c in rows.columns]
    picked = rows.select("id", as_timestamp(ts_col).alias("ts"), *[nz(c).alias(c) for c in names])
    return oldest_per_window(in_windows(picked, "ts", minutes), ["ts", "id"], cap)


# ---------------------------------------------------------------------------
# Classifier gate
# ---------------------------------------------------------------------------


def _texts(answer: Column, *keys: str) -> list[Column]:
    """Values of the keys that hold a text, else null; an empty text is a value."""
    found = [F.try_variant_get(F.try_parse_json(answer), f"$.{k}", "variant") for k in keys]
    return [F.when(F.schema_of_variant(x) == "STRING", strip(F.try_variant_get(x, "$", "string"))) for x in found]


def read_label(answer: Column) -> Column:
    """The first text that is there among classification, label, verdict, result, even an empty one; benign if it is empty."""
    first = F.coalesce(*_texts(answer, "classification", "label", "verdict", "result"), F.lit(""))
    return F.coalesce(blank_to_null(F.lower(first)), F.lit("benign"))


def read_error(answer: Column) -> Column:
    """The error that a classifier reports instead of an answer; null without one."""
    return blank_to_null(F.coalesce(*_texts(answer, "error")))


def read_confidence(answer: Column) -> Column:
    """First number among confidence, score, probability; texts count too."""
    fields = [strip(F.get_json_object(answer, f"$.{k}")).try_cast("double") for k in ("confidence", "score", "probability")]
    return F.coalesce(*fields, F.lit(0.0))


def severity_answer(severity: Column) -> Column:
    """Default classifier: CRITICAL and HIGH rows are malicious."""
    s = F.upper(severity)
    return F.when(s == "CRITICAL", '{"label":"Malicious","score":0.9}').when(
        s == "HIGH", '{"label":"Malicious","score":0.7}'
    ).when(s == "MEDIUM", '{"label":"Malicious","score":0.25}').otherwise('{"label":"Benign","score":0.9}')


def classify(events: DataFrame, classifier: Callable[[list[str]], list[str]] | None = None,
             threshold: float = MALICIOUS_CONFIDENCE) -> DataFrame:
    """Add raw_response, confidence and classification (malicious or benign).

    ``classifier`` maps a list of summaries to JSON answers and runs on the
    executors, a batch at a time; an error, raised or answered as ``error``, fails
    the job and so the window.  Without one the severity decides.
    """
    if classifier is None:
        answered = events.withColumn("raw_response", severity_answer(F.col("final_severity")))
    else:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + ", raw_response string"

        def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield frame.assign(raw_response=classifier([str(t).strip() for t in frame["final_summary"]]))

        answered = events.mapInPandas(call, schema)
    confidence = read_confidence(F.col("raw_response"))
    malicious = read_label(F.col("raw_response")).contains("malicious") & (confidence >= threshold)
    error = read_error(F.col("raw_response"))
    return answered.select(
        "*", confidence.alias("confidence"), F.lit(threshold).alias("threshold"),
        F.when(error.isNotNull(), F.raise_error(F.concat(F.lit("classifier error: "), error)))
        .when(malicious, "malicious").otherwise("benign").alias("classification"),
    )


# ---------------------------------------------------------------------------
# Window results
# ---------------------------------------------------------------------------


def window_counts(decisions: DataFrame, firewall: DataFrame, scada: DataFrame) -> DataFrame:
    """Rows per window and source; windows come from any of the three."""
    none = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")

    def part(df, total, malicious, fw, sc):
        return df.select("window_start", total.alias("a"), malicious.alias("b"), fw.alias("c"), sc.alias("d"))

    bad = F.when(F.col("classification") == "malicious", 1).otherwise(0).cast("bigint")
    rows = (
        part(decisions, one, bad, none, none)
        .unionByName(part(firewall, none, none, one, none))
        .unionByName(part(scada, none, none, none, one))
    )
    return rows.groupBy("window_start").agg(
        F.sum("a").alias("windows_total"), F.sum("b").alias("windows_malicious"),
        F.sum(F.col("a") - F.col("b")).alias("windows_benign"), F.sum("c").alias("firewall_total"),
        F.sum("d").alias("scada_total"),
    )


def assess(counts: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Assessment and confidence per window.

    A window with nothing to correlate is healthy with confidence 1.  Else the
    scorer's answer counts (``answers``: window_start, answer as JSON); an
    unknown assessment, and the default without a scorer, is "suspicious".
    """
    empty = F.col("windows_malicious") + F.col("firewall_total") + F.col("scada_total") == 0
    if answers is None:
        joined = counts.withColumn("answer", F.lit(None).cast("string"))
    else:
        joined = counts.join(answers.select("window_start", "answer"), "window_start", "left")
    said = F.lower(strip(F.get_json_object("answer", "$.overall_assessment")))
    known = F.when(said.isin(ASSESSMENTS), said).otherwise("suspicious")
    confidence = F.coalesce(F.get_json_object("answer", "$.confidence").try_cast("double"), F.lit(0.0))
    return joined.select(
        *counts.columns,
        F.when(empty, "healthy").otherwise(known).alias("assessment"),
        F.when(empty, 1.0).otherwise(confidence).alias("assessment_confidence"),
    )


def incidents_from_answers(answers: DataFrame) -> DataFrame:
    """Incident rows from scorer answers (window_start, window_end, answer)."""
    schema = (
        "incident_candidates array<struct<incident_type:string,severity:string,confidence:string,affected_host:string,"
        "affected_ip:string,mitre_techniques:array<string>,description:string,evidence:array<string>>>"
    )
    body = F.regexp_extract("answer", r"(?s)(\{.*\})", 1)
    each = answers.select(
        "window_start", "window_end", F.explode(F.from_json(body, schema)["incident_candidates"]).alias("i")
    )

    def filled(c):
        return blank_to_null(strip(F.col(c)))

    return each.select(
        "i.incident_type", "i.severity", "i.confidence",
        filled("i.affected_host").alias("affected_host"), filled("i.affected_ip").alias("affected_ip"),
        blank_to_null(strip(F.array_join("i.mitre_techniques", ","))).alias("mitre_techniques"),
        filled("i.description").alias("description"),
        F.to_json(F.struct(F.col("i.evidence").alias("evidence")), {"ignoreNullFields": "false"}).alias("evidence"),
        "window_start", "window_end", F.lit(3).cast("bigint").alias("source_count"),
    )


def _listed(df: DataFrame, name: str) -> DataFrame:
    fields = [c for c in df.columns if c not in ("window_start", "window_end", "id", "ts")]
    row = F.struct("id", iso_text("ts").alias("ts"), *fields)
    ordered = F.array_sort(F.collect_list(F.struct(F.col("ts").alias("o"), F.col("id").alias("i"), row.alias("r"))))
    return df.groupBy("window_start").agg(F.transform(ordered, lambda s: s["r"]).alias(name))


def window_payloads(counts: DataFrame, malicious: DataFrame, firewall: DataFrame, scada: DataFrame,
                    chains: DataFrame | None = None) -> DataFrame:
    """One JSON document per window for a correlation scorer.

    The lists hold all rows that are given: bound them first (:func:`oldest_per_window`) to what the scorer can read.
    """
    keep = [c for c in malicious.columns if c not in ("raw_response", "threshold", "classification", "confidence")]
    out = counts.join(_listed(malicious.select(*keep), "windows_events"), "window_start", "left")
    out = out.join(_listed(firewall, "firewall_events"), "window_start", "left")
    out = out.join(_listed(scada, "scada_events"), "window_start", "left")
    parts = ["windows_events", "firewall_events", "scada_events"]
    if chains is not None:
        graph = chains.groupBy("window_start").agg(
            F.array_sort(F.collect_list(F.struct("host", "chain_type", "chain_json", "nodes"))).alias("process_chain_evidence")
        )
        out = out.join(graph, "window_start", "left")
        parts.append("process_chain_evidence")
    numbers = [c for c in counts.columns if c not in ("window_start", "assessment", "assessment_confidence")]
    return out.select(
        "window_start",
        F.to_json(F.struct(iso_text("window_start").alias("window_start"), F.struct(*numbers).alias("counts"), *parts))
        .alias("payload"),
    )


# ---------------------------------------------------------------------------
# Ledger of processed windows: rows are only ever added
# ---------------------------------------------------------------------------


def open_windows(candidates: DataFrame, ledger: DataFrame, now: Column, lease: int = LEASE_SECONDS, engine: str = ENGINE) -> DataFrame:
    """Windows to work on: all but those that are done, and those claimed less than ``lease`` seconds ago and not failed."""
    state = latest_state(ledger.filter(F.col("engine_name") == engine))
    held = (F.col("status") == "processing") & (F.col("recorded_at") > now - F.make_dt_interval(secs=F.lit(lease)))
    taken = state.filter((F.col("status") == "done") | held).select("window_start", "window_end")
    return candidates.select("window_start", "window_end").distinct().join(
        taken, ["window_start", "window_end"], "left_anti"
    )


def ledger_rows(windows: DataFrame, status: str, now: Column, engine: str = ENGINE, run: str | None = None,
                error: Column | None = None) -> DataFrame:
    return windows.select(
        F.lit(engine).alias("engine_name"), "window_start", "window_end", F.lit(status).alias("status"),
        now.alias("recorded_at"), F.lit(run).cast("string").alias("run"),
        (F.lit(None) if error is None else error).cast("string").alias("error_text"),
    )


def claim_rows(windows: DataFrame, now: Column, engine: str = ENGINE, run: str | None = None) -> DataFrame:
    return ledger_rows(windows, "processing", now, engine, run)


def failure_rows(windows: DataFrame, now: Column, error: Column, engine: str = ENGINE, run: str | None = None) -> DataFrame:
    return ledger_rows(windows, "failed", now, engine, run, error)


def won_windows(ledger: DataFrame, run: str, now: Column, lease: int = LEASE_SECONDS, engine: str = ENGINE) -> DataFrame:
    """Windows that ``run`` has claimed before any other run whose claim still holds."""
    ended = ledger.filter(F.col("status") != "processing").select("window_start", "window_end", "run").distinct()
    live = ledger.filter(
        (F.col("engine_name") == engine) & (F.col("status") == "processing")
        & (F.col("recorded_at") > now - F.make_dt_interval(secs=F.lit(lease)))
    ).join(ended, ["window_start", "window_end", "run"], "left_anti")
    first = live.groupBy("window_start", "window_end").agg(F.min(F.struct("recorded_at", "run")).alias("f"))
    return first.filter(F.col("f")["run"] == run).select("window_start", "window_end")


def latest_state(ledger: DataFrame) -> DataFrame:
    """Current row of every window: done once it ever was, else the newest, finished before processing."""
    key = ["engine_name", "window_start", "window_end"]
    values = [c for c in ledger.columns if c not in key]
    order = F.struct(
        (F.col("status") == "done").cast("int"), F.col("recorded_at"), (F.col("status") != "processing").cast("int")
    )
    return ledger.groupBy(*key).agg(F.max_by(F.struct(*values), order).alias("r")).select(*key, "r.*")
