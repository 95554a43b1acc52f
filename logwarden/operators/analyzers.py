"""Behaviour analyzers over standardized logs in sliding windows.

The reference window is 60 seconds, looked at every 10 seconds.  A row belongs
to six windows; rows are therefore first reduced per 10-second slot, and only
the reduced rows are copied to the six windows.

Distinct counts first group by the counted value, so a noisy address is spread
over its values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.functions.text import nz
from logwarden.functions.times import bucket, bucket_start, iso_text, micros

# Window, thresholds, scores and texts of the analyzers.
WINDOW_SECONDS = 60
SLOT_SECONDS = 10
IP_DENIED = ["deny", "block", "reject"]
USER_FAILED = ["deny", "fail", "error"]
LOGIN_OK = ["allow", "success"]
LISTED_EVENTS = 20
LISTED_PEERS = 10
LISTED_PORTS = 50

RESULT_COLUMNS = [
    "correlation_id", "correlation_type", "severity", "title", "description", "window_start", "start_time", "end_time",
    "involved_sources", "involved_ips", "involved_users", "event_count", "indicators", "recommendations",
    "confidence_score",
]


def _filled(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def with_slot(logs: DataFrame) -> DataFrame:
    action = F.lower(nz("action"))
    failed = action.isin(USER_FAILED) | (F.coalesce("status_code", F.lit(0)) >= 400)
    ok = ~failed & (action.isin(LOGIN_OK) | (F.coalesce("status_code", F.lit(200)) < 300))
    return logs.select(
        "*", bucket("ts", SLOT_SECONDS).alias("slot"), micros("ts").alias("us"),
        action.isin(IP_DENIED).cast("int").alias("denied"), failed.cast("int").alias("failed"), ok.cast("int").alias("ok"),
    )


def _windows(reduced: DataFrame) -> DataFrame:
    """Copy slot rows to the windows that hold them; ``window_start`` is the first slot."""
    per = WINDOW_SECONDS // SLOT_SECONDS
    copies = reduced.withColumn("first_slot", F.explode(F.sequence(F.col("slot") - (per - 1), F.col("slot"))))
    return copies.drop("slot")




def _by_ip(logs: DataFrame) -> DataFrame:
    """Each row under its source and its destination, twice when they are equal."""
    ips = F.filter(F.array(_filled("source_ip"), _filled("dest_ip")), lambda ip: ip.isNotNull())
    return logs.withColumn("ip", F.explode(ips))




def _result(df: DataFrame, kind: str, ident: Column, severity: Column, title: Column, description: Column,
            sources: Column, ips: Column, users: Column, indicators: Column, recommendations: Column,
            score: Column) -> DataFrame:
    start = bucket_start(F.col("first_slot"), SLOT_SECONDS)
    return df.select(
        F.concat(ident, F.lit("_"), F.unix_seconds(start).cast("string")).alias("correlation_id"),
        F.lit(kind).alias("correlation_type"), severity.alias("severity"), title.alias("title"),
        description.alias("description"), start.alias("window_start"), F.timestamp_micros("first_us").alias("start_time"),
        F.timestamp_micros("last_us").alias("end_time"), sources.alias("involved_sources"), ips.alias("involved_ips"),
        users.alias("involved_users"), F.col("n").cast("bigint").alias("event_count"), F.to_json(indicators).alias("indicators"),
        recommendations.alias("recommendations"), score.alias("confidence_score"),
    )


def _texts(*items: Column | str) -> Column:
    return F.array(*[F.lit(i) if isinstance(i, str) else i for i in items])


def _none() -> Column:
    return F.array().cast("array<string>")


def _value_counts(rows: DataFrame, key: str, kinds: dict[str, Column]) -> DataFrame:
    """Rows per window, key and distinct value of each kind.

    Every attribute of a row becomes one (kind, value) line; lines are reduced
    per slot, copied to their windows and reduced again.  Distinct counts and
    value lists are then plain counts and lists of what is left, all in one
    pass, and a noisy key is spread over its values until the last step.
    """
    lines = F.filter(
        F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in kinds.items()]),
        lambda x: x["value"].isNotNull(),
    )
    sums = ["denied", "failed"]
    per_slot = (
        rows.select("slot", key, "us", *sums, F.explode(lines).alias("x")).groupBy("slot", key, "x.kind", "x.value")
        .agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums], F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    )
    return _windows(per_slot).groupBy("first_slot", key, "kind", "value").agg(
        *[F.sum(c).alias(c) for c in ("n", *sums)], F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us")
    )


def _few(counted: DataFrame, key: str, kind: str, k: int, value: Column) -> DataFrame:
    """``few``: the first ``k`` values of a kind of each (window, key), which are not the key itself.

    Every task keeps ``k`` of its rows before they meet, so a key with many values is no long list anywhere.
    """
    rows = counted.where((F.col("kind") == kind) & (F.col("value") != F.col(key))).withColumn("few", value)
    place = F.row_number().over(Window.partitionBy("first_slot", key).orderBy("few"))
    return rows.withColumn("place", place).where(F.col("place") <= k).groupBy("first_slot", key).agg(
        F.array_sort(F.collect_list("few")).alias("few"))


def _of(kind: str, value: Column | str) -> Column:
    return F.when(F.col("kind") == kind, F.col(value) if isinstance(value, str) else value)


def _values(kind: str, value: Column | None = None) -> Column:
    return F.array_sort(F.collect_list(_of(kind, F.col("value") if value is None else value)))


def _totals(base: str) -> list[Column]:
    """Sums over the kind that every row has exactly once."""
    return [
        F.sum(_of(base, "n")).alias("n"), F.sum(_of(base, "denied")).alias("denied"), F.sum(_of(base, "failed")).alias("failed"),
        F.min(_of(base, "first_us")).alias("first_us"), F.max(_of(base, "last_us")).alias("last_us"),
    ]


def _ip_values(logs: DataFrame) -> DataFrame:
    return _value_counts(_by_ip(with_slot(logs)), "ip", {
        "type": nz("source_type"), "dest": _filled("dest_ip"), "port": F.nullif("dst_port", F.lit(0)),
        "source": _filled("source_system"), "user": _filled("username"), "action": _filled("action"),
    })


def _user_values(logs: DataFrame) -> DataFrame:
    return _value_counts(with_slot(logs).filter(_filled("username").isNotNull()), "username", {
        "type": nz("source_type"), "ip": _filled("source_ip"), "source": _filled("source_system")})


def _scan_values(logs: DataFrame) -> DataFrame:
    used = with_slot(logs).filter(_filled("source_ip").isNotNull() & (F.coalesce("dst_port", F.lit(0)) != 0))
    return _value_counts(used, "source_ip", {"port": F.col("dst_port"), "source": _filled("source_system")})


def ip_activity(logs: DataFrame) -> DataFrame:
    """Addresses with many denied actions, peers, ports or source types."""
    other, counted = F.col("value") != F.col("ip"), _ip_values(logs)
    measured = counted.groupBy("first_slot", "ip").agg(
        *_totals("type"), F.count_if(F.col("kind") == "dest").alias("dests"), F.count_if(F.col("kind") == "port").alias("ports"),
        F.count_if(F.col("kind") == "type").alias("types"), _values("source").alias("sources"), _values("user").alias("users"),
        F.count_if((F.col("kind") == "dest") & other).alias("peers"),
        _values("action", F.struct("value", "n")).alias("actions"),
    )
    severity = F.when((F.col("denied") > 10) | (F.col("dests") > 20) | (F.col("ports") > 50), "CRITICAL").when(
        (F.col("denied") > 5) | (F.col("dests") > 10) | (F.col("types") > 2), "WARNING"
    )
    df = measured.filter(F.col("n") >= 5).withColumn("severity", severity).filter(F.col("severity").isNotNull())
    df = df.join(_few(counted, "ip", "dest", LISTED_PEERS, F.col("value")), ["first_slot", "ip"], "left")
    few = F.coalesce("few", _none())
    listed = F.array_join(F.transform("actions", lambda e: F.concat(
        F.lit("'"), e["value"], F.lit("': "), e["n"].cast("string"))), ", ")
    description = F.concat(
        F.lit("IP "), "ip", F.lit(" generated "), F.col("n").cast("string"), F.lit(" events across "),
        F.size("sources").cast("string"), F.lit(" sources. Actions: {"), listed, F.lit("}. "),
        F.when(F.col("peers") > 0, F.concat(F.lit("Contacted "), F.col("peers").cast("string"),
                                             F.lit(" unique destinations."))).otherwise(""),
    )
    critical = F.col("severity") == "CRITICAL"
    names = F.transform("actions", lambda e: e["value"])
    return _result(
        df, "ip_activity", F.concat(F.lit("ip_"), F.replace("ip", F.lit("."), F.lit("_"))), F.col("severity"),
        F.concat(F.lit("Suspicious IP Activity: "), "ip"), description, F.col("sources"),
        F.concat(F.array("ip"), few), F.col("users"),
        F.struct(F.array("ip").alias("source_ips"), few.alias("dest_ips"), names.alias("actions")),
        _texts(F.concat(F.lit("Review IP "), "ip", F.lit(" activity logs in detail")),
               "Check if IP is from expected geographic location", "Verify if activity aligns with normal user behavior"),
        F.when(critical, 0.7).otherwise(0.5),
    )


def user_activity(logs: DataFrame) -> DataFrame:
    """Users with many failures, addresses or source types."""
    measured = _user_values(logs).groupBy(
        "first_slot", "username"
    ).agg(
        *_totals("type"), F.count_if(F.col("kind") == "ip").alias("addresses"), F.count_if(F.col("kind") == "type").alias("types"),
        _values("source").alias("sources"), _values("ip").alias("ips"),
    )
    severity = F.when((F.col("failed") > 5) | (F.col("addresses") > 5), "CRITICAL").when(
        (F.col("failed") > 2) | (F.col("types") > 2), "WARNING"
    )
    df = measured.filter(F.col("n") >= 3).withColumn("severity", severity).filter(F.col("severity").isNotNull())
    return _result(
        df, "user_activity", F.concat(F.lit("user_"), "username"), F.col("severity"),
        F.concat(F.lit("Suspicious User Activity: "), "username"),
        F.concat(F.lit("User "), "username", F.lit(" generated "), F.col("n").cast("string"), F.lit(" events across "),
                 F.size("sources").cast("string"), F.lit(" sources from "), F.size("ips").cast("string"), F.lit(" IP(s).")),
        F.col("sources"), F.col("ips"), F.array("username"),
        F.struct(F.array("username").alias("usernames"), F.slice("ips", 1, LISTED_PEERS).alias("source_ips")),
        _texts(F.concat(F.lit("Review user "), "username", F.lit(" activity logs")),
               "Verify user credentials haven't been compromised",
               "Check if user is logging in from expected locations"),
        F.when(F.col("severity") == "CRITICAL", 0.6).otherwise(0.4),
    )


def port_scans(logs: DataFrame, minimum: int = 20) -> DataFrame:
    """Sources that reach more than ``minimum`` different ports."""
    counted = _scan_values(logs)
    df = counted.groupBy("first_slot", "source_ip").agg(
        *_totals("port"), F.count_if(F.col("kind") == "port").alias("ports"), _values("source").alias("sources"),
    ).filter(F.col("ports") > minimum)
    df = df.join(_few(counted, "source_ip", "port", LISTED_PORTS, F.col("value").cast("int")), ["first_slot", "source_ip"])
    return _result(
        df, "attack_sequence", F.concat(F.lit("portscan_"), F.replace("source_ip", F.lit("."), F.lit("_"))),
        F.lit("CRITICAL"), F.concat(F.lit("Port Scanning Detected: "), "source_ip"),
        F.concat(F.lit("IP "), "source_ip", F.lit(" attempted to access "), F.col("ports").cast("string"),
                 F.lit(" different ports, indicating possible port scanning.")),
        F.col("sources"), F.array("source_ip"), _none(),
        F.struct(F.array("source_ip").alias("source_ips"), F.col("few").alias("scanned_ports"),
                 _texts("port_scanning", "reconnaissance").alias("attack_type")),
        _texts(F.concat(F.lit("Block IP "), "source_ip", F.lit(" at firewall")), "Review all connections from this IP",
               "Check for successful connections after scan"),
        F.lit(0.9),
    )


def login_attacks(logs: DataFrame, minimum: int = 5) -> DataFrame:
    """More than ``minimum`` failed logins of one user from one source."""
    used = with_slot(logs).filter(
        _filled("source_ip").isNotNull() & _filled("username").isNotNull() & ((F.col("failed") == 1) | (F.col("ok") == 1))
    )
    reduced = used.groupBy("slot", "source_ip", "username", "source_system").agg(
        F.count("*").alias("n"), F.sum("failed").alias("failed"), F.sum("ok").alias("ok"), F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
    )
    df = _windows(reduced).groupBy("first_slot", "source_ip", "username").agg(
        F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.sum("ok").alias("ok"),
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
        F.array_sort(F.collect_set(_filled("source_system"))).alias("sources"),
    ).filter(F.col("failed") > minimum)
    won = F.col("ok") > 0
    return _result(
        df, "attack_sequence", F.concat(F.lit("bruteforce_"), "source_ip", F.lit("_"), "username"),
        F.when(won, "CRITICAL").otherwise("WARNING"),
        F.concat(F.lit("Brute Force Attack: "), "source_ip", F.lit(" → "), "username",
                 F.when(won, " (SUCCESSFUL)").otherwise("")),
        F.concat(F.lit("IP "), "source_ip", F.lit(" made "), F.col("failed").cast("string"),
                 F.lit(" failed authentication attempts for user "), "username", F.lit(". "),
                 F.when(won, F.concat(F.col("ok").cast("string"), F.lit(" successful login(s) detected.")))
                 .otherwise("No successful login.")),
        F.col("sources"), F.array("source_ip"), F.array("username"),
        F.struct(F.array("source_ip").alias("source_ips"), F.array("username").alias("targeted_users"),
                 _texts("brute_force", "credential_stuffing").alias("attack_type"), won.alias("success")),
        _texts(
            F.concat(F.when(won, F.lit("Block IP ")).otherwise("Monitor IP "), "source_ip",
                     F.when(won, " immediately").otherwise("")),
            F.concat(F.when(won, F.lit("Force password reset for user ")).otherwise("Notify user "), "username"),
            "Implement rate limiting on authentication endpoints", "Enable MFA for affected accounts"),
        F.when(won, 0.95).otherwise(0.75),
    )


#: Analyzer, its values, their key, and the column of a result that holds the key.
EVIDENCE = [
    ("ip_activity", _ip_values, "ip", "involved_ips"),
    ("user_activity", _user_values, "username", "involved_users"),
    ("port_scans", _scan_values, "source_ip", "involved_ips"),
]


def evidence(logs: DataFrame, options: dict[str, dict] | None = None) -> DataFrame:
    """Every value behind every result: ``analyzer, window_start, key, kind, value, events, first_seen, last_seen``.

    Results list the first few peers and ports; here are all, one row each, so a scanning address is many rows and no
    long list.  ``options`` has the arguments of an analyzer by its name.
    """
    out = None
    for name, values, key, column in EVIDENCE:
        found = ANALYZERS[name](logs, **(options or {}).get(name, {}))
        wanted = found.select(bucket("window_start", SLOT_SECONDS).alias("first_slot"), F.get(column, F.lit(0)).alias(key))
        rows = values(logs).join(wanted, ["first_slot", key]).select(
            F.lit(name).alias("analyzer"), bucket_start(F.col("first_slot"), SLOT_SECONDS).alias("window_start"), F.col(key).alias("key"),
            "kind", "value", F.col("n").alias("events"), F.timestamp_micros("first_us").alias("first_seen"), F.timestamp_micros("last_us").alias("last_seen"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


ANALYZERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "ip_activity": ip_activity,
    "user_activity": user_activity,
    "port_scans": port_scans,
    "login_attacks": login_attacks,
}


def register_analyzer(name: str, analyzer: Callable[[DataFrame], DataFrame]) -> None:
    """Add an analyzer: standardized logs in, ``RESULT_COLUMNS`` out."""
    ANALYZERS[name] = analyzer


def run_analyzers(logs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Results of all analyzers together."""
    out = None
    for name in names or list(ANALYZERS):
        found = ANALYZERS[name](logs).select(*RESULT_COLUMNS)
        out = found if out is None else out.unionByName(found)
    return out


def first_events(logs: DataFrame, results: DataFrame, key: str, columns: list[str] | None = None,
                 k: int = LISTED_EVENTS) -> DataFrame:
    """The first ``k`` log rows of each result as JSON, for results of one key.

    ``results`` needs window_start and ``key``; only matching rows are read.
    """
    columns = columns or [c for c in logs.columns if c not in ("id", "ts")]
    slots = with_slot(logs).select("slot", key, "id", "ts", *[c for c in columns if c != key])
    wanted = results.select(F.unix_seconds("window_start").alias("s"), key).distinct().withColumn(
        "first_slot", (F.col("s") / SLOT_SECONDS).cast("bigint")
    )
    rows = _windows(slots).join(wanted, ["first_slot", key])
    order = Window.partitionBy("first_slot", key).orderBy("ts", "id")
    top = rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k)
    row = F.struct(iso_text("ts").alias("timestamp"), *[c for c in columns if c != key])
    return top.groupBy("first_slot", key).agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rn", row.alias("row")))), lambda s: s["row"])).alias("events")
    ).select(bucket_start(F.col("first_slot"), SLOT_SECONDS).alias("window_start"), key, "events")
