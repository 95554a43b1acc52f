"""Cross-source correlation: five interval joins of endpoint and firewall events.

Every rule joins on an IP address and a time distance.  Incidents only need the
number of matches, the first and the last; a sweep over sorted times gives them
without making pairs (:mod:`logwarden.operators.sweep`).

Evidence needs the pairs.  A plain equi-join on the address would send one noisy
address to one task, so its key is (address, ten-minute bucket): the filtered
endpoint side is copied to the two or three buckets its interval touches, the
firewall side stays single.  A pair is found in exactly one bucket.  What
remains hot inside one bucket is split by the adaptive skew join, or by ``salt``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.functions.text import any_true, computed_once, to_long
from logwarden.functions.times import as_timestamp, bucket, iso_text, micros, whole_division
from logwarden.operators.sweep import within_reach

WINDOW_SECONDS = 600

# Ports, thresholds and addresses of the rules.
BEACON_PORTS = ["4444", "5555", "6666", "7777", "1337", "31337", "9001", "9030"]
BRUTE_FORCE_PORTS = ["3389", "445", "22", "5985"]
LATERAL_PORTS = ["445", "3389", "5985", "5986", "22"]
BLOCKED = ["DROP", "DENY", "REJECT"]
LOCAL_SOURCES = ["", "127.0.0.1", "-"]
EXFIL_BYTES = 10_000_000
MIN_FAILURES = 5

INCIDENT_COLUMNS = [
    "incident_key", "incident_type", "severity", "confidence", "affected_host", "affected_ip", "mitre_techniques",
    "description", "evidence", "window_start", "window_end", "source_count",
]


def interval_join(
    left: DataFrame,
    right: DataFrame,
    before: Column | int,
    after: Column | int,
    width: int = WINDOW_SECONDS,
    salt: int = 1,
    reach: int = WINDOW_SECONDS,
) -> DataFrame:
    """Pairs with equal ``key`` and ``right.ts - left.ts`` in [-before, after] seconds.

    Both sides need ``key`` and ``ts``; the other column names must differ.
    ``before`` and ``after`` may be columns of the left side and are at most
    ``reach``.  The left side should be the smaller one: it is copied per
    bucket and salt.
    """
    micro = F.lit(1_000_000).cast("bigint")
    low = micros("ts") - (F.lit(before) if isinstance(before, int) else before) * micro
    high = micros("ts") + (F.lit(after) if isinstance(after, int) else after) * micro
    spread = (
        left.select("*", low.alias("__low"), high.alias("__high"))
        .withColumn("__cell", F.explode(F.sequence(
            whole_division(F.col("__low"), width * 1_000_000), whole_division(F.col("__high"), width * 1_000_000))))
        .withColumnRenamed("ts", "left_ts")
    )
    cells = right.select(
        F.col("key").alias("__key"), F.col("ts").alias("right_ts"), bucket("ts", width).alias("__right_cell"),
        *[c for c in right.columns if c not in ("key", "ts")],
    )
    # The outer bounds are stated on the time columns as well: with watermarks
    # on a stream, that is what lets Spark forget old rows.
    bounds = F.expr(
        f"right_ts >= left_ts - INTERVAL {reach} SECONDS AND right_ts <= left_ts + INTERVAL {reach} SECONDS"
    )
    on = (F.col("key") == F.col("__key")) & (F.col("__cell") == F.col("__right_cell")) & bounds
    if salt > 1:
        spread = spread.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        others = [c for c in cells.columns if c not in ("__key", "__right_cell")]
        cells = cells.withColumn("__right_salt", F.pmod(F.xxhash64(*others), F.lit(salt)).cast("int"))
        on = on & (F.col("__salt") == F.col("__right_salt"))
    return (
        spread.join(cells, on)
        .filter(micros("right_ts").between(F.col("__low"), F.col("__high")))
        .drop("__key", "__cell", "__right_cell", "__salt", "__right_salt", "__low", "__high")
    )


def _between(events: DataFrame, as_of: dt.datetime | None) -> DataFrame:
    """One pass looks at the ten minutes before ``as_of``; None means everything."""
    if as_of is None:
        return events
    end = F.lit(as_of).cast("timestamp")
    return events.filter((F.col("ts") >= end - F.expr(f"INTERVAL {WINDOW_SECONDS} SECONDS")) & (F.col("ts") <= end))


def union_techniques(*texts: Column) -> Column:
    """Comma lists joined, blanks and repeats removed, first occurrence first."""
    parts = F.transform(F.split(F.concat_ws(",", *texts), ","), lambda t: F.trim(t))
    return F.array_join(F.array_distinct(F.filter(parts, lambda t: t != "")), ",")


def _evidence(*rows: tuple[str, Column, Column, Column]) -> Column:
    return F.to_json(F.array(*[
        F.struct(F.lit(src).alias("src"), iso_text(ts).alias("ts"), details.alias("details"),
                 F.nullif(ip, F.lit("")).alias("ip"))
        for src, ts, details, ip in rows
    ]))


def incident_key(kind: Column, *parts: Column) -> Column:
    """Stable id, so that overlapping passes produce the same incident once."""
    return F.sha2(F.concat_ws("|", kind, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


_W = ["id", "src_ip", "dst_ip", "agent_host", "mitre_technique", "event_details", "logon_type"]
_F = ["id", "src_ip", "dst_ip", "dst_port", "mitre_technique", "event_details", "sent_bytes"]

#: Incident columns of the pair rules that tell little, with the last of ``_W`` and of ``_F`` that they are made of.
_TOLD = {
    "incident_key": ("agent_host", "src_ip"), "incident_type": ("id", "id"), "severity": ("id", "id"), "confidence": ("id", "id"),
    "affected_host": ("agent_host", "id"), "affected_ip": ("src_ip", "src_ip"), "mitre_techniques": ("mitre_technique", "mitre_technique"),
    "window_start": ("id", "id"), "window_end": ("id", "id"), "source_count": ("id", "id"),
}

C2 = "C2_BEACON_CONFIRMED"
EXFIL = "CRED_DUMP_THEN_EXFIL"
LATERAL = "LATERAL_MOVEMENT_CONFIRMED"
BYPASS = "FIREWALL_BYPASS_SUSPECTED"
PAIR_RULES = [C2, EXFIL, LATERAL, BYPASS]


def _endpoint_tests() -> dict[str, Column]:
    technique, ip = F.col("mitre_technique"), F.col("src_ip")
    logon = F.col("event_id") == "4624"
    return {
        C2: (technique.contains("T1571") | technique.contains("T1071")) & (F.col("dst_ip") != ""),
        EXFIL: technique.contains("T1003") & (ip != ""),
        LATERAL: logon & F.col("logon_type").isin("3", "10") & ~ip.isin(LOCAL_SOURCES),
        BYPASS: logon & (ip != ""),
    }


def _firewall_tests(mode: str) -> dict[str, Column]:
    action, ip = F.upper("action"), F.col("src_ip")
    allowed = action == "ALLOW"
    return {
        C2: allowed & (ip != "") if mode == "intent" else allowed,
        EXFIL: allowed & (ip != "") & (to_long("sent_bytes") >= EXFIL_BYTES),
        LATERAL: allowed & ~ip.isin(LOCAL_SOURCES) & F.col("dst_port").isin(LATERAL_PORTS),
        BYPASS: action.isin(BLOCKED) & (ip != ""),
    }


#: Seconds a firewall row may lie before and after the endpoint row.
_REACH = {
    C2: (WINDOW_SECONDS, WINDOW_SECONDS),
    EXFIL: (0, WINDOW_SECONDS),
    LATERAL: (WINDOW_SECONDS, WINDOW_SECONDS),
    BYPASS: (WINDOW_SECONDS, 0),
}


def _flags(tests: dict[str, Column], rules: list[str], side: str) -> list[Column]:
    return [F.coalesce(tests[r], F.lit(False)).alias(f"{side}{i}") for i, r in enumerate(rules)]


def _endpoint_side(endpoint: DataFrame, rules: list[str], as_of: dt.datetime | None) -> DataFrame:
    """Rows that can take part in some rule; ``__w0``, ``__w1`` … say in which."""
    tests = _endpoint_tests()
    w = _between(endpoint, as_of).filter(any_true([tests[r] for r in rules]))
    return w.select("ts", *[F.col(c).alias("w_" + c) for c in _W], *_flags(tests, rules, "__w"))


def _firewall_side(firewall: DataFrame, rules: list[str], as_of: dt.datetime | None, mode: str) -> DataFrame:
    """Rows that can take part in some rule under their source address; ``__f0``, ``__f1`` … say in which."""
    f = _between(firewall, as_of)
    hits = F.struct(*_flags(_firewall_tests(mode), rules, "__f")).alias("__hits")
    # A filter on the tests themselves would work out addresses and actions anew for each of them.
    told = computed_once(f.select(F.col("src_ip").alias("key"), "ts", *[F.col(c).alias("f_" + c) for c in _F], hits), "__hits")
    some = any_true([F.col(f"__hits.__f{i}") for i in range(len(rules))])
    return told.filter(some).select("key", "ts", *["f_" + c for c in _F], "__hits.*")


def pair_incidents(
    endpoint: DataFrame,
    firewall: DataFrame,
    rules: list[str] | None = None,
    as_of: dt.datetime | None = None,
    mode: str = "intent",
    salt: int = 1,
    columns: list[str] | None = None,
) -> DataFrame:
    """Incidents of the rules that need an endpoint and a firewall row: one for each rule and endpoint row.

    The first firewall row that matches is told (the smallest of those of the
    same instant), the others are counted; all of them are rows of
    :func:`pair_matches`.  No pair is made here: a sweep over sorted times
    counts them, so busy addresses cost a sort.  ``salt`` is for
    :func:`pair_matches` and changes nothing here.  ``columns`` are those of the
    incidents that are asked for (all by default); rows carry no more than these need.
    """
    rules = rules or PAIR_RULES
    columns = columns or INCIDENT_COLUMNS
    w, f = _endpoint_side(endpoint, rules, as_of), _firewall_side(firewall, rules, as_of, mode)

    def watch(rule: str, key: Column, peer: Column) -> Column:
        before, after = _REACH[rule]
        low, high = F.col("us") - before * 1_000_000, F.col("us") + after * 1_000_000
        if rule == BYPASS:  # strictly earlier
            high = high - 1
        return F.struct(F.lit(rule).alias("kind"), key.alias("key"), peer.alias("peer"), low.alias("low"), high.alias("high"))

    def watches(i: int, rule: str) -> Column:
        none = F.lit("")
        if rule != C2:
            some = F.array(watch(rule, F.col("w_src_ip"), none))
        else:
            keys = F.array_distinct(F.array("w_src_ip", "w_agent_host"))
            some = F.concat(*[F.transform(keys, lambda k: watch(C2, k, peer)) for peer in (none, F.col("w_dst_ip"))])
        return F.when(F.col(f"__w{i}"), some).otherwise(F.slice(some, 1, 0))

    # The smallest row is told, so what it is told by is cut at its end only.
    w_told, f_told = (
        names[: max(names.index(_TOLD[c][i]) if c in _TOLD else len(names) for c in columns) + 1] for i, names in enumerate((_W, _F)))
    own = ["ts", *["w_" + c for c in w_told if c != "id"]]
    probes = w.withColumn("us", micros("ts")).select(
        "w_id", F.struct(*own).alias("told"), F.explode(F.concat(*[watches(i, r) for i, r in enumerate(rules)])).alias("p")
    ).select(F.struct("p.kind", "w_id").alias("probe"), "told", "p.*")
    if mode == "intent":
        probes = probes.where(F.col("key") != "")

    def seen(i: int, rule: str) -> Column:
        # A beacon is known by its port, whoever it reaches, or else by the peer that both sides name.
        beacon = F.coalesce(F.col("f_dst_port").isin(BEACON_PORTS), F.lit(False))
        peer = F.when(beacon, "").otherwise(F.nullif("f_dst_ip", F.lit(""))) if rule == C2 else F.lit("")
        return F.when(F.col(f"__f{i}"), F.struct(F.lit(rule).alias("kind"), peer.alias("peer")))

    points = f.select(
        "key", micros("ts").alias("us"), F.struct(*["f_" + c for c in f_told]).alias("told"),
        F.explode(F.array_compact(F.array(*[seen(i, r) for i, r in enumerate(rules)]))).alias("p"),
    ).select("p.*", "key", "us", "told", F.lit(1).cast("bigint").alias("n")).where(F.col("peer").isNotNull())
    found = within_reach(probes, points, ["kind", "key", "peer"]).select(
        "probe.*", F.col("told.ts").alias("left_ts"), *["told." + c for c in own[1:]], F.timestamp_micros("first_us").alias("right_ts"),
        "first.*", F.col("n").alias("matches"), F.timestamp_micros("last_us").alias("last_ts"))
    absent = [F.lit(None).cast("string").alias(c) for c in ["w_" + c for c in _W] + ["f_" + c for c in _F] if c not in found.columns]
    return _pair_output(found.select("*", *absent), F.col("w_id")).select(*columns)


def pair_matches(
    endpoint: DataFrame,
    firewall: DataFrame,
    rules: list[str] | None = None,
    as_of: dt.datetime | None = None,
    mode: str = "intent",
    salt: int = 1,
) -> DataFrame:
    """Evidence of :func:`pair_incidents`: every pair of rows that a rule matches, one row each.  For streams too."""
    pairs = _pairs(endpoint, firewall, rules, as_of, mode, salt)
    single = pairs.withColumns({"matches": F.lit(1).cast("bigint"), "last_ts": F.col("right_ts")})
    return _pair_output(single, F.col("w_id"), F.col("f_id"))


def _pairs(endpoint: DataFrame, firewall: DataFrame, rules: list[str] | None, as_of: dt.datetime | None, mode: str, salt: int) -> DataFrame:
    """Pairs of rows with the rule that they match, in one join.

    Each side is reduced to rows that can take part in some rule before the
    shuffle, and each side is read and shuffled once however many rules run.
    The beacon rule also accepts the endpoint's host name as the firewall
    source, so such rows are copied under both keys.  Empty addresses match
    nothing; with ``mode="reference"`` they match each other.
    """
    rules = rules or PAIR_RULES
    w, right = _endpoint_side(endpoint, rules, as_of), _firewall_side(firewall, rules, as_of, mode)
    two_keys = F.col(f"__w{rules.index(C2)}") if C2 in rules else F.lit(False)
    keys = F.when(two_keys, F.array_distinct(F.array("w_src_ip", "w_agent_host"))).otherwise(F.array("w_src_ip"))
    left = w.withColumn("key", F.explode(keys))
    if mode == "intent":
        left = left.filter(F.col("key") != "")

    def reach(position: int) -> Column:
        return F.greatest(F.lit(0), *[
            F.when(F.col(f"__w{i}"), F.lit(_REACH[r][position])).otherwise(0) for i, r in enumerate(rules)
        ])

    pairs = interval_join(left, right, reach(0), reach(1), salt=salt)
    gap = micros("right_ts") - micros("left_ts")
    same_address = F.col("f_src_ip") == F.col("w_src_ip")
    limit = WINDOW_SECONDS * 1_000_000
    pair_test = {
        C2: gap.between(-limit, limit)
        & (F.col("f_dst_port").isin(BEACON_PORTS) | (F.col("f_dst_ip") == F.col("w_dst_ip"))),
        EXFIL: same_address & gap.between(0, limit),
        LATERAL: same_address & gap.between(-limit, limit),
        BYPASS: same_address & (gap >= -limit) & (gap < 0),
    }
    found = F.array_compact(F.array(*[
        F.when(F.col(f"__w{i}") & F.col(f"__f{i}") & pair_test[r], F.lit(r)) for i, r in enumerate(rules)
    ]))
    return pairs.withColumn("kind", F.explode(found))


def _pair_output(pairs: DataFrame, *ids: Column) -> DataFrame:
    kind = F.col("kind")
    w = ("windows", F.col("left_ts"), F.col("w_event_details"), F.col("w_src_ip"))
    f = ("firewall", F.col("right_ts"), F.col("f_event_details"), F.col("f_src_ip"))
    ip = F.when(kind == BYPASS, F.col("f_src_ip")).otherwise(F.col("w_src_ip"))
    techniques = (
        F.when(kind == C2, union_techniques(F.col("w_mitre_technique"), F.col("f_mitre_technique")))
        .when(kind == EXFIL, "T1003.001,T1041")
        .when(kind == LATERAL, F.concat(F.lit("T1021,"), "w_mitre_technique"))
        .otherwise("T1562.004,T1078")
    )
    description = (
        F.when(kind == C2, F.concat(
            F.lit("C2 beacon confirmed by both Sysmon and Sophos firewall: "), "w_agent_host", F.lit(" ("), "w_src_ip",
            F.lit(") → "), "f_dst_ip", F.lit(":"), "f_dst_port"))
        .when(kind == EXFIL, F.concat(
            F.lit("Credential dump on "), "w_agent_host", F.lit(" followed by "), "f_sent_bytes",
            F.lit(" bytes exfiltrated → "), "f_dst_ip"))
        .when(kind == LATERAL, F.concat(
            F.lit("Lateral movement: "), "w_src_ip", F.lit(" → "), "w_agent_host", F.lit(" (logon type "),
            "w_logon_type", F.lit(") confirmed by firewall on port "), "f_dst_port"))
        .otherwise(F.concat(
            F.lit("Firewall blocked "), "f_src_ip", F.lit(" → "), "f_dst_ip", F.lit(":"), "f_dst_port",
            F.lit(" but Windows shows successful logon from same IP on "), "w_agent_host", F.lit(" shortly after")))
    )
    more = F.when(F.col("matches") > 1, F.concat(F.lit(" (and "), F.col("matches") - 1, F.lit(" more)"))).otherwise("")
    description = F.concat(description, more)
    return pairs.select(
        incident_key(kind, F.col("w_agent_host"), ip, *ids).alias("incident_key"),
        kind.alias("incident_type"),
        F.when(kind == LATERAL, "HIGH").otherwise("CRITICAL").alias("severity"),
        F.when(kind == BYPASS, "MEDIUM").otherwise("HIGH").alias("confidence"),
        F.col("w_agent_host").alias("affected_host"),
        ip.alias("affected_ip"),
        techniques.alias("mitre_techniques"),
        description.alias("description"),
        F.when(kind == BYPASS, _evidence(f, w)).otherwise(_evidence(w, f)).alias("evidence"),
        F.least("left_ts", "right_ts").alias("window_start"),
        F.greatest("left_ts", "last_ts").alias("window_end"),
        F.lit(2).cast("bigint").alias("source_count"),
    )


def c2_beacon(endpoint: DataFrame, firewall: DataFrame, as_of=None, mode: str = "intent", salt: int = 1) -> DataFrame:
    """Suspicious connection seen by the endpoint and allowed by the firewall."""
    return pair_incidents(endpoint, firewall, [C2], as_of, mode, salt)


def credential_dump_exfil(endpoint: DataFrame, firewall: DataFrame, as_of=None, salt: int = 1) -> DataFrame:
    """Credential access followed within ten minutes by a large allowed upload."""
    return pair_incidents(endpoint, firewall, [EXFIL], as_of, salt=salt)


def lateral_movement(endpoint: DataFrame, firewall: DataFrame, as_of=None, salt: int = 1) -> DataFrame:
    """Remote logon and allowed traffic on an administration port, same source."""
    return pair_incidents(endpoint, firewall, [LATERAL], as_of, salt=salt)


def firewall_bypass(endpoint: DataFrame, firewall: DataFrame, as_of=None, salt: int = 1) -> DataFrame:
    """Blocked traffic followed strictly later, within ten minutes, by a logon."""
    return pair_incidents(endpoint, firewall, [BYPASS], as_of, salt=salt)


# ---------------------------------------------------------------------------
# Brute force: aggregate first, then join.
# ---------------------------------------------------------------------------


def failures(endpoint: DataFrame) -> DataFrame:
    """Failed logons from elsewhere."""
    return endpoint.filter((F.col("event_id") == "4625") & ~F.col("src_ip").isin(LOCAL_SOURCES))


def guessing_blocks(firewall: DataFrame) -> DataFrame:
    """Connections to logon ports that the firewall blocked."""
    return firewall.filter(
        F.col("dst_port").isin(BRUTE_FORCE_PORTS) & F.upper("action").isin(BLOCKED) & ~F.col("src_ip").isin(LOCAL_SOURCES)
    )


def failure_bursts(endpoint: DataFrame, minimum: int = MIN_FAILURES, window: int = WINDOW_SECONDS) -> DataFrame:
    """Bursts of failed logons per source over the whole table.

    A burst row has ``minimum`` failures in the ``window`` seconds up to it;
    burst rows less than ``window`` apart belong together.  Failures are first
    counted per (source, instant); a sweep over short cells then counts what
    lies before each instant, so no task sorts a source's whole history or even
    one whole window of it.  Only one row per window-wide cell reaches the
    step that chains cells.
    """
    width = window * 1_000_000
    instants = (
        failures(endpoint)
        .groupBy("src_ip", micros("ts").alias("us"))
        .agg(F.count("*").alias("n"), F.min_by("agent_host", "id").alias("host"))
    )
    cell = whole_division(F.col("us"), width)
    probes = instants.select("src_ip", F.struct("src_ip", "us").alias("probe"), F.lit(0).alias("told"), "n",
                             (F.col("us") - width).alias("low"), F.col("us").alias("high"))
    recent = within_reach(probes, None, ["src_ip"])
    hot = recent.filter(F.col("n") >= minimum).select("probe.*", F.col("first_us").alias("since"))
    cells = hot.groupBy("src_ip", cell.alias("cell")).agg(
        F.min("us").alias("start"), F.max("us").alias("end"), F.min("since").alias("since")
    )
    ordered = Window.partitionBy("src_ip").orderBy("cell")
    fresh = F.coalesce((F.col("start") - F.lag("end").over(ordered)) >= width, F.lit(True))
    islands = (
        cells.withColumn("fresh", fresh.cast("int"))
        .withColumn("island", F.sum("fresh").over(ordered))
        .groupBy("src_ip", "island")
        .agg(F.min("since").alias("first_us"), F.max("end").alias("last_us"))
    )
    spans = islands.withColumn(
        "cell", F.explode(F.sequence(whole_division(F.col("first_us"), width), whole_division(F.col("last_us"), width)))
    )
    return (
        instants.withColumn("cell", cell)
        .join(spans, ["src_ip", "cell"])
        .filter(F.col("us").between(F.col("first_us"), F.col("last_us")))
        .groupBy("src_ip", "first_us", "last_us")
        .agg(F.sum("n").alias("failures"), F.min_by("host", "us").alias("host"))
    )


def _brute_force_incidents(groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """``groups``: src_ip, host, failures, first_us, last_us."""
    reach = WINDOW_SECONDS * 1_000_000
    probes = groups.select(
        F.col("src_ip").alias("key"), F.struct(F.col("src_ip").alias("key"), "first_us").alias("probe"),
        F.struct("host", "failures", "last_us").alias("told"), (F.col("first_us") - reach).alias("low"), (F.col("first_us") + reach).alias("high"))
    points = blocks.groupBy(F.col("src_ip").alias("key"), micros("ts").alias("us")).agg(F.count("*").alias("n"))
    hits = within_reach(probes, points.withColumn("told", F.lit(0)), ["key"]).select(
        "probe.*", "told.*", F.col("n").alias("blocks"), F.col("first_us").alias("f_min"), F.col("last_us").alias("f_max"))
    return burst_incidents(hits)


def burst_incidents(hits: DataFrame) -> DataFrame:
    """Incidents of confirmed bursts: key, host, failures, first_us, last_us, blocks, f_min, f_max."""
    host = F.coalesce(F.nullif("host", F.lit("")), F.concat(F.lit("host@"), "key"))
    return hits.select(
        incident_key(F.lit("BRUTE_FORCE_CONFIRMED"), F.col("key"), F.col("first_us")).alias("incident_key"),
        F.lit("BRUTE_FORCE_CONFIRMED").alias("incident_type"),
        F.lit("HIGH").alias("severity"),
        F.lit("HIGH").alias("confidence"),
        host.alias("affected_host"),
        F.col("key").alias("affected_ip"),
        F.lit("T1110,T1110.001").alias("mitre_techniques"),
        F.concat(F.lit("Brute force confirmed: "), "key", F.lit(" caused "), F.col("failures").cast("string"),
                 F.lit(" Windows logon failures + "), F.col("blocks").cast("string"), F.lit(" firewall blocks"))
        .alias("description"),
        F.to_json(F.struct(F.col("failures"), F.col("blocks"))).alias("evidence"),
        F.timestamp_micros(F.least("first_us", "f_min")).alias("window_start"),
        F.timestamp_micros(F.greatest("last_us", "f_max")).alias("window_end"),
        F.lit(2).cast("bigint").alias("source_count"),
    )


def brute_force(endpoint: DataFrame, firewall: DataFrame, as_of=None) -> DataFrame:
    """Failed logons of one source that the firewall blocks as well.

    The evidence column holds the two counts; the rows themselves, which may be
    very many, are given by :func:`brute_force_evidence`.
    """
    if as_of is None:
        return _brute_force_incidents(failure_bursts(endpoint), guessing_blocks(firewall))
    w, f = _between(endpoint, as_of), _between(firewall, as_of)
    order = F.struct(micros("ts"), F.col("id"))
    groups = (
        failures(w).groupBy("src_ip")
        .agg(F.count("*").alias("failures"), F.min(micros("ts")).alias("first_us"), F.max(micros("ts")).alias("last_us"))
        .filter(F.col("failures") >= MIN_FAILURES)
    )
    hosts = (
        w.select(F.explode(F.array_distinct(F.array("src_ip", "dst_ip"))).alias("src_ip"), "agent_host", "ts", "id")
        .filter(F.col("src_ip") != "")
        .groupBy("src_ip").agg(F.min_by("agent_host", order).alias("host"))
    )
    return _brute_force_incidents(groups.join(hosts, "src_ip", "left"), guessing_blocks(f))


def brute_force_evidence(endpoint: DataFrame, firewall: DataFrame) -> DataFrame:
    """The rows behind each whole-table brute-force incident, one per line."""
    width = WINDOW_SECONDS * 1_000_000
    bursts = failure_bursts(endpoint)
    key = incident_key(F.lit("BRUTE_FORCE_CONFIRMED"), F.col("src_ip"), F.col("first_us")).alias("incident_key")
    spans = bursts.select(
        key, F.col("src_ip"), "first_us", "last_us",
        F.explode(F.sequence(whole_division(F.col("first_us"), width), whole_division(F.col("last_us"), width))).alias("cell"),
    )
    failed = (
        failures(endpoint).withColumn("cell", bucket("ts", WINDOW_SECONDS)).join(spans, ["src_ip", "cell"])
        .filter(micros("ts").between(F.col("first_us"), F.col("last_us")))
        .select("incident_key", "source", "id", "ts", "event_details")
    )
    left = bursts.select(key, F.col("src_ip").alias("key"), F.timestamp_micros("first_us").alias("ts"))
    right = guessing_blocks(firewall).select(F.col("src_ip").alias("key"), "ts", "source", "id", "event_details")
    blocked = interval_join(left, right, WINDOW_SECONDS, WINDOW_SECONDS).select(
        "incident_key", "source", "id", F.col("right_ts").alias("ts"), "event_details"
    )
    confirmed = blocked.select("incident_key").distinct()
    return failed.join(confirmed, "incident_key", "left_semi").unionByName(blocked)


def correlate_all(endpoint: DataFrame, firewall: DataFrame, as_of=None, mode: str = "intent", salt: int = 1) -> DataFrame:
    """All five rules; inputs in the common shape of ``operators.projections``."""
    return (
        pair_incidents(endpoint, firewall, None, as_of, mode, salt)
        .unionByName(brute_force(endpoint, firewall, as_of))
        .select(*INCIDENT_COLUMNS)
    )


def last_seen_address(events: DataFrame, width: int = 3600) -> DataFrame:
    """Fill an empty ``src_ip`` with the address last seen on the same host.

    An as-of lookup in two steps: inside (host, bucket) by a running last
    value, across buckets by the last address of each earlier bucket.
    """
    known = F.nullif("src_ip", F.lit(""))
    e = events.withColumn("__cell", bucket("ts", width))
    ends = e.groupBy("agent_host", "__cell").agg(
        F.max_by(known, F.when(known.isNotNull(), F.struct(micros("ts"), F.col("id")))).alias("__end")
    )
    earlier = Window.partitionBy("agent_host").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("__carried", F.last("__end", ignorenulls=True).over(earlier)).drop("__end")
    inside = Window.partitionBy("agent_host", "__cell").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    return (
        e.join(carried, ["agent_host", "__cell"])
        .withColumn("src_ip", F.coalesce(F.last(known, ignorenulls=True).over(inside), "__carried", F.lit("")))
        .select(*events.columns)
    )


def new_incidents(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Incidents not in the target yet, each key once."""
    return found.dropDuplicates(["incident_key"]).join(stored.select("incident_key"), "incident_key", "left_anti")
