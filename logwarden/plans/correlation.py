"""Cross-source correlation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from logwarden.functions.times import micros
from logwarden.operators import correlate as C
from logwarden.operators import projections as P
from logwarden.plans import views as V
from logwarden.plans.catalog import query
from logwarden.plans.detection import firewall_verdicts, security_verdicts
from logwarden.plans.sqltext import EVENTS, evidence, key
from logwarden.streaming.bursts import brute_force_stream
from logwarden.streaming.replay import replay

BOTH = V.with_views(V.SQL_SECURITY, V.SQL_FIREWALL, V.SQL_FIREWALL_VERDICT, EVENTS)
MIN10 = 600_000_000


def sides(spark, sf):
    return P.endpoint_events(security_verdicts(spark, sf)), P.firewall_events(firewall_verdicts(spark, sf))


def flat(incidents):
    return incidents.select(
        *[c for c in C.INCIDENT_COLUMNS if c not in ("window_start", "window_end")],
        micros("window_start").alias("start_us"),
        micros("window_end").alias("end_us"),
    )


def _pair_sql(kind, severity, confidence, techniques, description, *conditions, ip="w.src_ip", firewall_first=False):
    """One incident for each endpoint row: ``f`` is the first firewall row that matches, ``n`` counts them."""
    w = ("windows", "w.us", "w.event_details", "w.src_ip")
    f = ("firewall", "f.us", "f.event_details", "f.src_ip")
    ev = evidence(*((f, w) if firewall_first else (w, f)))
    pairs = " UNION ALL ".join(f"SELECT w, f FROM w, f WHERE {c}" for c in conditions)
    return f"""
SELECT {key(f"'{kind}'", "w.agent_host", ip, "w.id")} AS incident_key, '{kind}' AS incident_type,
       '{severity}' AS severity, '{confidence}' AS confidence, w.agent_host AS affected_host, {ip} AS affected_ip,
       {techniques} AS mitre_techniques, {description} || CASE WHEN n > 1 THEN ' (and ' || (n - 1) || ' more)' ELSE '' END AS description,
       {ev} AS evidence, CAST(2 AS BIGINT) AS source_count, least(w.us, f.us) AS start_us, greatest(w.us, last_us) AS end_us
FROM (SELECT any_value(w) AS w, arg_min(f, (f.us, f.id)) AS f, count(*) AS n, max(f.us) AS last_us FROM ({pairs}) GROUP BY w.id)"""


# ADDRESS_OR_HOST: one equality per half keeps the SQL twin a hash join.
_C2_COMMON = f"""(w.mitre_technique LIKE '%T1571%' OR w.mitre_technique LIKE '%T1071%') AND w.dst_ip <> ''
  AND (f.dst_port IN ('4444','5555','6666','7777','1337','31337','9001','9030') OR f.dst_ip = w.dst_ip)
  AND abs(w.us - f.us) <= {MIN10} AND upper(f.action) = 'ALLOW' AND f.src_ip <> ''"""


def _c2_sql():
    techniques = """(SELECT string_agg(t, ',' ORDER BY p) FROM (
        SELECT trim(t) AS t, min(p) AS p FROM (
          SELECT unnest(string_split(w.mitre_technique || ',' || f.mitre_technique, ',')) AS t,
                 generate_subscripts(string_split(w.mitre_technique || ',' || f.mitre_technique, ','), 1) AS p)
        WHERE trim(t) <> '' GROUP BY 1))"""
    description = ("'C2 beacon confirmed by both Sysmon and Sophos firewall: ' || w.agent_host || ' (' || w.src_ip || ') → ' "
                   "|| f.dst_ip || ':' || f.dst_port")
    args = ("C2_BEACON_CONFIRMED", "CRITICAL", "HIGH", techniques, description)
    return _pair_sql(
        *args, "f.src_ip = w.src_ip AND " + _C2_COMMON, "f.src_ip = w.agent_host AND f.src_ip <> w.src_ip AND " + _C2_COMMON
    )


C2_SQL = _c2_sql()
DUMP_SQL = _pair_sql(
    "CRED_DUMP_THEN_EXFIL", "CRITICAL", "HIGH", "'T1003.001,T1041'",
    "'Credential dump on ' || w.agent_host || ' followed by ' || f.sent_bytes || ' bytes exfiltrated → ' || f.dst_ip",
    f"""f.src_ip = w.src_ip AND w.mitre_technique LIKE '%T1003%' AND w.src_ip <> '' AND f.us >= w.us
  AND f.us - w.us <= {MIN10} AND coalesce(TRY_CAST(f.sent_bytes AS BIGINT), 0) >= 10000000 AND upper(f.action) = 'ALLOW'""",
)
LATERAL_SQL = _pair_sql(
    "LATERAL_MOVEMENT_CONFIRMED", "HIGH", "HIGH", "'T1021,' || w.mitre_technique",
    "'Lateral movement: ' || w.src_ip || ' → ' || w.agent_host || ' (logon type ' || w.logon_type || ') confirmed by "
    "firewall on port ' || f.dst_port",
    f"""f.src_ip = w.src_ip AND w.event_id = '4624' AND w.logon_type IN ('3','10') AND w.src_ip NOT IN ('','127.0.0.1','-')
  AND f.dst_port IN ('445','3389','5985','5986','22') AND upper(f.action) = 'ALLOW' AND abs(w.us - f.us) <= {MIN10}""",
)
BYPASS_SQL = _pair_sql(
    "FIREWALL_BYPASS_SUSPECTED", "CRITICAL", "MEDIUM", "'T1562.004,T1078'",
    "'Firewall blocked ' || f.src_ip || ' → ' || f.dst_ip || ':' || f.dst_port || ' but Windows shows successful logon "
    "from same IP on ' || w.agent_host || ' shortly after'",
    f"""f.src_ip = w.src_ip AND upper(f.action) IN ('DROP','DENY','REJECT') AND f.src_ip <> '' AND w.event_id = '4624'
  AND w.us > f.us AND w.us - f.us <= {MIN10}""",
    ip="f.src_ip", firewall_first=True,
)
BURST_CTE = f"""
fail AS (SELECT id, us, src_ip, agent_host FROM w WHERE event_id = '4625' AND src_ip NOT IN ('','127.0.0.1','-')),
fail2 AS (
  SELECT *, count(*) OVER r AS recent, min(us) OVER r AS since FROM fail
  WINDOW r AS (PARTITION BY src_ip ORDER BY us RANGE BETWEEN {MIN10} PRECEDING AND CURRENT ROW)
),
hot AS (SELECT *, us - lag(us) OVER (PARTITION BY src_ip ORDER BY us, id) AS gap FROM fail2 WHERE recent >= 5),
isl AS (
  SELECT *, sum(CASE WHEN gap IS NULL OR gap >= {MIN10} THEN 1 ELSE 0 END) OVER (PARTITION BY src_ip ORDER BY us, id) AS island
  FROM hot
),
burst0 AS (SELECT src_ip, min(since) AS first_us, max(us) AS last_us FROM isl GROUP BY src_ip, island),
burst AS (
  SELECT b.src_ip, b.first_us, b.last_us, count(*) AS failures, arg_min(fail.agent_host, (fail.us, fail.id)) AS host
  FROM burst0 b JOIN fail ON fail.src_ip = b.src_ip AND fail.us BETWEEN b.first_us AND b.last_us GROUP BY ALL
),
block AS (
  SELECT id, us, src_ip, event_details FROM f WHERE dst_port IN ('3389','445','22','5985')
  AND upper(action) IN ('DROP','DENY','REJECT')
),
brute AS (
  SELECT b.*, count(*) AS blocks, min(k.us) AS f_min, max(k.us) AS f_max
  FROM burst b JOIN block k ON k.src_ip = b.src_ip AND abs(k.us - b.first_us) <= {MIN10} GROUP BY ALL
)"""
BRUTE_SQL = f"""
SELECT {key("'BRUTE_FORCE_CONFIRMED'", "src_ip", "first_us")} AS incident_key, 'BRUTE_FORCE_CONFIRMED' AS incident_type,
       'HIGH' AS severity, 'HIGH' AS confidence, host AS affected_host, src_ip AS affected_ip,
       'T1110,T1110.001' AS mitre_techniques,
       'Brute force confirmed: ' || src_ip || ' caused ' || failures || ' Windows logon failures + ' || blocks || ' firewall blocks' AS description,
       '{{"failures":' || failures || ',"blocks":' || blocks || '}}' AS evidence, CAST(2 AS BIGINT) AS source_count,
       least(first_us, f_min) AS start_us, greatest(last_us, f_max) AS end_us
FROM brute"""


@query("correlate_c2_beacon", BOTH + C2_SQL)
def correlate_c2_beacon(spark, sf):
    return flat(C.c2_beacon(*sides(spark, sf)))


@query("correlate_brute_force", BOTH + "," + BURST_CTE + BRUTE_SQL)
def correlate_brute_force(spark, sf):
    return flat(C.brute_force(*sides(spark, sf)))


def _after_all(rows):
    """One of ``rows`` a day later, under an address of its own: it moves the watermark past all others."""
    latest = rows.agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct("ts", "id")).alias("r"))
    return latest.where(F.col("r").isNotNull()).select("r.*").withColumns(
        {"ts": F.col("ts") + F.expr("INTERVAL 1 DAY"), "src_ip": F.lit("replay-end")})


@query("correlate_brute_force_stream", BOTH + "," + BURST_CTE + BRUTE_SQL)
def correlate_brute_force_stream(spark, sf):
    w, f = sides(spark, sf)
    w, f = C.failures(w), C.guessing_blocks(f)
    columns = ["id", "ts", "event_id", "src_ip", "dst_port", "agent_host", "action"]
    tables = {"endpoint": w.select(*[c for c in columns if c in w.columns]), "firewall": f.select(*[c for c in columns if c in f.columns])}
    return flat(replay(spark, tables, brute_force_stream, closing=dict.fromkeys(tables, _after_all)))


@query("correlate_brute_force_evidence", BOTH + "," + BURST_CTE + f"""
SELECT {key("'BRUTE_FORCE_CONFIRMED'", "b.src_ip", "b.first_us")} AS incident_key, 'windows' AS source, e.id, e.us, w.event_details
FROM brute b JOIN fail e ON e.src_ip = b.src_ip AND e.us BETWEEN b.first_us AND b.last_us JOIN w ON w.id = e.id
UNION ALL
SELECT {key("'BRUTE_FORCE_CONFIRMED'", "b.src_ip", "b.first_us")}, 'firewall', k.id, k.us, k.event_details
FROM brute b JOIN block k ON k.src_ip = b.src_ip AND abs(k.us - b.first_us) <= {MIN10}""")
def correlate_brute_force_evidence(spark, sf):
    return C.brute_force_evidence(*sides(spark, sf)).withColumn("us", micros("ts")).drop("ts")


@query("correlate_credential_dump_exfil", BOTH + DUMP_SQL)
def correlate_credential_dump(spark, sf):
    return flat(C.credential_dump_exfil(*sides(spark, sf)))


@query("correlate_lateral_movement", BOTH + LATERAL_SQL)
def correlate_lateral(spark, sf):
    return flat(C.lateral_movement(*sides(spark, sf)))


@query("correlate_firewall_bypass", BOTH + BYPASS_SQL)
def correlate_bypass(spark, sf):
    return flat(C.firewall_bypass(*sides(spark, sf)))


ALL_SQL = " UNION ALL ".join([C2_SQL, BRUTE_SQL, DUMP_SQL, LATERAL_SQL, BYPASS_SQL])


@query("correlate_all", BOTH + "," + BURST_CTE + ALL_SQL)
def correlate_all(spark, sf):
    return flat(C.correlate_all(*sides(spark, sf)))


@query("correlate_incident_summary", BOTH + "," + BURST_CTE + f""", inc AS ({ALL_SQL})
SELECT incident_type, severity, affected_ip, count(*) AS incidents, count(DISTINCT affected_host) AS hosts,
       min(start_us) AS first_us, max(end_us) AS last_us FROM inc GROUP BY ALL""")
def incident_summary(spark, sf):
    return C.correlate_all(*sides(spark, sf)).groupBy("incident_type", "severity", "affected_ip").agg(
        F.count("*").alias("incidents"), F.countDistinct("affected_host").alias("hosts"),
        F.min(micros("window_start")).alias("first_us"), F.max(micros("window_end")).alias("last_us"),
    )


_AS_OF = V.BASE_SECONDS + 6 * 3600


@query("correlate_single_pass", BOTH.replace("FROM sec WHERE", f"FROM sec WHERE us BETWEEN {(_AS_OF - 600) * 1_000_000} AND {_AS_OF * 1_000_000} AND")
       .replace("FROM fwv WHERE", f"FROM fwv WHERE us BETWEEN {(_AS_OF - 600) * 1_000_000} AND {_AS_OF * 1_000_000} AND")
       + f""", fail AS (SELECT src_ip, count(*) AS failures, min(us) AS first_us, max(us) AS last_us FROM w
  WHERE event_id = '4625' AND src_ip NOT IN ('','127.0.0.1','-') GROUP BY 1 HAVING count(*) >= 5),
block AS (SELECT us, src_ip FROM f WHERE dst_port IN ('3389','445','22','5985') AND upper(action) IN ('DROP','DENY','REJECT')),
brute AS (
  SELECT b.*, (SELECT arg_min(w.agent_host, (w.us, w.id)) FROM w WHERE w.src_ip = b.src_ip OR w.dst_ip = b.src_ip) AS host,
         count(*) AS blocks, min(k.us) AS f_min, max(k.us) AS f_max
  FROM fail b JOIN block k ON k.src_ip = b.src_ip AND abs(k.us - b.first_us) <= {MIN10} GROUP BY ALL
)""" + ALL_SQL)
def correlate_single_pass(spark, sf):
    import datetime as dt

    as_of = dt.datetime.fromtimestamp(_AS_OF, dt.timezone.utc)
    return flat(C.correlate_all(*sides(spark, sf), as_of=as_of))


@query("events_by_ip", BOTH + """, u AS (
  SELECT 'windows' AS source, id, us, src_ip, dst_ip, severity FROM w UNION ALL
  SELECT 'firewall', id, us, src_ip, dst_ip, severity FROM f),
x AS (SELECT src_ip AS ip, * FROM u WHERE src_ip <> '' UNION ALL SELECT dst_ip, * FROM u WHERE dst_ip <> '' AND dst_ip <> src_ip)
SELECT ip, count(*) AS events, count(DISTINCT source) AS sources, min(us) AS first_us, max(us) AS last_us,
       CASE max(CASE severity WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 2 ELSE 1 END)
         WHEN 5 THEN 'CRITICAL' WHEN 4 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' ELSE 'LOW' END AS top
FROM x GROUP BY ip""")
def events_by_ip(spark, sf):
    w, f = sides(spark, sf)
    return P.events_by_ip(w.unionByName(f)).groupBy("ip").agg(
        F.count("*").alias("events"), F.countDistinct("source").alias("sources"),
        F.min(micros("ts")).alias("first_us"), F.max(micros("ts")).alias("last_us"),
        P.highest_severity(F.col("severity")).alias("top"),
    )


@query("address_last_seen", BOTH + """, e AS (
  SELECT id, us, agent_host, CASE WHEN id % 4 = 0 THEN src_ip ELSE '' END AS src_ip FROM w)
SELECT id, agent_host, coalesce(last_value(nullif(src_ip, '') IGNORE NULLS) OVER (
  PARTITION BY agent_host ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS src_ip FROM e""")
def address_last_seen(spark, sf):
    w, _ = sides(spark, sf)
    e = w.withColumn("src_ip", F.when(F.col("id") % 4 == 0, F.col("src_ip")).otherwise(""))
    return C.last_seen_address(e).select("id", "agent_host", "src_ip")
