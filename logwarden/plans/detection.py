"""Verdict queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from logwarden.functions.times import micros
from logwarden.operators.endpoint import detect_endpoint
from logwarden.operators.firewall import detect_firewall
from logwarden.plans import views as V
from logwarden.plans.catalog import query


def security_verdicts(spark, sf):
    return detect_endpoint(V.security(spark, sf))


def firewall_verdicts(spark, sf):
    return detect_firewall(V.firewall(spark, sf))


SEC = V.with_views(V.SQL_SECURITY)
FWV = V.with_views(V.SQL_FIREWALL, V.SQL_FIREWALL_VERDICT)


@query("endpoint_verdicts", SEC + """
SELECT id, us, rule_id, severity, mitre_technique, detection_module, event_details FROM sec""")
def endpoint_verdicts(spark, sf):
    return security_verdicts(spark, sf).select(
        "id", micros("ts").alias("us"), "rule_id", "severity", "mitre_technique", "detection_module", "event_details"
    )


@query("endpoint_verdict_summary", SEC + """
SELECT rule_id, severity, mitre_technique, detection_module, count(*) AS hits, count(DISTINCT computer_0) AS hosts
FROM sec GROUP BY ALL""")
def endpoint_verdict_summary(spark, sf):
    return security_verdicts(spark, sf).groupBy("rule_id", "severity", "mitre_technique", "detection_module").agg(
        F.count("*").alias("hits"), F.countDistinct("computer_0").alias("hosts")
    )


@query("firewall_verdicts", FWV + """
SELECT id, us, threat_level, threat_type, mitre_technique, detection_module, event_details FROM fwv""")
def firewall_verdicts_query(spark, sf):
    return firewall_verdicts(spark, sf).select(
        "id", micros("ts").alias("us"), "threat_level", "threat_type", "mitre_technique", "detection_module",
        "event_details",
    )
