"""Endpoint verdicts: one rule per row, first match wins.

The whole rule set is one ordered expression that yields the number of the
matching rule; severity, technique and the other attributes are then read from
constant arrays by that number.  No join, no shuffle, no Python, and the same
expression runs on a stream.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.functions.text import computed_once, field, has, pick
from logwarden.operators import endpoint_rules as R

_POSITION = {rule.rule_id: i + 1 for i, rule in enumerate(R.ALL_RULES)}

# Which rule groups an event id is tested with, in order.
SYSMON_EVENTS = [
    (["1"], [
        R.PROCESS_CREATION, R.COLLECTION_PROCESS, R.DISCOVERY, R.CREDENTIAL_ACCESS, R.LATERAL_MOVEMENT,
        R.COMMAND_AND_CONTROL, R.EXFILTRATION, R.IMPACT, R.PRIVILEGE_ESCALATION, R.EXECUTION, R.INITIAL_ACCESS,
    ]),
    (["3"], [R.NETWORK_CONNECTION]),
    (["7"], [R.IMAGE_LOAD, R.COLLECTION_IMAGE]),
    (["8"], [R.REMOTE_THREAD]),
    (["10"], [R.PROCESS_ACCESS]),
    (["11"], [R.FILE_CREATE, R.COLLECTION_FILE]),
    (["12", "13", "14"], [R.REGISTRY]),
    (["17", "18"], [R.PIPE]),
    (["22"], [R.DNS_QUERY, R.COMMAND_AND_CONTROL]),
    (["23"], [R.FILE_DELETE, R.IMPACT]),
]
SECURITY_EVENTS = [
    (["4624"], [R.LOGON_SUCCESS]),
    (["4625"], [R.LOGON_FAILURE]),
    (["4648"], [R.EXPLICIT_CREDENTIALS]),
    (["4672"], [R.PRIVILEGE_ASSIGNMENT]),
    (["4688"], [R.PROCESS_CREATED_AUDIT]),
    (["4697"], [R.SERVICE_INSTALL_AUDIT]),
    (["4698", "4702"], [R.SCHEDULED_TASK]),
    (["4720"], [R.USER_CREATED]),
    (["4732"], [R.GROUP_MEMBERSHIP]),
    (["4768"], [R.KERBEROS_TGT]),
    (["4769"], [R.KERBEROS_SERVICE]),
    (["4776"], [R.NTLM]),
    (["4778", "4779"], [R.RDP_SESSION]),
    (["5140"], [R.SHARE_ACCESS]),
]
SYSTEM_EVENTS = [
    (["7045"], [R.SERVICE_INSTALL]),
    (["7036"], [R.SERVICE_STATE]),
    (["104"], [R.LOG_CLEARED]),
]

# Event column behind each name used in the rules, and whether
# the rules look at it in lower case.
_INPUTS = {
    "source": ("logsource_5", True),
    "event_id": ("eventid_0", False),
    "image": ("image_2", True),
    "cmd": ("commandline_2", True),
    "parent_image": ("parentimage_2", True),
    "target_filename": ("targetfilename_2", True),
    "target_object": ("targetobject_2", True),
    "target_image": ("targetimage_2", True),
    "source_image": ("sourceimage_2", True),
    "image_loaded": ("imageloaded_2", True),
    "pipe": ("pipename_2", True),
    "query": ("queryname_2", True),
    "service_file": ("servicefilename_3", True),
    "new_process": ("newprocessname_3", True),
    "dest_port": ("destinationport_2", False),
    "dest_ip": ("destinationip_2", False),
    "granted_access": ("grantedaccess_2", False),
    "signed": ("signed_2", False),
    "signature_status": ("signaturestatus_2", False),
    "logon_type": ("logontype_3", False),
    "target_user": ("targetusername_3", False),
    "subject_user": ("subjectusername_3", False),
    "ip_address": ("ipaddress_3", False),
    "service_name": ("servicename_3", False),
    "task_name": ("taskname_3", False),
    "ticket_encryption": ("ticketencryptiontype_3", False),
    "client_name": ("clientname_3", False),
    "channel": ("channel_0", False),
}

VERDICT_COLUMNS = ["rule_id", "severity", "mitre_technique", "detection_module", "event_details", "additional_context"]
_WORK = "__ep_"


def _first_rule(groups, e) -> Column:
    chain = None
    for group in groups:
        for rule in group:
            number, test = F.lit(_POSITION[rule.rule_id]), rule.test(e)
            chain = F.when(test, number) if chain is None else chain.when(test, number)
    return chain.otherwise(F.lit(0))


def _by_event(table, e) -> Column:
    """Number of the first matching rule, 0 for none, NULL for other event ids."""
    chain = None
    for ids, groups in table:
        here = e.event_id == ids[0] if len(ids) == 1 else e.event_id.isin(ids)
        number = _first_rule(groups, e)
        chain = F.when(here, number) if chain is None else chain.when(here, number)
    return chain


def rule_number(e) -> Column:
    """The three source blocks run in sequence and a later one that knows the
    event id replaces the verdict of an earlier one, except that the sysmon
    events which are tested in several steps return at once on a hit."""
    sysmon = F.when(has(e.source, "sysmon"), _by_event(SYSMON_EVENTS, e))
    security = F.when(has(e.source, "security"), _by_event(SECURITY_EVENTS, e))
    system = F.when(has(e.source, "system"), _by_event(SYSTEM_EVENTS, e))
    # No event id belongs to two blocks, so at most one of them is not NULL.
    return F.coalesce(sysmon, security, system, F.lit(0))


def detect_endpoint(df: DataFrame, mode: str = "reference") -> DataFrame:
    """Add the verdict columns to endpoint events (lower-case field names).

    Absent input columns count as empty.  ``mode="intent"`` also lets the
    upper-case alternatives of the rule patterns match.
    """
    base = [c for c in df.columns if c not in VERDICT_COLUMNS]
    # Lower-casing once per row, in its own projection: Spark keeps it apart
    # because the results are used many times below.
    staged = df.select(
        *base,
        *[
            (F.lower(field(df, name)) if lower else field(df, name)).alias(_WORK + key)
            for key, (name, lower) in _INPUTS.items()
        ],
    )
    number, verdict = _expressions(mode)
    return computed_once(staged.withColumn(_WORK + "n", number), _WORK + "n").select(*base, *verdict)


_BUILT: dict = {}


def _expressions(mode: str) -> tuple[Column, list[Column]]:
    """Rule number and verdict columns.  They refer to columns by name only, so
    they are built once per JVM connection: some thousand calls otherwise."""
    key = (id(SparkContext._gateway), mode)
    if key not in _BUILT:
        e = SimpleNamespace(mode=mode, **{key: F.col(_WORK + key) for key in _INPUTS})
        _BUILT[key] = (rule_number(e), _verdict(F.col(_WORK + "n"), e))
    return _BUILT[key]


def _verdict(n: Column, e) -> list[Column]:
    def constant(attribute: str, default: str) -> Column:
        values = [getattr(r, attribute) for r in R.ALL_RULES]
        return pick([default] + [v if isinstance(v, str) else "" for v in values], n + 1)

    def computed(attribute: str) -> Column:
        chain = None
        for r in R.ALL_RULES:
            value = getattr(r, attribute)
            if not isinstance(value, str):
                hit = n == _POSITION[r.rule_id]
                chain = F.when(hit, value(e)) if chain is None else chain.when(hit, value(e))
        return chain.otherwise(constant(attribute, ""))

    return [
        constant("rule_id", "").alias("rule_id"),
        constant("severity", "INFO").alias("severity"),
        constant("technique", "").alias("mitre_technique"),
        constant("module", "").alias("detection_module"),
        computed("details").alias("event_details"),
        computed("context").alias("additional_context"),
    ]
