"""JSON payloads and text lines to event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from logwarden import schemas as S
from logwarden.functions.text import computed_once, first_filled, named_once, nz, strip
from logwarden.functions.times import as_timestamp, parse_event_time, parse_iso, parse_scada_time


def _events(value: Column, wire: StructType) -> Column:
    """A JSON array of objects, else one object, else NULL."""
    def read(text: Column) -> Column:
        many = F.when(text.startswith("["), F.from_json(text, ArrayType(wire)))
        one = F.when(text.startswith("{"), F.array(F.from_json(text, wire)))
        return F.when(F.try_parse_json(text).isNotNull(), F.coalesce(many, one))

    return named_once(strip(value), read)


def split_payloads(df: DataFrame, wire: StructType, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows with column ``event``, rejected payloads).  Unknown keys are dropped."""
    staged = computed_once(df.withColumn("__events", _events(F.col(value), wire)), "__events")
    rejected = staged.filter(F.col("__events").isNull()).drop("__events")
    rows = staged.filter(F.col("__events").isNotNull())
    kept = [c for c in df.columns if c != value]
    return rows.select(*kept, F.explode("__events").alias("event")), rejected


def endpoint_events(df: DataFrame, value: str = "value", ingest: str = "ingest_ts") -> DataFrame:
    """Endpoint events of JSON payloads with ``event_time``."""
    rows, _ = split_payloads(df, S.ENDPOINT_WIRE, value)
    kept = [c for c in rows.columns if c != "event"]
    flat = rows.select(*kept, *[F.col(f"event.{n}").alias(n.lower()) for n in S.ENDPOINT_WIRE_NAMES])
    return flat.withColumn("event_time", parse_event_time(F.col("timecreated_0"), F.col("timestamp"), F.col(ingest)))


def firewall_events(df: DataFrame, value: str = "value", ingest: str = "ingest_ts") -> DataFrame:
    """Firewall events of JSON payloads; the receive time defaults to ingest."""
    wire = StructType([StructField("received_at", StringType()), *[StructField(n, StringType()) for n in S.FIREWALL_NAMES]])
    rows, _ = split_payloads(df, wire, value)
    kept = [c for c in rows.columns if c != "event"]
    received = F.coalesce(parse_iso(nz("event.received_at")), as_timestamp(ingest))
    return rows.select(*kept, received.alias("received_at"), *[F.col(f"event.{n}").alias(n) for n in S.FIREWALL_NAMES])


SCADA_REQUIRED = ["timestamp", "tag", "name", "message"]


def scada_events(df: DataFrame, value: str = "value", ingest: str = "ingest_ts", payload_id: str | None = None) -> DataFrame:
    """SCADA events of JSON payloads.

    With ``payload_id`` the strict rule applies: a payload in which any event
    misses a required field is dropped as a whole.
    """
    wire = StructType([StructField("received_at", StringType()), *[StructField(n, StringType()) for n in S.SCADA_NAMES]])
    staged = df
    if payload_id is not None:
        complete = F.forall(_events(F.col(value), wire), lambda e: _all_filled(e))
        staged = df.filter(F.coalesce(complete, F.lit(False)))
    rows, _ = split_payloads(staged, wire, value)
    kept = [c for c in rows.columns if c != "event"]
    received = F.coalesce(parse_iso(nz("event.received_at")), as_timestamp(ingest))
    flat = rows.select(
        *kept, received.alias("received_at"), first_filled("event.source", default="Unknown_SCADA").alias("source"),
        *[F.col(f"event.{n}").alias(n) for n in S.SCADA_NAMES if n != "source"],
    )
    return flat.withColumn("event_time", parse_scada_time(nz("timestamp"), F.col("received_at")))


def _all_filled(event: Column) -> Column:
    test = F.lit(True)
    for name in SCADA_REQUIRED:
        test = test & (strip(nz(event[name])) != "")
    return test


def standardized_logs(df: DataFrame, value: str = "value", ingest: str = "ingest_ts", mode: str = "reference") -> DataFrame:
    """Standardized logs of JSON messages.

    The source system is taken from the key ``source``, which parsers do not
    write; ``mode="intent"`` takes ``source_system``.
    """
    names = ["timestamp", "source", "user", *[n for n in S.STANDARD_NAMES if n != "additional_fields"], "additional_fields"]
    wire = StructType([StructField(n, StringType()) for n in names])
    rows, _ = split_payloads(df, wire, value)
    kept = [c for c in rows.columns if c != "event"]
    system = "event.source" if mode == "reference" else "event.source_system"

    def column(name: str) -> Column:
        if name in S.STANDARD_INTS:
            return F.col(f"event.{name}").try_cast("int").alias(name)
        if name in ("source_type", "parser_id"):
            return F.coalesce(f"event.{name}", F.lit("unknown")).alias(name)
        if name == "source_system":
            return F.coalesce(system, F.lit("unknown")).alias(name)
        if name == "username":
            return F.coalesce("event.user", "event.username").alias(name)
        return F.col(f"event.{name}").alias(name)

    stamp = F.coalesce(F.regexp_replace(nz("event.timestamp"), "T", " ").try_cast("timestamp"), as_timestamp(ingest))
    return rows.select(*kept, stamp.alias("timestamp"), *[column(n) for n in S.STANDARD_NAMES], as_timestamp(ingest).alias("ingested_at"))


# ---------------------------------------------------------------------------
# Windows event XML
# ---------------------------------------------------------------------------

# Normalized name -> event data name.
ALIASES = {
    "process_id": "ProcessId", "process_name": "Image", "command_line": "CommandLine", "username": "User",
    "source_ip": "SourceIp", "dest_ip": "DestinationIp", "file_path": "TargetFilename", "registry_key": "TargetObject",
}
_XML = (
    "System struct<Provider:struct<_Name:string,_Guid:string>,EventID:string,Version:string,Level:string,Task:string,"
    "Opcode:string,Keywords:string,TimeCreated:struct<_SystemTime:string>,EventRecordID:string,"
    "Execution:struct<_ProcessID:string,_ThreadID:string>,Channel:string,Computer:string,Security:struct<_UserID:string>>,"
    "EventData struct<Data:array<struct<_Name:string,_VALUE:string>>>"
)
_SYSTEM_PATHS = {
    "TimeCreated": "System.TimeCreated._SystemTime", "ProviderName": "System.Provider._Name",
    "ProviderGuid": "System.Provider._Guid", "ExecutionProcessID": "System.Execution._ProcessID",
    "ExecutionThreadID": "System.Execution._ThreadID", "SecurityUserID": "System.Security._UserID",
}


def windows_xml_events(df: DataFrame, value: str = "value", host: Column | None = None) -> DataFrame:
    """Endpoint events of Windows event XML, one document per row."""
    kept = [c for c in df.columns if c != value]
    staged = df.select(*kept, F.from_xml(F.col(value), _XML, {"rowTag": "Event"}).alias("x"))
    data = F.filter(
        F.transform(F.coalesce("x.EventData.Data", F.array().cast("array<struct<_Name:string,_VALUE:string>>")),
                    lambda d: F.struct(F.coalesce(d["_Name"], F.lit("Data")).alias("k"), strip(d["_VALUE"]).alias("v"))),
        lambda d: d["v"] != "",
    )
    staged = staged.withColumn("d", F.reverse(data)).select(
        *kept, "x", F.transform("d", lambda p: p["k"]).alias("ks"), F.transform("d", lambda p: p["v"]).alias("vs"),
        F.array_join(F.transform(F.reverse("d"), lambda p: F.concat(p["k"], F.lit(": "), p["v"])), "\n").alias("lines"),
    )

    def datum(name: str) -> Column:
        return F.get("vs", (F.array_position("ks", name) - 1).cast("int"))

    def system(name: str) -> Column:
        return F.col("x." + _SYSTEM_PATHS.get(name, "System." + name))

    channel = nz(system("Channel"))
    source = log_source(channel)
    event_id = nz(system("EventID"))
    provider = nz(system("ProviderName"))
    agent = host if host is not None else system("Computer")
    return staged.select(
        *kept, agent.alias("agent_host"), system("TimeCreated").alias("timestamp"),
        *[datum(n).alias(a) for a, n in ALIASES.items()],
        *[system(n).alias(f"{n}_0".lower()) for n in S.SYSTEM], F.col("lines").alias("eventdata_1"),
        *[datum(n).alias(f"{n}_2".lower()) for n in S.SYSMON], *[datum(n).alias(f"{n}_3".lower()) for n in S.SECURITY],
        source.alias("logsource_5"), event_category(source, event_id, provider).alias("eventcategory_5"),
    )


# Event categories by source and id.
CATEGORIES = {
    "Sysmon": {
        1: "Process Creation", 2: "File Creation Time Changed", 3: "Network Connection", 4: "Sysmon Service State Changed",
        5: "Process Terminated", 6: "Driver Loaded", 7: "Image Loaded", 8: "CreateRemoteThread", 9: "RawAccessRead",
        10: "ProcessAccess", 11: "FileCreate", 12: "RegistryEvent (Object create and delete)",
        13: "RegistryEvent (Value Set)", 14: "RegistryEvent (Key and Value Rename)", 15: "FileCreateStreamHash",
        16: "ServiceConfigurationChange", 17: "PipeEvent (Pipe Created)", 18: "PipeEvent (Pipe Connected)",
        19: "WmiEvent (WmiEventFilter activity detected)", 20: "WmiEvent (WmiEventConsumer activity detected)",
        21: "WmiEvent (WmiEventConsumerToFilter activity detected)", 22: "DNSEvent (DNS query)",
        23: "FileDelete (File Delete archived)", 24: "ClipboardChange (New content in the clipboard)",
        25: "ProcessTampering (Process image change)",
    },
    "Security": {
        4624: "Successful Logon", 4625: "Failed Logon", 4634: "Logoff", 4648: "Explicit Credential Logon",
        4672: "Special Privileges Assigned", 4688: "Process Creation", 4689: "Process Termination",
        4697: "Service Installed", 4698: "Scheduled Task Created", 4720: "User Account Created",
        4726: "User Account Deleted", 4728: "Member Added to Security Group", 4732: "Member Added to Local Group",
        4740: "Account Lockout", 4768: "Kerberos TGT Request", 4769: "Kerberos Service Ticket Request",
        4771: "Kerberos Pre-Auth Failed", 5156: "Windows Filtering Platform Connection",
    },
    "System": {
        6005: "Event Log Service Started", 6006: "Event Log Service Stopped", 6008: "Unexpected Shutdown",
        7034: "Service Crashed", 7035: "Service Control Manager", 7036: "Service Started/Stopped",
        7040: "Service Start Type Changed", 7045: "Service Installed",
    },
}
LOG_SOURCES = ["Sysmon", "Security", "System", "Application"]


def log_source(channel: Column) -> Column:
    """First known source named in the channel, any case."""
    chain = None
    for name in LOG_SOURCES:
        hit = F.lower(channel).contains(name.lower())
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise("Unknown")


def event_category(source: Column, event_id: Column, provider: Column) -> Column:
    """Category text; unknown ids become ``<source> Event <id>``."""
    pairs = []
    for name, ids in CATEGORIES.items():
        for number, text in ids.items():
            pairs += [F.lit(f"{name}/{number}"), F.lit(text)]
    known = F.try_element_at(F.create_map(*pairs), F.concat(source, F.lit("/"), event_id))
    prefix = F.when((source == "Application") & (provider != ""), provider).otherwise(source)
    return F.coalesce(known, F.concat(prefix, F.lit(" Event "), event_id))


# ---------------------------------------------------------------------------
# Files
# ---------------------------------------------------------------------------


def read_lines(spark: SparkSession, path: str, sensor_ip: str = "", streaming: bool = False) -> DataFrame:
    """Raw syslog lines of text files; blank lines are dropped."""
    reader = spark.readStream if streaming else spark.read
    lines = reader.text(path)
    return lines.filter(strip(F.col("value")) != "").select(
        F.col("value").alias("raw_log"), F.lit(sensor_ip).alias("sensor_ip"), F.current_timestamp().alias("ingest_ts")
    )


def read_payloads(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """One JSON payload per line."""
    reader = spark.readStream if streaming else spark.read
    return reader.text(path).withColumn("ingest_ts", F.current_timestamp())


def rejected_payloads(df: DataFrame, wire: StructType, value: str = "value") -> DataFrame:
    """Payloads that are neither an array nor an object: the dead letters."""
    return split_payloads(df, wire, value)[1]


