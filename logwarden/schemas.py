"""Schemas of the event types.  Wire names keep their level suffix; columns are
the lower-cased names."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType,
)

# Endpoint fields by level.
AGENT = [
    "agent_host", "agent_timestamp", "timestamp", "process_id", "process_name", "command_line", "username",
    "source_ip", "dest_ip", "file_path", "registry_key", "severity", "mitre_technique", "detection_module",
    "event_details", "additional_context",
]
SYSTEM = [
    "TimeCreated", "ProviderName", "ProviderGuid", "EventID", "Version", "Level", "Task", "Opcode", "Keywords",
    "EventRecordID", "ExecutionProcessID", "ExecutionThreadID", "Channel", "Computer", "SecurityUserID",
]
RAW = ["EventData", "SystemData", "UserData"]
SYSMON = [
    "UtcTime", "ProcessGuid", "ProcessId", "Image", "FileVersion", "Description", "Product", "Company",
    "CommandLine", "CurrentDirectory", "User", "LogonGuid", "LogonId", "TerminalSessionId", "IntegrityLevel",
    "Hashes", "ParentProcessGuid", "ParentProcessId", "ParentImage", "ParentCommandLine", "RuleName",
    "TargetFilename", "CreationUtcTime", "PreviousCreationUtcTime", "Protocol", "Initiated", "SourceIsIpv6",
    "SourceIp", "SourceHostname", "SourcePort", "SourcePortName", "DestinationIsIpV6", "DestinationIp",
    "DestinationHostname", "DestinationPort", "DestinationPortName", "State", "Version", "SchemaVersion",
    "ImageLoaded", "Signed", "Signature", "SignatureStatus", "SourceProcessGuid", "SourceProcessId", "SourceImage",
    "TargetProcessId", "TargetImage", "NewThreadId", "StartAddress", "StartModule", "StartFunction", "Device",
    "SourceThreadId", "TargetProcessGuid", "GrantedAccess", "CallTrace", "EventType", "TargetObject", "Details",
    "NewName", "Hash", "Configuration", "ConfigurationFileHash", "PipeName", "Operation", "Name", "Query", "Type",
    "Destination", "Consumer", "Filter", "QueryName", "QueryType", "QueryStatus", "QueryResults", "IsExecutable",
    "Archived", "Session", "ClientInfo", "ParentUser", "RawAccessRead", "EventNamespace",
]
SECURITY = [
    "LogonType", "TargetUserName", "IpAddress", "WorkstationName", "FailureReason", "NewProcessName",
    "SubjectUserName", "NewProcessId", "TaskName", "TaskContent", "ServiceName", "ServiceFileName", "ServiceType",
    "ImagePath", "AccountName", "ProcessName", "SubjectLogonId", "PrivilegeList", "OriginalFileName", "Status",
    "SubStatus", "CallerComputerName", "TicketEncryptionType", "CertThumbprint", "AuthenticationPackageName",
    "LogonProcessName", "SessionID", "ClientName", "ActionName", "Service",
]
CLASS = ["LogSource", "EventCategory"]

ENDPOINT_WIRE_NAMES = (
    AGENT + [f"{n}_0" for n in SYSTEM] + [f"{n}_1" for n in RAW] + [f"{n}_2" for n in SYSMON]
    + [f"{n}_3" for n in SECURITY] + [f"{n}_5" for n in CLASS]
)
ENDPOINT_WIRE = StructType([StructField(n, StringType()) for n in ENDPOINT_WIRE_NAMES])
ENDPOINT = StructType([StructField(n.lower(), StringType()) for n in ENDPOINT_WIRE_NAMES])

# Firewall fields after received_at.
FIREWALL_NAMES = [
    "sensor_ip", "raw_log", "device_name", "device_id", "log_date", "log_time", "timezone", "log_id", "log_type",
    "log_component", "log_subtype", "status", "priority", "action", "src_ip", "src_port", "src_mac",
    "src_country_code", "src_zone", "src_zone_type", "src_trans_ip", "dst_ip", "dst_port", "dst_country_code",
    "dst_zone", "dst_zone_type", "protocol", "ether_type", "conn_event", "conn_id", "sent_bytes", "recv_bytes",
    "sent_pkts", "recv_pkts", "fw_rule_id", "nat_rule_id", "fw_type", "user", "user_group", "app_name", "app_risk",
    "message", "severity", "classification", "url", "threat_level", "threat_type", "mitre_technique",
    "detection_module", "event_details",
]
FIREWALL = StructType(
    [StructField("received_at", TimestampType())] + [StructField(n, StringType()) for n in FIREWALL_NAMES]
)

SCADA_NAMES = ["source", "timestamp", "tag", "name", "message", "state", "classification", "username", "userlocation", "raw_log"]
SCADA = StructType([StructField("received_at", TimestampType())] + [StructField(n, StringType()) for n in SCADA_NAMES])

# Standardized log fields that are not text.
STANDARD_INTS = ["src_port", "dst_port", "status_code"]
STANDARD_NAMES = [
    "source_type", "source_system", "parser_id", "source_ip", "dest_ip", "src_port", "dst_port", "protocol",
    "action", "severity", "username", "app_name", "event_id", "category", "url", "http_method", "status_code",
    "log", "raw_log", "additional_fields",
]
STANDARD_LOG = StructType(
    [StructField("timestamp", TimestampType())]
    + [StructField(n, IntegerType() if n in STANDARD_INTS else StringType()) for n in STANDARD_NAMES]
    + [StructField("ingested_at", TimestampType())]
)

PASS_ROW = StructType([
    StructField("source_event_id", LongType()), StructField("source_type", StringType()),
    StructField("window_ts", TimestampType()),
    *[StructField(n, StringType()) for n in (
        "agent_host", "src_ip", "dst_ip", "dst_port", "event_id", "raw_summary", "rule_severity", "rule_mitre")],
    StructField("rule_is_ioa", BooleanType()), StructField("llm_severity", StringType()),
    StructField("llm_short_summary", StringType()), StructField("llm_is_ioa", BooleanType()),
    StructField("llm_is_ioc", BooleanType()), StructField("llm_ioc_values", StringType()),
    StructField("llm_ioa_values", StringType()), StructField("llm_mitre_technique", StringType()),
    StructField("llm_confidence", DoubleType()), StructField("llm_model", StringType()),
    StructField("llm_latency_ms", LongType()), StructField("llm_enabled", BooleanType()),
    StructField("final_severity", StringType()), StructField("final_summary", StringType()),
    StructField("final_mitre", StringType()),
])
