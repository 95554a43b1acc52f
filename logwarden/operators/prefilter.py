"""Collection filter: include and exclude lists per event type."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.functions.text import any_true, field

# Event ids per list, field, and the values by kind of match.
# include keeps only matching events of a type, exclude drops matching ones.
RULES = [
    (["1"], "exclude", "image_2", "is", [
        "C:\\Windows\\System32\\smss.exe", "C:\\Windows\\System32\\csrss.exe", "C:\\Windows\\System32\\wininit.exe",
        "C:\\Windows\\System32\\winlogon.exe"]),
    (["1"], "exclude", "image_2", "begin with", ["C:\\ProgramData\\Microsoft\\Windows Defender\\Platform\\"]),
    (["2"], "include", "targetfilename_2", "begin with", ["C:\\Windows\\System32\\", "C:\\Windows\\SysWOW64\\"]),
    (["2"], "include", "targetfilename_2", "end with", [
        ".exe", ".dll", ".scr", ".com", ".bat", ".cmd", ".ps1", ".vbs", ".js", ".jar"]),
    (["3"], "exclude", "destinationip_2", "is", ["127.0.0.1", "::1"]),
    (["3"], "exclude", "image_2", "is", ["C:\\Windows\\System32\\svchost.exe"]),
    (["3"], "exclude", "destinationip_2", "begin with", ["10.", "192.168."]),
    (["5"], "include", "image_2", "contains", [
        "defender", "antivirus", "firewall", "security", "sysmon", "procmon", "wireshark"]),
    (["5"], "include", "image_2", "end with", ["svchost.exe", "explorer.exe", "winlogon.exe"]),
    (["6"], "exclude", "signature_2", "is", [
        "Microsoft Windows", "Microsoft Corporation", "Intel Corporation", "NVIDIA Corporation",
        "Advanced Micro Devices, Inc."]),
    (["7"], "include", "imageloaded_2", "contains", [
        "powershell", "amsi", "clr", "system.management.automation", "sekurlsa", "kerberos", "wdigest", "tspkg", "samlib",
        "vaultcli", "comsvcs", "dbgcore", "dbghelp", "lsasrv", "msv1_0", "cryptsp", "wincred", "advapi32", "ntdll",
        "kernel32", "user32", "userenv", "winsta", "\\Temp\\", "\\AppData\\"]),
    (["7"], "include", "imageloaded_2", "end with", [".tmp"]),
    (["8"], "exclude", "sourceimage_2", "is", ["C:\\Windows\\System32\\csrss.exe", "C:\\Windows\\System32\\winlogon.exe"]),
    (["9"], "include", "device_2", "contains", ["HarddiskVolume", "PhysicalDrive"]),
    (["10"], "exclude", "sourceimage_2", "is", [
        "C:\\Windows\\System32\\svchost.exe", "C:\\Windows\\System32\\csrss.exe", "C:\\Windows\\System32\\winlogon.exe",
        "C:\\Windows\\System32\\services.exe"]),
    (["10"], "exclude", "grantedaccess_2", "is", ["0x1000", "0x1400"]),
    (["11"], "include", "targetfilename_2", "end with", [
        ".exe", ".dll", ".scr", ".com", ".bat", ".cmd", ".ps1", ".vbs", ".js", ".jar", ".hta", ".msi", ".doc", ".docx",
        ".xls", ".xlsx", ".ppt", ".pptx"]),
    (["12", "13", "14"], "include", "targetobject_2", "contains", [
        "CurrentVersion\\Run", "CurrentVersion\\RunOnce", "CurrentVersion\\RunServices", "CurrentVersion\\RunServicesOnce",
        "\\Services\\", "\\CurrentVersion\\Windows\\Load", "\\CurrentVersion\\Windows\\Run", "\\CurrentVersion\\Winlogon\\",
        "\\Policies\\Explorer\\Run", "\\Group Policy\\Scripts", "\\Policies\\System\\EnableLUA", "\\Windows Defender\\",
        "\\Real-Time Protection", "\\Security\\Trusted Documents\\", "\\Security\\VBAWarnings", "\\Security\\ProtectedView\\",
        "\\Security\\FileBlock\\", "\\PowerShell\\1\\ShellIds\\Microsoft.PowerShell\\ExecutionPolicy",
        "\\Policies\\Microsoft\\Windows\\PowerShell\\", "\\Schedule\\TaskCache\\Tree\\", "\\Schedule\\TaskCache\\Tasks\\",
        "\\Internet Settings\\", "\\Connections\\DefaultConnectionSettings", "\\ROOT\\subscription\\", "\\ROOT\\default\\"]),
    (["15"], "include", "targetfilename_2", "contains", [":"]),
    (["17", "18"], "include", "pipename_2", "contains", [
        "msf", "cobalt", "beacon", "evil", "meterpreter", "stage", "payload"]),
    (["19", "20", "21"], "include", "operation_2", "is", ["Created", "Deleted"]),
    (["22"], "exclude", "queryname_2", "end with", [
        "microsoft.com", "windows.com", "office.com", "live.com", "google.com", "youtube.com", "googleapis.com",
        "gstatic.com", ".local", ".lan", ".in-addr.arpa", ".ip6.arpa"]),
    (["22"], "exclude", "queryname_2", "is", ["wpad"]),
    (["22"], "exclude", "queryname_2", "begin with", ["wpad."]),
    (["23"], "include", "targetfilename_2", "contains", ["antivirus", "defender", "firewall", "security"]),
    (["23"], "include", "targetfilename_2", "end with", [".evtx", ".log", ".exe", ".dll", ".ps1", ".bat", ".cmd", ".vbs"]),
    (["24"], "include", "clientinfo_2", "contains", ["powershell", "cmd", "script"]),
    (["25"], "include", "type_2", "is", ["Image is replaced", "Image is hollowed"]),
    (["26"], "include", "targetfilename_2", "end with", [".evtx", ".exe", ".dll", ".ps1", ".bat", ".cmd", ".vbs"]),
    (["26"], "include", "targetfilename_2", "contains", ["sysmon"]),
]

# Event ids collected per log source; None means every id.
COLLECTED = {
    "Sysmon": ["1", "3", "7", "8", "10", "11", "12", "13", "14", "17", "18", "22", "23"],
    "Security": ["4624", "4625", "4648", "4672", "4688", "4697", "4698", "4702", "4720", "4732", "4768", "4769", "4776",
                 "4778", "4779", "5140"],
    "System": ["7036", "7045", "104"],
    "Application": None,
}


def _matches(value: Column, how: str, wanted: list[str], ignore_case: bool) -> Column:
    if ignore_case:
        value, wanted = F.lower(value), [w.lower() for w in wanted]
    if how == "is":
        return value.isin(wanted)
    test = {"begin with": value.startswith, "end with": value.endswith, "contains": value.contains}[how]
    return any_true([test(w) for w in wanted])


def collection_filter(events: DataFrame, rules: Iterable[tuple] | None = None, ignore_case: bool = True,
                      event_col: str = "eventid_0") -> DataFrame:
    """Keep the events the lists let through.

    All conditions of one event type are alternatives, also where a pair reads
    as if both were meant.  Event types without a list, and other log sources,
    pass.
    """
    lists: dict = defaultdict(list)
    for ids, action, name, how, wanted in rules or RULES:
        lists[(tuple(ids), action)].append(_matches(field(events, name), how, wanted, ignore_case))
    event = field(events, event_col)
    keep = None
    for (ids, action), tests in lists.items():
        hit = any_true(tests)
        verdict = hit if action == "include" else ~hit
        keep = F.when(event.isin(list(ids)), verdict) if keep is None else keep.when(event.isin(list(ids)), verdict)
    sysmon = F.lower(field(events, "logsource_5")).contains("sysmon")
    return events.filter(F.when(sysmon, keep.otherwise(True)).otherwise(True))


def collected_events(events: DataFrame, selection: dict | None = None) -> DataFrame:
    """Events whose id is collected for their log source."""
    source, event = field(events, "logsource_5"), field(events, "eventid_0")
    tests = [
        (source == name) if ids is None else (source == name) & event.isin(ids)
        for name, ids in (selection or COLLECTED).items()
    ]
    return events.filter(any_true(tests))
