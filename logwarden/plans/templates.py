"""Event templates for the endpoint test view, with hand-written expectations.

Each template names the fields of one kind of event and the verdict a correct
rule set gives it: (rule id or "", severity, technique, module).  The view
joins them to the rows of ``events``; the SQL twin of the verdict query uses
only the expectations, never a rule.
"""

from __future__ import annotations

from logwarden.operators.endpoint_rules import ALL_RULES

FIELDS = [
    "logsource_5", "eventid_0", "image_2", "commandline_2", "parentimage_2", "targetfilename_2", "targetobject_2",
    "targetimage_2", "sourceimage_2", "imageloaded_2", "pipename_2", "queryname_2", "destinationip_2",
    "destinationport_2", "grantedaccess_2", "signed_2", "signaturestatus_2", "logontype_3", "targetusername_3",
    "subjectusername_3", "servicename_3", "servicefilename_3", "newprocessname_3", "taskname_3",
    "ticketencryptiontype_3", "clientname_3", "channel_0",
]
_SHORT = dict(zip(
    ["img", "cmd", "par", "file", "obj", "timg", "simg", "dll", "pipe", "q", "dip", "dport", "acc", "signed", "sigst",
     "lt", "tuser", "suser", "svc", "svcfile", "newp", "task", "enc", "client", "channel"],
    FIELDS[2:], strict=True,
))


def _t(source, event_id, want, details=None, **kw):
    row = dict.fromkeys(FIELDS, "")
    row.update(logsource_5=source, eventid_0=event_id)
    row.update({_SHORT[k]: v for k, v in kw.items()})
    return row, want, details


def _ps(cmd, want, **kw):
    return _t("Sysmon", "1", want, img="C:\\Windows\\System32\\WindowsPowerShell\\powershell.exe", cmd=cmd, **kw)


def _p(cmd, want, **kw):
    kw.setdefault("img", "C:\\Apps\\tool.exe")
    return _t("Sysmon", "1", want, cmd=cmd, **kw)


_NONE = ("", "INFO", "", "")

TEMPLATES = [
    # process creation
    _ps("powershell.exe -enc " + "QUJD" * 8, ("EP-001", "HIGH", "T1059.001", "Execution")),
    _ps("IEX (New-Object Net.WebClient).DownloadString('x')", ("EP-002", "HIGH", "T1059.001,T1105", "Execution")),
    _ps("-ExecutionPolicy  Bypass -WindowStyle Hidden -File a.ps1", ("EP-003", "HIGH", "T1059.001,T1564.003", "Execution")),
    _ps("[Ref].Assembly.GetType('AmsiUtils')", ("EP-004", "CRITICAL", "T1562.001", "DefenseEvasion")),
    _p("cmd.exe /c WHOAMI /all", ("EP-005", "MEDIUM", "T1059.003", "Discovery"), img="C:\\Windows\\System32\\cmd.exe"),
    _p("run.vbs", ("EP-006", "MEDIUM", "T1059.005", "Execution"), img="C:\\Windows\\wscript.exe"),
    _p("page.hta", ("EP-007", "HIGH", "T1218.005", "DefenseEvasion"), img="mshta.exe"),
    _p("rundll32 javascript:alert", ("EP-008", "HIGH", "T1218.011", "DefenseEvasion"), img="rundll32.exe"),
    _p("regsvr32 /s /n /i:http", ("EP-009", "HIGH", "T1218.010", "DefenseEvasion"), img="regsvr32.exe"),
    _p("certutil -decode a b", ("EP-010", "HIGH", "T1140,T1105", "DefenseEvasion"), img="certutil.exe"),
    _p("bitsadmin /transfer j", ("EP-011", "MEDIUM", "T1197,T1105", "DefenseEvasion"), img="bitsadmin.exe"),
    _p("x sekurlsa::logonpasswords", ("EP-012", "CRITICAL", "T1003.001", "CredentialAccess")),
    _p("a b", ("EP-013", "HIGH", "T1569.002,T1021.002", "LateralMovement"), img="C:\\t\\PsExec64.exe"),
    _p("vssadmin x", ("EP-014", "CRITICAL", "T1490", "Impact")),
    _p("bcdedit /set recoveryenabled no", ("EP-015", "CRITICAL", "T1490", "Impact")),
    _p("wevtutil  cl Security", ("EP-016", "HIGH", "T1070.001", "DefenseEvasion")),
    _p("/c x", ("EP-017", "HIGH", "T1566.001", "InitialAccess"), img="cmd.exe", par="WINWORD.EXE"),
    # network, process access, files
    _t("Sysmon", "3", ("EP-018", "HIGH", "T1571", "CommandAndControl"), "Connection to suspicious port: 4444",
       img="a.exe", dip="203.0.113.9", dport="4444"),
    _t("Sysmon", "3", ("EP-019", "MEDIUM", "T1059.001,T1071", "Execution"), img="powershell.exe", dip="203.0.113.10", dport="443"),
    _t("Sysmon", "3", ("EP-020", "HIGH", "T1071.001", "CommandAndControl"), img="rundll32.exe", dip="203.0.113.11", dport="80"),
    _t("Sysmon", "3", _NONE, img="chrome.exe", dip="203.0.113.12", dport="443"),
    _t("Sysmon", "10", ("EP-021", "CRITICAL", "T1003.001", "CredentialAccess"), timg="C:\\W\\LSASS.exe", acc="0x1010"),
    _t("Sysmon", "10", _NONE, timg="C:\\W\\lsass.exe", acc="0x1FFFFF"),
    _t("Sysmon", "11", ("EP-022", "MEDIUM", "T1105", "Execution"), file="C:\\Users\\Public\\a.EXE"),
    _t("Sysmon", "11", ("EP-023", "HIGH", "T1547.001", "Persistence"), file="C:\\Start\\Startup\\note.txt"),
    _t("Sysmon", "11", ("EP-024", "CRITICAL", "T1505.003", "Persistence"), file="C:\\inetpub\\a.aspx"),
    _t("Sysmon", "11", _NONE, file="C:\\docs\\report.docx"),
    # registry, pipes, dns, delete, image load, remote thread
    _t("Sysmon", "12", ("EP-025", "HIGH", "T1547.001", "Persistence"), obj="HKLM\\Software\\CurrentVersion\\Run\\x"),
    _t("Sysmon", "13", ("EP-026", "MEDIUM", "T1543.003", "Persistence"), obj="HKLM\\System\\Services\\x"),
    _t("Sysmon", "14", ("EP-027", "CRITICAL", "T1562.001", "DefenseEvasion"), obj="HKLM\\Defender\\DisableAntiSpyware"),
    _t("Sysmon", "13", ("EP-028", "HIGH", "T1548.002", "PrivilegeEscalation"), obj="HKCU\\mscfile\\shell\\open\\command"),
    _t("Sysmon", "13", _NONE, obj="HKCU\\Software\\x"),
    _t("Sysmon", "17", ("EP-029", "HIGH", "T1570", "CommandAndControl"), pipe="\\postex_1"),
    _t("Sysmon", "18", ("EP-029", "HIGH", "T1570", "CommandAndControl"), pipe="\\win_svc"),
    _t("Sysmon", "18", _NONE, pipe="\\lsass"),
    _t("Sysmon", "22", ("EP-031", "MEDIUM", "T1071.004", "CommandAndControl"), q="a.ngrok.io"),
    _t("Sysmon", "22", ("EP-032", "HIGH", "T1071.004", "Exfiltration"), q="é" * 26 + ".example.org"),
    _t("Sysmon", "22", ("EP-103", "HIGH", "T1568.002", "CommandAndControl"), q="abcdefgh12.com"),
    _t("Sysmon", "22", ("EP-104", "MEDIUM", "T1568.001", "CommandAndControl"), q="shop.tk"),
    _t("Sysmon", "22", ("EP-105", "MEDIUM", "T1102", "CommandAndControl"), q="api.github.com"),
    _t("Sysmon", "22", _NONE, q="intranet.example"),
    _t("Sysmon", "22", ("EP-097", "HIGH", "T1572", "CommandAndControl"), q="x.example", cmd="stunnel"),
    _t("Sysmon", "23", ("EP-033", "CRITICAL", "T1562.001", "DefenseEvasion"), file="C:\\P\\Windows Defender\\MpCmd.exe"),
    _t("Sysmon", "23", ("EP-114", "CRITICAL", "T1486", "Impact"), file="a.locked"),
    _t("Sysmon", "23", _NONE, file="C:\\a.tmp"),
    _t("Sysmon", "7", ("EP-034", "MEDIUM", "T1574.001", "Persistence"), img="a.exe", dll="C:\\Temp\\x.dll", signed="false", sigst="Unavailable"),
    _t("Sysmon", "7", ("EP-035", "HIGH", "T1003", "CredentialAccess"), img="a.exe", dll="C:\\W\\samlib.dll", signed="true"),
    _t("Sysmon", "7", _NONE, img="svchost.exe", dll="C:\\W\\samlib.dll", signed="true"),
    _t("Sysmon", "7", ("EP-068", "MEDIUM", "T1113", "Collection"), img="cmd.exe", dll="C:\\W\\gdi32.dll", signed="true"),
    _t("Sysmon", "7", ("EP-069", "MEDIUM", "T1056.004", "Collection"), img="rundll32.exe", dll="C:\\W\\user32.dll", signed="true"),
    _t("Sysmon", "8", ("EP-036", "HIGH", "T1055", "DefenseEvasion"), simg="C:\\a.exe", timg="C:\\W\\explorer.exe"),
    _t("Sysmon", "8", _NONE, simg="C:\\W\\explorer.exe", timg="C:\\W\\explorer.exe"),
    # security log
    _t("Security", "4624", ("EP-037", "LOW", "T1021.001", "LateralMovement"), lt="10", tuser="alice"),
    _t("Security", "4624", ("EP-038", "INFO", "T1021.002", "LateralMovement"), lt="3", tuser="bob"),
    _t("Security", "4624", _NONE, lt="2", tuser="carol"),
    _t("Security", "4625", ("EP-039", "LOW", "T1110", "CredentialAccess"), lt="3", tuser="admin"),
    _t("Security", "4648", ("EP-040", "MEDIUM", "T1078", "DefenseEvasion"), suser="alice", tuser="svc"),
    _t("Security", "4672", ("EP-041", "LOW", "T1078", "PrivilegeEscalation"), suser="alice"),
    _t("Security", "4688", ("EP-042", "LOW", "T1059.001", "Execution"), newp="C:\\W\\PowerShell.exe"),
    _t("Security", "4688", _NONE, newp="C:\\W\\notepad.exe"),
    _t("Security", "4697", ("EP-043", "HIGH", "T1543.003", "Persistence"), svc="Upd", svcfile="C:\\Temp\\u.exe"),
    _t("Security", "4697", ("EP-044", "LOW", "T1543.003", "Persistence"), svc="Print", svcfile="C:\\W\\p.exe"),
    _t("Security", "4698", ("EP-045", "MEDIUM", "T1053.005", "Persistence"), task="\\Backup"),
    _t("Security", "4702", ("EP-045", "MEDIUM", "T1053.005", "Persistence"), task="\\Update"),
    _t("Security", "4720", ("EP-046", "MEDIUM", "T1136.001", "Persistence"), tuser="eve"),
    _t("Security", "4732", ("EP-047", "MEDIUM", "T1098", "Persistence"), tuser="eve"),
    _t("Security", "4768", ("EP-048", "MEDIUM", "T1558.004", "CredentialAccess"), enc="0x17"),
    _t("Security", "4769", ("EP-049", "MEDIUM", "T1558.003", "CredentialAccess"), enc="0x17"),
    _t("Security", "4769", _NONE, enc="0x12"),
    _t("Security", "4776", ("EP-050", "INFO", "T1550.002", "LateralMovement"), tuser="dave"),
    _t("Security", "4778", ("EP-051", "LOW", "T1021.001", "LateralMovement"), "RDP session connected", tuser="al", client="W1"),
    _t("Security", "4779", ("EP-051", "LOW", "T1021.001", "LateralMovement"), "RDP session disconnected", tuser="al", client="W2"),
    _t("Security", "5140", ("EP-052", "INFO", "T1021.002", "LateralMovement")),
    _t("Security", "4740", _NONE, tuser="eve"),
    _t("Security", "4624", _NONE, lt="2", cmd="krbtgt"),
    # system log
    _t("System", "7045", ("EP-053", "HIGH", "T1543.003", "Persistence"), svc="S", svcfile="c:\\temp\\x.exe"),
    _t("System", "7045", ("EP-054", "LOW", "T1543.003", "Persistence"), svc="S2", svcfile="c:\\w\\x.exe"),
    _t("System", "7036", ("EP-055", "HIGH", "T1562.001", "DefenseEvasion"), svc="WinDefend"),
    _t("System", "7036", _NONE, svc="Spooler"),
    _t("System", "104", ("EP-056", "HIGH", "T1070.001", "DefenseEvasion"), channel="Security"),
    # collection
    _p("xcopy C:\\a D:\\b /s", ("EP-057", "MEDIUM", "T1005", "Collection")),
    _p("net use z:", ("EP-058", "MEDIUM", "T1039", "Collection")),
    _p("screencap now", ("EP-060", "MEDIUM", "T1113", "Collection")),
    _p("ffmpeg -f gdigrab -i x", ("EP-061", "MEDIUM", "T1125", "Collection")),
    _p("sox -t waveaudio x", ("EP-062", "MEDIUM", "T1123", "Collection")),
    _p("clip.exe", ("EP-063", "MEDIUM", "T1115", "Collection")),
    _p("Get-Clipboard", _NONE),
    _p("keylogger", ("EP-064", "CRITICAL", "T1056.004", "Collection")),
    _p("makecab.exe a", ("EP-065", "MEDIUM", "T1560", "Collection")),
    _p("move a c:\\temp\\b", ("EP-066", "MEDIUM", "T1074", "Collection")),
    _p("while 1 copy", ("EP-067", "MEDIUM", "T1119", "Collection")),
    _t("Sysmon", "11", ("EP-070", "LOW", "T1113", "Collection"), file="C:\\d\\a.PNG"),
    _t("Sysmon", "11", ("EP-071", "LOW", "T1125", "Collection"), file="C:\\d\\a.mp4"),
    _t("Sysmon", "11", ("EP-072", "LOW", "T1123", "Collection"), file="C:\\d\\a.wav"),
    _t("Sysmon", "11", ("EP-073", "LOW", "T1560", "Collection"), file="C:\\d\\a.zip"),
    _t("Sysmon", "11", _NONE, file="C:\\d\\Temp\\a.pdf"),
    # discovery
    _p("dsquery user", ("EP-075", "LOW", "T1087", "Discovery")),
    _p("msinfo32", ("EP-076", "LOW", "T1082", "Discovery")),
    _p("ps  aux", ("EP-077", "LOW", "T1057", "Discovery")),
    _p("nmap -p 1", ("EP-078", "MEDIUM", "T1046", "Discovery")),
    _p("route print", ("EP-079", "LOW", "T1016", "Discovery")),
    _p("find -name x", ("EP-080", "LOW", "T1083", "Discovery")),
    _p("net share", ("EP-081", "LOW", "T1135", "Discovery")),
    _p("bookmarks", ("EP-083", "LOW", "T1217", "Discovery")),
    _p("reg query hklm", ("EP-084", "LOW", "T1012", "Discovery")),
    _p("Get-Process", _NONE),
    # credential access, lateral movement
    _p("tcpdump -i 1", ("EP-086", "HIGH", "T1040", "CredentialAccess")),
    _p("keychain dump", ("EP-087", "HIGH", "T1555", "CredentialAccess")),
    _p("type .env", ("EP-088", "HIGH", "T1552", "CredentialAccess")),
    _p("fake a token", ("EP-089", "MEDIUM", "T1606", "CredentialAccess")),
    _p("winrm qc", ("EP-090", "MEDIUM", "T1021.006", "LateralMovement")),
    _p("run rce", ("EP-091", "HIGH", "T1210", "LateralMovement")),
    _p("putty a", ("EP-092", "MEDIUM", "T1021.004", "LateralMovement")),
    _p("robocopy a network", ("EP-093", "MEDIUM", "T1080", "LateralMovement")),
    _p("usb auto copy", ("EP-094", "MEDIUM", "T1091", "LateralMovement")),
    _p("tscon 2", ("EP-095", "HIGH", "T1563.002", "LateralMovement")),
    _p("sccm push", ("EP-096", "MEDIUM", "T1072", "LateralMovement")),
    # command and control, exfiltration
    _p("socat tcp", ("EP-097", "HIGH", "T1572", "CommandAndControl")),
    _p("psiphon", ("EP-098", "HIGH", "T1090.003", "CommandAndControl")),
    _p("gpg -e", ("EP-099", "LOW", "T1573.001", "CommandAndControl")),
    _p("wget a", ("EP-100", "MEDIUM", "T1105", "CommandAndControl")),
    _p("teamviewer", ("EP-101", "HIGH", "T1219", "CommandAndControl")),
    _p("raw a socket", ("EP-102", "HIGH", "T1095", "CommandAndControl")),
    _p("get dropbox.com", ("EP-105", "MEDIUM", "T1102", "CommandAndControl")),
    _p("port a knock", ("EP-107", "MEDIUM", "T1205", "CommandAndControl")),
    _p("schtasks /create /sc daily", ("EP-108", "HIGH", "T1020", "Exfiltration"), dip="203.0.113.20"),
    _p("invoke-webrequest -method post -body x", ("EP-109", "CRITICAL", "T1041", "Exfiltration")),
    _p("ftp -s:f", ("EP-110", "HIGH", "T1048", "Exfiltration")),
    _p("icloud put", ("EP-111", "HIGH", "T1567", "Exfiltration")),
    _p("schtasks /run sync", ("EP-113", "MEDIUM", "T1029", "Exfiltration")),
    _p("x", _NONE, file="D:\\a"),
    # impact, privilege escalation, execution, initial access
    _p("x", ("EP-114", "CRITICAL", "T1486", "Impact"), file="c:\\a.conti"),
    _p("cipher /w", ("EP-115", "CRITICAL", "T1486", "Impact")),
    _p("sc stop x", ("EP-116", "HIGH", "T1489", "Impact")),
    _p("shutdown /r", ("EP-117", "HIGH", "T1529", "Impact")),
    _p("format x /fs:ntfs", ("EP-118", "CRITICAL", "T1485", "Impact")),
    _p("dd if=/dev/zero", ("EP-119", "CRITICAL", "T1561", "Impact")),
    _p("net.exe user x /delete", ("EP-120", "HIGH", "T1531", "Impact")),
    _p("ping flood", ("EP-121", "MEDIUM", "T1499", "Impact")),
    _p("echo a > index.html", ("EP-122", "MEDIUM", "T1491", "Impact")),
    _p("SeImpersonatePrivilege", ("EP-124", "CRITICAL", "T1134", "PrivilegeEscalation")),
    _p("ms17-010", ("EP-125", "CRITICAL", "T1068", "PrivilegeEscalation")),
    _p("shellcode", ("EP-126", "HIGH", "T1203", "Execution")),
    _p("open the attachment", ("EP-127", "MEDIUM", "T1204", "Execution")),
    _p("wmic node:h create", _NONE, img="wmic.exe"),
    _p("a process call b create", ("EP-128", "MEDIUM", "T1218.001", "Execution"), img="wmic.exe"),
    _p("a.proj", ("EP-129", "HIGH", "T1218.009", "DefenseEvasion"), img="MSBuild.exe"),
    _p("a.bin", ("EP-130", "HIGH", "T1218.004", "DefenseEvasion"), img="InstallUtil.exe"),
    _p("drive by", ("EP-131", "HIGH", "T1189", "InitialAccess"), par="C:\\Chrome.exe"),
    _p("web a vulnerability", ("EP-132", "HIGH", "T1190", "InitialAccess"), par="C:\\w3wp.exe"),
    _p("vpn up", ("EP-133", "MEDIUM", "T1133", "InitialAccess")),
    # nothing to report
    _p("C:\\Apps\\tool.exe --run", _NONE),
    _p("", _NONE, img="C:\\Windows\\explorer.exe"),
    _t("Sysmon", "5", _NONE, img="a.exe"),
    _t("Application", "1000", _NONE, img="a.exe"),
    _t("Unknown", "1", _NONE, cmd="mimikatz"),
    _t("Security", "1", _NONE, cmd="mimikatz"),
]

#: Template used for every row whose event type is "error".
LOGON_FAILURE = next(i for i, (row, _, _) in enumerate(TEMPLATES) if row["eventid_0"] == "4625")

_DETAILS = {r.rule_id: r.details for r in ALL_RULES if isinstance(r.details, str)}


def _quote(value: str, raw: bool) -> str:
    prefix = "r" if raw and "\\" in value else ""
    assert not (prefix and "'" in value), value
    return prefix + "'" + value.replace("'", "''") + "'"


def template_values(raw_strings: bool) -> str:
    """``VALUES`` rows (tid, fields…).  Spark reads backslashes as escapes
    unless the literal is raw; DuckDB always takes them as they are."""
    rows = []
    for tid, (row, _, _) in enumerate(TEMPLATES):
        rows.append("(" + ", ".join([f"CAST({tid} AS BIGINT)"] + [_quote(row[f], raw_strings) for f in FIELDS]) + ")")
    return "VALUES " + ",\n".join(rows)


def expectation_values() -> str:
    """``VALUES`` rows (tid, rule_id, severity, technique, module, details)."""
    rows = []
    for tid, (_, want, details) in enumerate(TEMPLATES):
        text = details if details is not None else _DETAILS.get(want[0], "")
        rows.append("(" + ", ".join([str(tid)] + [_quote(v, False) for v in (*want, text)]) + ")")
    return "VALUES " + ",\n".join(rows)
