"""The 133 endpoint rules as data, grouped by what they look at.

Inside a group the order is the evaluation order: the first rule that matches
gives the verdict.  ``operators.endpoint`` decides which groups see which event.

A rule is (id, severity, ATT&CK technique, module, details, context, test).
``details`` and ``context`` are texts or functions of the event; ``test`` is a
function from the event's columns to a boolean column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from logwarden.functions.patterns import matches
from logwarden.functions.text import any_true, ends, has, starts


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    technique: str
    module: str
    details: str | Callable
    context: str | Callable
    test: Callable


def ALWAYS(e) -> Column:
    return F.lit(True)


# ---------------------------------------------------------------------------
# Patterns, word lists and port lists of the rules.
# All texts are compared with lower-cased fields.
# ---------------------------------------------------------------------------

POWERSHELL_ENCODED = r"-e(nc(odedcommand)?)?[\s]+[a-z0-9+/=]{20,}"
POWERSHELL_DOWNLOAD = r"downloadstring|downloadfile|invoke-webrequest|iwr|wget|curl"
POWERSHELL_BYPASS = r"-ep\s+bypass|-executionpolicy\s+bypass|set-executionpolicy\s+bypass"
POWERSHELL_HIDDEN = r"-w\s+hidden|-windowstyle\s+hidden"
CMD_SUSPICIOUS = r"whoami|net\s+(user|localgroup|group)|systeminfo|ipconfig|netstat|tasklist"
AMSI_BYPASS = r"amsi|antimalware"
CLEAR_LOGS = r"wevtutil\s+cl|clear-eventlog"
MIMIKATZ = r"mimikatz|sekurlsa|logonpasswords|kerberos::"
PSEXEC = r"psexec"
REGISTRY_RUN = r"currentversion\\run|currentversion\\runonce"
SHADOW_DELETE = r"vssadmin|wmic\s+shadowcopy|delete\s+shadows"
BCDEDIT = r"bcdedit.*(recoveryenabled|bootstatuspolicy)"

SUSPICIOUS_PORTS = ["4444", "5555", "6666", "7777", "8080", "8443", "1337", "31337"]
WEB_PORTS = ["443", "80", "53", "8080"]
SUSPICIOUS_ACCESS = ["0x1010", "0x1410", "0x1438", "0x143a", "0x1fffff"]
SUSPICIOUS_LOCATIONS = ["\\temp\\", "\\tmp\\", "\\appdata\\local\\temp\\", "\\users\\public\\", "\\programdata\\"]
EXECUTABLE_EXTENSIONS = [".exe", ".dll", ".bat", ".ps1", ".vbs", ".js", ".hta"]
WEB_ROOTS = ["\\inetpub\\", "\\wwwroot\\", "\\htdocs\\"]
WEB_SHELL_EXTENSIONS = [".asp", ".aspx", ".php", ".jsp"]
MALICIOUS_PIPES = ["\\msagent_", "\\isapi", "\\msse-", "\\postex_", "\\status_", "\\mypipe-", "\\win_svc"]
BAD_DOMAINS = ["pastebin.com", "githubusercontent.com", "ngrok.io", "duckdns.org", "no-ip.com"]
LONG_LABEL_BYTES = 50
SECURITY_TOOL_FOLDERS = [
    "\\windows defender\\", "\\malwarebytes\\", "\\symantec\\", "\\mcafee\\", "\\avg\\", "\\avast\\",
]
CREDENTIAL_DLLS = ["vaultcli.dll", "samlib.dll"]
INJECTION_TARGETS = ["explorer.exe", "svchost.exe", "lsass.exe", "winlogon.exe"]
WEB_SERVICES = ["pastebin.com", "github.com", "dropbox.com", "googledrive", "onedrive"]
RANSOM_EXTENSIONS = [
    "encrypted", "locked", "crypto", "crypt", "enc", "vault", "xxx", "teslacrypt", "cryptolocker",
    "cryptowall", "wannacry", "petya", "locky", "conti", "ryuk", "revil", "babuk", "avaddon",
]
TOKEN_PRIVILEGES = [
    "sedebugprivilege", "setcbprivilege", "seimpersonateprivilege", "seassignprimarytokenprivilege",
    "seloaddriverprivilege",
]
EXPLOIT_PATTERNS = [r"cve-", r"ms\d{2}-\d{3}", r"exploit", r"token manipulation", r"uac.*bypass"]
BROWSERS = ["chrome", "firefox", "iexplore", "msedge"]


def is_powershell(e) -> Column:
    return has(e.image, "powershell", "pwsh")


def with_destination(text: str, e) -> Column:
    return F.when(e.dest_ip != "", F.concat(F.lit(text + " to "), e.dest_ip)).otherwise(text)


def first_extension(name: Column) -> Column:
    """The first listed extension that occurs in the file name."""
    return F.coalesce(*[F.when(name.contains("." + x), x) for x in RANSOM_EXTENSIONS])


# ---------------------------------------------------------------------------
# The rules.
# ---------------------------------------------------------------------------

PROCESS_CREATION = [
    Rule("EP-001", "HIGH", "T1059.001", "Execution",
         "Encoded PowerShell command detected",
         "Base64 encoded command execution is commonly used to evade detection",
         lambda e: is_powershell(e) & matches(e.cmd, POWERSHELL_ENCODED, e.mode)),
    Rule("EP-002", "HIGH", "T1059.001,T1105", "Execution",
         "PowerShell download cradle detected",
         "File download via PowerShell may indicate malware delivery",
         lambda e: is_powershell(e) & matches(e.cmd, POWERSHELL_DOWNLOAD, e.mode)),
    Rule("EP-003", "HIGH", "T1059.001,T1564.003", "Execution",
         "Hidden PowerShell with execution policy bypass",
         "Combination of hidden window and bypass suggests malicious intent",
         lambda e: is_powershell(e) & matches(e.cmd, POWERSHELL_BYPASS, e.mode) & matches(e.cmd, POWERSHELL_HIDDEN, e.mode)),
    Rule("EP-004", "CRITICAL", "T1562.001", "DefenseEvasion",
         "AMSI bypass attempt detected",
         "Antimalware Scan Interface bypass indicates evasion attempt",
         lambda e: is_powershell(e) & matches(e.cmd, AMSI_BYPASS, e.mode)),
    Rule("EP-005", "MEDIUM", "T1059.003", "Discovery",
         "Reconnaissance command via cmd.exe",
         "System enumeration commands detected",
         lambda e: has(e.image, "cmd.exe") & matches(e.cmd, CMD_SUSPICIOUS, e.mode)),
    Rule("EP-006", "MEDIUM", "T1059.005", "Execution",
         "Script host execution detected",
         "Windows Script Host can execute malicious VBS/JS",
         lambda e: has(e.image, "wscript", "cscript")),
    Rule("EP-007", "HIGH", "T1218.005", "DefenseEvasion",
         "MSHTA execution detected",
         "MSHTA can be used to proxy execution of malicious code",
         lambda e: has(e.image, "mshta")),
    Rule("EP-008", "HIGH", "T1218.011", "DefenseEvasion",
         "Rundll32 script execution",
         "Rundll32 executing script indicates proxy execution",
         lambda e: has(e.image, "rundll32") & has(e.cmd, "javascript:", "vbscript:")),
    Rule("EP-009", "HIGH", "T1218.010", "DefenseEvasion",
         "Regsvr32 proxy execution (Squiblydoo)",
         "Regsvr32 can be abused to execute code from remote scripts",
         lambda e: has(e.image, "regsvr32") & has(e.cmd, "/s") & has(e.cmd, "/i:")),
    Rule("EP-010", "HIGH", "T1140,T1105", "DefenseEvasion",
         "Certutil abuse detected",
         "Certutil used for file download or decode",
         lambda e: has(e.image, "certutil") & has(e.cmd, "-decode", "-urlcache")),
    Rule("EP-011", "MEDIUM", "T1197,T1105", "DefenseEvasion",
         "BITS job for file transfer",
         "BITS can be abused for stealthy file downloads",
         lambda e: has(e.image, "bitsadmin") & has(e.cmd, "/transfer")),
    Rule("EP-012", "CRITICAL", "T1003.001", "CredentialAccess",
         "Mimikatz detected",
         "Credential dumping tool execution",
         lambda e: matches(e.cmd, MIMIKATZ, e.mode) | has(e.image, "mimikatz")),
    Rule("EP-013", "HIGH", "T1569.002,T1021.002", "LateralMovement",
         "PsExec execution detected",
         "Remote execution tool commonly used for lateral movement",
         lambda e: matches(e.image, PSEXEC, e.mode) | matches(e.cmd, PSEXEC, e.mode)),
    Rule("EP-014", "CRITICAL", "T1490", "Impact",
         "Shadow copy deletion detected",
         "Ransomware commonly deletes shadow copies",
         lambda e: matches(e.cmd, SHADOW_DELETE, e.mode)),
    Rule("EP-015", "CRITICAL", "T1490", "Impact",
         "Boot configuration modification",
         "Disabling recovery options may indicate ransomware",
         lambda e: matches(e.cmd, BCDEDIT, e.mode)),
    Rule("EP-016", "HIGH", "T1070.001", "DefenseEvasion",
         "Event log clearing detected",
         "Attackers clear logs to cover tracks",
         lambda e: matches(e.cmd, CLEAR_LOGS, e.mode)),
    Rule("EP-017", "HIGH", "T1566.001", "InitialAccess",
         "Office application spawned suspicious process",
         "May indicate macro-based malware execution",
         lambda e: has(e.parent_image, "winword", "excel", "outlook") & has(e.image, "powershell", "cmd", "wscript")),
]

NETWORK_CONNECTION = [
    Rule("EP-018", "HIGH", "T1571", "CommandAndControl",
         lambda e: F.concat(F.lit("Connection to suspicious port: "), e.dest_port),
         "Non-standard port may indicate C2 communication",
         lambda e: e.dest_port.isin(SUSPICIOUS_PORTS)),
    Rule("EP-019", "MEDIUM", "T1059.001,T1071", "Execution",
         "PowerShell network connection",
         lambda e: F.concat(F.lit("PowerShell connecting to "), e.dest_ip, F.lit(":"), e.dest_port),
         lambda e: has(e.image, "powershell") & (e.dest_port != "")),
    Rule("EP-020", "HIGH", "T1071.001", "CommandAndControl",
         "Suspicious binary making web connection",
         "LOLBin network activity may indicate C2",
         lambda e: e.dest_port.isin(WEB_PORTS) & has(e.image, "rundll32", "regsvr32")),
]

PROCESS_ACCESS = [
    Rule("EP-021", "CRITICAL", "T1003.001", "CredentialAccess",
         "LSASS memory access detected",
         lambda e: F.concat(F.lit("Source: "), e.image, F.lit(", Access: "), e.granted_access),
         lambda e: has(e.target_image, "lsass") & e.granted_access.isin(SUSPICIOUS_ACCESS)),
]

FILE_CREATE = [
    Rule("EP-022", "MEDIUM", "T1105", "Execution",
         "Executable created in suspicious location",
         lambda e: e.target_filename,
         lambda e: has(e.target_filename, *SUSPICIOUS_LOCATIONS) & ends(e.target_filename, *EXECUTABLE_EXTENSIONS)),
    Rule("EP-023", "HIGH", "T1547.001", "Persistence",
         "File created in Startup folder",
         lambda e: e.target_filename,
         lambda e: has(e.target_filename, "\\startup\\")),
    Rule("EP-024", "CRITICAL", "T1505.003", "Persistence",
         "Potential web shell created",
         lambda e: e.target_filename,
         lambda e: has(e.target_filename, *WEB_ROOTS) & ends(e.target_filename, *WEB_SHELL_EXTENSIONS)),
]

REGISTRY = [
    Rule("EP-025", "HIGH", "T1547.001", "Persistence",
         "Registry Run key modification",
         lambda e: e.target_object,
         lambda e: matches(e.target_object, REGISTRY_RUN, e.mode)),
    Rule("EP-026", "MEDIUM", "T1543.003", "Persistence",
         "Service registry modification",
         lambda e: e.target_object,
         lambda e: has(e.target_object, "\\services\\")),
    Rule("EP-027", "CRITICAL", "T1562.001", "DefenseEvasion",
         "Security feature disabled via registry",
         lambda e: e.target_object,
         lambda e: has(e.target_object, "disableantispyware", "disablerealtimemonitoring")),
    Rule("EP-028", "HIGH", "T1548.002", "PrivilegeEscalation",
         "Potential UAC bypass registry modification",
         lambda e: e.target_object,
         lambda e: has(e.target_object, "\\mscfile\\shell\\open\\command", "\\fodhelper")),
]

PIPE = [
    Rule("EP-029", "HIGH", "T1570", "CommandAndControl",
         "Known malicious named pipe detected",
         lambda e: e.pipe,
         lambda e: has(e.pipe, *MALICIOUS_PIPES)),
    Rule("EP-030", "CRITICAL", "T1071.001", "CommandAndControl",
         "Potential Cobalt Strike pipe detected",
         lambda e: e.pipe,
         lambda e: starts(e.pipe, "\\msagent_", "\\postex_")),
]

DNS_QUERY = [
    Rule("EP-031", "MEDIUM", "T1071.004", "CommandAndControl",
         "DNS query to suspicious domain",
         lambda e: e.query,
         lambda e: has(e.query, *BAD_DOMAINS)),
    Rule("EP-032", "HIGH", "T1071.004", "Exfiltration",
         "Potential DNS tunneling detected",
         lambda e: F.concat(F.lit("Long subdomain: "), e.query),
         lambda e: F.exists(F.split(e.query, r"\."), lambda label: F.octet_length(label) > LONG_LABEL_BYTES)),
]

FILE_DELETE = [
    Rule("EP-033", "CRITICAL", "T1562.001", "DefenseEvasion",
         "Security tool file deletion",
         lambda e: e.target_filename,
         lambda e: has(e.target_filename, *SECURITY_TOOL_FOLDERS)),
]

IMAGE_LOAD = [
    Rule("EP-034", "MEDIUM", "T1574.001", "Persistence",
         "Unsigned DLL loaded from suspicious path",
         lambda e: e.image_loaded,
         lambda e: (e.signed == "false") & (e.signature_status != "Valid") & has(e.image_loaded, "\\temp\\", "\\appdata\\")),
    Rule("EP-035", "HIGH", "T1003", "CredentialAccess",
         "Credential-related DLL loaded by suspicious process",
         lambda e: F.concat(e.image, F.lit(" loaded "), e.image_loaded),
         lambda e: has(e.image_loaded, *CREDENTIAL_DLLS) & ~has(e.image, "lsass", "svchost")),
]

REMOTE_THREAD = [
    Rule("EP-036", "HIGH", "T1055", "DefenseEvasion",
         "Remote thread creation in system process",
         lambda e: F.concat(e.source_image, F.lit(" -> "), e.target_image),
         lambda e: (e.source_image != e.target_image) & has(e.target_image, *INJECTION_TARGETS)),
]

LOGON_SUCCESS = [
    Rule("EP-037", "LOW", "T1021.001", "LateralMovement",
         "RDP logon detected",
         lambda e: F.concat(F.lit("User: "), e.target_user, F.lit(", Source: "), e.ip_address),
         lambda e: e.logon_type == "10"),
    Rule("EP-038", "INFO", "T1021.002", "LateralMovement",
         "Network logon",
         lambda e: F.concat(F.lit("User: "), e.target_user, F.lit(", Source: "), e.ip_address),
         lambda e: e.logon_type == "3"),
]

LOGON_FAILURE = [
    Rule("EP-039", "LOW", "T1110", "CredentialAccess",
         "Failed logon attempt",
         lambda e: F.concat(F.lit("User: "), e.target_user, F.lit(", Type: "), e.logon_type, F.lit(", Source: "), e.ip_address),
         ALWAYS),
]

EXPLICIT_CREDENTIALS = [
    Rule("EP-040", "MEDIUM", "T1078", "DefenseEvasion",
         "Explicit credential usage",
         lambda e: F.concat(F.lit("Subject: "), e.subject_user, F.lit(", Target: "), e.target_user),
         ALWAYS),
]

PRIVILEGE_ASSIGNMENT = [
    Rule("EP-041", "LOW", "T1078", "PrivilegeEscalation",
         "Special privileges assigned to logon",
         lambda e: F.concat(F.lit("User: "), e.subject_user),
         ALWAYS),
]

PROCESS_CREATED_AUDIT = [
    Rule("EP-042", "LOW", "T1059.001", "Execution",
         "PowerShell execution (Security log)",
         lambda e: e.new_process,
         lambda e: has(e.new_process, "powershell")),
]

SERVICE_INSTALL_AUDIT = [
    Rule("EP-043", "HIGH", "T1543.003", "Persistence",
         "Suspicious service installation",
         lambda e: F.concat(e.service_name, F.lit(": "), e.service_file),
         lambda e: has(e.service_file, "\\temp\\", "\\appdata\\", "cmd.exe", "powershell")),
    Rule("EP-044", "LOW", "T1543.003", "Persistence",
         "Service installed",
         lambda e: e.service_name,
         ALWAYS),
]

SCHEDULED_TASK = [
    Rule("EP-045", "MEDIUM", "T1053.005", "Persistence",
         "Scheduled task created",
         lambda e: e.task_name,
         ALWAYS),
]

USER_CREATED = [
    Rule("EP-046", "MEDIUM", "T1136.001", "Persistence",
         "Local user account created",
         lambda e: F.concat(F.lit("Target: "), e.target_user),
         ALWAYS),
]

GROUP_MEMBERSHIP = [
    Rule("EP-047", "MEDIUM", "T1098", "Persistence",
         "User added to local group",
         lambda e: F.concat(F.lit("User: "), e.target_user),
         ALWAYS),
]

KERBEROS_TGT = [
    Rule("EP-048", "MEDIUM", "T1558.004", "CredentialAccess",
         "Kerberos TGT with RC4 encryption",
         "Possible AS-REP Roasting target",
         lambda e: e.ticket_encryption == "0x17"),
]

KERBEROS_SERVICE = [
    Rule("EP-049", "MEDIUM", "T1558.003", "CredentialAccess",
         "Kerberos service ticket with RC4",
         "Possible Kerberoasting",
         lambda e: e.ticket_encryption == "0x17"),
]

NTLM = [
    Rule("EP-050", "INFO", "T1550.002", "LateralMovement",
         "NTLM authentication",
         lambda e: F.concat(F.lit("Account: "), e.target_user),
         ALWAYS),
]

RDP_SESSION = [
    Rule("EP-051", "LOW", "T1021.001", "LateralMovement",
         lambda e: F.when(e.event_id == "4779", "RDP session disconnected").otherwise("RDP session connected"),
         lambda e: F.concat(F.lit("User: "), e.target_user, F.lit(", Client: "), e.client_name),
         ALWAYS),
]

SHARE_ACCESS = [
    Rule("EP-052", "INFO", "T1021.002", "LateralMovement",
         "Network share accessed",
         lambda e: F.concat(F.lit("Source: "), e.ip_address),
         ALWAYS),
]

SERVICE_INSTALL = [
    Rule("EP-053", "HIGH", "T1543.003", "Persistence",
         "Suspicious service installed (System log)",
         lambda e: F.concat(e.service_name, F.lit(": "), e.service_file),
         lambda e: has(e.service_file, "cmd", "powershell", "\\temp\\", "\\appdata\\")),
    Rule("EP-054", "LOW", "T1543.003", "Persistence",
         "Service installed",
         lambda e: e.service_name,
         ALWAYS),
]

SERVICE_STATE = [
    Rule("EP-055", "HIGH", "T1562.001", "DefenseEvasion",
         "Windows Defender service state change",
         lambda e: F.lower(e.service_name),
         lambda e: has(F.lower(e.service_name), "defender", "windefend")),
]

LOG_CLEARED = [
    Rule("EP-056", "HIGH", "T1070.001", "DefenseEvasion",
         "Event log cleared",
         lambda e: F.concat(F.lit("Channel: "), e.channel),
         ALWAYS),
]

COLLECTION_PROCESS = [
    Rule("EP-057", "MEDIUM", "T1005", "Collection",
         "Potential local data collection detected",
         "Pattern suggests recursive file enumeration",
         lambda e: matches(e.cmd, r"xcopy.*\/s|robocopy.*\/s|copy.*\*\.|findstr.*\/s|Get-ChildItem.*-Recurse", e.mode)),
    Rule("EP-058", "MEDIUM", "T1039", "Collection",
         "Network shared drive access detected",
         "Network path enumeration or copy operation",
         lambda e: matches(e.cmd, r"\\\\[^\\]+\\|net use|pushd \\\\|copy.*\\\\|xcopy.*\\\\|robocopy.*\\\\", e.mode)),
    Rule("EP-059", "MEDIUM", "T1025", "Collection",
         "Potential removable media data collection",
         "Copy operation from fixed to removable drive",
         lambda e: matches(e.cmd, r"[A-Z]:\\.*copy|[A-Z]:\\.*xcopy|[A-Z]:\\.*robocopy", e.mode) & matches(e.cmd, r"[D-Z]:\\", e.mode)),
    Rule("EP-060", "MEDIUM", "T1113", "Collection",
         "Screen capture activity detected",
         "Image capture utility or API usage detected",
         lambda e: matches(e.cmd, r"Graphics\.CopyFromScreen|PrintWindow|BitBlt|screenshot|screencap|nircmd.*savescreenshot", e.mode)),
    Rule("EP-061", "MEDIUM", "T1125", "Collection",
         "Video capture activity detected",
         "Media capture tool execution",
         lambda e: matches(e.cmd, r"ffmpeg.*-f.*gdigrab|vlc.*--intf.*dummy.*--vout.*dummy", e.mode)),
    Rule("EP-062", "MEDIUM", "T1123", "Collection",
         "Audio capture activity detected",
         "Audio recording tool usage",
         lambda e: matches(e.cmd, r"ffmpeg.*-f.*dshow.*audio|sox.*-t.*waveaudio", e.mode)),
    Rule("EP-063", "MEDIUM", "T1115", "Collection",
         "Clipboard access detected",
         "Access to clipboard data",
         lambda e: matches(e.cmd, r"Get-Clipboard|Set-Clipboard|Windows\.Forms\.Clipboard|clip\.exe|GetClipboardData", e.mode)),
    Rule("EP-064", "CRITICAL", "T1056.004", "Collection",
         "Potential input capture activity detected",
         "Keyboard hook or input capture attempt",
         lambda e: matches(e.cmd, r"SetWindowsHookEx|GetAsyncKeyState|RegisterHotKey|UnregisterHotKey|keylogger|keystroke|GetKeyboardState", e.mode)),
    Rule("EP-065", "MEDIUM", "T1560", "Collection",
         "Data archiving activity detected",
         "Compression tool with password protection",
         lambda e: matches(e.cmd, r"7z\.exe.*a.*-p|winrar\.exe.*a.*-hp|tar.*-c.*-z|gzip.*-r|Compress-Archive|makecab\.exe", e.mode)),
    Rule("EP-066", "MEDIUM", "T1074", "Collection",
         "Data staging activity detected",
         "Files moved to temporary location",
         lambda e: matches(e.cmd, r"copy.*\\temp\\|copy.*\\appdata\\|move.*\\temp\\|xcopy.*\\temp\\", e.mode)),
    Rule("EP-067", "MEDIUM", "T1119", "Collection",
         "Automated data collection detected",
         "Scripted bulk file operations",
         lambda e: matches(e.cmd, r"for.*in.*do.*copy|for.*in.*do.*xcopy|while.*copy|while.*xcopy|ForEach.*Copy-Item", e.mode)),
]

COLLECTION_IMAGE = [
    Rule("EP-068", "MEDIUM", "T1113", "Collection",
         "Graphics library loaded by script",
         "GDI/User32 DLL for screen capture",
         lambda e: matches(e.image_loaded, r"gdi32\.dll|user32\.dll", e.mode) & matches(e.image, r"powershell|cmd", e.mode)),
    Rule("EP-069", "MEDIUM", "T1056.004", "Collection",
         "User32.dll loaded - potential hook installation",
         "Hook-related DLL loaded by unusual process",
         lambda e: matches(e.image_loaded, r"user32\.dll", e.mode) & matches(e.image, r"powershell|cmd|rundll32", e.mode)),
]

COLLECTION_FILE = [
    Rule("EP-070", "LOW", "T1113", "Collection",
         "Image file created - potential screenshot",
         "Image file in suspicious context",
         lambda e: matches(e.target_filename, r"\.(png|jpg|jpeg|bmp|gif)$", e.mode)),
    Rule("EP-071", "LOW", "T1125", "Collection",
         "Video file created",
         "Video recording file",
         lambda e: matches(e.target_filename, r"\.(avi|mp4|wmv|mov|mkv)$", e.mode)),
    Rule("EP-072", "LOW", "T1123", "Collection",
         "Audio file created",
         "Audio recording file",
         lambda e: matches(e.target_filename, r"\.(wav|mp3|wma|flac|m4a)$", e.mode)),
    Rule("EP-073", "LOW", "T1560", "Collection",
         "Archive file created",
         "Compressed file archive",
         lambda e: matches(e.target_filename, r"\.(zip|rar|7z|tar|gz|cab)$", e.mode)),
    Rule("EP-074", "LOW", "T1074", "Collection",
         "File staged in temporary location",
         "Data staging in temp folder",
         lambda e: matches(e.target_filename, r"\\Temp\\.*\.(txt|doc|pdf|xls)|\\AppData\\.*\.(txt|doc|pdf|xls)", e.mode)),
]

DISCOVERY = [
    Rule("EP-075", "LOW", "T1087", "Discovery",
         "Account enumeration detected",
         "User/account discovery commands",
         lambda e: matches(e.cmd, r"net\s+user|get-localuser|wmic\s+useraccount|dsquery|get-aduser", e.mode)),
    Rule("EP-076", "LOW", "T1082", "Discovery",
         "System information enumeration",
         "OS and hardware discovery",
         lambda e: matches(e.cmd, r"systeminfo|wmic\s+os|Get-ComputerInfo|msinfo32", e.mode)),
    Rule("EP-077", "LOW", "T1057", "Discovery",
         "Process discovery detected",
         "Running process enumeration",
         lambda e: matches(e.cmd, r"tasklist|Get-Process|wmic\s+process|ps\s+aux", e.mode)),
    Rule("EP-078", "MEDIUM", "T1046", "Discovery",
         "Network service scanning detected",
         "Port and service discovery",
         lambda e: matches(e.cmd, r"nmap|masscan|netstat.*-ano|Get-NetTCPConnection", e.mode)),
    Rule("EP-079", "LOW", "T1016", "Discovery",
         "Network configuration discovery",
         "Network settings enumeration",
         lambda e: matches(e.cmd, r"ipconfig|Get-NetIPConfiguration|route\s+print|netsh.*interface", e.mode)),
    Rule("EP-080", "LOW", "T1083", "Discovery",
         "File system discovery",
         "Directory and file enumeration",
         lambda e: matches(e.cmd, r"dir|ls|Get-ChildItem|find\s+-name", e.mode)),
    Rule("EP-081", "LOW", "T1135", "Discovery",
         "Network share discovery",
         "SMB share enumeration",
         lambda e: matches(e.cmd, r"net\s+share|net\s+view|Get-SmbShare|nbtstat", e.mode)),
    Rule("EP-082", "LOW", "T1018", "Discovery",
         "Remote system discovery",
         "Network host enumeration",
         lambda e: matches(e.cmd, r"net\s+view|Get-ADComputer|dsquery\s+computer|nmap.*-sL", e.mode)),
    Rule("EP-083", "LOW", "T1217", "Discovery",
         "Browser bookmark discovery",
         "Browser data access",
         lambda e: matches(e.cmd, r"favorites|bookmarks|browser|History", e.mode)),
    Rule("EP-084", "LOW", "T1012", "Discovery",
         "Registry enumeration detected",
         "Registry key discovery",
         lambda e: matches(e.cmd, r"reg\s+query|Get-ItemProperty|regedit", e.mode)),
]

CREDENTIAL_ACCESS = [
    Rule("EP-085", "CRITICAL", "T1558.001", "CredentialAccess",
         "Potential Golden Ticket creation",
         "KRBTGT credential usage",
         lambda e: has(e.source, "security") & (e.event_id == "4624") & has(e.cmd, "krbtgt")),
    Rule("EP-086", "HIGH", "T1040", "CredentialAccess",
         "Network sniffing tool detected",
         "Packet capture utility execution",
         lambda e: matches(e.cmd, r"netsh.*trace|tcpdump|wireshark|rawcap", e.mode)),
    Rule("EP-087", "HIGH", "T1555", "CredentialAccess",
         "Password store access detected",
         "Browser or credential manager access",
         lambda e: matches(e.cmd, r"credential|password.*store|vault|keychain|chrome.*profile|firefox.*profile", e.mode)),
    Rule("EP-088", "HIGH", "T1552", "CredentialAccess",
         "Unsecured credentials file accessed",
         "Plain text credentials discovery",
         lambda e: matches(e.cmd, r"credentials\.txt|password\.txt|\.env|aws.*credentials|api.*key", e.mode)),
    Rule("EP-089", "MEDIUM", "T1606", "CredentialAccess",
         "Web credential forgery detected",
         "Artificial credential generation",
         lambda e: matches(e.cmd, r"forge.*credential|fake.*token|jwt.*encode|jwt.*create", e.mode)),
]

LATERAL_MOVEMENT = [
    Rule("EP-090", "MEDIUM", "T1021.006", "LateralMovement",
         "WinRM remote execution detected",
         "PowerShell remoting session creation",
         lambda e: matches(e.cmd, r"winrm|invoke-command|enter-pssession|New-PSSession", e.mode)),
    Rule("EP-091", "HIGH", "T1210", "LateralMovement",
         "Remote service exploitation detected",
         "Exploit code execution pattern",
         lambda e: matches(e.cmd, r"exploit|remote.*service|rce|vulnerability.*exploit", e.mode)),
    Rule("EP-092", "MEDIUM", "T1021.004", "LateralMovement",
         "SSH connection attempted",
         "SSH client execution",
         lambda e: matches(e.cmd, r"ssh|putty|plink.*-ssh", e.mode)),
    Rule("EP-093", "MEDIUM", "T1080", "LateralMovement",
         "Shared content modification",
         "Network share content alteration",
         lambda e: matches(e.cmd, r"copy.*\\\\.*\\shares|xcopy.*\\\\.*shared|robocopy.*network", e.mode)),
    Rule("EP-094", "MEDIUM", "T1091", "LateralMovement",
         "Removable media replication",
         "USB device content modification",
         lambda e: matches(e.cmd, r"copy.*removable|xcopy.*[d-z]:|usb.*copy", e.mode)),
    Rule("EP-095", "HIGH", "T1563.002", "LateralMovement",
         "RDP session hijacking detected",
         "Terminal Services connection hijack",
         lambda e: matches(e.cmd, r"tscon|rdp.*session.*hijack", e.mode)),
    Rule("EP-096", "MEDIUM", "T1072", "LateralMovement",
         "Software deployment tool usage",
         "System deployment/management tool",
         lambda e: matches(e.cmd, r"psexec|gpsexec|windows.*deployment|sccm|landesk|casper", e.mode)),
]

COMMAND_AND_CONTROL = [
    Rule("EP-097", "HIGH", "T1572", "CommandAndControl",
         "Protocol tunneling tool detected",
         "Port forwarding or VPN tunnel creation",
         lambda e: matches(e.cmd, r"ssh.*-l|ssh.*-r|ssh.*-d|stunnel|socat|chisel|ngrok|plink", e.mode)),
    Rule("EP-098", "HIGH", "T1090.003", "CommandAndControl",
         "Proxy/anonymization tool detected",
         "Traffic anonymization tool usage",
         lambda e: matches(e.cmd, r"proxychains|tor|i2p|freegate|ultrasurf|psiphon", e.mode)),
    Rule("EP-099", "LOW", "T1573.001", "CommandAndControl",
         "Encryption tool usage detected",
         "Cryptographic tool execution",
         lambda e: matches(e.cmd, r"openssl|gpg|aes|des|blowfish|twofish|serpent", e.mode)),
    Rule("EP-100", "MEDIUM", "T1105", "CommandAndControl",
         "Tool transfer detected",
         "File download from internet",
         lambda e: matches(e.cmd, r"wget|curl|bitsadmin.*urlcache|certutil.*-urlcache|powershell.*downloadfile", e.mode)),
    Rule("EP-101", "HIGH", "T1219", "CommandAndControl",
         "Remote access software detected",
         "Unauthorized remote access tool",
         lambda e: matches(e.cmd, r"teamviewer|anydesk|zoho.*assist", e.mode)),
    Rule("EP-102", "HIGH", "T1095", "CommandAndControl",
         "Non-standard protocol communication",
         "Non-application layer protocol usage",
         lambda e: matches(e.cmd, r"icmp|raw.*socket|igmp", e.mode)),
    Rule("EP-103", "HIGH", "T1568.002", "CommandAndControl",
         "Potential DGA domain detected",
         "Algorithmically generated domain name",
         lambda e: has(e.source, "sysmon") & (e.event_id == "22") & matches(e.query, r"^[a-z0-9]{8,20}\.(com|net|org|info)$", e.mode)),
    Rule("EP-104", "MEDIUM", "T1568.001", "CommandAndControl",
         "Suspicious TLD query detected",
         "Free tier domain TLD usage",
         lambda e: has(e.source, "sysmon") & (e.event_id == "22") & matches(e.query, r"\.(tk|ml|ga|cf)$", e.mode)),
    Rule("EP-105", "MEDIUM", "T1102", "CommandAndControl",
         "Web service C2 usage detected",
         "Public web service for C2 communication",
         lambda e: has(e.query, *WEB_SERVICES) | has(e.cmd, *WEB_SERVICES)),
    Rule("EP-106", "MEDIUM", "T1092", "CommandAndControl",
         "Removable media communication",
         "Data transfer via removable device",
         lambda e: matches(e.cmd, r"copy.*removable|xcopy.*[d-z]:\\", e.mode)),
    Rule("EP-107", "MEDIUM", "T1205", "CommandAndControl",
         "Port knocking pattern detected",
         "Sequential port connection pattern",
         lambda e: matches(e.cmd, r"connect.*\d{1,5}.*then.*\d{1,5}|port.*knock", e.mode)),
]

EXFILTRATION = [
    Rule("EP-108", "HIGH", "T1020", "Exfiltration",
         "Automated exfiltration activity",
         lambda e: with_destination("Scheduled data transmission detected", e),
         lambda e: matches(e.cmd, r"schtasks.*create.*daily|powershell.*-windowstyle.*hidden.*invoke-webrequest|curl.*-o.*--data-binary|wget.*--post-file|robocopy.*\\\\.*\/E", e.mode)),
    Rule("EP-109", "CRITICAL", "T1041", "Exfiltration",
         "C2 exfiltration channel detected",
         lambda e: with_destination("Data transmission over C2", e),
         lambda e: matches(e.cmd, r"invoke-webrequest.*-method.*post.*-body|curl.*-X.*POST.*--data|certutil.*-urlcache.*-split.*-f.*http", e.mode)),
    Rule("EP-110", "HIGH", "T1048", "Exfiltration",
         "Alternative protocol exfiltration",
         "Non-HTTP protocol data transfer",
         lambda e: matches(e.cmd, r"ftp.*-s|sftp.*-b|scp.*-r|rsync.*-av", e.mode)),
    Rule("EP-111", "HIGH", "T1567", "Exfiltration",
         "Web service exfiltration detected",
         "Cloud storage service usage",
         lambda e: matches(e.cmd, r"dropbox|googledrive|onedrive|icloud|mega\.nz|wetransfer|pastebin|github", e.mode)),
    Rule("EP-112", "MEDIUM", "T1052", "Exfiltration",
         "File exfiltration over removable media",
         "USB or removable device access",
         lambda e: matches(e.target_filename, r"^[D-Z]:\\", e.mode)),
    Rule("EP-113", "MEDIUM", "T1029", "Exfiltration",
         "Scheduled data transfer detected",
         "Scheduled task for data exfiltration",
         lambda e: matches(e.cmd, r"schtasks.*backup|schtasks.*export|schtasks.*transfer|schtasks.*sync", e.mode)),
]

IMPACT = [
    Rule("EP-114", "CRITICAL", "T1486", "Impact",
         "File encrypted by ransomware",
         lambda e: F.concat(F.lit("Ransomware file extension: "), first_extension(e.target_filename)),
         lambda e: has(e.target_filename, *["." + x for x in RANSOM_EXTENSIONS])),
    Rule("EP-115", "CRITICAL", "T1486", "Impact",
         "Ransomware preparation activity",
         "Shadow copy or backup deletion",
         lambda e: matches(e.cmd, r"vssadmin.*delete.*shadows|wbadmin.*delete.*backup|cipher.*\/w|sdelete.*-z", e.mode)),
    Rule("EP-116", "HIGH", "T1489", "Impact",
         "Service stop attempt detected",
         "Critical service disruption",
         lambda e: matches(e.cmd, r"net.*stop|sc.*stop|Get-Service.*Stop-Service|Stop-Service", e.mode)),
    Rule("EP-117", "HIGH", "T1529", "Impact",
         "System shutdown/reboot command",
         "System availability disruption",
         lambda e: matches(e.cmd, r"shutdown.*\/s|shutdown.*\/r|Restart-Computer|Stop-Computer", e.mode)),
    Rule("EP-118", "CRITICAL", "T1485", "Impact",
         "Data destruction activity",
         "Mass file deletion pattern",
         lambda e: matches(e.cmd, r"del.*\/s.*\/q.*\/f.*\*|rmdir.*\/s.*\/q|format.*\/fs:|sdelete.*-s", e.mode)),
    Rule("EP-119", "CRITICAL", "T1561", "Impact",
         "Disk wipe activity detected",
         "Complete disk wiping pattern",
         lambda e: matches(e.cmd, r"diskpart.*clean.*all|cipher.*\/w|sdelete.*-z|dd.*if=\/dev\/zero", e.mode)),
    Rule("EP-120", "HIGH", "T1531", "Impact",
         "Account access removal detected",
         "User account deletion/disabling",
         lambda e: matches(e.cmd, r"net.*user.*\/delete|net.*localgroup.*administrators.*\/delete|Remove-LocalUser|Disable-LocalUser", e.mode)),
    Rule("EP-121", "MEDIUM", "T1499", "Impact",
         "Endpoint DoS activity detected",
         "Denial of service attack pattern",
         lambda e: matches(e.cmd, r"ping.*-t.*-l.*65500|ping.*flood|hping.*-S.*--flood|while.*Invoke-WebRequest", e.mode)),
    Rule("EP-122", "MEDIUM", "T1491", "Impact",
         "Potential defacement activity",
         "Website content modification",
         lambda e: matches(e.cmd, r"echo.*>.*index.html|echo.*>.*default.htm|copy.*ransom.*html", e.mode)),
    Rule("EP-123", "LOW", "T1499.004", "Impact",
         "Account lockout detected",
         "Potential DoS via account lockout",
         lambda e: has(e.source, "security") & (e.event_id == "4740")),
]

PRIVILEGE_ESCALATION = [
    Rule("EP-124", "CRITICAL", "T1134", "PrivilegeEscalation",
         "Access token manipulation attempt",
         "Privilege escalation via token",
         lambda e: has(e.cmd, *TOKEN_PRIVILEGES)),
    Rule("EP-125", "CRITICAL", "T1068", "PrivilegeEscalation",
         "Exploitation for privilege escalation",
         "Vulnerability exploitation detected",
         lambda e: any_true([matches(e.cmd, p, e.mode) for p in EXPLOIT_PATTERNS])),
]

EXECUTION = [
    Rule("EP-126", "HIGH", "T1203", "Execution",
         "Exploitation for client execution",
         "Malicious code execution attempt",
         lambda e: matches(e.cmd, r"exploit|shellcode|payload|rce", e.mode)),
    Rule("EP-127", "MEDIUM", "T1204", "Execution",
         "User execution of malicious file",
         "User-initiated file execution",
         lambda e: matches(e.cmd, r"click.*file|open.*attachment|execute.*document", e.mode)),
    Rule("EP-128", "MEDIUM", "T1218.001", "Execution",
         "WMIC process creation",
         "WMI Command-line interface usage",
         lambda e: has(e.image, "wmic") & matches(e.cmd, r"process.*call.*create|process.*call.*delete", e.mode)),
    Rule("EP-129", "HIGH", "T1218.009", "DefenseEvasion",
         "MSBuild execution",
         "Trusted binary proxy execution",
         lambda e: has(e.image, "msbuild")),
    Rule("EP-130", "HIGH", "T1218.004", "DefenseEvasion",
         "InstallUtil execution",
         ".NET installation utility abuse",
         lambda e: has(e.image, "installutil")),
]

INITIAL_ACCESS = [
    Rule("EP-131", "HIGH", "T1189", "InitialAccess",
         "Drive-by compromise detected",
         lambda e: F.when(has(e.parent_image, *BROWSERS), F.concat(F.lit("Compromised website infection spawned from browser: "), e.parent_image)).otherwise("Compromised website infection"),
         lambda e: matches(e.cmd, r"download.*javascript|drive.*by|compromised.*website", e.mode)),
    Rule("EP-132", "HIGH", "T1190", "InitialAccess",
         "Public-facing app exploitation",
         lambda e: F.when(e.parent_image != "", F.concat(F.lit("Web application vulnerability exploitation from parent: "), e.parent_image)).otherwise("Web application vulnerability exploitation"),
         lambda e: matches(e.cmd, r"exploit.*application|web.*vulnerability|cve-.*web", e.mode)),
    Rule("EP-133", "MEDIUM", "T1133", "InitialAccess",
         "External remote service access",
         "Remote access service exploitation",
         lambda e: matches(e.cmd, r"vpn|rdp.*external|remote.*access.*external|external.*login", e.mode)),
]
GROUPS = {name: value for name, value in globals().items() if isinstance(value, list) and value and isinstance(value[0], Rule)}

#: Every rule in group order; position + 1 is the number stored while matching.
ALL_RULES = [rule for group in GROUPS.values() for rule in group]
