"""Which exported field fills which slot, by route (fixed values, in order of preference).

A route is ``vendor.kind``; an entry under ``vendor`` alone serves every route of
that vendor that has no entry of its own.
"""

from __future__ import annotations

_INITIATOR = ["sentinel.DeviceNetworkEvents", "sentinel.DeviceFileEvents", "sentinel.DeviceEvents"]


def _each(routes: list[str], *keys: str) -> dict[str, list[str]]:
    return {r: list(keys) for r in routes}


_LOGON = ["splunk.logon", "splunk.logon_failed"]

SLOTS: dict[str, dict[str, list[str]]] = {
    "time": {
        "splunk": ["_time", "time", "TimeCreated", "EventTime"],
        "sentinel": ["TimeGenerated", "Timestamp", "EventTime"],
        "qradar.event": ["starttime", "devicetime", "endtime", "time"],
        "qradar.offense": ["start_time", "starttime", "last_updated_time"],
        "generic": ["time", "timestamp", "@timestamp", "rt", "_time", "start"],
    },
    "device": {
        "splunk": ["ComputerName", "Computer", "host", "dvc", "dest"],
        "sentinel": ["DeviceName", "Computer", "HostName"],
        "qradar.event": ["hostname", "identityhostname"],
        "generic": ["host", "hostname", "dvchost", "device_host", "computer"],
    },
    "log_source": {"qradar.event": ["logsourcename"]},
    "message": {
        "splunk": ["Message", "name", "signature", "_raw"],
        "sentinel.alert": ["AlertName", "DisplayName", "Title"],
        "sentinel": ["AlertName", "Description", "ActionType", "Title"],
        "qradar.event": ["qidname", "eventname", "message"],
        "qradar.offense": ["description", "offense_source"],
        "generic": ["name", "message", "_raw"],
    },
    "origin": {
        "qradar.event": ["logsourcename", "devicetype", "qid"],
        "generic": ["device_product", "application", "__format__"],
    },
    "user": {
        **_each(_LOGON, "Account_Name", "TargetUserName", "user", "Target_Account_Name"),
        "splunk.process": ["Account_Name", "User", "SubjectUserName", "user"],
        "splunk.network": ["User", "user", "Account_Name"],
        "splunk.file": ["User", "user"],
        "splunk.account": ["New_Account_Name", "TargetUserName", "Account_Name"],
        "sentinel.DeviceProcessEvents": ["AccountName", "InitiatingProcessAccountName", "AccountUpn"],
        "sentinel.DeviceNetworkEvents": ["InitiatingProcessAccountName", "InitiatingProcessAccountUpn"],
        "sentinel.DeviceFileEvents": ["InitiatingProcessAccountName"],
        "sentinel.DeviceLogonEvents": ["AccountName", "AccountUpn"],
        "sentinel.SigninLogs": ["UserPrincipalName", "UserDisplayName", "Identity"],
        "qradar.event": ["username", "user", "identityusername"],
        "generic": ["src_user", "user", "username", "duser", "account", "user_name"],
    },
    "user_domain": {
        **_each(_LOGON, "Account_Domain", "TargetDomainName", "Target_Domain_Name"),
        "splunk.process": ["Account_Domain", "SubjectDomainName"],
        **_each(["sentinel.DeviceProcessEvents", "sentinel.DeviceLogonEvents"], "AccountDomain"),
        "generic": ["src_domain", "domain"],
    },
    "sid": _each(_LOGON, "Security_ID", "TargetUserSid"),
    "session": _each(_LOGON, "Logon_ID", "TargetLogonId"),
    "src_ip": {
        **_each(_LOGON, "Source_Network_Address", "IpAddress", "src_ip", "src"),
        "splunk.network": ["SourceIp", "src_ip", "src"],
        "sentinel.DeviceNetworkEvents": ["LocalIP"],
        "sentinel.DeviceLogonEvents": ["RemoteIP"],
        "sentinel.SigninLogs": ["IPAddress"],
        "qradar.event": ["sourceip", "src_ip", "source_ip"],
        "qradar.offense": ["offense_source"],
        "generic": ["src_ip", "source_ip", "sourceip", "client_ip"],
    },
    "src_host": {
        **_each(_LOGON, "Workstation_Name", "WorkstationName", "src_host"),
        "sentinel.DeviceLogonEvents": ["RemoteDeviceName"],
        "generic": ["src_host", "source_host", "src_hostname"],
    },
    "src_port": {
        **_each(_LOGON, "Source_Port", "IpPort"),
        "splunk.network": ["SourcePort", "src_port"],
        "sentinel.DeviceNetworkEvents": ["LocalPort"],
        "qradar.event": ["sourceport", "source_port"],
        "generic": ["src_port", "source_port"],
    },
    "dst_ip": {
        "splunk.network": ["DestinationIp", "dest_ip", "dest", "destination_ip"],
        "sentinel.DeviceNetworkEvents": ["RemoteIP"],
        "qradar.event": ["destinationip", "dst_ip", "destination_ip"],
        "generic": ["dest_ip", "destination_ip", "destinationip", "server_ip"],
    },
    "dst_host": {
        "splunk.network": ["DestinationHostname", "dest_host", "destination_host"],
        "generic": ["dest_host", "destination_host", "dest_hostname"],
    },
    "dst_port": {
        "splunk.network": ["DestinationPort", "dest_port", "destination_port"],
        "sentinel.DeviceNetworkEvents": ["RemotePort"],
        "qradar.event": ["destinationport", "destination_port"],
        "generic": ["dest_port", "destination_port"],
    },
    "image": {
        "splunk.process": ["New_Process_Name", "NewProcessName", "Image", "process_path", "process"],
        "splunk.network": ["Image", "process_path", "process_name"],
        **_each(["splunk.file", "splunk.dns"], "Image", "process_path"),
        "sentinel.DeviceProcessEvents": ["FileName", "ProcessName"],
        **_each(_INITIATOR, "InitiatingProcessFileName"),
        "qradar.event": ["processname", "process", "image"],
        "generic": ["process_name", "process", "image"],
    },
    "image_folder": {
        "sentinel.DeviceProcessEvents": ["FolderPath"],
        **_each(_INITIATOR, "InitiatingProcessFolderPath"),
    },
    "cmdline": {
        "splunk.process": ["Process_Command_Line", "CommandLine", "process", "cmdline"],
        "sentinel.DeviceProcessEvents": ["ProcessCommandLine"],
        **_each(_INITIATOR, "InitiatingProcessCommandLine"),
        "qradar.event": ["commandline", "process_command_line"],
        "generic": ["cmdline", "command_line", "commandline"],
    },
    "pid": {
        "splunk.process": ["New_Process_ID", "NewProcessId", "ProcessId", "process_id"],
        "sentinel.DeviceProcessEvents": ["ProcessId"],
        **_each(_INITIATOR, "InitiatingProcessId"),
    },
    "parent": {
        "splunk.process": ["Creator_Process_Name", "ParentProcessName", "ParentImage", "Parent_Process_Name", "parent_process"],
        "sentinel.DeviceProcessEvents": ["InitiatingProcessFileName"],
        **_each(_INITIATOR, "InitiatingProcessParentFileName"),
    },
    "parent_folder": {"sentinel.DeviceProcessEvents": ["InitiatingProcessFolderPath"]},
    "parent_pid": {
        "splunk.process": ["Creator_Process_ID", "ParentProcessId"],
        "sentinel.DeviceProcessEvents": ["InitiatingProcessId"],
        **_each(_INITIATOR, "InitiatingProcessParentId"),
    },
    "integrity": {"splunk.process": ["Mandatory_Label", "IntegrityLevel"]},
    "hashes": _each(["splunk.process", "splunk.file"], "Hashes", "hash"),
    "sha256": {
        **_each(["sentinel.DeviceProcessEvents", "sentinel.DeviceFileEvents"], "SHA256"),
        "qradar.event": ["sha256", "filehash"],
    },
    "md5": {
        **_each(["sentinel.DeviceProcessEvents", "sentinel.DeviceFileEvents"], "MD5"),
        "qradar.event": ["md5"],
    },
    "any_hash": {"generic": ["file_hash", "sha256", "hash"]},
    "file": {
        "splunk.file": ["TargetFilename", "file_path", "file_name"],
        "sentinel.DeviceFileEvents": ["FileName"],
        "qradar.event": ["filename", "file", "filepath"],
        "generic": ["file_name", "filename", "file_path"],
    },
    "file_folder": {
        "sentinel.DeviceFileEvents": ["FolderPath"],
        "generic": ["file_path", "filepath"],
    },
    "file_size": {"sentinel.DeviceFileEvents": ["FileSize"]},
    "url": {"sentinel.DeviceNetworkEvents": ["RemoteUrl"], "generic": ["url", "request", "uri"]},
    "domain_text": {
        "splunk.network": ["DestinationHostname", "dest_host", "destination_host"],
        "splunk.dns": ["QueryName", "query", "domain"],
        "sentinel.DeviceEvents": ["RemoteUrl", "AdditionalFields"],
        "qradar.event": ["url", "domainname", "hostname"],
        "generic": ["domain", "dest_domain", "query"],
    },
    "answers": {"splunk.dns": ["QueryResults", "answer"]},
    "action": {"splunk.network": ["action", "Action"], "sentinel": ["ActionType"], "generic": ["outcome", "action", "result"]},
    "logon_type": {**_each(_LOGON, "Logon_Type", "LogonType"), "sentinel.DeviceLogonEvents": ["LogonType"]},
    "app": {"sentinel.SigninLogs": ["AppDisplayName", "ResourceDisplayName"]},
    "result": {"sentinel.SigninLogs": ["ResultType"]},
    "sender": {"sentinel.EmailEvents": ["SenderFromAddress", "SenderMailFromAddress"]},
    "recipient": {"sentinel.EmailEvents": ["RecipientEmailAddress"]},
    "subject": {"sentinel.EmailEvents": ["Subject"]},
    "mail_url": {"sentinel.EmailEvents": ["Url", "UrlDomain"]},
    "severity": {
        "sentinel.alert": ["AlertSeverity", "Severity"],
        "qradar": ["magnitude", "severity"],
        "generic": ["cef_severity", "severity", "priority"],
    },
    "techniques": {"sentinel.alert": ["Techniques", "Tactics"], "qradar.offense": ["categories"]},
    "compromised": {"sentinel.alert": ["CompromisedEntity"]},
    "payload": {"qradar.event": ["payload", "utf8_payload"]},
    "category": {"qradar.event": ["categoryname", "highlevelcategory", "category"]},
    "event_name": {"qradar.event": ["qidname", "eventname", "qid_name"]},
}

# Windows codes and their routes; the low ones only count on a Sysmon source type.
EVENT_CODES = {"4624": "logon", "4648": "logon", "4625": "logon_failed", "4688": "process", "4720": "account",
               "1": "process", "3": "network", "11": "file", "22": "dns"}
SYSMON_ONLY = ["1", "3", "11", "22"]
NETWORK_SOURCETYPES = ["firewall", "proxy", "netflow", "stream:", "pan:", "cisco"]

# Hunting tables and their routes.
HUNTING_TABLES = {
    "DeviceProcessEvents": "DeviceProcessEvents", "DeviceNetworkEvents": "DeviceNetworkEvents",
    "DeviceFileEvents": "DeviceFileEvents", "DeviceLogonEvents": "DeviceLogonEvents",
    "SigninLogs": "SigninLogs", "AADNonInteractiveUserSignInLogs": "SigninLogs", "EmailEvents": "EmailEvents",
    "SecurityAlert": "alert", "SecurityIncident": "alert", "DeviceEvents": "DeviceEvents",
}
HUNTING_MARKERS = ["TimeGenerated", "DeviceName", "AlertName", "UserPrincipalName", "InitiatingProcessFileName",
                   "ReportId", "DeviceId"]
ARIEL_MARKERS = ["qid", "starttime", "logsourcename", "magnitude", "categoryname", "devicetype"]

# Word lists of the two classifiers.
ARIEL_AUTH = ["authentication", "logon", "login", "session opened", "credential"]
ARIEL_FILE = ["file", "malware", "virus", "antivirus"]
ARIEL_PROCESS = ["process", "exploit", "application"]
ARIEL_NETWORK = ["firewall", "flow", "network", "traffic", "proxy", "session", "vpn", "dns"]
ARIEL_FAILURE = ["fail", "denied", "deny", "block", "reject", "invalid", "unauthorized"]
HINT_AUTH = ["logon", "login", "auth", "signin", "sign-in", "credential", "kerberos", "session opened", "password",
             "ssh", "sudo", "pam_"]
HINT_PROCESS = ["process", "execut", "command", "script"]
HINT_FILE = ["file", "download", "upload", "malware", "quarantine"]
HINT_NETWORK = ["connect", "traffic", "firewall", "flow", "proxy", "http", "dns", "tcp", "udp", "vpn"]
HINT_FAILURE = ["fail", "denied", "deny", "block", "reject", "invalid", "unauthorized", "error"]
HINT_SUCCESS = ["success", "allow", "allowed", "accept", "permitted"]
BLOCK_ACTIONS = ["blocked", "block", "denied", "deny", "dropped"]
