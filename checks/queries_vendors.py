"""Vendor queries: every event written as one JSON record of a vendor's tables, normalised, all event columns compared.

A shape says which fields a record has (Spark SQL) and which event columns that are not null it must give (DuckDB SQL);
both only use ``concat``, ``CASE`` and ``chr``, which mean the same in either.  Expected values are spelled out here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from sleuthgraph.operators import normalize as n
from sleuthgraph.plans.session import spread
from sleuthgraph.sources import records

from . import workload as w
from .queries_ingest import BASE, INGEST, ISO, MILLIS
from .registry import query

ENDPOINT = ("hostname", "ip", "port")
# compared as text, so that null numbers mean the same in either engine
NESTED = {
    "actor": ("user", "domain", "sid", "session_id"), "src": ENDPOINT, "dst": ENDPOINT, "device": ENDPOINT,
    "process": ("name", "path", "cmdline", "pid", "parent_name", "parent_path", "parent_pid", "integrity"),
    "file": ("name", "path", "sha256", "md5", "size"), "email": ("sender", "recipient", "subject", "url"),
}
PLAIN = {"source": "VARCHAR", "origin": "VARCHAR", "class_name": "VARCHAR", "class_uid": "INTEGER", "activity": "VARCHAR",
         "severity": "INTEGER", "status": "VARCHAR", "message": "VARCHAR", "time_is_fallback": "BOOLEAN", "domain": "VARCHAR",
         "url": "VARCHAR", "app": "VARCHAR", "logon_type_label": "VARCHAR", "payload_decoded": "VARCHAR"}
MADE = {"time": ("unix_micros(time)", "BIGINT"), "event_date": ("CAST(event_date AS STRING)", "VARCHAR"),
        "techniques": ("array_join(transform(mitre, m -> concat_ws('/', m.id, m.tactic)), ',')", "VARCHAR"),
        "extra": ("array_join(transform(extra_entities, e -> concat_ws(':', e.type, e.value)), ',')", "VARCHAR")}
COLUMNS = (PLAIN | {f"{part}_{k}": "VARCHAR" for part, fields in NESTED.items() for k in fields}
           | {name: t for name, (_, t) in MADE.items()})
CLASSES = {"Authentication": 3002, "Account Change": 3001, "Process Activity": 1007, "File System Activity": 1001, "Network Activity": 4001,
           "DNS Activity": 4003, "Email Activity": 4009, "Detection Finding": 2004}

BAD = "id % 7 = 0"
USER = "concat('u', id)"


def at(*names: str) -> str:
    """A path of names that are SQL expressions if they begin with ``@``."""
    parts = [p[1:] if p.startswith("@") else f"'{p}'" for p in names]
    return "concat(" + ", chr(92), ".join(parts) + ")"


CMD = at("C:", "Windows", "System32", "cmd.exe")
EXPLORER = at("C:", "Windows", "explorer.exe")
TOOL = at("C:", "Tools", "p.exe")
LOUD = "CASE WHEN k % 2 = 1 THEN 'cmd.exe /c dir' ELSE 'notepad.exe a.txt' END"
FOUND = "CASE WHEN k % 2 = 1 THEN 'T1059.003/execution' ELSE '' END"


@dataclass(frozen=True)
class Shape:
    cls: str
    activity: str  # expressions from here on
    severity: str
    status: str
    fields: dict[str, str]
    wants: dict[str, str]

    def record(self, common: dict[str, str]) -> str:
        return "to_json(named_struct(" + ", ".join(f"'{k}', {v}" for k, v in (common | self.fields).items()) + "))"

    def expected(self, common: dict[str, str], shape: int, of: int) -> str:
        values = {"time_is_fallback": "false", "message": "''", "techniques": "''"} | common | self.wants | {
            "class_name": f"'{self.cls}'", "class_uid": str(CLASSES[self.cls]), "activity": self.activity, "severity": self.severity,
            "status": self.status, "event_date": "strftime(ts, '%Y-%m-%d')"}
        cols = ", ".join(f"CAST({values.pop(c, 'NULL')} AS {t}) AS {c}" for c, t in COLUMNS.items())
        assert not values, values
        return f"SELECT id, {cols} FROM b WHERE id % {of} = {shape}"


def flat(events):
    return events.select(*[F.col(c) for c in PLAIN], *[F.col(f"{part}.{k}").cast("string").alias(f"{part}_{k}") for part, fields in NESTED.items()
                                                          for k in fields],
                         *[F.expr(e).alias(name) for name, (e, _) in MADE.items()])


def vendor(name: str, doc: str, fields: dict[str, str], wants: dict[str, str], shapes: list[Shape]) -> None:
    of = len(shapes)
    parts = " UNION ALL ".join(s.expected(wants, k, of) for k, s in enumerate(shapes))
    lines = "CASE " + " ".join(f"WHEN id % {of} = {k} THEN {s.record(fields)}" for k, s in enumerate(shapes)) + " END"

    def run(spark, sf):
        w.tune(spark)
        spread(w.table(spark, sf, "events")).createOrReplaceTempView("driver_events")
        rows = spark.sql(f"SELECT {lines} AS line, 'derived' AS origin_file FROM ({BASE.format(table='driver_events')})")
        return flat(n.normalize(records.parse_ndjson(rows), INGEST))

    run.__doc__ = doc
    query(f"WITH b AS ({BASE.format(table='events')}) SELECT * EXCLUDE (id) FROM ({parts})", name)(run)


SHA, MD5 = "sha2(CAST(id AS STRING), 256)", "md5(CAST(id AS STRING))"
WANT_SHA, WANT_MD5 = "sha256(CAST(id AS STRING))", "md5(CAST(id AS STRING))"
SYSMON = "'XmlWinEventLog:Microsoft-Windows-Sysmon/Operational'"
SECURITY = "'WinEventLog:Security'"
OK, LAUNCH, CONNECT = "'success'", "'launch'", "'connect'"
REACH = "CASE WHEN k % 2 = 0 THEN concat('203.0.113.', k) ELSE concat('10.1.1.', k) END"
PUBLIC = "CASE WHEN k % 2 = 0 THEN 3 ELSE 2 END"
OWN = {"process_name": "'p.exe'", "process_path": TOOL}

vendor(
    "windows_records", "Windows and Sysmon records: processes, connections, files, lookups, accounts, firewalls, failed logons.",
    {"_time": f"concat({ISO['spark']}, 'Z')", "ComputerName": "concat('WKS-', u, '.corp.local')", "signature": "concat('note ', id)"},
    {"source": "'splunk'", "time": "epoch_us(ts)", "device_hostname": "concat('wks-', u)", "message": "concat('note ', id)"},
    [
        Shape("Process Activity", LAUNCH, "CASE WHEN k % 2 = 1 THEN 3 ELSE 2 END", OK,
              {"sourcetype": SECURITY, "EventCode": "'4688'", "Account_Name": USER, "Account_Domain": "'CORP'", "New_Process_Name": CMD,
               "Process_Command_Line": LOUD, "New_Process_ID": "'0x1a4c'", "Creator_Process_Name": EXPLORER, "Creator_Process_ID": "k + 7",
               "Mandatory_Label": "'S-1-16-12288'"},
              {"origin": SECURITY, "actor_user": USER, "actor_domain": "'CORP'", "process_name": "'cmd.exe'", "process_path": CMD,
               "process_cmdline": LOUD, "process_parent_name": "'explorer.exe'", "process_parent_path": EXPLORER,
               "process_parent_pid": "k + 7", "process_integrity": "'S-1-16-12288'", "techniques": FOUND}),
        Shape("Process Activity", LAUNCH, "2", OK,
              {"sourcetype": SYSMON, "EventID": "' 1 '", "User": at("CORP", "@" + USER), "Image": TOOL, "CommandLine": "concat('p.exe --', k)",
               "ProcessId": "k + 100", "ParentImage": EXPLORER, "ParentProcessId": "'7'", "IntegrityLevel": "'High'",
               "Hashes": f"concat('SHA256=', upper({SHA}), ', MD5=', upper({MD5}))"},
              OWN | {"origin": SYSMON, "actor_user": at("CORP", "@" + USER), "process_cmdline": "concat('p.exe --', k)", "process_pid": "k + 100",
                     "process_parent_name": "'explorer.exe'", "process_parent_path": EXPLORER, "process_parent_pid": "7",
                     "process_integrity": "'High'", "file_name": "'p.exe'", "file_path": TOOL, "file_sha256": WANT_SHA, "file_md5": WANT_MD5}),
        Shape("Network Activity", CONNECT, PUBLIC, OK,
              {"sourcetype": SYSMON, "EventCode": "3", "User": USER, "Image": TOOL, "SourceIp": "concat('10.0.0.', k)", "SourcePort": "40000 + k",
               "DestinationIp": REACH, "DestinationHostname": "concat('C', k, '.Example.net.')", "DestinationPort": "'8443'"},
              OWN | {"origin": SYSMON, "actor_user": USER, "src_ip": "concat('10.0.0.', k)", "src_port": "40000 + k", "dst_ip": REACH,
                     "dst_hostname": "concat('c', k)", "dst_port": "8443", "domain": "concat('c', k, '.example.net')",
                     "device_ip": "concat('10.0.0.', k)"}),
        Shape("File System Activity", "'create'", "2", OK,
              {"sourcetype": SYSMON, "EventCode": "'11'", "User": USER, "Image": TOOL, "hash": f"concat('md5=', {MD5})",
               "TargetFilename": at("C:", "Users", "@concat('f', id, '.txt')")},
              OWN | {"origin": SYSMON, "actor_user": USER, "file_name": "concat('f', id, '.txt')",
                     "file_path": at("C:", "Users", "@concat('f', id, '.txt')"), "file_md5": WANT_MD5}),
        Shape("DNS Activity", "'query'", "1", OK,
              {"sourcetype": SYSMON, "EventCode": "'22'", "Image": TOOL, "QueryName": "concat('q', k, '.example.org')",
               "QueryResults": "concat('type:  5 alias.example.org;type:198.51.100.', k, ';198.51.100.250')"},
              OWN | {"origin": SYSMON, "domain": "concat('q', k, '.example.org')", "dst_ip": "concat('198.51.100.', k)"}),
        Shape("Account Change", "'create_account'", "4", OK,
              {"source": SECURITY, "EventCode": "'4720'", "New_Account_Name": "concat('n', id)", "Account_Name": "'admin'"},
              {"origin": SECURITY, "actor_user": "concat('n', id)", "techniques": "'T1136/persistence'"}),
        Shape("Network Activity", f"CASE WHEN {BAD} THEN 'blocked' ELSE 'connect' END", PUBLIC, f"CASE WHEN {BAD} THEN 'failure' ELSE 'success' END",
              {"sourcetype": "'pan:traffic'", "src_ip": "concat('10.5.0.', k)", "dest_ip": REACH, "dest_port": "53",
               "action": f"CASE WHEN {BAD} THEN 'Dropped' ELSE 'allowed' END", "user": USER},
              {"origin": "'pan:traffic'", "actor_user": USER, "src_ip": "concat('10.5.0.', k)", "dst_ip": REACH, "dst_port": "53",
               "device_ip": "concat('10.5.0.', k)"}),
        Shape("Authentication", "'logon_failed'", "3", "'failure'",
              {"sourcetype": SECURITY, "EventCode": "'4625'", "Account_Name": "'-'", "TargetUserName": USER, "Account_Domain": "'CORP'",
               "Security_ID": "concat('S-1-5-21-', k)", "Logon_ID": "'0x3e7'", "Logon_Type": "'8'", "Workstation_Name": "concat('LT-', k, '.corp')",
               "Source_Network_Address": "'-'", "IpAddress": "concat('10.9.0.', k)", "Source_Port": "50000 + k"},
              {"origin": SECURITY, "actor_user": USER, "actor_domain": "'CORP'", "actor_sid": "concat('S-1-5-21-', k)",
               "actor_session_id": "'0x3e7'", "src_hostname": "concat('lt-', k)", "src_ip": "concat('10.9.0.', k)", "src_port": "50000 + k",
               "logon_type_label": "'network cleartext'", "techniques": "'T1110.001/credential-access'"}),
    ])

STARTED = {"InitiatingProcessFileName": "'p.exe'", "InitiatingProcessFolderPath": TOOL, "InitiatingProcessCommandLine": "concat('p.exe --', k)",
           "InitiatingProcessId": "k + 100", "InitiatingProcessParentFileName": "'explorer.exe'", "InitiatingProcessParentId": "7"}
STARTED_BY = OWN | {"process_cmdline": "concat('p.exe --', k)", "process_pid": "k + 100", "process_parent_name": "'explorer.exe'",
                    "process_parent_pid": "7"}
REMOTE_TYPE = "CASE k % 3 WHEN 0 THEN 'Network' WHEN 1 THEN 'RemoteInteractive' ELSE 'Interactive' END"
CHANGE = "CASE k % 3 WHEN 0 THEN 'FileDeleted' WHEN 1 THEN 'FileModified' ELSE 'FileCreated' END"
ENTITIES = f"""concat('[{{"Type": "host", "HostName": "SRV-', k, '.corp"}}, {{"Type": "Host", "NetBiosName": "SRV-B"}}, {{"Type": "account", "Name": "u', id,
  '", "UPNSuffix": "corp.example"}}, {{"Type": "account", "AadUserId": "a', k, '"}}, {{"Type": "ip", "Address": "203.0.113.', k,
  '"}}, {{"Type": "ip", "Address": "10.7.0.', k, '"}}, {{"Type": "file", "Name": "e', id, '.exe", "Value": "', upper({SHA}),
  '"}}, {{"Type": "url", "Url": "https://bad', k, '.example.net/p"}}]')"""

vendor(
    "hunting_records", "Hunting tables: processes, files, logons, sign-ins, mail, alerts with entities, lookups, connections.",
    {"TimeGenerated": f"concat({ISO['spark']}, 'Z')", "ReportId": "id"}, {"source": "'sentinel'", "time": "epoch_us(ts)"},
    [
        Shape("Process Activity", LAUNCH, "CASE WHEN k % 2 = 1 THEN 3 ELSE 2 END", OK,
              {"DeviceName": "concat('WKS-', u, '.corp.local')", "FileName": "'cmd.exe'", "FolderPath": CMD, "ProcessCommandLine": LOUD,
               "ProcessId": "k", "InitiatingProcessFileName": "'explorer.exe'", "InitiatingProcessFolderPath": EXPLORER,
               "InitiatingProcessId": "7", "AccountName": USER, "AccountDomain": "'CORP'", "SHA256": f"upper({SHA})", "MD5": f"upper({MD5})",
               "ActionType": "'ProcessCreated'"},
              {"origin": "'DeviceProcessEvents'", "message": "'ProcessCreated'", "device_hostname": "concat('wks-', u)", "actor_user": USER,
               "actor_domain": "'CORP'", "process_name": "'cmd.exe'", "process_path": CMD, "process_cmdline": LOUD, "process_pid": "k",
               "process_parent_name": "'explorer.exe'", "process_parent_path": EXPLORER, "process_parent_pid": "7", "file_name": "'cmd.exe'",
               "file_path": CMD, "file_sha256": WANT_SHA, "file_md5": WANT_MD5, "techniques": FOUND}),
        Shape("File System Activity", "CASE k % 3 WHEN 0 THEN 'delete' WHEN 1 THEN 'modify' ELSE 'create' END", "2", OK,
              STARTED | {"Type": "'DeviceFileEvents'", "DeviceName": "'srv-x'", "ActionType": CHANGE, "FileName": "concat('f', id, '.txt')",
                         "FolderPath": at("D:", "data", "@concat('f', id, '.txt')"), "FileSize": "5000000000 + id", "SHA256": SHA,
                         "InitiatingProcessAccountName": USER},
              STARTED_BY | {"origin": "'DeviceFileEvents'", "message": CHANGE, "device_hostname": "'srv-x'", "actor_user": USER,
                            "file_name": "concat('f', id, '.txt')", "file_path": at("D:", "data", "@concat('f', id, '.txt')"),
                            "file_size": "5000000000 + id", "file_sha256": WANT_SHA}),
        Shape("Authentication", f"CASE WHEN {BAD} THEN 'logon_failed' WHEN k % 3 < 2 THEN 'logon_remote' ELSE 'logon' END",
              f"CASE WHEN {BAD} THEN 3 ELSE 2 END", f"CASE WHEN {BAD} THEN 'failure' ELSE 'success' END",
              {"Type": "'DeviceLogonEvents'", "DeviceName": "'srv-x'", "ActionType": f"CASE WHEN {BAD} THEN 'LogonFailed' ELSE 'LogonSuccess' END",
               "LogonType": REMOTE_TYPE, "RemoteIP": "concat('10.8.0.', k)", "RemoteDeviceName": "concat('LT-', k, '.corp')", "AccountName": USER,
               "AccountDomain": "'CORP'"},
              {"origin": "'DeviceLogonEvents'", "message": f"CASE WHEN {BAD} THEN 'LogonFailed' ELSE 'LogonSuccess' END", "device_hostname": "'srv-x'",
               "src_ip": "concat('10.8.0.', k)", "src_hostname": "concat('lt-', k)", "actor_user": USER, "actor_domain": "'CORP'",
               "techniques": f"CASE WHEN {BAD} THEN '' WHEN k % 3 = 0 THEN 'T1021.002/lateral-movement' WHEN k % 3 = 1 THEN 'T1021.001/lateral-movement' ELSE '' END"}),
        Shape("Authentication", f"CASE WHEN {BAD} THEN 'logon_failed' ELSE 'logon' END", f"CASE WHEN {BAD} THEN 3 ELSE 2 END",
              f"CASE WHEN {BAD} THEN 'failure' ELSE 'success' END",
              {"Type": "'AADNonInteractiveUserSignInLogs'", "UserPrincipalName": "concat('u', id, '@corp.example')",
               "ResultType": f"CASE WHEN {BAD} THEN '50126' ELSE '0' END", "IPAddress": "concat('198.51.100.', k)", "AppDisplayName": "'Portal'"},
              {"origin": "'SigninLogs'", "actor_user": "concat('u', id, '@corp.example')", "src_ip": "concat('198.51.100.', k)", "app": "'Portal'",
               "techniques": f"CASE WHEN {BAD} THEN 'T1110/credential-access' ELSE '' END"}),
        Shape("Email Activity", "'deliver'", "CASE WHEN k % 2 = 0 THEN 4 ELSE 3 END", "CASE WHEN k % 3 = 1 THEN 'failure' ELSE 'success' END",
              {"DeviceId": "'x'", "SenderFromAddress": "concat('s', k, '@mail.example')", "RecipientEmailAddress": "concat('u', id, '@corp.example')",
               "Subject": "concat('Offer ', id)", "Url": "concat('https://o', k, '.example')",
               "DeliveryAction": "CASE k % 3 WHEN 1 THEN 'Blocked' ELSE 'Delivered' END", "ThreatTypes": "CASE WHEN k % 2 = 0 THEN 'Phish' END"},
              {"origin": "'EmailEvents'", "email_sender": "concat('s', k, '@mail.example')", "email_recipient": "concat('u', id, '@corp.example')",
               "email_subject": "concat('Offer ', id)", "email_url": "concat('https://o', k, '.example')",
               "techniques": "CASE WHEN k % 2 = 0 THEN 'T1566.002/initial-access' ELSE '' END"}),
        Shape("Detection Finding", "'alert'", "CASE WHEN k % 2 = 0 THEN 4 ELSE 3 END", "'unknown'",
              {"TableName": "'SecurityIncident'", "AlertName": "concat('Alert ', id)", "AlertSeverity": "CASE WHEN k % 2 = 0 THEN 'High' ELSE 'Medium' END",
               "Techniques": "array('T1021.002', 'T1110')", "Entities": ENTITIES, "CompromisedEntity": "'other'"},
              {"origin": "'SecurityAlert'", "message": "concat('Alert ', id)", "device_hostname": "concat('srv-', k)", "actor_user": USER,
               "actor_domain": "'corp.example'", "dst_ip": "concat('203.0.113.', k)", "file_name": "concat('e', id, '.exe')",
               "file_sha256": WANT_SHA, "url": "concat('https://bad', k, '.example.net/p')", "domain": "concat('bad', k, '.example.net')",
               "techniques": "'T1021.002/lateral-movement,T1110/credential-access'",
               "extra": "concat('host:srv-b,user:a', k, ',ip:10.7.0.', k)"}),
        Shape("DNS Activity", "'query'", "1", "'unknown'",
              STARTED | {"Type": "'DeviceEvents'", "DeviceName": "'srv-x'", "RemoteUrl": "concat('D', k, '.example.com')", "ActionType": "'DnsQuery'"},
              STARTED_BY | {"origin": "'DeviceEvents'", "message": "'DnsQuery'", "device_hostname": "'srv-x'", "domain": "concat('d', k, '.example.com')"}),
        Shape("Network Activity", CONNECT, PUBLIC, f"CASE WHEN {BAD} THEN 'failure' ELSE 'success' END",
              STARTED | {"DeviceName": "'srv-x'", "ActionType": f"CASE WHEN {BAD} THEN 'ConnectionFailed' ELSE 'ConnectionSuccess' END",
                         "RemoteIP": REACH, "RemotePort": "443", "LocalIP": "concat('10.0.0.', k)", "LocalPort": "40000 + k",
                         "RemoteUrl": "concat('https://x', k, '.example.com:8443/a')", "InitiatingProcessAccountUpn": USER},
              STARTED_BY | {"origin": "'DeviceNetworkEvents'", "message": f"CASE WHEN {BAD} THEN 'ConnectionFailed' ELSE 'ConnectionSuccess' END",
                            "device_hostname": "'srv-x'", "device_ip": "concat('10.0.0.', k)", "dst_ip": REACH, "dst_port": "443",
                            "src_ip": "concat('10.0.0.', k)", "src_port": "40000 + k", "actor_user": USER,
                            "url": "concat('https://x', k, '.example.com:8443/a')", "domain": "concat('x', k, '.example.com')"}),
    ])

NET = at("C:", "Windows", "System32", "net.exe")

vendor(
    "ariel_records", "Records with keys in any case: logons with payloads, processes, files, connections, offenses, findings.",
    {"StartTime": MILLIS["spark"], "QID": "id"}, {"source": "'qradar'", "time": "epoch_us(date_trunc('millisecond', ts))"},
    [
        Shape("Authentication", f"CASE WHEN {BAD} THEN 'logon_failed' ELSE 'logon' END", "2", f"CASE WHEN {BAD} THEN 'failure' ELSE 'success' END",
              {"categoryname": "'User Login'", "qidname": f"CASE WHEN {BAD} THEN 'Login Failed' ELSE 'Login done' END", "LogSourceName": "'Palo Alto 7'",
               "sourceIP": "concat('10.2.0.', k)", "sourcePort": "40000 + k", "userName": USER, "magnitude": "3",
               "Payload": "base64(CAST(concat('login of u', id) AS BINARY))"},
              {"origin": "'Palo Alto 7'", "message": f"CASE WHEN {BAD} THEN 'Login Failed' ELSE 'Login done' END", "src_ip": "concat('10.2.0.', k)",
               "src_port": "40000 + k", "actor_user": USER, "payload_decoded": "concat('login of u', id)",
               "techniques": f"CASE WHEN {BAD} THEN 'T1110/credential-access' ELSE '' END"}),
        Shape("Process Activity", LAUNCH, "2", OK,
              {"category": "'Process Start'", "eventname": "'Process seen'", "logsourcename": "concat('SRV-', k, '.corp')", "ProcessName": NET,
               "commandline": "'net view'", "identityusername": USER},
              {"origin": "concat('SRV-', k, '.corp')", "message": "'Process seen'", "device_hostname": "concat('srv-', k)", "process_name": "'net.exe'",
               "process_path": NET, "process_cmdline": "'net view'", "actor_user": USER, "techniques": "'T1018/discovery'"}),
        Shape("Process Activity", LAUNCH, "2", OK,
              {"highlevelcategory": "'Process Start'", "logsourcename": "'SRV-A'", "image": NET, "utf8_payload": "'whoami /all'"},
              {"origin": "'SRV-A'", "device_hostname": "'srv-a'", "process_name": "'net.exe'", "process_path": NET, "process_cmdline": "'whoami /all'",
               "payload_decoded": "'whoami /all'", "techniques": "'T1087/discovery'"}),
        Shape("File System Activity", "'create'", "5", "'failure'",
              {"categoryname": "'Malware'", "qidname": "'Infected file blocked'", "HostName": "concat('HX-', k, '.corp')", "severity": "9",
               "fileName": at("C:", "Users", "@concat('e', id, '.exe')"), "FileHash": f"upper({SHA})", "md5": MD5},
              {"origin": "CAST(id AS STRING)", "message": "'Infected file blocked'", "device_hostname": "concat('hx-', k)",
               "file_name": "concat('e', id, '.exe')", "file_path": at("C:", "Users", "@concat('e', id, '.exe')"), "file_sha256": WANT_SHA,
               "file_md5": WANT_MD5}),
        Shape("Network Activity", f"CASE WHEN {BAD} THEN 'blocked' ELSE 'connect' END", PUBLIC.replace("ELSE 2", "ELSE 1"),
              f"CASE WHEN {BAD} THEN 'failure' ELSE 'success' END",
              {"categoryname": "'Web proxy'", "qidname": f"CASE WHEN {BAD} THEN 'Deny' ELSE 'Permit' END", "logsourcename": "'Bluecoat-Proxy'",
               "sourceip": "concat('10.2.0.', k)", "sourceport": "40000 + k", "destinationip": REACH, "destinationport": "443",
               "url": "concat('https://p', k, '.example.org/x')", "magnitude": "1"},
              {"origin": "'Bluecoat-Proxy'", "message": f"CASE WHEN {BAD} THEN 'Deny' ELSE 'Permit' END", "src_ip": "concat('10.2.0.', k)",
               "src_port": "40000 + k", "dst_ip": REACH, "dst_port": "443", "domain": "concat('p', k, '.example.org')",
               "techniques": f"CASE WHEN k % 2 = 0 AND NOT {BAD} THEN 'T1071.001/command-and-control' ELSE '' END"}),
        Shape("Detection Finding", "'alert'", "4", "'unknown'",
              {"offense_type": "2", "offense_source": "CASE WHEN k % 2 = 0 THEN concat('10.6.0.', k) ELSE concat('SRV-', k, '.corp') END",
               "description": "concat('Offense ', id)", "magnitude": "8", "categories": "array('T1110', 'T1566.002 mail', 'T1110')"},
              {"origin": "'offense'", "message": "concat('Offense ', id)", "src_ip": "CASE WHEN k % 2 = 0 THEN concat('10.6.0.', k) END",
               "device_hostname": "CASE WHEN k % 2 = 1 THEN concat('srv-', k) END", "techniques": "'T1110/credential-access,T1566.002/initial-access'"}),
        Shape("Detection Finding", "'unknown'", "2", OK,
              {"categoryname": "'Other'", "qidname": "'Heartbeat'", "devicetype": "'Box'"}, {"origin": "'Box'", "message": "'Heartbeat'"}),
    ])

vendor(
    "plain_records", "Records of no vendor, classified by words: processes, files, connections, findings.",
    {"timestamp": f"concat({ISO['spark']}, 'Z')", "host": "concat('SRV-', u, '.corp')"},
    {"source": "'generic'", "time": "epoch_us(ts)", "device_hostname": "concat('srv-', u)"},
    [
        Shape("Process Activity", LAUNCH, "4", OK,
              {"name": "'Process seen'", "application": "'App'", "process_name": TOOL, "command_line": "'whoami /all'", "user": USER,
               "domain": "'CORP'", "severity": "'High'"},
              OWN | {"origin": "'App'", "message": "'Process seen'", "process_cmdline": "'whoami /all'", "actor_user": USER, "actor_domain": "'CORP'",
                     "techniques": "'T1087/discovery'"}),
        Shape("File System Activity", "'delete'", "2", OK,
              {"message": "'Deleted upload'", "username": USER, "file_name": "concat('f', id, '.txt')", "file_path": "concat('/srv/', id)", "file_hash": MD5},
              {"origin": "'generic'", "message": "'Deleted upload'", "actor_user": USER, "file_name": "concat('f', id, '.txt')",
               "file_path": "concat('/srv/', id)", "file_md5": WANT_MD5}),
        Shape("Network Activity", f"CASE WHEN {BAD} THEN 'blocked' ELSE 'connect' END",
              f"CASE WHEN k % 2 = 0 OR {BAD} THEN 3 ELSE 2 END", f"CASE WHEN {BAD} THEN 'failure' ELSE 'success' END",
              {"name": "'Connect'", "action": f"CASE WHEN {BAD} THEN 'deny' ELSE 'pass' END", "src_ip": "concat('10.3.0.', k)",
               "source_host": "concat('LT-', k)", "source_port": "40000 + k", "destination_ip": REACH, "dest_host": "concat('C', k, '.example.net')",
               "dest_port": "' 8443 '", "request": "concat('https://c', k, '.example.net:8443/a')"},
              {"origin": "'generic'", "message": "'Connect'", "src_ip": "concat('10.3.0.', k)", "src_hostname": "concat('lt-', k)",
               "src_port": "40000 + k", "dst_ip": REACH, "dst_hostname": "concat('c', k)", "dst_port": "8443",
               "url": "concat('https://c', k, '.example.net:8443/a')", "domain": "concat('c', k, '.example.net')"}),
        Shape("Detection Finding", "'alert'", "3", OK, {"name": "'Heartbeat'", "priority": "5", "sha256": SHA},
              {"origin": "'generic'", "message": "'Heartbeat'", "file_sha256": WANT_SHA}),
    ])
