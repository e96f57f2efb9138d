"""Incident events derived from the driver's ``events`` table.

One SELECT text serves both engines, so Spark and the oracle start from equal
rows; only the quoting of literals differs.  About a third of all events sit on
one device, a few names are spelled in several ways, some addresses are claimed
by several hosts: the shapes the operators have to cope with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sleuthgraph.functions import fixed, values
from sleuthgraph.plans.session import spread, tune


def spark_quote(text: str | None) -> str:
    if text is None:
        return "CAST(NULL AS STRING)"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def duck_quote(text: str | None) -> str:
    if text is None:
        return "CAST(NULL AS STRING)"
    return "'" + text.replace("'", "''") + "'"


IMAGES = [  # (name, path); a path equal to the name means the path is unknown
    ("powershell.exe", r"C:\Windows\System32\WindowsPowerShell\v1.0\powershell.exe"),
    ("svchost.exe", "svchost.exe"),
    ("svchost.exe", r"C:\Windows\System32\svchost.exe"),
    ("tuna-sync.exe", r"C:\Users\Public\tuna-sync.exe"),
    ("explorer.exe", "explorer.exe"),
    ("explorer.exe", r"C:\Windows\explorer.exe"),
    ("Explorer.exe", r"D:\Temp\explorer.exe"),
    ("net.exe", "C:/Windows/System32/net.exe"),
    ("cmd.exe", r"C:\Windows\System32\cmd.exe"),
    (None, None),
]

COMMANDS = [
    "vssadmin.exe delete shadows /all /quiet",
    "bcdedit /set {default} recoveryenabled No",
    "wbadmin delete catalog -quiet",
    "net stop veeam /y",
    "powershell Set-MpPreference -DisableRealtimeMonitoring $true",
    "wevtutil cl Security",
    "bcdedit /set {default} safeboot network",
    r"psexec \\srv-fs01 -c c:\temp\lock.exe",
    r"tuna-sync.exe copy d:\data remote:bucket",
    r"7z a -pS3cret c:\temp\out.7z d:\data",
    r"procdump.exe -ma lsass.exe c:\temp\l.dmp",
    "nltest /dclist:corp",
    r"net view \\srv-fs01",
    "notepad.exe report.txt",
    r"explorer.exe c:\users\ann\documents",
    r'"C:\Tools\grab-keys.exe" sekurgrab::all',
    "reg add hkcu /v x",
    r"cmd /c copy c:\users\tuna-sync-backup\a.docx d:\b.docx",
    "wormscan --quick 10.0.0.0/24",
    "powershell -enc SQBFAFgAIAAoAE4AZQB3AC0ATwBiAGoA",
    "schtasks /create /tn upd /tr c:\\temp\\farhand.exe:run",
    "whoami /all & systeminfo",
    "farhand.exe --listen; net.exe user",
    "git status",
]

FILES = [  # (name, path)
    ("m.exe", None),
    ("m.exe", r"C:\Windows\Temp\m.exe"),
    ("report.docx", r"C:\Users\ann\report.docx"),
    ("RECOVER-FILES.txt", r"C:\Share\RECOVER-FILES.txt"),
    ("WHALE_README.txt", r"C:\Share\whale_readme.txt"),
    ("How-To-Restore_x.html", r"D:\data\How-To-Restore_x.html"),
    ("grab-keys.exe", r"C:\Temp\grab-keys.exe"),
    ("stage2.bin", None),
    ("stage2.bin", r"C:\A\stage2.bin"),
    ("stage2.bin", r"C:\B\stage2.bin"),
    ("readme.log", r"C:\logs\readme.log"),
    ("README.txt", "/srv/share/README.txt"),
]

DOMAINS = [
    "https://CDN-update.example.net/path?x=1", "login.evil-1.example.org", "corp.local", "10.1.2.3",
    "single", "ann@mail.example.com:8443", "c2.evil-2.example.org.", "-", None, "bad_label.example.com",
]

FINDING_TECHNIQUES = ["T1071.001", "T1003.001", "T1486", "T1021.002", "T9999.001", "T1059.999", None, "T1566",
                      "T1595"]


def _pick(expr: str, items: list, quote) -> str:
    arms = " ".join(f"WHEN {i} THEN {quote(v)}" for i, v in enumerate(items) if v is not None)
    return f"CASE {expr} {arms} END"


def flat_events_sql(source: str, quote) -> str:
    """The derived events as one flat SELECT over ``source`` (table or view name)."""
    s = "CAST({} AS STRING)".format
    bs = quote("CORP\\User")
    auth, acct, proc, file, net, dns, mail, find = (quote(c) for c in (
        fixed.AUTHENTICATION, fixed.ACCOUNT_CHANGE, fixed.PROCESS_ACTIVITY, fixed.FILE_ACTIVITY,
        fixed.NETWORK_ACTIVITY, fixed.DNS_ACTIVITY, fixed.EMAIL_ACTIVITY, fixed.DETECTION_FINDING))
    has_proc = (f"(class_name = {proc} OR (class_name = {net} AND id % 2 = 0) "
                f"OR (class_name = {file} AND id % 2 = 1) OR (class_name = {dns} AND id % 2 = 0))")
    has_file = f"(class_name = {file} OR (class_name = {find} AND id % 2 = 0))"
    image = "((id + user_id) % 10)"
    fpick = f"((id + k) % {len(FILES)})"
    return f"""
WITH base0 AS (
  SELECT event_id AS id, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k
  FROM {source}),
base AS (
  SELECT *, user_id % 60 AS dn,
    CASE WHEN event_type = 'signup' AND id % 11 = 0 THEN {acct}
         WHEN event_type = 'signup' THEN {auth}
         WHEN event_type = 'purchase' THEN {proc}
         WHEN event_type = 'view' AND id % 9 = 0 THEN {mail}
         WHEN event_type = 'view' THEN {file}
         WHEN event_type = 'click' AND id % 5 = 0 THEN {dns}
         WHEN event_type = 'click' THEN {net}
         ELSE {find} END AS class_name,
    CASE WHEN event_type = 'error' THEN 'unknown' WHEN id % 7 = 0 THEN 'failure' ELSE 'success' END AS status,
    CASE WHEN value >= 200 THEN 5 WHEN value >= 100 THEN 4 WHEN value >= 50 THEN 3
         WHEN value >= 10 THEN 2 ELSE 1 END AS severity
  FROM base0)
SELECT
  lpad({s('id')}, 16, '0') AS uid, ts AS time,
  CASE id % 4 WHEN 0 THEN 'splunk' WHEN 1 THEN 'sentinel' WHEN 2 THEN 'qradar' ELSE 'generic' END AS source,
  class_name, severity, status,
  CASE WHEN class_name = {auth} AND status = 'failure' THEN 'logon_failed'
       WHEN class_name = {auth} AND id % 5 IN (2, 3) THEN 'logon_remote'
       WHEN class_name = {auth} THEN 'logon'
       WHEN class_name = {proc} THEN 'launch'
       WHEN class_name = {net} AND status = 'failure' AND id % 2 = 0 THEN 'blocked'
       WHEN class_name = {net} THEN 'connect'
       WHEN class_name = {file} THEN CASE id % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'modify' WHEN 2 THEN 'read'
                                     ELSE 'create' END
       WHEN class_name = {dns} THEN 'query'
       WHEN class_name = {mail} THEN 'deliver'
       WHEN class_name = {acct} THEN 'create_account'
       ELSE 'alert' END AS activity,
  CASE WHEN class_name = {find} THEN concat('Rule ', {s('k % 12')}, ' matched')
       ELSE concat(event_type, ' seen on channel ', {s('k % 7')}) END AS message,
  CASE WHEN id % 50 = 49 THEN concat('WKS-', {s('dn')}, '$')
       WHEN id % 47 = 0 THEN 'SYSTEM'
       WHEN id % 41 = 0 THEN CAST(NULL AS STRING)
       WHEN id % 3 = 0 THEN concat({bs}, {s('user_id')})
       WHEN id % 3 = 1 THEN concat('user', {s('user_id')}, '@corp.com')
       ELSE concat('USER', {s('user_id')}) END AS actor_user,
  CASE WHEN id % 3 = 0 THEN 'CORP' END AS actor_domain,
  CASE WHEN id % 3 = 0 THEN 'SRV-DC01.corp.local'
       WHEN id % 17 = 0 THEN CAST(NULL AS STRING)
       WHEN dn % 10 = 7 THEN concat('FW-EDGE', {s('dn')})
       WHEN dn % 10 = 8 THEN concat('RTR-CORE', {s('dn')}, '.corp.local')
       ELSE concat('WKS-', lpad({s('dn')}, 4, '0'), '.corp.local') END AS device_hostname,
  CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN '10.9.9.9'
       WHEN id % 3 = 0 OR id % 4 <> 1 THEN CAST(NULL AS STRING)
       WHEN dn % 20 = 13 THEN '10.0.0.250'
       ELSE concat('10.0.', {s('dn % 4')}, '.', {s('dn + 1')}) END AS device_ip,
  CASE WHEN id % 6 = 1 THEN concat('Laptop', {s('user_id % 25')}, '.corp.local') END AS src_hostname,
  CASE WHEN id % 5 = 2 THEN concat('10.0.', {s('dn % 4')}, '.', {s('dn + 1')})
       WHEN id % 5 = 3 THEN concat('198.51.100.', {s('k % 50')})
       WHEN id % 5 = 4 AND id % 2 = 0 THEN 'not-an-ip' END AS src_ip,
  CASE WHEN id % 10 = 1 THEN concat('SRV-FS0', {s('k % 3')}) END AS dst_hostname,
  CASE WHEN id % 4 = 0 THEN concat('203.0.113.', {s('k % 40')})
       WHEN id % 4 = 1 THEN concat('10.0.', {s('(dn + 1) % 4')}, '.', {s('dn + 2')})
       WHEN id % 12 = 2 THEN '10.9.9.9' END AS dst_ip,
  CASE WHEN id % 3 = 0 THEN 443 WHEN id % 3 = 1 THEN 445 END AS dst_port,
  CASE WHEN {has_proc} THEN {_pick(image, [n for n, _ in IMAGES], quote)} END AS proc_name,
  CASE WHEN {has_proc} THEN {_pick(image, [p for _, p in IMAGES], quote)} END AS proc_path,
  CASE WHEN class_name = {proc} THEN {_pick(f'((id * 7 + k) % {len(COMMANDS)})', COMMANDS, quote)} END AS proc_cmdline,
  CASE WHEN class_name = {proc} AND (id * 3 + k) % 10 < 6
       THEN {_pick('((id * 3 + k) % 10)', [n for n, _ in IMAGES], quote)} END AS parent_name,
  CASE WHEN class_name = {proc} AND (id * 3 + k) % 10 < 6
       THEN {_pick('((id * 3 + k) % 10)', [p for _, p in IMAGES], quote)} END AS parent_path,
  CASE WHEN {has_file} THEN {_pick(fpick, [n for n, _ in FILES], quote)} END AS file_name,
  CASE WHEN {has_file} THEN {_pick(fpick, [p for _, p in FILES], quote)} END AS file_path,
  CASE WHEN {has_file} AND {fpick} IN (0, 1) THEN lpad({s('k % 6')}, 64, 'A')
       WHEN {has_file} AND {fpick} = 6 THEN lpad({s('k % 3')}, 64, 'c') END AS file_sha256,
  CASE WHEN {has_file} AND {fpick} IN (7, 8, 9) THEN lpad({s('k % 2')}, 32, 'd') END AS file_md5,
  CASE WHEN class_name IN ({net}, {dns}) AND id % 3 <> 0 THEN {_pick(f'(k % {len(DOMAINS)})', DOMAINS, quote)}
       END AS domain,
  CASE WHEN class_name = {net} AND id % 6 = 1 THEN concat('https://p', {s('k % 9')}, '.example.com/a?b=1') END AS url,
  CASE WHEN class_name = {auth} AND id % 4 = 1 THEN 'Office 365 Portal' END AS app,
  CASE WHEN class_name = {auth} AND id % 4 = 2 THEN 'RDP' END AS logon_type_label,
  CASE WHEN class_name = {auth} AND status = 'failure' THEN 'T1110.001'
       WHEN class_name = {proc} AND severity >= 3 THEN 'T1059.001'
       WHEN class_name = {mail} AND severity >= 3 THEN 'T1566.002'
       WHEN class_name = {acct} THEN 'T1136'
       WHEN class_name = {find} THEN {_pick(f'(k % {len(FINDING_TECHNIQUES)})', FINDING_TECHNIQUES, quote)}
       END AS tech1,
  CASE WHEN class_name = {find} AND id % 4 = 0 THEN 'T1041' END AS tech2,
  CASE WHEN class_name <> {mail} THEN CAST(NULL AS STRING)
       WHEN id % 13 = 0 THEN concat('user', {s('user_id')}, '@Corp.com')
       WHEN id % 2 = 0 THEN concat('Billing', {s('k % 20')}, '@mail.evil-', {s('k % 4')}, '.example.org')
       ELSE concat('user', {s('k')}, '@corp.com') END AS email_sender,
  CASE WHEN class_name = {mail} AND id % 8 <> 3 THEN concat('user', {s('user_id')}, '@Corp.com') END AS email_recipient,
  CASE WHEN class_name = {mail} THEN concat('Invoice ', {s('k')}) END AS email_subject,
  CASE WHEN class_name = {mail} AND id % 2 = 0
       THEN concat('https://evil-', {s('k % 4')}, '.example.org/a/b') END AS email_url,
  CASE WHEN class_name = {find} AND id % 3 = 1 THEN 'host' WHEN class_name = {find} AND id % 3 = 2 THEN 'user'
       END AS extra_type,
  CASE WHEN class_name = {find} AND id % 3 = 1 THEN concat('wks-', lpad({s('k % 60')}, 4, '0'))
       WHEN class_name = {find} AND id % 3 = 2 THEN concat('user', {s('k')}) END AS extra_value,
  concat('{{"id": ', {s('id')}, ', "password": "hunter', {s('k')}, '", "note": "', event_type, '"}}') AS raw
FROM base"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    spread(table(spark, sf_dir, "events")).createOrReplaceTempView("driver_events")
    return spark.sql(flat_events_sql("driver_events", spark_quote))


def nest(flat: DataFrame) -> DataFrame:
    """Flat derived events in the stored event schema."""
    c = F.col
    text = F.lit(None).cast("string")
    number = F.lit(None).cast("int")

    def some(struct: Column, *parts: str) -> Column:
        return F.when(F.coalesce(*[c(p) for p in parts]).isNotNull(), struct)

    def endpoint(host: str, ip: str, port: Column = number) -> Column:
        return some(F.struct(c(host).alias("hostname"), c(ip).alias("ip"), port.alias("port"),
                             text.alias("mac"), text.alias("os")), host, ip)

    technique = values.technique
    return flat.select(
        "uid", c("time").cast("timestamp").alias("time"), F.lit(False).alias("time_is_fallback"),
        F.to_date("time").alias("event_date"), "source", F.lit("derived").alias("origin"), "class_name",
        values.class_uid(c("class_name")).alias("class_uid"), "activity", "severity", "status", "message",
        some(F.struct(c("actor_user").alias("user"), c("actor_domain").alias("domain"), text.alias("sid"),
                      text.alias("session_id")), "actor_user").alias("actor"),
        endpoint("src_hostname", "src_ip").alias("src"),
        endpoint("dst_hostname", "dst_ip", c("dst_port")).alias("dst"),
        endpoint("device_hostname", "device_ip").alias("device"),
        some(F.struct(c("proc_name").alias("name"), c("proc_path").alias("path"), c("proc_cmdline").alias("cmdline"),
                      number.alias("pid"), c("parent_name"), c("parent_path"), number.alias("parent_pid"),
                      text.alias("integrity")), "proc_name", "proc_cmdline", "parent_name").alias("process"),
        some(F.struct(c("file_name").alias("name"), c("file_path").alias("path"), c("file_sha256").alias("sha256"),
                      c("file_md5").alias("md5"), F.lit(None).cast("bigint").alias("size")), "file_name").alias("file"),
        some(F.struct(c("email_sender").alias("sender"), c("email_recipient").alias("recipient"),
                      c("email_subject").alias("subject"), c("email_url").alias("url")), "email_subject").alias("email"),
        "domain", "url", "app",
        F.transform(F.array_compact(F.array("tech1", "tech2")), technique).alias("mitre"),
        "logon_type_label",
        F.when(c("extra_type").isNotNull(),
               F.array(F.struct(c("extra_type").alias("type"), c("extra_value").alias("value")))).alias("extra_entities"),
        text.alias("payload_decoded"), "raw")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nest(flat_events(spark, sf_dir))
