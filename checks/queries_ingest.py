"""Ingest queries: every event written as one vendor line, parsed and normalised again."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sleuthgraph.functions import fixed
from sleuthgraph.operators import normalize as n
from sleuthgraph.plans.lineage import new_folder
from sleuthgraph.plans.session import spread
from sleuthgraph.sources import records, textlogs

from . import workload as w
from .oracle import q
from .registry import micros, query

INGEST = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)
MONTH_DAY = {"spark": "date_format(ts, 'MMM d HH:mm:ss')", "duck": "strftime(ts, '%b %-d %H:%M:%S')"}
MONTH_YEAR = {"spark": "date_format(ts, 'MMM d yyyy HH:mm:ss')", "duck": "strftime(ts, '%b %-d %Y %H:%M:%S')"}
ISO = {"spark": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")", "duck": "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"}
MILLIS = {"spark": "CAST(unix_millis(CAST(ts AS TIMESTAMP)) AS STRING)", "duck": "CAST(epoch_ms(ts) AS VARCHAR)"}

BASE = """SELECT event_id AS id, ts, user_id AS u, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k, event_type FROM {table}"""


def vendor_lines_sql(table: str) -> str:
    """One line per event in one of six vendor shapes (Spark SQL)."""
    s = "CAST({} AS STRING)".format
    bs = "chr(92)"
    splunk = f"""concat('{{"_time": "', {ISO['spark']}, 'Z", "sourcetype": "WinEventLog:Security", "EventCode": "',
      CASE WHEN id % 7 = 0 THEN '4625' ELSE '4624' END, '", "ComputerName": "WKS-', {s('u')}, '.corp.local", "Account_Name": "CORP', {bs}, {bs},
      'u', {s('id')}, '", "Logon_Type": "', CASE k % 3 WHEN 0 THEN '2' WHEN 1 THEN '3' ELSE '10' END,
      '", "Source_Network_Address": "10.0.0.', {s('k')}, '"}}')"""
    sentinel = f"""concat('{{"Type": "DeviceNetworkEvents", "TimeGenerated": "', {ISO['spark']}, 'Z", "DeviceName": "srv-', {s('k')},
      '.corp.local", "ActionType": "', CASE WHEN id % 7 = 0 THEN 'ConnectionBlocked' ELSE 'ConnectionSuccess' END, '", "RemoteIP": "',
      CASE WHEN k % 2 = 0 THEN '203.0.113.' ELSE '10.1.1.' END, {s('k')}, '", "RemotePort": 443, "InitiatingProcessAccountName": "u', {s('id')},
      '", "RemoteUrl": "https://x', {s('k')}, '.example.com:8443/a"}},')"""
    qradar = f"""concat('{{"StartTime": ', {MILLIS['spark']}, ', "QID": ', {s('id')}, ', "qidname": "',
      CASE WHEN id % 7 = 0 THEN 'Deny' ELSE 'Permit' END, '", "categoryname": "', CASE k % 4 WHEN 0 THEN 'Logon' WHEN 1 THEN 'Virus found'
      WHEN 2 THEN 'Firewall' ELSE 'Other' END, '", "logsourcename": "', CASE WHEN k % 2 = 0 THEN 'Fw-Proxy' ELSE 'SRV-A.corp' END,
      '", "sourceip": "10.2.0.', {s('k')}, '", "destinationip": "198.51.100.', {s('k')}, '", "username": "u', {s('id')},
      '", "magnitude": ', {s('k % 10 + 1')}, '}}')"""
    cef = f"""concat('<134>CEF:0|Acme|Gate|1.0|13|Traffic ', CASE WHEN id % 7 = 0 THEN 'Denied' ELSE 'Allowed' END, '|', {s('k % 11')},
      '|rt=', {MONTH_YEAR['spark']}, ' src=10.3.0.', {s('k')}, ' dst=198.51.100.', {s('k')}, ' dpt=443 act=',
      CASE WHEN id % 7 = 0 THEN 'deny' ELSE 'accept' END, ' suser=u', {s('id')}, ' dvchost=GATE-1 msg=session with a ', {bs}, '= sign')"""
    leef = f"""concat('LEEF:2.0|Acme|Mail|1.1|note|x09|devTime=', {MONTH_YEAR['spark']}, chr(9), 'src=10.4.0.', {s('k')}, chr(9),
      'usrName=u', {s('id')}, chr(9), 'sev=8', chr(9), 'fname=a', {s('k')}, '.txt', chr(9), 'msg=quarantined')"""
    syslog = f"""concat('<', CASE WHEN id % 7 = 0 THEN '131' ELSE '134' END, '>', {MONTH_DAY['spark']}, ' BOX-', {s('k')}, ' sshd[', {s('k')}, ']: ',
      CASE WHEN id % 7 = 0 THEN 'Failed' ELSE 'Accepted' END, ' password for u', {s('id')})"""
    return f"""SELECT CASE id % 6 WHEN 0 THEN {splunk} WHEN 1 THEN {sentinel} WHEN 2 THEN {qradar} WHEN 3 THEN {cef}
      WHEN 4 THEN {leef} ELSE {syslog} END AS line, 'derived' AS origin_file FROM ({BASE.format(table=table)})"""


def vendor_lines(spark, sf):
    w.tune(spark)
    spread(w.table(spark, sf, "events")).createOrReplaceTempView("driver_events")
    return spark.sql(vendor_lines_sql("driver_events"))


def _expected() -> str:
    auth, net, file, find = (q(x) for x in (fixed.AUTHENTICATION, fixed.NETWORK_ACTIVITY, fixed.FILE_ACTIVITY, fixed.DETECTION_FINDING))
    bad = "id % 7 = 0"
    qclass = f"CASE k % 4 WHEN 0 THEN {auth} WHEN 1 THEN {file} ELSE {net} END"
    magnitude = "least(5, floor((k % 10 + 1) / 10.0 * 5 + 0.5))"
    cef_sev = "least(5, floor((k % 11) / 10.0 * 5 + 0.5))"
    return f"""WITH b AS ({BASE.format(table='events')})
SELECT CASE id % 6 WHEN 0 THEN 'CORP' || chr(92) || 'u' || id WHEN 5 THEN CASE WHEN {bad} THEN 'Failed' ELSE 'Accepted' END
    || ' password for u' || id ELSE 'u' || id END AS key,
  CASE id % 6 WHEN 0 THEN 'splunk' WHEN 1 THEN 'sentinel' WHEN 2 THEN 'qradar' ELSE 'generic' END AS source,
  CASE id % 6 WHEN 0 THEN 'WinEventLog:Security' WHEN 1 THEN 'DeviceNetworkEvents' WHEN 2 THEN CASE WHEN k % 2 = 0 THEN 'Fw-Proxy' ELSE 'SRV-A.corp' END
    WHEN 3 THEN 'Gate' WHEN 4 THEN 'Mail' ELSE 'sshd' END AS origin,
  CASE id % 6 WHEN 0 THEN {auth} WHEN 1 THEN {net} WHEN 2 THEN {qclass} WHEN 3 THEN {net} WHEN 4 THEN {file} ELSE {auth} END AS class_name,
  CASE id % 6 WHEN 0 THEN CASE WHEN {bad} THEN 'logon_failed' WHEN k % 3 > 0 THEN 'logon_remote' ELSE 'logon' END
    WHEN 1 THEN CASE WHEN {bad} THEN 'blocked' ELSE 'connect' END
    WHEN 2 THEN CASE k % 4 WHEN 0 THEN CASE WHEN {bad} THEN 'logon_failed' ELSE 'logon' END WHEN 1 THEN 'create'
      ELSE CASE WHEN {bad} THEN 'blocked' ELSE 'connect' END END
    WHEN 3 THEN CASE WHEN {bad} THEN 'blocked' ELSE 'connect' END WHEN 4 THEN 'create'
    ELSE CASE WHEN {bad} THEN 'logon_failed' ELSE 'logon' END END AS activity,
  CAST(CASE id % 6 WHEN 0 THEN CASE WHEN {bad} THEN 3 ELSE 2 END WHEN 1 THEN CASE WHEN k % 2 = 0 THEN 3 ELSE 2 END
    WHEN 2 THEN CASE WHEN k % 4 >= 2 THEN greatest(3, {magnitude}) ELSE {magnitude} END
    WHEN 3 THEN greatest(3, {cef_sev}) WHEN 4 THEN 2
    ELSE CASE WHEN {bad} THEN 4 ELSE 2 END END AS INTEGER) AS severity,
  CASE WHEN {bad} AND id % 6 <> 4 THEN 'failure' ELSE 'success' END AS status,
  epoch_us(CASE id % 6 WHEN 0 THEN ts WHEN 1 THEN ts WHEN 2 THEN date_trunc('millisecond', ts) ELSE date_trunc('second', ts) END) AS time,
  CASE id % 6 WHEN 0 THEN 'wks-' || u WHEN 1 THEN 'srv-' || k WHEN 2 THEN CASE WHEN k % 2 = 1 THEN 'srv-a' END WHEN 3 THEN 'gate-1'
    WHEN 5 THEN 'box-' || k END AS device,
  CASE id % 6 WHEN 0 THEN '10.0.0.' || k WHEN 2 THEN '10.2.0.' || k WHEN 3 THEN '10.3.0.' || k WHEN 4 THEN '10.4.0.' || k END AS src_ip,
  CASE id % 6 WHEN 1 THEN CASE WHEN k % 2 = 0 THEN '203.0.113.' ELSE '10.1.1.' END || k WHEN 2 THEN '198.51.100.' || k
    WHEN 3 THEN '198.51.100.' || k END AS dst_ip,
  CASE WHEN id % 6 = 1 THEN 'x' || k || '.example.com' END AS domain,
  CASE WHEN id % 6 = 0 AND {bad} THEN 'T1110.001' WHEN id % 6 = 0 AND k % 3 = 1 THEN 'T1021.002' WHEN id % 6 = 0 AND k % 3 = 2 THEN 'T1021.001'
    WHEN id % 6 = 2 AND k % 4 = 0 AND {bad} THEN 'T1110' WHEN id % 6 = 2 AND k % 4 >= 2 AND NOT ({bad}) THEN 'T1071.001' ELSE '' END AS techniques
FROM b"""


@query(_expected())
def normalized_vendor_lines(spark, sf):
    events = n.normalize(textlogs.parse_lines(vendor_lines(spark, sf)), INGEST)
    return events.select(
        F.coalesce("actor.user", "message").alias("key"), "source", "origin", "class_name", "activity", "severity", "status",
        micros("time").alias("time"), F.col("device.hostname").alias("device"), F.col("src.ip").alias("src_ip"),
        F.col("dst.ip").alias("dst_ip"), "domain", F.array_join(F.col("mitre.id"), ",").alias("techniques"))


@query("""SELECT CASE event_id % 6 WHEN 3 THEN 'cef' WHEN 4 THEN 'leef' WHEN 5 THEN 'syslog' ELSE 'json' END AS format, count(*) AS lines
  FROM events GROUP BY 1""")
def line_formats(spark, sf):
    return textlogs.with_format(vendor_lines(spark, sf)).groupBy("format").agg(F.count(F.lit(1)).alias("lines"))


@query("""SELECT CASE event_id % 6 WHEN 0 THEN 'splunk' WHEN 1 THEN 'sentinel' WHEN 2 THEN 'qradar' ELSE 'generic' END AS source,
  CAST(2 * count(*) AS BIGINT) AS normalized, count(*) AS added, count(*) AS duplicates,
  CAST(CASE WHEN min(event_id % 6) >= 3 THEN 2 * count(*) ELSE 0 END AS BIGINT) AS unmatched, (SELECT 2 * count(*) FROM events) AS read,
  (SELECT count(*) FROM events) AS total FROM events GROUP BY 1""")
def ingest_accounting(spark, sf):
    lines = vendor_lines(spark, sf)
    read = textlogs.parse_lines(lines.unionByName(lines))
    found = n.ingest_accounting(read, n.normalize(read, INGEST))
    return found.groupBy("source").agg(*[F.sum(c).alias(c) for c in ("normalized", "added", "duplicates", "unmatched")],
                                       F.max("read").alias("read"), F.max("total").alias("total"))


@query("""SELECT CAST(event_id AS VARCHAR) AS id, event_type AS kind, 'Sign' || (event_id % 3) AS type FROM events WHERE event_id % 4 <> 3""")
def unwrapped_envelopes(spark, sf):
    """Rows wrapped in four envelope shapes (search hits, result list, tables, finished search lines) and read back."""
    w.tune(spark)
    body = """'{"id": "', CAST(event_id AS STRING), '", "kind": "', event_type, '", "Type": "Sign', CAST(event_id % 3 AS STRING), '"}'"""
    spread(w.table(spark, sf, "events")).createOrReplaceTempView("driver_events")
    rows = spark.sql(f"""SELECT event_id % 4 AS shape, 'derived' AS origin_file, CASE event_id % 4
      WHEN 0 THEN concat('{{"took": 1, "hits": {{"hits": [{{"_source": ', {body}, '}}]}}}}')
      WHEN 1 THEN concat('{{"count": 1, "records": [', {body}, ', 7]}}')
      WHEN 2 THEN concat('{{"tables": [{{"name": "Sign', CAST(event_id % 3 AS STRING), '", "columns": [{{"name": "id"}}, {{"name": "kind"}}],
        "rows": [["', CAST(event_id AS STRING), '", "', event_type, '"]]}}]}}')
      ELSE 'not json' END AS line FROM driver_events""")
    return records.parse_ndjson(rows.drop("shape")).select(
        *[F.try_element_at("record", F.lit(k)).alias(a) for k, a in (("id", "id"), ("kind", "kind"), ("Type", "type"))])


@query("""SELECT CAST(event_id AS VARCHAR) AS id, event_type AS kind FROM events WHERE event_id % 3 <> 0
  UNION ALL SELECT CAST(event_id AS VARCHAR), 'second' FROM events WHERE event_id % 3 = 2""")
def finished_search_results(spark, sf):
    w.tune(spark)
    item = """'{"id": "', CAST(event_id AS STRING), '", "kind": "', event_type, '"}'"""
    spread(w.table(spark, sf, "events")).createOrReplaceTempView("driver_events")
    lines = spark.sql(f"""SELECT 'derived' AS origin_file, CASE event_id % 3
      WHEN 0 THEN concat('{{"preview": true, "result": ', {item}, '}}')
      WHEN 1 THEN concat('{{"preview": false, "result": ', {item}, '}}')
      ELSE concat('{{"results": [', {item}, ', {{"id": "', CAST(event_id AS STRING), '", "kind": "second"}}]}}') END AS line FROM driver_events""")
    return records.parse_search_export(lines).select(
        F.try_element_at("record", F.lit("id")).alias("id"), F.try_element_at("record", F.lit("kind")).alias("kind"))


@query("SELECT count(*) FILTER (WHERE event_id % 4 = 3) AS rejected FROM events")
def rejected_lines(spark, sf):
    w.tune(spark)
    rows = w.table(spark, sf, "events").select(
        F.when(F.col("event_id") % 4 == 3, F.concat(F.lit("{bad "), "event_type")).otherwise(F.col("props")).alias("line"))
    return records.ndjson_rejects(rows).agg(F.count(F.lit(1)).alias("rejected"))


def _exports(spark, sf, shapes: dict[str, str]) -> str:
    """Files of the events, each in the shape of its remainder; (name of a folder, line) by shape."""
    w.tune(spark)
    w.table(spark, sf, "events").createOrReplaceTempView("driver_events")
    path = new_folder(spark)
    for k, (name, line) in enumerate(shapes.items()):
        spark.sql(f"SELECT {line} AS value FROM driver_events WHERE event_id % {len(shapes)} = {k}").write.text(f"{path}/{name}")
    return path


PAIR = """concat('{"id": "', CAST(event_id AS STRING), '", "kind": "', event_type, '"}')"""


@query("""SELECT CAST(event_id AS VARCHAR) AS id, event_type AS kind, 'record' AS what FROM events WHERE event_id % 4 < 3
  UNION ALL SELECT CAST(event_id AS VARCHAR), 'twin', 'record' FROM events WHERE event_id % 4 = 1
  UNION ALL SELECT CAST(event_id AS VARCHAR), NULL, 'reject' FROM events WHERE event_id % 4 = 2
  UNION ALL SELECT NULL, 'line ' || event_id || ' of ' || event_type, 'record' FROM events WHERE event_id % 4 = 3""")
def mixed_text_records(spark, sf):
    """Text files told apart by content: one value a line, several values, lists with a number in them, log lines."""
    from sleuthgraph.sources import folder
    found = folder.Folder(spark, _exports(spark, sf, {
        "values": PAIR, "glued": PAIR[:-1] + """, '{"kind": "twin", "id": "', CAST(event_id AS STRING), '"}')""",
        "lists": f"concat('[', {PAIR}, ', ', CAST(event_id AS STRING), ']')",
        "logs": "concat('<13>line ', CAST(event_id AS STRING), ' of ', event_type)"}))
    field = lambda k: F.try_element_at("record", F.lit(k))
    records_ = found.records().select(field("id").alias("id"), F.coalesce(field("kind"), field("message")).alias("kind"), F.lit("record").alias("what"))
    return records_.unionByName(found.rejects().select(F.col("line").alias("id"), F.lit(None).cast("string").alias("kind"), F.lit("reject").alias("what")))


@query("""SELECT CAST(event_id AS VARCHAR) AS id, event_type AS kind, 'user ' || user_id || CASE WHEN event_id % 2 = 0 THEN ', "x"' ELSE '; y' END AS note
  FROM events""")
def delimited_records(spark, sf):
    """Tables under two headers with other marks and column orders, told apart by content; quoted cells hold marks and quotes."""
    w.tune(spark)
    rows = w.table(spark, sf, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("kind"), F.concat(
        F.lit("user "), "user_id", F.when(F.col("event_id") % 2 == 0, ', "x"').otherwise("; y")).alias("note"), (F.col("event_id") % 2).alias("half"))
    path = new_folder(spark)
    rows.where("half = 0").select("id", "kind", "note").write.csv(f"{path}/a", header=True, escape='"')
    rows.where("half = 1").select("note", "id", "kind").write.csv(f"{path}/b", header=True, sep=";", escape='"')
    return records.read_folder(spark, path).select(*[F.try_element_at("record", F.lit(k)).alias(k) for k in ("id", "kind", "note")])
