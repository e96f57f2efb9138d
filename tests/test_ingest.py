import json
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from conftest import INGEST
from sleuthgraph.operators import events as e
from sleuthgraph.operators.normalize import ingest_accounting, normalize
from sleuthgraph.sources import records, sinks, textlogs


def lines(spark, *texts):
    return spark.createDataFrame([(t, "x") for t in texts], "line string, origin_file string")


def one(spark, record):
    text = record if isinstance(record, str) else json.dumps(record)
    rows = normalize(textlogs.parse_lines(lines(spark, text)), INGEST).collect()
    assert len(rows) == 1
    return rows[0]


def test_windows_process_creation(spark):
    r = one(spark, {"_time": "2025-02-01T10:00:00Z", "sourcetype": "XmlWinEventLog:Sysmon", "EventCode": "1", "Image": "C:\\T\\x.exe",
                    "CommandLine": "powershell -enc AAAA", "User": "CORP\\ann", "Hashes": "SHA256=ABC,MD5=DEF", "ProcessId": "7", "host": "W1.corp"})
    assert (r.class_name, r.severity, r.status) == ("Process Activity", 3, "success")
    assert (r.process.name, r.process.pid, r.file.sha256, r.file.md5, r.device.hostname) == ("x.exe", 7, "abc", "def", "w1")
    assert [t.id for t in r.mitre] == ["T1027", "T1059.001"]


def test_low_codes_need_sysmon(spark):
    assert one(spark, {"_time": "2025-02-01T10:00:00Z", "sourcetype": "app", "EventCode": "1", "user": "ann"}).class_name == "Authentication"


def test_dns_and_account(spark):
    r = one(spark, {"_time": "1738400000", "sourcetype": "sysmon", "EventCode": 22, "QueryName": "evil.example.org", "QueryResults": "type: 5 x;9.9.9.9;"})
    assert (r.class_name, r.domain, r.dst.ip, r.severity) == ("DNS Activity", "evil.example.org", "9.9.9.9", 1)
    r = one(spark, {"_time": "1738400000", "sourcetype": "sec", "EventCode": "4720", "New_Account_Name": "mallory"})
    assert (r.class_name, r.severity, r.mitre[0].id) == ("Account Change", 4, "T1136")


def test_alert_entities(spark):
    entities = [{"Type": "host", "HostName": "W1.corp"}, {"Type": "host", "HostName": "W2"}, {"Type": "account", "Name": "ann", "UPNSuffix": "corp.com"},
                {"Type": "account", "Name": "bob"}, {"Type": "ip", "Address": "9.9.9.9"}, {"Type": "ip", "Address": "8.8.8.8"},
                {"Type": "file", "Name": "m.exe", "Value": "AB"}, {"Type": "url", "Url": "https://evil.example.org/a"}]
    r = one(spark, {"Type": "SecurityAlert", "TimeGenerated": "2025-02-01T10:00:00Z", "AlertName": "Bad", "AlertSeverity": "High",
                    "Techniques": "T1003.001, T1041", "Entities": json.dumps(entities)})
    assert (r.class_name, r.severity, r.status, r.device.hostname, r.actor.user, r.actor.domain, r.dst.ip) == (
        "Detection Finding", 4, "unknown", "w1", "ann", "corp.com", "9.9.9.9")
    assert (r.file.name, r.file.sha256, r.domain) == ("m.exe", "ab", "evil.example.org")
    assert {(x.type, x.value) for x in r.extra_entities} == {("host", "w2"), ("user", "bob"), ("ip", "8.8.8.8")}
    assert [t.tactic for t in r.mitre] == ["credential-access", "exfiltration"]


def test_mail_and_signin(spark):
    r = one(spark, {"Type": "EmailEvents", "TimeGenerated": "2025-02-01T10:00:00Z", "SenderFromAddress": "a@b.org", "DeliveryAction": "Delivered", "ThreatTypes": "Phish"})
    assert (r.class_name, r.severity, r.status, r.email.sender, r.mitre[0].id) == ("Email Activity", 4, "success", "a@b.org", "T1566.002")
    r = one(spark, {"TimeGenerated": "2025-02-01T10:00:00Z", "UserPrincipalName": "ann@corp.com", "ResultType": 50126, "IPAddress": "9.9.9.9", "AppDisplayName": "Portal"})
    assert (r.activity, r.status, r.app, r.src.ip, r.mitre[0].id) == ("logon_failed", "failure", "Portal", "9.9.9.9", "T1110")


def test_guess_by_fields_and_offense(spark):
    assert one(spark, {"TimeGenerated": "2025-02-01T10:00:00Z", "DeviceName": "w1", "LogonType": "Network", "ActionType": "LogonSuccess"}).activity == "logon_remote"
    r = one(spark, {"Offense_Type": "1", "offense_source": "9.9.9.9", "magnitude": 8, "description": "many", "start_time": 1738400000000})
    assert (r.class_name, r.origin, r.src.ip, r.severity) == ("Detection Finding", "offense", "9.9.9.9", 4)


def test_unknown_json_goes_to_generic(spark):
    r = one(spark, {"message": "hello there", "severity": "critical"})
    assert (r.source, r.class_name, r.activity, r.severity, r.time_is_fallback, r.event_date) == ("generic", "Detection Finding", "alert", 5, True, None)
    assert r.time.year == INGEST.year


def test_text_formats(spark):
    cef = one(spark, r"x CEF:0|A\|B|P|1|7|Na\=me|3|rt=Aug 19 2025 09:16:02 filePath=C:\\new\\t.exe fileHash=" + "a" * 64 + r" msg=one two act=blocked")
    assert (cef.origin, cef.file.path, cef.file.sha256, cef.status) == ("P", "C:\\new\\t.exe", "a" * 64, "failure")
    leef = one(spark, "LEEF:1.0|A|P|1|7|src=1.2.3.4\tusrName=ann\tdevTime=Aug 19 2025 09:16:02")
    assert (leef.src.ip, leef.actor.user, leef.time_is_fallback) == ("1.2.3.4", "ann", False)
    assert one(spark, "LEEF:2.0|A|P|1|7|^|src=1.2.3.4^usrName=ann").src.ip == "1.2.3.4"
    new = one(spark, "<34>1 2025-08-19T09:16:02Z box app 12 ID7 su failed for ann")
    assert (new.origin, new.device.hostname, new.severity, new.message) == ("app", "box", 4, "su failed for ann")
    assert one(spark, "no shape at all").message == "no shape at all"


def test_files_and_totals(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"results": [{"a": 1}, {"a": 2}, 3]}))
    (tmp_path / "b.ndjson").write_text('[\n{"a": 1},\nbroken\n{"a": 2}\n]\n')
    (tmp_path / "c.csv").write_text('a,b\n1,"x,y"\n2,z,surplus\n')
    (tmp_path / "d.log").write_text("<13>Aug 19 09:16:02 box tag: hi\n\n")
    found = records.read_folder(spark, str(tmp_path))
    totals = {r.origin_file.rsplit("/", 1)[-1]: r.records for r in records.totals_by_file(found).collect()}
    assert totals == {"a.json": 2, "b.ndjson": 2, "c.csv": 2, "d.log": 1}
    assert {r.record["b"] for r in found.where(F.map_contains_key("record", F.lit("b"))).collect()} == {"x,y", "z"}
    assert records.limited(found, 3).count() == 3
    rejected = records.ndjson_rejects(lines(spark, "[", '{"a": 1},', "broken")).collect()
    assert [r.line for r in rejected] == ["broken"]


def test_repeated_keys_last_wins(spark):
    row = textlogs.parse_lines(lines(spark, "CEF:0|A|P|1|7|n|3|msg=first msg=second src=1.1.1.1")).first().record
    assert row["message"] == "second" and row["src_ip"] == "1.1.1.1"


def test_custom_format_first(spark):
    def project(frame):
        return frame.select(F.lit("u1").alias("uid"), F.lit("own").alias("source"))
    rows = textlogs.parse_lines(lines(spark, '{"mine": "1"}', '{"x": "1"}'))
    got = normalize(rows, INGEST, custom=[(F.map_contains_key("record", F.lit("mine")), project)])
    assert {r.source for r in got.collect()} == {"own", "generic"}


def test_redaction_any_depth(spark):
    raw = json.dumps({"a": {"b": [{"api_key": {"x": [1, "}"]}, "ok": "keep"}]}, "Password": "p\"q", "client-secret": 5, "token": None, "note": "secret: no"})
    out = json.loads(spark.createDataFrame([(raw,)], "raw string").select(e.redact_json(F.col("raw")).alias("r")).first().r)
    mark = "***redacted***"
    assert out == {"a": {"b": [{"api_key": mark, "ok": "keep"}]}, "Password": mark, "client-secret": mark, "token": mark, "note": "secret: no"}


def test_append_adds_only_new(spark, tmp_path):
    texts = ['{"message": "a", "time": "2025-01-01 00:00:00"}', '{"message": "b", "time": "2025-01-02 00:00:00"}', '{"message": "no time"}']
    batch = normalize(textlogs.parse_lines(lines(spark, *texts, texts[0])), INGEST)
    table = str(tmp_path / "events")
    sinks.append_events(spark, batch, table)
    sinks.append_events(spark, batch, table)
    assert spark.read.parquet(table).count() == 3
    read = textlogs.parse_lines(lines(spark, *texts, texts[0]))
    row = ingest_accounting(read, batch).first()
    assert (row.read, row.normalized, row.added, row.duplicates) == (4, 4, 3, 1)


def test_stream_equals_batch(spark, tmp_path):
    from sleuthgraph.streaming import ingest
    source, table = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.log").write_text("<13>Aug 19 09:16:02 box sshd[1]: Failed password for ann\n" * 2 + '{"message": "b", "time": "2025-08-19 10:00:00"}\n')
    stream = ingest.line_stream(spark, str(source))
    query = ingest.append_stream(stream, table, str(tmp_path / "cp"), INGEST)
    assert query.awaitTermination(120)
    got = {r.uid for r in spark.read.parquet(table).collect()}
    want = {r.uid for r in normalize(textlogs.read_lines(spark, str(source)), INGEST).collect()}
    assert got == want and len(got) == 2


@pytest.mark.parametrize("copies", [5000])
def test_hot_duplicate(spark, copies):
    rows = spark.range(copies).selectExpr("'same' AS uid", "timestamp_seconds(id) AS time", "cast(id as string) AS origin")
    assert [r.origin for r in e.deduplicate(rows).collect()] == ["0"]


def test_late_stream_events_are_stored(spark, tmp_path):
    from sleuthgraph.streaming import ingest
    source, table = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for name, day in (("a", "2090-01-01"), ("b", "2025-01-03"), ("c", "2025-01-01")):
        (source / f"{name}.log").write_text(f'{{"message": "{name}", "time": "{day} 00:00:00"}}\n')
        query = ingest.append_stream(ingest.line_stream(spark, str(source)), table, str(tmp_path / "cp"))
        assert query.awaitTermination(120)
    assert sorted(r.message for r in spark.read.parquet(table).collect()) == ["a", "b", "c"]


def test_no_line_vanishes(spark):
    texts = ["[2024-01-01 10:00] sshd: Failed password", '{"a": broken', "[1, 2]", '{"a": "1"}', "CEF:0|A" + "\\\\" * 17 + "|P|1|7|n|3|msg=x"]
    rows = textlogs.parse_lines(lines(spark, *texts)).collect()
    assert len(rows) == len(texts)
    got = {r.raw: r.record for r in rows}
    assert got[texts[0]]["message"].startswith("[2024") or "Failed" in got[texts[0]]["message"]
    assert got[texts[4]]["__format__"] == "cef" and got[texts[4]]["device_product"] == "P"


def test_files_by_content(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n{"a": 2}\nbroken\n{"a": 3}\n')
    (tmp_path / "b.json").write_text('{"value": [{"a": 4}]}')
    (tmp_path / "c.csv").write_text('time,src_ip,user\n2024-01-01,1.1.1.1,ann\n')
    (tmp_path / "d.csv").write_text('user,time,dest_ip\nbob,2024-01-02,8.8.8.8\n"x\ny",2024-01-03,9.9.9.9\n')
    found = records.read_folder(spark, str(tmp_path)).collect()
    assert sorted(r.record["a"] for r in found if "a" in r.record) == ["1", "2", "3", "4"]
    assert [r.line for r in records.folder_rejects(spark, str(tmp_path)).collect()] == ["broken"]
    whole = records.read_delimited(spark, str(tmp_path), multi_line=True, pathGlobFilter="*.csv").collect()
    assert {(r.record["user"], r.record.get("src_ip"), r.record.get("dest_ip")) for r in whole} == {
        ("ann", "1.1.1.1", None), ("bob", None, "8.8.8.8"), ("x\ny", None, "9.9.9.9")}


@pytest.mark.parametrize("depth", [12, 40, 900])
def test_redaction_counts_depth(spark, depth):
    raw = '{"password": ' + '["a", [' * depth + '"deep secret"' + "]" * (2 * depth) + ', "keep": "yes"}'
    out = spark.createDataFrame([(raw,)], "raw string").select(e.redact_json(F.col("raw")).alias("r")).first().r
    assert out == '{"password": "***redacted***", "keep": "yes"}'


def test_redaction_of_text_lines(spark):
    batch = normalize(textlogs.parse_lines(lines(spark, "CEF:0|A|P|1|7|n|3|suser=ann password=hunter2 msg=ok", "LEEF:1.0|A|P|1|7|token=abc\tsrc=1.2.3.4",
                                                 "<13>Aug 19 09:16:02 box app: api_key: zzz9 done")), INGEST)
    raws = " ".join(r.raw for r in e.redact(batch).collect())
    assert not any(s in raws for s in ("hunter2", "abc", "zzz9")) and "msg=ok" in raws and "src=1.2.3.4" in raws


@pytest.mark.parametrize("raw, want", [
    ("[2024-01-01 10:00] sshd: password=hunter2 ok", "[2024-01-01 10:00] sshd: password=*** ok"),
    ("[4711] sshd: password=hunter2", "[4711] sshd: password=***"),
    ("[1]] sshd: password=hunter2", "[1]] sshd: password=***"),
    ('{"a": 1} token: hunter2', '{"a": 1} token: ***'),
    ('{"password": "hunter2', '{"password": "***"'),
    ('{"password": "hunter2\\', '{"password": "***"'),
    ('{"a": broken, "password": "hunter2", "b": 1}', '{"a": broken, "password": "***", "b": 1}'),
    ('{"password": ["hunter2", ["hunter2', '{"password": "***"'),
    ('host app: {"password": "hunter2 hunter2", "b": "x"}', 'host app: {"password": "***", "b": "x"}'),
    ('host app: {"password": {"x": ["hunter2"]}, "b": "x"}', 'host app: {"password": "***", "b": "x"}'),
    ("{'password': 'hunter2 hunter2', 'b': 1}", "{'password': ***, 'b': 1}"),
    (r'app: {\"password\": \"hunter2 hunter2\", \"b\": 1}', r'app: {\"password\": ***, \"b\": 1}'),
    ('"token=hunter2"', '"token=***'),
    ('{"note": "secret: no", "password": "hunter2"}', '{"note": "secret: no", "password": "***"}'),
    ('[{"note": "token=x", "my pwd 2": null}]', '[{"note": "token=x", "my pwd 2": "***"}]'),
    ("[a] password=hunter2 " + '"' + "x" * 200000, "[a] password=*** " + '"' + "x" * 200000),
    ('{"note": "' + "y" * 200000 + '", "password": "hunter2"}', '{"note": "' + "y" * 200000 + '", "password": "***"}'),
    ("Authorization: Bearer abc.def.ghi ok", "Authorization: *** ok"),
    ("proxy-authorization=Basic Zm9vOmJhcg== x", "proxy-authorization=*** x"),
    ('Authorization: Digest username="ann", response="6629fae", qop=auth\nHost: a', "Authorization: ***\nHost: a"),
    ("Authorization: AWS4-HMAC-SHA256 Credential=AK/1, SignedHeaders=host, Signature=fe5f rest", "Authorization: *** rest"),
    ("GET / cookie: a=b; c=d; e=f\nHost: a", "GET / cookie: ***\nHost: a"),
    ("Set-Cookie: sid=38afes7a8; HttpOnly; Path=/", "Set-Cookie: ***"),
    ("tool --password hunter2 --user ann", "tool --password *** --user ann"),
    ("tool --api-key 'hun ter2' -token abc next", "tool --api-key *** -token *** next"),
    ("curl https://u:secretpw@host/a?b=c ftp://bob:x@h", "curl https://u:***@host/a?b=c ftp://bob:***@h"),
    ('{"headers":"Authorization: Basic Zm9v","b":"x"}', '{"headers":"Authorization: ***","b":"x"}'),
    (r'{"h":"Authorization: Digest username=\"x\", response=\"y\"\r\nCookie: a=b; c=d\r\nHost: a"}', r'{"h":"Authorization: ***\r\nCookie: ***\r\nHost: a"}'),
    ('{"cmd":"tool --password hunter2 -x","url":"https://u:pw@h/"}', '{"cmd":"tool --password *** -x","url":"https://u:***@h/"}'),
    ('{"note":"the cookie: none","time":"10:00"}', '{"note":"the cookie: none","time":"10:00"}'),
    (None, None)])
def test_redaction_of_what_is_not_whole_json(spark, raw, want):
    got = e.redact(spark.createDataFrame([(raw,)], "raw string")).first().raw
    assert got == (want and want.replace("***", "***redacted***"))


def test_one_uid_once_over_years(spark, tmp_path):
    import datetime as dt
    table, line = str(tmp_path / "events"), "<13>Aug 19 09:16:02 box app: hi"
    for year in (2024, 2025):
        moment = dt.datetime(year, 12, 1, tzinfo=dt.timezone.utc)
        sinks.append_events(spark, normalize(textlogs.parse_lines(lines(spark, line)), moment), table)
    assert spark.read.parquet(table).count() == 1


def test_signature_far_into_a_message(spark):
    from sleuthgraph.operators import threat
    r = normalize(textlogs.parse_lines(lines(spark, json.dumps({"message": "x" * 5000 + " vssadmin delete shadows /all"}))), INGEST)
    assert len(r.first().message) > 5000 and threat.behaviour_hits(r).count() > 0


def test_folder_by_content(spark, tmp_path):
    write = lambda name, text: (tmp_path / name).write_text(text)
    write("UPPER.JSON", '{"a": "u1"}\n{"a": "u2"}\n')
    write("glued.json", '{"a": "g1"}{"a": "g2"} [{"a": "} {"}]\n7 {"a": "lost"}\n7\n"x"\nnull\n[1, {"a": "g3"}]\n')
    write("doc in a [log] 100%.log", '{\n  "results": [\n    {"a": "d1"},\n    {"a": "d2"}, 5\n  ]\n}\n')
    write("list.txt", '[\n{"a": "l1"},\n{\n"a": "l2"}\n]\n')
    write("cut.json", '{"a": "c1",\n"b"\n{"a": "c2"}\n')
    write("table.txt", "﻿time;a;user\n2024-01-01;t1;ann\n2024-01-02;\"t;2\";bob;surplus\ntime;a;user\n2024-01-03;t3\n")
    write("table.log", "a,b,c\n1,2,3\n")
    write("two.CSV", "a,a\nfirst,p1\n")
    write("broken.csv", 'a,note,z\nq1,"two\nlines",1\n')
    write("plain.txt", "a message, with commas, user=ann, and more\n<13>Aug 19 09:16:02 box tag: hi\n")
    write("gate.log", "CEF:0|A|P|1|7|n,a,m,e|3|src=1.1.1.1\n")
    write("blank.json", "\n  \n")
    write("image.PNG", "not read")
    (tmp_path / "deep").mkdir()
    write("deep/more.ndjson", 'broken, first, line\n{"a": "m1"},\n')
    rows = records.read_folder(spark, str(tmp_path)).collect()
    got = {}
    for r in rows:
        got.setdefault(unquote(r.origin_file).rsplit("/", 1)[-1], []).append(r.record)
    values = {name: sorted(str(x.get("a")) for x in found) for name, found in got.items()}
    assert values == {"doc in a [log] 100%.log": ["d1", "d2"],
                      "UPPER.JSON": ["u1", "u2"], "glued.json": ["g1", "g2", "g3", "} {"], "list.txt": ["l1", "l2"], "cut.json": ["c2"],
                      "table.txt": ["t1", "t3", "t;2"], "table.log": ["1"], "two.CSV": ["p1"], "broken.csv": ["q1"],
                      "plain.txt": ["None", "None"], "gate.log": ["None"], "more.ndjson": ["m1"]}
    assert {r["user"] for r in got["table.txt"]} == {"ann", "bob", None} and got["broken.csv"][0]["note"] == "two\nlines"
    assert got["gate.log"][0]["src_ip"] == "1.1.1.1" and len(got["plain.txt"]) == 2
    left = {}
    for r in records.folder_rejects(spark, str(tmp_path)).collect():
        left.setdefault(unquote(r.origin_file).rsplit("/", 1)[-1], []).append(r.line)
    assert {k: sorted(v) for k, v in left.items()} == {
        "glued.json": sorted(['7 {"a": "lost"}', "7", "x", "null", "1"]), "cut.json": sorted(['{"a": "c1",', "b"]),
         "more.ndjson": ["broken, first, line"], "doc in a [log] 100%.log": ["5"]}
    from sleuthgraph.sources.folder import skipped_files
    assert [(r.path.rsplit("/", 1)[-1], r.suffix) for r in skipped_files(spark, str(tmp_path)).collect()] == [("image.PNG", "png")]


def test_large_line_file_is_split(spark, tmp_path):
    (tmp_path / "a.json").write_text("".join(f'{{"a": {k}, "pad": "{"x" * 200}"}}\n' for k in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        found = records.read_folder(spark, str(tmp_path))
        assert found.count() == 4000 and found.rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_append_over_many_days(spark, tmp_path):
    """400 stored days: what a batch reads of them is filtered by its uids without a shuffle, and pruned by day."""
    import datetime as dt
    table, base = str(tmp_path / "events"), dt.datetime(2023, 1, 1)
    text = lambda k: json.dumps({"message": f"m{k}", "time": (base + dt.timedelta(days=k % 400)).strftime("%Y-%m-%d 00:00:00")})
    stored = normalize(textlogs.parse_lines(lines(spark, *[text(k) for k in range(800)])), INGEST)
    account = sinks.append_events(spark, stored, table)
    assert account["generic"] == {"normalized": 800, "added": 800, "duplicates": 0, "unmatched": 800} and account["splunk"]["added"] == 0
    odd = ['{"message": "no time"}', "<13>Feb 29 09:16:02 box app: leap", "<13>Jan 2 09:16:02 box app: yearless"]
    batch = [*[text(k) for k in (5, 6, 6, 1200)], *odd]
    read = textlogs.parse_lines(lines(spark, *batch))
    for year, added in ((2024, 4), (2025, 0)):
        events = normalize(read, dt.datetime(year, 12, 1, tzinfo=dt.timezone.utc))
        want = ingest_accounting(read, events, spark.read.parquet(table)).groupBy("source").sum("normalized", "added", "duplicates", "unmatched").first()
        account = sinks.append_events(spark, events, table, by_record=True)
        assert account["all"]["added"] == added and tuple(account["generic"].values()) == tuple(want)[1:]
    assert spark.read.parquet(table).count() == 804 == spark.read.parquet(table).select("uid").distinct().count()
    fresh = sinks.cut(normalize(textlogs.parse_lines(lines(spark, text(5))), INGEST))
    plan = sinks.known_uids(spark.read.parquet(table).where(sinks._possible_days(fresh)), fresh)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan and "PartitionFilters: [(isnull(event_date" in plan


def test_stream_of_a_folder(spark, tmp_path):
    """Every value that lands is an event or a reject."""
    from sleuthgraph.streaming import ingest
    source, table, side = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "side")
    source.mkdir()
    (source / "a b.ndjson").write_text('{"message": "1"}{"message": "2"}\nbroken\n7\n')
    (source / "c.JSON").write_text('{\n"results": [{"message": "3"},\n {"message": "3"}, "x"]}\n')
    (source / "d.txt").write_text("time,message,user\n2024-01-01 00:00:00,4,ann\n")
    (source / "e.log").write_text("hello 5\n")
    start = lambda: ingest.append_folder_stream(spark, str(source), table, str(tmp_path / "cp"), INGEST, side)
    assert start().awaitTermination(200)
    (source / "f.log").write_text("hello 5\nhello 6\n")
    assert start().awaitTermination(200)
    events, left = spark.read.parquet(table), spark.read.json(f"{side}/rejects")
    assert sorted(r.message[-1] for r in events.collect()) == ["1", "2", "3", "4", "5", "6"]
    assert sorted(r.line for r in left.collect()) == ["7", "broken", "x"]
    account = spark.read.json(f"{side}/accounts").groupBy().sum("normalized", "added", "duplicates").first()
    assert tuple(account) == (8, 6, 2)


def test_stream_of_lines_sets_rejects_aside(spark, tmp_path):
    from sleuthgraph.streaming import ingest
    source, side = tmp_path / "in", str(tmp_path / "side")
    source.mkdir()
    (source / "a.ndjson").write_text('{"message": "1"}\nbroken\n[{"message": "2"}, 3]\n')
    (source / "b.log").write_text("plain\n")
    query = ingest.append_stream(ingest.line_stream(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "cp"), INGEST, side)
    assert query.awaitTermination(200)
    assert sorted(r.message for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2", "plain"]
    assert sorted(r.line for r in spark.read.json(f"{side}/rejects").collect()) == ["3", "broken"]
