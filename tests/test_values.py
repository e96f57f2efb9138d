import datetime as dt

import pytest
from pyspark.sql import functions as F

from sleuthgraph.functions import canon, values


def evaluate(spark, column, items):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r.y for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize("step, cases", [
    (canon.canon_user, {"CORP\\Ann": "ann", "ann@corp.com": "ann", " ANN ": "ann", "SYSTEM": None, "NT AUTHORITY\\Local Service": None,
                        "WKS-01$": None, "-": None, "": None, "a\\b\\c": "c"}),
    (canon.canon_host, {"WKS-1.corp.local": "wks-1", "10.0.0.1": "10.0.0.1", ".host.": "host", "N/A": None, "fe80::1": "fe80::1"}),
    (canon.canon_path, {'"C:/Temp/A.EXE"': "c:\\temp\\a.exe", "-": None}),
    (canon.canon_domain, {"https://u:p@Evil.Example.org:8443/x?y": "evil.example.org", "host": None, "10.1.2.3": None,
                          "a_b.example.com": None, "c:\\temp": None, "x." + "a" * 64 + ".org": None, "ann@mail.example.com": "mail.example.com"}),
    (canon.basename, {"C:\\a\\b.exe": "b.exe", "/usr/bin/x/": "x", "\\": None}),
    (canon.device_class, {"SRV-DC01": "server", "fgt-perim": "firewall", "core-sw1": "router", "wks-1": "workstation"}),
])
def test_canonical_forms(spark, step, cases):
    assert evaluate(spark, step, list(cases)) == list(cases.values())


def test_private_addresses(spark):
    got = evaluate(spark, canon.is_private_ip, ["10.0.0.1", "172.16.0.1", "172.32.0.1", "192.168.9.9", "169.254.1.1", "127.0.0.1", "8.8.8.8", "fe80::1", None])
    assert got == [True, True, False, True, True, True, False, False, False]


@pytest.mark.parametrize("text", ["Aug 19 2025 09:16:02", "19 Aug 2025 09:16:02", "2025-08-19 09:16:02", "08/19/2025 09:16:02", "8/19/2025 9:16:02 AM",
                                  "2025-08-19T11:16:02+02:00", "1755594962", "1755594962000", "Aug 19 09:16:02", "Aug  19 09:16:02"])
def test_times(spark, text):
    got = evaluate(spark, lambda c: F.date_format(values.parse_time(c, 2025), "yyyy-MM-dd HH:mm:ss"), [text])
    assert got == ["2025-08-19 09:16:02"]


def test_unreadable_time_and_severity(spark):
    assert evaluate(spark, lambda c: values.parse_time(c, 2025), ["soon", "", None]) == [None] * 3
    assert evaluate(spark, values.parse_severity, ["High", "9", "5", "x", None, "99", "-1", "nan"]) == [4, 5, 3, 1, 1, 5, 0, 1]
    assert evaluate(spark, lambda c: values.parse_severity(c, 5), ["4", "informational"]) == [4, 1]
    assert evaluate(spark, values.to_int, ["12", " 7 ", "0x1a", "5.0", None]) == [12, 7, None, None, None]


def test_uid_ignores_key_order(spark):
    rows = spark.sql("SELECT map('a', '1', 'b', null) AS m UNION ALL SELECT map('b', null, 'a', '1') UNION ALL SELECT map('a', '2', 'b', null)")
    ids = [r.u for r in rows.select(values.make_uid(F.lit("splunk"), F.col("m")).alias("u")).collect()]
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 16


def test_moments():
    now = dt.datetime(2025, 3, 1, tzinfo=dt.timezone.utc)
    assert values.parse_moment("-24h", now) == now - dt.timedelta(days=1)
    assert values.parse_moment("-2w", now) == now - dt.timedelta(days=14)
    assert values.parse_moment("2025-01-01T00:00:00Z").year == 2025
    assert [values.parse_moment(x, now) for x in ("-5y", "-xh", "later", "", None)] == [None] * 5


def test_payloads(spark):
    assert evaluate(spark, values.decode_payload, ["aGVsbG8gd29ybGQ=", "plain text", "/wAA/wAB"])[:2] == ["hello world", "plain text"]


def test_command_names(spark):
    got = evaluate(spark, values.command_names, ['"C:\\Tools\\a.exe" -x "b.exe:s" | c.exe'])[0]
    assert {"a.exe", "b.exe:s", "b.exe", "c.exe", "-x"} == set(got)
