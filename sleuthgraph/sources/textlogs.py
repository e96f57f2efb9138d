"""CEF, LEEF and syslog lines as record maps, by regular expressions inside one projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canon, values
from .records import _lines, json_values, last_wins_map, marked, unwrap

# Short extension keys and their readable names (fixed values).
KEY_NAMES = {
    "src": "src_ip", "dst": "dest_ip", "spt": "src_port", "dpt": "dest_port",
    "suser": "src_user", "duser": "dest_user", "shost": "src_host", "dhost": "dest_host",
    "act": "action", "msg": "message", "proto": "protocol", "app": "application",
    "fname": "file_name", "filePath": "file_path", "fileHash": "file_hash",
    "request": "url", "requestMethod": "http_method", "dntdom": "dest_domain",
    "sntdom": "src_domain", "deviceProcessName": "process_name", "sproc": "process_name",
    "dproc": "dest_process_name", "rt": "time", "start": "time", "end": "end_time",
    "cat": "category", "devTime": "time", "devTimeFormat": "time_format", "usrName": "src_user",
    "srcPort": "src_port", "dstPort": "dest_port", "identSrc": "src_ip",
}

# One part of a header, read forward: characters up to a pipe, where a backslash takes the next one along.
_PART = r"(?:[^|\\]|\\.|\\$)*+"
CEF_START = r"(?s)^.*?CEF:(?=\d+\|)"
LEEF_START = r"(?s)^.*?LEEF:(?=[\d.]+\|)"
_EXT_KEY = r"[A-Za-z][A-Za-z0-9_.\[\]]*"
CEF_PAIR = rf"(?s)((?:^|\s){_EXT_KEY}=.*?(?=\s{_EXT_KEY}=|$))"
RFC5424 = r"(?s)^1\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s*(.*)$"
RFC3164 = r"(?s)^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^:\[]+)(?:\[\d+\])?:\s*(.*)$"
PRIORITY = r"(?s)^<(\d{1,3})>(.*)"


def _named(keys: Column) -> Column:
    names = values.literal_map(KEY_NAMES)
    return F.transform(keys, lambda k: F.coalesce(F.try_element_at(names, k), k))


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _unescape_value(text: Column) -> Column:
    """One pass over ``\\\\``, ``\\n``, ``\\=`` and ``\\|``."""
    held = F.replace(text, F.lit("\\\\"), F.lit("\u0000"))
    held = F.regexp_replace(F.replace(held, F.lit("\\n"), F.lit("\n")), r"\\([=|])", "$1")
    return F.replace(held, F.lit("\u0000"), F.lit("\\"))


def _header(line: Column, mark: str, start: str, limit: int | None = None) -> Column:
    """Pipe-separated parts after the format mark, null for other lines; with ``limit`` the last part is the rest."""
    body = F.regexp_replace(line, start, "")
    parts = F.regexp_extract_all(body, F.lit(rf"(?s)\G(?:^|\|)({_PART})"), F.lit(1))
    if limit:
        rest = F.regexp_replace(body, rf"(?s)^(?:{_PART}\|){{{limit - 1}}}", "")
        parts = F.when(F.size(parts) >= limit, F.concat(F.slice(parts, 1, limit - 1), F.array(rest))).otherwise(parts)
    return F.when(line.contains(mark) & line.rlike(start), parts)


def with_format(lines: DataFrame) -> DataFrame:
    """``format`` of each line by its own shape, with the values of JSON and the parts of CEF and LEEF headers."""
    line = F.col("line")
    parts = lines.withColumns({"_cef": _header(line, "CEF:", CEF_START, 8), "_leef": _header(line, "LEEF:", LEEF_START)})
    # JSON by content: a line that only begins like JSON is text
    parts = parts.withColumn("_values", F.when(line.rlike(r"(?s)^[\[{].*[\]}],?\s*$"), json_values(line)))
    return parts.withColumn("format", F.when(F.col("_values").isNotNull(), "json").when(F.size("_cef") == 8, "cef")
                            .when(F.size("_leef") >= 6, "leef").otherwise("syslog"))


def _pairs_of(pairs: Column, value) -> tuple[Column, Column]:
    keys = F.transform(pairs, lambda p: canon.strip(F.substring_index(p, "=", 1)))
    vals = F.transform(pairs, lambda p: value(canon.strip(F.regexp_replace(p, "(?s)^[^=]*=", ""))))
    return _named(keys), vals


def _cef_fields() -> tuple[Column, Column]:
    names = ["device_vendor", "device_product", "device_version", "signature_id", "name", "cef_severity"]
    keys, vals = _pairs_of(F.regexp_extract_all(F.get("_cef", F.lit(7)), F.lit(CEF_PAIR), F.lit(1)), _unescape_value)
    head = F.transform(F.slice("_cef", 2, 6), _unescape)
    return (F.concat(F.array(*[F.lit(n) for n in ["__format__", *names]]), keys),
            F.concat(F.array(F.lit("cef")), head, vals))


def _leef_fields() -> tuple[Column, Column]:
    """Fields of LEEF 1 (tab) and LEEF 2 (declared separator, hexadecimal after ``x`` or literal)."""
    fields = F.transform("_leef", _unescape)
    get = lambda i: F.get(fields, F.lit(i))
    declares = F.get("_leef", F.lit(0)).startswith("2") & (F.size("_leef") >= 7)
    code = F.char(F.conv(F.regexp_replace(get(5), "^x", ""), 16, 10).try_cast("int"))
    declared = F.when(get(5).startswith("x"), code).otherwise(canon.not_in(get(5), [""]))
    mark = F.when(declares, F.coalesce(declared, F.lit("\t"))).otherwise("\t")
    first = F.when(declares, 7).otherwise(6)
    body = F.array_join(F.slice(fields, first, F.greatest(F.size("_leef") - first + 1, F.lit(0))), "\u0001")
    marks = F.concat(F.lit("(?:\u0001|\\Q"), mark, F.lit("\\E)"))
    keys, vals = _pairs_of(F.filter(F.split(body, marks), lambda p: p.contains("=")), lambda v: v)
    names = ["__format__", "device_vendor", "device_product", "device_version", "signature_id"]
    return (F.concat(F.array(*[F.lit(n) for n in names]), keys),
            F.concat(F.array(F.lit("leef"), get(1), get(2), get(3), get(4)), vals))


def _syslog_fields() -> tuple[Column, Column]:
    """RFC 5424, RFC 3164 or the bare text as message; the priority gives the severity number."""
    text = F.col("_text")
    new = lambda i: F.regexp_extract(text, RFC5424, i)
    old = lambda i: F.regexp_extract(text, RFC3164, i)
    keys = lambda *names: F.array(*[F.lit(n) for n in ("__format__", *names)])
    vals = lambda *cols: F.array(F.lit("syslog"), *cols)
    is_new, is_old = text.rlike(RFC5424), text.rlike(RFC3164)
    k = (F.when(is_new, keys("time", "host", "application", "process_id", "message"))
         .when(is_old, keys("time", "host", "application", "message")).otherwise(keys("message")))
    v = (F.when(is_new, vals(new(1), new(2), new(3), new(4), canon.strip(new(6))))
         .when(is_old, vals(old(1), old(2), old(3), canon.strip(old(4)))).otherwise(vals(text)))
    rated = F.col("_severity").isNotNull()
    none = F.array().cast("array<string>")
    return (F.concat(k, F.when(rated, F.array(F.lit("syslog_severity"))).otherwise(none)),
            F.concat(v, F.when(rated, F.array("_severity")).otherwise(none)))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Mixed ``line`` rows to records: JSON objects, CEF, LEEF, syslog, each by its own shape.

    Keys and values are columns before they become a map, so the expressions
    that find them run once per line.
    """
    line, fmt = F.col("line"), F.col("format")
    shaped = with_format(lines)
    has_pri = (fmt == "syslog") & line.rlike(PRIORITY)
    shaped = shaped.withColumns({
        "_text": F.when(has_pri, F.regexp_extract(line, PRIORITY, 2)).when(fmt == "syslog", line),
        "_severity": F.when(has_pri, (F.regexp_extract(line, PRIORITY, 1).try_cast("int") % 8).cast("string")),
    })
    shaped = values.unnest(shaped, [F.col(c) for c in shaped.columns], marked("_values", "_json", "_known"), "_known")
    parsed = {"cef": _cef_fields(), "leef": _leef_fields(), "syslog": _syslog_fields()}
    pick = lambda i, last: F.concat(reduce(lambda acc, f: acc.when(fmt == f, parsed[f][i]), list(parsed)[1:],
                                           F.when(fmt == "cef", parsed["cef"][i])), F.array(last))
    keyed = unwrap(shaped.withColumns({"_keys": pick(0, F.lit("_raw")), "_vals": pick(1, line)}), "_json")
    # JSON without an object in it is kept as text, like any other line
    found = (fmt == "json") & (F.size("records") > 0)
    bare = F.create_map(F.lit("__format__"), F.lit("syslog"), F.lit("message"), F.coalesce("_json", line), F.lit("_raw"), line)
    made = F.when(found, F.col("records")).when(fmt == "json", F.array(bare)).otherwise(
        F.array(last_wins_map(F.col("_keys"), F.col("_vals"))))
    rows = keyed.withColumns({"records": made, "format": F.when(~found & (fmt == "json"), "syslog").otherwise(fmt)}).select("origin_file", "line", "format", F.explode_outer("records").alias("record")).where("record IS NOT NULL")
    raw = F.when(fmt == "json", F.to_json("record", {"ignoreNullFields": "false"})).otherwise(line)
    return rows.select("record", raw.alias("raw"), "origin_file")


def read_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    return parse_lines(_lines(spark, path, **options))
