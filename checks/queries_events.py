"""Canonicalisation, value and event-table queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sleuthgraph.functions import canon, fixed, values
from sleuthgraph.operators import events as e
from sleuthgraph.operators.narrate import sentence

from . import oracle_text  # noqa: F401  (adds SQL steps)
from . import workload as w
from .oracle import (basename, canon_domain, canon_host, canon_path, canon_user, device_class, is_ip, is_private, key_event,
                     looks_like_product, name_of, q, sql, tactic_of)
from .registry import micros, query

# --- canonical identities ------------------------------------------------------------


@query(sql(f"""SELECT uid, {canon_user('actor_user')} AS canon_user, {canon_host('device_hostname')} AS canon_host,
  {device_class('device_hostname')} AS device_class, coalesce({looks_like_product('device_hostname')}, false) AS is_product,
  {canon_path('file_path')} AS canon_path, {basename('file_path')} AS base_name, lower({basename('file_path')}) AS base_key,
  {canon_domain('domain')} AS canon_domain, {is_ip('src_ip')} AS is_ip, {is_private('src_ip')} AS is_private FROM ev""", "ev"))
def canonical_identities(spark, sf):
    flat = w.flat_events(spark, sf).select("uid", "actor_user", "device_hostname", "file_path", "domain", "src_ip")
    return canon.canonicalize_identities(flat, user="actor_user", host="device_hostname", path="file_path",
                                         domain="domain", ip="src_ip").drop(
        "actor_user", "device_hostname", "file_path", "domain", "src_ip")


@query(f"""SELECT page_id, {canon_domain('url')} AS domain,
  split_part(split_part(regexp_replace(url, '^.*//', ''), '/', 1), ':', 1) AS host FROM pages""")
def page_domains(spark, sf):
    return w.table(spark, sf, "pages").select("page_id", canon.canon_domain(F.col("url")).alias("domain"),
                                              canon.url_host(F.col("url")).alias("host"))


TIME_TEXT = """SELECT event_id, value, CASE event_id % 5
    WHEN 0 THEN {iso} WHEN 1 THEN {seconds} WHEN 2 THEN {millis} WHEN 3 THEN {words} ELSE 'soon' END AS time_text,
  CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'Critical' WHEN 2 THEN CAST(event_id % 11 AS STRING) END AS severity_text
  FROM {table}"""
INGEST = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(date_trunc('second', ts))
    WHEN 2 THEN epoch_us(date_trunc('millisecond', ts)) WHEN 3 THEN epoch_us(date_trunc('second', ts))
    ELSE 1706745600000000 END AS event_time, event_id % 5 = 4 AS time_is_fallback,
  CAST(CASE event_id % 4 WHEN 0 THEN CASE event_type WHEN 'error' THEN 4 ELSE 1 END WHEN 1 THEN 5
    WHEN 2 THEN least(5, floor((event_id % 11) / 10.0 * 5 + 0.5)) ELSE 1 END AS INTEGER) AS event_severity FROM events""")
def standard_time_severity(spark, sf):
    w.flat_events(spark, sf)
    text = TIME_TEXT.format(table="driver_events", iso="replace(CAST(ts AS STRING), ' ', 'T')",
                            seconds="CAST(unix_seconds(CAST(ts AS TIMESTAMP)) AS STRING)",
                            millis="CAST(unix_millis(CAST(ts AS TIMESTAMP)) AS STRING)",
                            words="date_format(ts, 'MMM d yyyy HH:mm:ss')")
    out = values.standardize_time_severity(spark.sql(text), time="time_text", severity="severity_text", scale=10, ingest_time=INGEST)
    return out.select("event_id", micros("event_time").alias("event_time"), "time_is_fallback", "event_severity")


@query("""SELECT event_id, left(sha256(concat('splunk|{"event_type":"', event_type, '","id":"', event_id, '","user":"', user_id, '"}')),
  16) AS uid FROM events""")
def record_fingerprint(spark, sf):
    record = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("id"), F.col("event_id").cast("string"),
                          F.lit("event_type"), F.col("event_type"))
    rows = w.table(spark, sf, "events").select("event_id", F.lit("splunk").alias("source"), record.alias("record"))
    return values.fingerprint(rows, source="source", record="record").select("event_id", "uid")


@query(sql("""SELECT uid, 'binary' AS kind, name AS value FROM (SELECT DISTINCT uid, name FROM tokens)
  UNION ALL SELECT uid, 'sha256', lower(file_sha256) FROM ev WHERE file_sha256 IS NOT NULL
  UNION ALL SELECT uid, 'md5', lower(file_md5) FROM ev WHERE file_md5 IS NOT NULL""", "tokens", "ev"))
def event_artifacts(spark, sf):
    flat = w.flat_events(spark, sf).withColumn("hashes", F.concat_ws(
        ",", F.concat(F.lit("SHA256="), "file_sha256"), F.concat(F.lit("MD5="), "file_md5")))
    return values.explode_artifacts(flat, key="uid", hashes="hashes", cmdline="proc_cmdline")


@query(sql("SELECT uid, message AS payload FROM ev", "ev"))
def decoded_payloads(spark, sf):
    flat = w.flat_events(spark, sf)
    packed = F.when(F.col("uid").cast("bigint") % 2 == 0, F.base64(F.encode("message", "UTF-8"))).otherwise(F.col("message"))
    return flat.select("uid", values.decode_payload(packed).alias("payload"))


@query(sql(f"""SELECT uid, CAST(CASE class_name {' '.join(f'WHEN {q(k)} THEN {v}' for k, v in fixed.CLASS_UIDS.items())} END AS INTEGER)
  AS class_uid, concat_ws(',', {tactic_of('tech1')}, {tactic_of('tech2')}) AS tactics FROM ev""", "ev"))
def class_and_tactics(spark, sf):
    return w.events(spark, sf).select("uid", values.class_uid(F.col("class_name")).alias("class_uid"),
                                      F.array_join(values.tactics_of(F.col("mitre")), ",").alias("tactics"))


# --- techniques ---------------------------------------------------------------------------

@query(sql(f"""SELECT uid, concat_ws(',', tech1, CASE WHEN tech2 IS DISTINCT FROM tech1 THEN tech2 END) AS ids,
  concat_ws(';', {name_of('tech1')}, CASE WHEN tech2 IS NOT NULL AND tech2 IS DISTINCT FROM tech1 THEN {name_of('tech2')} END) AS names
  FROM ev WHERE tech1 IS NOT NULL""", "ev"))
def technique_lists(spark, sf):
    text = F.concat_ws(" and ", F.lower("tech1"), F.col("tech2"))
    found = values.techniques(text)
    return w.flat_events(spark, sf).where("tech1 IS NOT NULL").select("uid", found.alias("t")).select(
        "uid", F.array_join(F.col("t.id"), ",").alias("ids"), F.array_join(F.col("t.name"), ";").alias("names"))


@query(sql("SELECT uid, concat_ws(',', " + ", ".join(
    f"CASE WHEN regexp_matches(proc_cmdline, {q('(?i)' + p)}) THEN {q(t)} END" for p, t in fixed.CMDLINE_RULES)
    + ") AS ids FROM ev WHERE proc_cmdline IS NOT NULL", "ev"))
def inferred_techniques(spark, sf):
    rows = w.flat_events(spark, sf).where("proc_cmdline IS NOT NULL")
    return rows.select("uid", F.array_join(values.infer_techniques(F.col("proc_cmdline"))["id"], ",").alias("ids"))


# --- event table ------------------------------------------------------------------------------

@query(sql("SELECT uid, source, 'derived' AS origin FROM ev", "ev"))
def deduplicated_events(spark, sf):
    events = w.events(spark, sf)
    return e.deduplicate(events.unionByName(events.withColumn("origin", F.lit("second copy")))).select("uid", "source", "origin")


@query(sql("SELECT uid FROM ev WHERE source <> 'splunk'", "ev"))
def newly_added_events(spark, sf):
    events = w.events(spark, sf)
    return e.new_events(events.where("source = 'splunk'"), events).select("uid")


@query(sql("""SELECT uid, regexp_replace(raw, '"password": "[^"]*"', '"password": "***redacted***"') AS raw FROM ev""", "ev"))
def redacted_raw(spark, sf):
    return e.redact(w.events(spark, sf)).select("uid", "raw")


@query(sql(f"""SELECT uid, -epoch_us(time) AS position FROM ev WHERE class_name = {q(fixed.DETECTION_FINDING)} AND severity >= 3
  ORDER BY time DESC LIMIT 500""", "ev"))
def fetched_events(spark, sf):
    events = w.events(spark, sf)
    wanted = events.where((F.col("class_name") == fixed.DETECTION_FINDING) & (F.col("severity") >= 3)).select(
        "uid", (-micros("time")).alias("position"))
    return e.fetch_events(events, wanted, limit=500).select("uid", "position")


@query(sql("SELECT DISTINCT source FROM ev", "ev"))
def event_sources(spark, sf):
    return e.distinct_sources(w.events(spark, sf))


@query(sql("SELECT epoch_us(min(time)) AS time_from, epoch_us(max(time)) AS time_to FROM ev", "ev"))
def event_span(spark, sf):
    return e.time_span(w.events(spark, sf)).select(micros("time_from").alias("time_from"), micros("time_to").alias("time_to"))


@query(sql(f"""SELECT uid, source, severity FROM ev WHERE time >= TIMESTAMP '2024-01-08 00:00:00'
  AND time <= TIMESTAMP '2024-01-25 12:00:00' AND severity >= 2 AND source IN ('splunk', 'qradar')
  AND class_name IN ({q(fixed.AUTHENTICATION)}, {q(fixed.DETECTION_FINDING)})
  AND ({tactic_of('tech1')} IN ('credential-access', 'impact') OR {tactic_of('tech2')} IN ('credential-access', 'impact'))""", "ev"))
def filtered_events(spark, sf):
    return e.filter_events(
        w.events(spark, sf), time_from="2024-01-08T00:00:00Z", time_to="-6d", min_severity=2, sources=["Splunk", "qradar"],
        tactics=["credential-access", "Impact"], classes=[fixed.AUTHENTICATION, fixed.DETECTION_FINDING],
        now=dt.datetime(2024, 1, 31, 12, tzinfo=dt.timezone.utc)).select("uid", "source", "severity")


SEARCHED = ("message actor_user src_hostname src_ip dst_hostname dst_ip device_hostname device_ip proc_name proc_path proc_cmdline "
            "file_name file_path file_sha256 domain tech1 tech2 raw").split()


@query(sql("SELECT uid FROM ev WHERE " + " OR ".join(f"coalesce(contains(lower({c}), 'explorer'), false)" for c in SEARCHED), "ev"))
def text_search(spark, sf):
    return e.filter_events(w.events(spark, sf), text=" Explorer ").select("uid")


TIMELINE = """SELECT epoch_us(s) + b * w * 1000000 AS t, w AS bucket_seconds, count(*) AS count, max(severity) AS max_severity
FROM (SELECT severity, s, w, CAST(floor((epoch_us(time) - epoch_us(s)) / (w * 1000000.0)) AS BIGINT) AS b FROM {src},
  (SELECT min(time) AS s, CAST(greatest(floor(greatest((epoch_us(max(time)) - epoch_us(min(time))) / 1e6, 1.0) / 120), 1) AS BIGINT) AS w
   FROM {src})) GROUP BY s, w, b"""


def _timeline_rows(df):
    return df.select(micros("t").alias("t"), "bucket_seconds", "count", "max_severity")


@query(sql(TIMELINE.format(src="ev"), "ev"))
def event_timeline(spark, sf):
    return _timeline_rows(e.timeline(w.events(spark, sf)))


@query(TIMELINE.format(src="(SELECT l_shipdate AS time, l_linenumber AS severity FROM lineitem)"))
def shipment_timeline(spark, sf):
    w.tune(spark)
    rows = w.table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("timestamp").alias("time"), F.col("l_linenumber").alias("severity"))
    return _timeline_rows(e.timeline(rows))


@query(sql(f"SELECT uid FROM ev WHERE {key_event()}", "ev"))
def key_events(spark, sf):
    return w.events(spark, sf).where(e.is_key_event()).select("uid")


@query(sql("SELECT uid, text FROM said", "said"))
def event_sentences(spark, sf):
    return w.events(spark, sf).select("uid", sentence().alias("text"))
