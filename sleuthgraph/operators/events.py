"""Operators on the event table: dedup, redaction, lookup, filters, timeline."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, values

# --- identity -------------------------------------------------------------------


def deduplicate(events: DataFrame) -> DataFrame:
    """One row per uid, the earliest by (time, origin).

    The rank limit is applied before the shuffle as well, so a uid with very
    many copies sends one row per task.
    """
    order = Window.partitionBy("uid").orderBy("time", "origin")
    return events.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def new_events(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming events, without duplicates, whose uid is not stored yet."""
    return deduplicate(incoming).join(existing.select("uid"), "uid", "left_anti").select(incoming.columns)


def union_events(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The combined table and a one-row count of what was added."""
    fresh = new_events(existing, incoming)
    return existing.unionByName(fresh), fresh.agg(F.count(F.lit(1)).alias("added"))


# --- redaction --------------------------------------------------------------------

# A string may be cut off: then it goes on to the end.  Keys are found from the secret word on and loops over
# strings are possessive, so long texts need neither stack nor backtracking.
_STRING = r'"(?:[^"\\]|\\[\s\S])*+\\?"?'
_SINGLE = r"'(?:[^'\\]|\\[\s\S])*+'"
_SECRET = rf'((?i:{fixed.SECRET_KEYS})(?:[^"\\]|\\[\s\S])*+"\s*+:\s*+)'
_OPENED = re.compile(_SECRET + r"(?=[\[{])")
_MARKS = re.compile(_STRING + r"|[\[\]{}]")


def _nested_redacted(raw: Column) -> Column:
    """Replace arrays and objects under secret keys; their depth is counted, so any is fine.

    All in one closure, so workers need not have this package.
    """
    opened, marks, shown = _OPENED, _MARKS, f'"{fixed.REDACTED}"'

    def without(text):
        out, at = [], 0
        while text is not None and (found := opened.search(text, at)):
            depth, end = 0, len(text)
            for mark in marks.finditer(text, found.end()):
                depth += {"[": 1, "{": 1, "]": -1, "}": -1}.get(mark[0], 0)
                if not depth:
                    end = mark.end()
                    break
            out += [text[at:found.end()], shown]
            at = end
        return None if text is None else "".join(out) + text[at:]

    def redacted(batch: pd.Series) -> pd.Series:
        return batch.map(without)

    return F.pandas_udf(redacted, "string")(raw)


def redact_json(raw: Column) -> Column:
    """JSON text with the value of every secret-looking key replaced, at any depth.

    Plain values go by one regular expression; only texts with a nested secret
    value, which no expression can delimit, are sent through Python.
    """
    nested = raw.rlike(_SECRET + r"[\[{]")
    flat = F.when(nested, _nested_redacted(F.when(nested, raw))).otherwise(raw)
    return F.regexp_replace(flat, _SECRET + rf'(?:{_STRING}|{_SINGLE}|[^\s,}}\]\["{{]+)', f'$1"{fixed.REDACTED}"')


def redact_text(raw: Column) -> Column:
    """``key=value`` and ``key: value`` of a text line with secret-looking keys; quoted values as a whole.

    The key may be quoted, also with escaped quotes; what redact_json has replaced stays as it is.
    """
    escaped = r"""(\\+)["'][\s\S]*?(?:(?<!\\)\2["']|\z)"""
    return F.regexp_replace(raw, rf'(?i)((?:{fixed.SECRET_KEYS})[\w.-]*+(?:\\*["\'])?\s*+[=:]\s*+)(?!"{re.escape(fixed.REDACTED)}")'
                            rf'(?:{_STRING}|{_SINGLE}|{escaped}|[^\s,;|&]+)', f"$1{fixed.REDACTED}")


def redact_headers(raw: Column, in_json: bool) -> Column:
    """Secrets whose value has a grammar of its own: scheme and credentials, cookie lists, flags with a blank, users in URLs.

    ``in_json`` is for texts inside a JSON document: quotes are escaped there, and a value never goes beyond its string.
    """
    quoted = r'\\"[^"\\]*+\\"' if in_json else _STRING
    # no quote, blank or mark between parameters; inside JSON no escape either
    bare, plain = (r'[^\s"\\,;|&\']++', r'[^\s";\\]++') if in_json else (r'[^\s",;|&\']++', r'[^\s;"]++')
    parameter = rf'[\w-]++=(?:{quoted}|{bare})'
    mark = fixed.REDACTED
    authorization = (rf'(?i)(authorization["\']?\s*+[=:]\s*+)(?:{fixed.AUTHORIZATION_SCHEMES})[ \t]++'
                     rf'(?:{parameter}(?:[ \t]*+,[ \t]*+{parameter})*+|{bare})')
    cookies = rf'(?i)(cookie["\']?\s*+[=:][ \t]*+)[^\s=;,"\\]++={plain}(?:;[ \t]*+[^\s=;"\\]++(?:={plain})?+)*+'
    flags = rf'(?i)((?<![\w-])--?[\w-]*?(?:{fixed.SECRET_KEYS})[\w-]*+[ \t]++)(?!-)(?:{quoted}|{_SINGLE}|[^\s"\\]++)'
    users = r'(://[^\s/:@"\\]*+:)[^\s/@"\\]++(?=@)'
    for pattern in (authorization, cookies, flags, users):
        raw = F.regexp_replace(raw, pattern, f"$1{mark}")
    return raw


def _is_json(raw: Column) -> Column:
    """Whether the whole text is one JSON array or object.

    The parser ignores what follows a value, so the text is read as the first of
    two values in an array; the second, its hash, cannot stand in the text.
    """
    mark = F.md5(raw)
    both = F.try_parse_json(F.concat(F.lit("["), raw, F.lit(', "'), mark, F.lit('"]')))
    whole = F.try_variant_get(both, "$[1]", "string") == mark
    return F.coalesce(raw.rlike(r"^\s*[\[{]") & whole, F.lit(False))


def redact_map(record: Column) -> Column:
    """The same for a field map."""
    return F.transform_values(record, lambda k, v: F.when(
        k.rlike(f"(?i){fixed.SECRET_KEYS}"), fixed.REDACTED).otherwise(redact_json(v)))


def redact(events: DataFrame) -> DataFrame:
    """Raw records without secrets; all that is no whole JSON document is read as JSON and as text.

    In a document's text values only header-like secrets go: other words there may well be prose.
    """
    raw = F.col("raw")
    cleaned = redact_json(raw)
    return events.withColumn("raw", F.when(_is_json(raw), redact_headers(cleaned, True)).otherwise(
        redact_text(redact_headers(cleaned, False))))


# --- lookup ---------------------------------------------------------------------------

def fetch_events(events: DataFrame, requested: DataFrame | Sequence[str], limit: int | None = None) -> DataFrame:
    """Events by uid in the requested order, each once.

    ``requested`` is a list of uids or a frame (uid, position).
    """
    if not isinstance(requested, DataFrame):
        uids = list(dict.fromkeys(requested))
        events = events.where(F.col("uid").isin(uids))
        requested = events.sparkSession.createDataFrame(list(zip(uids, range(len(uids)))), "uid string, position long")
    wanted = requested.groupBy("uid").agg(F.min("position").alias("position"))
    out = events.join(wanted, "uid").orderBy("position")
    return out if limit is None else out.limit(limit)


def distinct_sources(events: DataFrame) -> DataFrame:
    return events.select("source").distinct()


def time_span(events: DataFrame) -> DataFrame:
    return events.agg(F.min("time").alias("time_from"), F.max("time").alias("time_to"))


# --- filters ------------------------------------------------------------------------------

ENDPOINTS = ("src", "dst", "device")


def text_match(needle: str) -> Column:
    """Free-text test: cheap columns first, technique ids, then the raw record."""
    word = needle.strip().lower()
    named = ["message", "actor.user", *[f"{e}.{p}" for e in ENDPOINTS for p in ("hostname", "ip")],
             "process.name", "process.path", "process.cmdline", "file.name", "file.path", "file.sha256", "domain"]
    tests = [F.lower(F.col(c)).contains(word) for c in named]
    tests.append(F.exists("mitre", lambda t: F.lower(t["id"]).contains(word)))
    tests.append(F.lower("raw").contains(word))
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])


def _moment(bound, now):
    return values.parse_moment(bound, now) if isinstance(bound, str) else bound


def _spelled(asked: Sequence[str], known) -> list[str]:
    """The stored spellings of names given in any case; unknown ones as given."""
    stored = {k.lower(): k for k in known}
    return sorted({stored.get(a.lower(), a) for a in asked} | set(asked))


def filter_events(events: DataFrame, time_from=None, time_to=None, min_severity: int = 0,
                  sources: Sequence[str] | None = None, tactics: Sequence[str] | None = None,
                  classes: Sequence[str] | None = None, text: str | None = None,
                  now: dt.datetime | None = None) -> DataFrame:
    """Conjunction of the given tests; bounds are datetimes or text (ISO or relative to ``now``)."""
    lowered = lambda items: [i.lower() for i in items]
    start, end = _moment(time_from, now), _moment(time_to, now)
    out = events
    if start:
        # The partition column prunes whole days; events with a fallback time have none.
        day = F.col("event_date").isNull() | (F.col("event_date") >= F.lit(start.date()))
        out = out.where(day & (F.col("time") >= F.lit(start)))
    if end:
        day = F.col("event_date").isNull() | (F.col("event_date") <= F.lit(end.date()))
        out = out.where(day & (F.col("time") <= F.lit(end)))
    if min_severity:
        out = out.where(F.col("severity") >= min_severity)
    if sources:
        # bare columns reach the Parquet scan; names are spelled as stored
        out = out.where(F.col("source").isin(_spelled(sources, fixed.SOURCES)))
    if classes:
        out = out.where(F.col("class_name").isin(_spelled(classes, fixed.CLASS_UIDS)))
    if tactics:
        wanted = F.array(*[F.lit(t) for t in lowered(tactics)])
        out = out.where(F.arrays_overlap(F.transform("mitre", lambda t: F.lower(t["tactic"])), wanted))
    if text and text.strip():
        out = out.where(text_match(text))
    return out


def timeline(events: DataFrame, buckets: int = 120) -> DataFrame:
    """Non-empty histogram buckets in order: (t, bucket_seconds, count, max_severity).

    The span comes from scalar subqueries over the time column alone.
    """
    start = events.agg(F.min("time")).scalar()
    end = events.agg(F.max("time")).scalar()
    micros = lambda c: F.unix_micros(c)
    span = F.greatest((micros(end) - micros(start)) / 1e6, F.lit(1.0))
    width = F.greatest(F.floor(span / max(buckets, 1)), F.lit(1))
    placed = events.select("severity", micros(F.col("time")).alias("us"), micros(start).alias("start"), width.alias("bucket_seconds"))
    index = F.floor((F.col("us") - F.col("start")) / (F.col("bucket_seconds") * 1000000))
    counted = placed.groupBy(index.alias("bucket"), "start", "bucket_seconds").agg(
        F.count(F.lit(1)).alias("count"), F.max("severity").alias("max_severity"))
    return counted.select(
        F.timestamp_micros(F.col("start") + F.col("bucket") * F.col("bucket_seconds") * 1000000).alias("t"),
        "bucket_seconds", "count", "max_severity").orderBy("t")


def is_key_event() -> Column:
    """Worth a line in a report: technique, high severity, finding, mail, account, failure, remote logon."""
    test = ((F.size("mitre") > 0) | (F.col("severity") >= 4)
            | F.col("class_name").isin(fixed.DETECTION_FINDING, fixed.EMAIL_ACTIVITY, fixed.ACCOUNT_CHANGE)
            | (F.col("status") == "failure")
            | ((F.col("class_name") == fixed.AUTHENTICATION) & (F.col("activity") == "logon_remote")))
    return F.coalesce(test, F.lit(False))


# --- drill-down ---------------------------------------------------------------------------

def events_of_node(events: DataFrame, node_ids: DataFrame, mentions: DataFrame, limit: int | None = None) -> DataFrame:
    """Stored events behind the given nodes (frame with node_id), in time order.

    ``mentions`` is the resolved bridge (node_id, uid); the join key is the uid.
    """
    uids = mentions.join(node_ids.select("node_id").distinct(), "node_id", "left_semi").select("uid").distinct()
    out = events.join(uids, "uid", "left_semi").orderBy("time", "uid")
    return out if limit is None else out.limit(limit)


def events_of_link(events: DataFrame, links: DataFrame, bridge: DataFrame, limit: int | None = None) -> DataFrame:
    """Stored events behind the given links (frame with source, target, rel)."""
    key = ["source", "target", "rel"]
    uids = bridge.join(links.select(*key).distinct(), key, "left_semi").select("uid").distinct()
    out = events.join(uids, "uid", "left_semi").orderBy("time", "uid")
    return out if limit is None else out.limit(limit)
