"""Scalar steps for numbers, time, severity, fingerprints and artifacts."""

from __future__ import annotations

import datetime as dt
import re
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import canon, fixed

# Layouts tried in order after plain ISO text (fixed values).
TIME_LAYOUTS = [
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSZ",
    "yyyy-MM-dd'T'HH:mm:ssZ",
    "M/d/yyyy h:mm:ss a",
    "M/d/yyyy H:mm:ss",
    "d/M/yyyy H:mm:ss",
    "MMM d yyyy H:mm:ss",
    "MMM d yyyy H:mm:ss.SSSSSS",
    "d MMM yyyy H:mm:ss",
]
YEARLESS_LAYOUT = "yyyy MMM d H:mm:ss"
ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}.*)?$"
EPOCH_SHAPE = r"^\d{10,16}(\.\d+)?$"


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def to_int(value: Column, kind: str = "int") -> Column:
    text = canon.strip(value)
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast(kind))


def parse_time(value: Column, year: int) -> Column:
    """Timestamp of any exported time text, null when nothing fits.

    ``year`` completes syslog times, which carry none.
    """
    return parse_clean_time(clean_time(value), year)


def clean_time(value: Column) -> Column:
    return F.regexp_replace(canon.strip(value), r"\s+", " ")


def parse_clean_time(text: Column, year: int) -> Column:
    """:func:`parse_time` of text that is already stripped; it is referred to once per layout."""
    number = text.try_cast("double")
    seconds = F.when(number > 1e11, number / 1000.0).otherwise(number)
    formats = [F.try_to_timestamp(text, F.lit(f)) for f in TIME_LAYOUTS]
    yearless = F.try_to_timestamp(F.concat(F.lit(f"{year} "), text), F.lit(YEARLESS_LAYOUT))
    return F.when(text.rlike(EPOCH_SHAPE), F.timestamp_seconds(seconds)).otherwise(
        F.coalesce(F.when(text.rlike(ISO_SHAPE), text.try_cast("timestamp")), *formats, yearless))


def parse_severity(value: Column, scale: int = 10) -> Column:
    """Any severity scale to 0..5; words first, then numbers rounded half up, default 1."""
    word = F.lower(canon.strip(value))
    number = word.try_cast("double")
    scaled = number if scale <= 5 else number / float(scale) * 5
    bounded = F.greatest(F.lit(0), F.least(F.lit(5), F.floor(scaled + 0.5).cast("int")))
    known = F.try_element_at(literal_map(fixed.SEVERITY_WORDS), word)
    return F.coalesce(known, F.when(number.isNotNull() & ~F.isnan(number), bounded), F.lit(1))


def standardize_time_severity(df: DataFrame, *, time: str, severity: str, scale: int,
                              ingest_time: dt.datetime) -> DataFrame:
    """Parsed ``time``/``severity`` columns; unusable time becomes ingest time and is flagged."""
    parsed = parse_time(F.col(time), ingest_time.year)
    return df.withColumn("_t", parsed).withColumns({
        "event_time": F.coalesce("_t", F.lit(ingest_time)),
        "time_is_fallback": F.col("_t").isNull(),
        "event_severity": parse_severity(F.col(severity), scale),
    }).drop("_t")


def make_uid(source: Column, record: Column) -> Column:
    """Stable 16-hex id of a record map; key order does not matter."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(record)))
    text = F.to_json(ordered, {"ignoreNullFields": "false"})
    return F.substring(F.sha2(F.concat_ws("|", source, text), 256), 1, 16)


def fingerprint(df: DataFrame, *, source: str, record: str) -> DataFrame:
    return df.withColumn("uid", make_uid(F.col(source), F.col(record)))


def listed_hash(value: Column, algorithm: str) -> Column:
    """One hash out of ``SHA256=..,MD5=..``."""
    found = F.regexp_extract(F.lower(value), rf"(?:^|,)\s*{algorithm}\s*=([^,]*)", 1)
    return canon.not_in(canon.strip(found), [""])


def unnest(df: DataFrame, kept: list[Column], structs: Column, key: str) -> DataFrame:
    """``kept`` columns plus the fields of each struct; ``key`` is a field that is never null.

    The outer form with a test afterwards is used on purpose: for the inner form
    the optimiser adds a size test, pushes it below the projections that build
    the array and so computes the whole array twice.
    """
    return df.select(*kept, F.inline_outer(structs)).where(F.col(key).isNotNull())


COMMAND_SPLIT = r"[\s\"'`|&;,()<>]+"


def command_names(cmdline: Column) -> Column:
    """Distinct executable-looking names in a command line (array)."""
    tokens = F.split(F.lower(cmdline), COMMAND_SPLIT)
    names = F.transform(tokens, canon.basename)
    heads = F.transform(names, lambda n: F.when(n.contains(":"), F.substring_index(n, ":", 1)))
    return F.array_distinct(F.array_compact(F.concat(names, heads)))


def explode_artifacts(df: DataFrame, *, key: str, hashes: str, cmdline: str) -> DataFrame:
    """One row per hash and per executable name: ``(key, kind, value)``."""
    found = F.array_compact(F.concat(
        F.array(*[F.when(listed_hash(F.col(hashes), a).isNotNull(),
                         F.struct(F.lit(a).alias("kind"), listed_hash(F.col(hashes), a).alias("value")))
                  for a in ("sha256", "md5")]),
        F.coalesce(F.transform(command_names(F.col(cmdline)),
                               lambda n: F.struct(F.lit("binary").alias("kind"), n.alias("value"))),
                   F.array().cast("array<struct<kind:string,value:string>>"))))
    return unnest(df, [F.col(key)], found, "value")


def decode_payload(value: Column) -> Column:
    """Base64 text decoded when it looks like base64 and is mostly printable."""
    shaped = (F.length(value) % 4 == 0) & value.rlike(r"^[A-Za-z0-9+/=\r\n]+$")
    plain = F.make_valid_utf8(F.try_to_binary(value, F.lit("base64")).cast("string"))
    printable = F.length(F.regexp_replace(plain, r"[\p{Cntrl}&&[^\r\n\t]]", ""))
    decoded = F.when(printable > F.length(plain) * 0.8, plain)
    return F.coalesce(F.when(shaped, decoded), value)


# --- Techniques ---------------------------------------------------------------

TECHNIQUE_ID = r"(\bT\d{4}(?:\.\d{3})?\b)"
_NAMES = {k: v[0] for k, v in fixed.TECHNIQUES.items()}
_TACTICS = {k: v[1] for k, v in fixed.TECHNIQUES.items()}
MITRE_TYPE = "array<struct<id:string,name:string,tactic:string>>"


def _lookup(table: dict, tid: Column) -> Column:
    known = literal_map(table)
    return F.coalesce(F.try_element_at(known, tid),
                      F.try_element_at(known, F.substring_index(tid, ".", 1)), F.lit(""))


def technique(tid: Column) -> Column:
    """Technique struct; an unknown sub-technique takes its parent, an unknown id stays blank."""
    key = F.upper(canon.strip(tid))
    return F.struct(key.alias("id"), _lookup(_NAMES, key).alias("name"),
                    _lookup(_TACTICS, key).alias("tactic"))


def technique_ids(text: Column) -> Column:
    """Ordered distinct technique ids of a list, CSV or free text."""
    upper = F.upper(text)
    found = F.regexp_extract_all(upper, F.lit(TECHNIQUE_ID), F.lit(1))
    parts = F.transform(F.split(upper, ","), canon.strip)
    ids = F.when(F.size(found) > 0, found).otherwise(F.filter(parts, lambda p: p != ""))
    return F.array_distinct(ids)


def techniques(text: Column) -> Column:
    return F.coalesce(F.transform(technique_ids(text), technique), F.array().cast(MITRE_TYPE))


def fixed_technique(tid: str) -> Column:
    name, tactic = fixed.TECHNIQUES[tid]
    return F.struct(F.lit(tid).alias("id"), F.lit(name).alias("name"), F.lit(tactic).alias("tactic"))


def infer_techniques(cmdline: Column) -> Column:
    """All command-line rules evaluated; rule order kept."""
    hits = [F.when(cmdline.rlike("(?i)" + pattern), fixed_technique(tid))
            for pattern, tid in fixed.CMDLINE_RULES]
    return F.array_compact(F.array(*hits))


# --- Sets as bit masks ----------------------------------------------------------

def tactic_mask(tactics: Column) -> Column:
    """Bit per tactic (bit = kill-chain rank) of an array of tactic names."""
    bits = literal_map({t: 1 << i for i, t in enumerate(fixed.TACTICS)})
    return F.aggregate(tactics, F.lit(0), lambda acc, t: acc.bitwiseOR(F.coalesce(F.try_element_at(bits, t), F.lit(0))))


def source_mask(source: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map({s: 1 << i for i, s in enumerate(fixed.SOURCES)}), source),
                      F.lit(1 << fixed.SOURCES.index("generic")))


def mask_of(names: list[str], universe: list[str]) -> int:
    return sum(1 << universe.index(n) for n in names)


def mask_names(mask: Column, universe: list[str]) -> Column:
    """Array of the names whose bit is set, in universe order."""
    return F.array_compact(F.array(*[F.when(mask.bitwiseAND(1 << i) != 0, n) for i, n in enumerate(universe)]))


def lowest_bit(mask: Column) -> Column:
    """Position of the lowest set bit; null for 0."""
    return F.when(mask != 0, F.bit_count(mask.bitwiseAND(-mask) - 1).cast("int"))


def class_uid(class_name: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(fixed.CLASS_UIDS), class_name), F.lit(0))


def tactics_of(mitre: Column) -> Column:
    return F.filter(F.transform(mitre, lambda t: t["tactic"]), lambda x: x != "")


# --- Moments -------------------------------------------------------------------

def parse_moment(text: str | None, now: dt.datetime | None = None) -> dt.datetime | None:
    """ISO or relative (``-30m``, ``-24h``, ``-7d``, ``-2w``) bound; None when unusable."""
    if not text or not text.strip():
        return None
    text = text.strip()
    relative = re.fullmatch(r"-(.+)(.)", text)
    if relative and len(text) > 2:
        unit = fixed.MOMENT_UNITS.get(relative[2].lower())
        try:
            amount = int(relative[1])
        except ValueError:
            return None
        if unit is None:
            return None
        return (now or dt.datetime.now(dt.timezone.utc)) - dt.timedelta(seconds=amount * unit)
    try:
        moment = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return None
    return moment if moment.tzinfo else moment.replace(tzinfo=dt.timezone.utc)
