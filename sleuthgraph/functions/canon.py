"""Canonical identities as Column expressions (users, hosts, paths, domains, IPs).

Every function maps Column -> Column with built-in functions only, so the steps
stay inside the projection that calls them.  Inputs that are themselves long
expressions should be materialised with ``withColumns`` first: the steps refer
to their argument more than once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed

WHITESPACE = " \t\r\n\x0b\x0c"
BACKSLASH = "\\"

# One octet of a dotted quad, up to 255, leading zeros allowed.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
IP_PATTERN = rf"^(?:(?:{_OCTET}\.){{3}}{_OCTET}|[0-9a-fA-F:]*:[0-9a-fA-F:]*)$"
QUAD_PATTERN = r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"
PRIVATE_PATTERN = (r"^(?:0*10\.|0*127\.|0*192\.0*168\.|"
                   r"0*172\.0*(?:1[6-9]|2[0-9]|3[01])\.|0*169\.0*254\.)")
_LABEL = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
HOSTNAME_PATTERN = rf"^{_LABEL}(?:\.{_LABEL})+$"
EMPTY_MARKS = ["", "-", "N/A"]
NULL_MARKS = ["", "-", "N/A", "null", "NULL"]


def strip(value: Column) -> Column:
    return F.trim(value, F.lit(WHITESPACE))


def not_in(value: Column, marks: list[str]) -> Column:
    """The value, or null when it is one of ``marks``."""
    return F.when(~value.isin(marks), value)


def first_of(*values: Column) -> Column:
    """First value that is neither null nor an empty mark (``''``, ``-``, ``N/A``)."""
    return F.coalesce(*[not_in(v, EMPTY_MARKS) for v in values])


def is_ip(value: Column) -> Column:
    return F.coalesce(strip(value).rlike(IP_PATTERN), F.lit(False))


def is_private_ip(value: Column) -> Column:
    text = strip(value)
    return F.coalesce(text.rlike(QUAD_PATTERN) & text.rlike(PRIVATE_PATTERN), F.lit(False))


def canon_user(value: Column) -> Column:
    """``CORP\\Ann``, ``ann@corp.com`` and ``ANN`` all become ``ann``."""
    text = not_in(strip(value), NULL_MARKS)
    bare = F.substring_index(F.substring_index(text, BACKSLASH, -1), "@", 1)
    name = F.lower(strip(bare))
    noise = name.isin(["", *fixed.NOISE_ACCOUNTS]) | name.rlike(fixed.MACHINE_ACCOUNT)
    return F.when(~noise, name)


def canon_host(value: Column) -> Column:
    """First label in lower case; an IP address passes unchanged."""
    text = not_in(F.trim(strip(value), F.lit(".")), NULL_MARKS)
    return F.when(is_ip(text), text).otherwise(
        not_in(F.lower(F.substring_index(text, ".", 1)), [""]))


def canon_path(value: Column) -> Column:
    text = F.trim(strip(value), F.lit('"'))
    return F.lower(F.translate(not_in(text, ["", "-"]), "/", BACKSLASH))


def domain_text(value: Column) -> Column:
    """Whatever precedes validation: scheme, path, user info, port and dots cut off."""
    text = not_in(F.lower(strip(value)), ["", "-", "n/a", "null", "none"])
    text = F.regexp_replace(text, r"(?s)^.*?//", "")
    text = F.substring_index(F.substring_index(text, "/", 1), "?", 1)
    text = F.substring_index(F.substring_index(text, "@", -1), ":", 1)
    return F.trim(strip(text), F.lit("."))


def valid_domain(text: Column) -> Column:
    ok = (F.length(text) <= 253) & text.rlike(HOSTNAME_PATTERN) & ~text.rlike(IP_PATTERN)
    return F.when(ok, text)


def canon_domain(value: Column) -> Column:
    return valid_domain(domain_text(value))


def url_host(value: Column) -> Column:
    """Host part of a URL: after the last ``//``, before ``/`` and ``:``."""
    return F.substring_index(F.substring_index(F.substring_index(value, "//", -1), "/", 1), ":", 1)


def basename(path: Column) -> Column:
    """Last path segment, case kept, null when empty."""
    cut = F.rtrim(F.translate(path, "/", BACKSLASH), F.lit(BACKSLASH))
    return not_in(F.substring_index(cut, BACKSLASH, -1), [""])


def lower_basename(path: Column) -> Column:
    return F.lower(basename(path))


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def looks_like_product(name: Column) -> Column:
    return F.coalesce(contains_any(F.lower(strip(name)), fixed.PRODUCT_MARKERS), F.lit(False))


def device_class(host_label: Column) -> Column:
    name = F.lower(strip(host_label))
    (first, words), *rest = fixed.DEVICE_CLASSES
    out = F.when(contains_any(name, words), first)
    for cls, needles in rest:
        out = out.when(contains_any(name, needles), cls)
    return out.otherwise(fixed.DEFAULT_DEVICE_CLASS)


def canonicalize_identities(df: DataFrame, *, user: str | None = None, host: str | None = None,
                            path: str | None = None, domain: str | None = None,
                            ip: str | None = None) -> DataFrame:
    """Add canonical columns next to the named raw columns (one narrow projection)."""
    cols: dict[str, Column] = {}
    if user:
        cols["canon_user"] = canon_user(F.col(user))
    if host:
        cols["canon_host"] = canon_host(F.col(host))
        cols["device_class"] = device_class(F.col(host))
        cols["is_product"] = looks_like_product(F.col(host))
    if path:
        cols["canon_path"] = canon_path(F.col(path))
        cols["base_name"] = basename(F.col(path))
        cols["base_key"] = lower_basename(F.col(path))
    if domain:
        cols["canon_domain"] = canon_domain(F.col(domain))
    if ip:
        cols["is_ip"] = is_ip(F.col(ip))
        cols["is_private"] = is_private_ip(F.col(ip))
    return df.withColumns(cols)
