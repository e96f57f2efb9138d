"""Repeated byte strings, from anchors (see ``repeats``).

This departs from bucket-pointer refinement: no suffix gets a bucket identifier that
a later round takes as its sort key.  Identifiers of 64 and 100 bytes are hashes of
pairs of shorter ones, as there, but every task takes them from the text.  Runs
of windows at repeated 32-byte anchors are grouped by their whole text first;
windows between are looked at only where an anchor has several kinds of run.

A byte goes if a string of 100 bytes covers it that also starts earlier: in a smaller
id, or before in the same document.

Nulls and ties: a null text has no bytes; documents without an id come before all
others; rows that share an id are ordered by a hash of their text, and rows
that share id and text count as one place, so none of them is the later one; an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame

from .repeats import Shape, applied, merged, repeated_windows

WINDOW = 100
GRAM = 32


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans, kept_sha256): ``kept`` is the remaining bytes."""
    shape = Shape("bytes", gram, window)

    def made(text: bytes, spans) -> tuple:
        gone, kept, at = merged(spans, len(text), window), [], 0
        for first, end in gone:
            kept.append(text[at:first])
            at = end
        body = b"".join(kept) + text[at:]
        return body, len(text), sum(e - f for f, e in gone), len(gone), hashlib.sha256(body).hexdigest()

    return applied(docs, repeated_windows(docs, shape, keep_first=True), window, made,
                   "kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
