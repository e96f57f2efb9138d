"""Repeated word windows, by level-wise doubling.

Windows of nine words are counted first.  Only where one repeats, and the window
that ends eighteen words on does too, is the window of eighteen words made (its
identifier from those of its halves) and counted; from the survivors, in the same
way, those of 35 words, whose halves overlap by a word.  The loop ends when the
wanted length is reached or no candidates survive.  A window that also starts
anywhere else removes all its words, in every place.

Documents travel in pieces of about ``PIECE`` bytes; a longer text makes several,
which overlap so that each of the longest windows starts in one alone.  For a level
a piece sends the sorted identifiers of its candidates, each at most twice, to
buckets by their leading bits; a bucket answers with one bit for each.  So a common
window costs a bucket no more than two entries a piece.  Levels before the last only
set windows aside, and send 32 bits below the bucket's number; the last sends all 64.

Nulls and ties: a null text has no words; rows are documents of their own, so a row
that is there twice repeats all its windows; an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleuthgraph.plans.lineage import cut

from .hashing import U, pair, windows, word_spans, words
from .repeats import WHOLE, _based, _copies, _ranges, _without, applied, merged, skipping, texts_of

WINDOW = 35
LEAST = 8
PIECE = 1 << 21
BUCKET = 1 << 21  # identifiers in a bucket, about
LEAST_BITS = 7
SHORT = 32

PIECES = "chunk long, doc_id array<long>, row_hash array<int>, size array<int>, skipped long, body binary, n long"
CANDIDATES = "chunk long, doc_id array<long>, row_hash array<int>, begin array<int>, skipped long, at binary, ids binary, n long"
SENT = "bucket long, chunk long, v binary"
ANSWERS = "chunk long, bucket long, bits binary"
SPANS = "doc_id long, row_hash int, start long, n_windows int"
ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def levels(window: int, least: int) -> list[int]:
    """Lengths, rising; each at most twice the one before, the first at least ``least`` where the window is."""
    if not 0 < least <= window:
        raise ValueError(f"a window of {window} words has no part of {least}")
    out = [window]
    while (out[0] + 1) // 2 >= least and out[0] > 1:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _table(rows: list[dict], schema: str) -> pa.Table:
    kinds = dict(c.strip().split(" ") for c in schema.split(","))
    return pa.table({n: pa.array([r[n] for r in rows], type=ARROW[t]) for n, t in kinds.items()})


def _piece(doc: np.ndarray, row: np.ndarray, texts: list, skipped: int) -> dict:
    body = b" ".join(texts)
    name = hashlib.blake2b(doc.tobytes() + row.tobytes() + skipped.to_bytes(8, "little") + body, digest_size=8)
    return {"chunk": int.from_bytes(name.digest(), "little", signed=True), "doc_id": doc, "row_hash": row,
            "size": [len(t) for t in texts], "skipped": skipped, "body": body, "n": len(body)}


def _pieces(batch: pa.RecordBatch, window: int):
    """Short texts together, long ones in slices of whole windows; named by what they hold, so a task run again names them alike."""
    doc, row = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("doc_id", "row_hash"))
    held, size = [], 0
    texts = texts_of(batch)
    for k, text in enumerate(texts):
        if len(text) > PIECE:
            first, last = word_spans(np.frombuffer(text, dtype=np.uint8))
            step = max(PIECE // 8, 1)
            for at in range(0, max(len(first) - window + 1, 0), step):
                end = min(at + step + window - 1, len(first))
                yield _piece(doc[[k]], row[[k]], [text[first[at]:last[end - 1]]], at)
            continue
        held.append(k)
        size += len(text)
        if size > PIECE:
            yield _piece(doc[held], row[held], [texts[j] for j in held], 0)
            held, size = [], 0
    if size:
        yield _piece(doc[held], row[held], [texts[j] for j in held], 0)


def pieces(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """One of each group of equal texts in pieces; and the members of those groups, whose windows all repeat."""
    members, later = _copies(_based(docs))
    everything, rest, skip = _without(_based(docs), later)

    def of(bitmap):
        def run(batches):
            for batch in batches:
                for piece in _pieces(batch if bitmap is None else skipping(batch, bitmap), window):
                    yield from _table([piece], PIECES).to_batches()
        return run

    return cut(everything.mapInArrow(of(skip), PIECES).unionByName(rest.mapInArrow(of(None), PIECES))), members


def _opened(row: dict, length: int) -> dict:
    """Candidates of a piece: (at, ids) and where its documents begin.  Places count one word more behind each document."""
    if "ids" in row:
        return row | {"at": np.frombuffer(row["at"], dtype=np.int32), "ids": np.frombuffer(row["ids"], dtype=U)}
    values, first, _ = words(np.frombuffer(row["body"], dtype=np.uint8))
    number = np.diff(np.searchsorted(first, np.cumsum(np.array(row["size"]) + 1)), prepend=0)
    begin = np.cumsum(number) - number
    room = np.maximum(number - length + 1, 0)
    place = _ranges(begin, room)
    ids = windows(values, length)[place] if len(place) else np.zeros(0, dtype=U)
    gaps = np.arange(len(number))
    return row | {"begin": (begin + gaps).astype(np.int32), "at": (place + np.repeat(gaps, room)).astype(np.int32), "ids": ids}


def _keys(ids: np.ndarray, bits: int, last: bool) -> tuple[np.ndarray, U]:
    """What is compared, and how far the number of its bucket is to the left."""
    return (ids, U(64 - bits)) if last else (ids >> U(64 - bits - SHORT), U(SHORT))


def _dealt(keys: np.ndarray, shift) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the buckets that sorted keys fall in, and the edges between them."""
    bucket = (keys >> shift).astype(np.int64)
    edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, dtype=np.int64)
    return bucket[edge], np.append(edge, len(bucket))


def _sender(length: int, bits: int, last: bool):
    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                row = _opened(batch.slice(k, 1).to_pylist()[0], length)
                keys, shift = _keys(row["ids"], bits, last)
                keys, number = np.unique(keys, return_counts=True)
                keys = np.repeat(keys, np.minimum(number, 2))
                bucket, edge = _dealt(keys, shift)
                short = keys if last else keys.astype(np.uint32)
                rows = [{"bucket": b, "chunk": row["chunk"], "v": short[lo:hi].tobytes()}
                        for b, lo, hi in zip(bucket, edge[:-1], edge[1:], strict=True)]
                yield from _table(rows, SENT).to_batches()
    return run


def _answer(last: bool):
    kind = U if last else np.uint32

    def run(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(v, dtype=kind) for v in table.column("v").to_pylist()]
        every = np.sort(np.concatenate(lists))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        rows = []
        for chunk, bucket, v in zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), lists, strict=True):
            spot = np.minimum(np.searchsorted(twice, v), max(len(twice) - 1, 0))
            hit = twice[spot] == v if len(twice) else np.zeros(len(v), dtype=bool)
            if hit.any():
                rows.append({"chunk": chunk, "bucket": bucket, "bits": np.packbits(hit).tobytes()})
        return _table(rows, ANSWERS)
    return run


def _alive(row: dict, answers: dict, bits: int, last: bool) -> np.ndarray:
    """Which candidates of a piece repeat; buckets without an answer have none that does."""
    keys, shift = _keys(row["ids"], bits, last)
    keys, spot, number = np.unique(keys, return_inverse=True, return_counts=True)
    number = np.minimum(number, 2)
    bucket, edge = _dealt(np.repeat(keys, number), shift)
    hits = np.zeros(edge[-1], dtype=bool)
    for b, lo, hi in zip(bucket.tolist(), edge[:-1], edge[1:], strict=True):
        if b in answers:
            hits[lo:hi] = np.unpackbits(np.frombuffer(answers[b], dtype=np.uint8), count=hi - lo)
    return hits[(np.cumsum(number) - number)[spot]]


def _extended(at: np.ndarray, ids: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Longer windows: of two survivors that start ``step`` apart."""
    where = np.full(int(at.max(initial=0)) + step + 1, -1, dtype=np.int32)
    where[at] = np.arange(len(at), dtype=np.int32)
    other = where[at + step]
    both = other >= 0
    return at[both], pair(ids[both], ids[other[both]])


def _survivors(length: int, longer: int | None, bits: int):
    """Of a piece and its answers: candidates of the next length, or spans where there is none."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = dict(zip(right.column("bucket").to_pylist(), right.column("bits").to_pylist(), strict=True))
        rows = []
        for row in left.to_pylist() if answers else ():
            row = _opened(row, length)
            alive = _alive(row, answers, bits, longer is None)
            at, ids = row["at"][alive], row["ids"][alive]
            if longer is None:
                rows += _spans(row, at)
                continue
            at, ids = _extended(at, ids, longer - length)
            if len(at):
                rows.append(row | {"at": at.tobytes(), "ids": ids.tobytes(), "n": len(at)})
        return _table(rows, SPANS if longer is None else CANDIDATES)
    return run


def _spans(row: dict, at: np.ndarray) -> list[dict]:
    head = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1)) if len(at) else np.zeros(0, dtype=np.int64)
    number, begin = np.diff(np.append(head, len(at))), np.asarray(row["begin"])
    own = np.searchsorted(begin, at[head], side="right") - 1
    return [{"doc_id": row["doc_id"][o], "row_hash": row["row_hash"][o], "start": s, "n_windows": n}
            for o, s, n in zip(own.tolist(), (at[head] - begin[own] + row["skipped"]).tolist(), number.tolist(), strict=True)]


def repeated_windows(docs: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """(doc_id, row_hash, start, n_windows): runs of windows that also stand elsewhere; ``WHOLE`` windows for copies of texts."""
    lengths = levels(window, least)
    state, members = pieces(docs, window)
    spans = members.select("doc_id", "row_hash", F.lit(0).cast("long").alias("start"), F.lit(WHOLE).alias("n_windows"))
    # a word takes about six bytes
    candidates = -(-(state.agg(F.sum("n")).first()[0] or 0) // 6)
    for length, longer in zip(lengths, [*lengths[1:], None], strict=True):
        if not candidates:
            break
        bits = min(max(LEAST_BITS, (candidates // BUCKET).bit_length()), SHORT - 1)
        answers = (state.mapInArrow(_sender(length, bits, longer is None), SENT)
                   .groupBy("bucket").applyInArrow(_answer(longer is None), ANSWERS))
        met = state.groupBy("chunk").cogroup(answers.groupBy("chunk"))
        if longer is None:
            return spans.unionByName(met.applyInArrow(_survivors(length, None, bits), SPANS))
        state = cut(met.applyInArrow(_survivors(length, longer, bits), CANDIDATES))
        candidates = state.agg(F.sum("n")).first()[0]
    return spans


def without_repeats(docs: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """(doc_id, text, n_words, n_removed, kept_sha256): ``text`` is the kept words, joined by one space."""
    def made(text: bytes, spans) -> tuple:
        w = text.split()
        gone = merged(spans, len(w), window)
        kept, at = [], 0
        for first, end in gone:
            kept += w[at:first]
            at = end
        body = b" ".join(kept + w[at:])
        return body.decode(), len(w), sum(e - f for f, e in gone), hashlib.sha256(body).hexdigest()

    return applied(docs, repeated_windows(docs, window, least), window, made,
                   "text string, n_words long, n_removed long, kept_sha256 string")
