"""Repeated windows of a corpus, found from sparse anchors by identifiers of growing length.

Every window of ``size`` units has one anchor, the least short gram in it, so equal
windows have equal anchors at equal offsets.  Neighbouring windows with one anchor
are a run, and only runs travel: first their anchors alone, counted; then the runs
of repeated anchors, with an identifier of the whole run.  Equal runs settle all
their windows at once.  One run of each kind goes on where an anchor has several
kinds: windows that hold a gram of twice the length that nothing repeats are set
aside, the rest are compared in blocks of eight windows and at last one by one.

All counting is pre-aggregated, joins back to the occurrences can be split by Spark
where a key is hot, and no step has more than one row for a run, block or window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleuthgraph.plans.lineage import cut

from .bitmaps import Bitmap, key_of
from .hashing import U, identifiers, least, mix, windows, words

SLICE = 1 << 17
BLOCK = 8
WHO = ["doc_id", "row_hash", "start"]


@dataclass(frozen=True)
class Shape:
    """``units``: bytes or words; ``gram``: length of an anchor; ``size``: length of a window, at least ``gram``.

    From ``3 * gram - 1`` on every window holds a gram of twice the length to a side of its anchor; shorter ones that
    hold none are never set aside by such grams.
    """

    units: str
    gram: int
    size: int

    def __post_init__(self):
        if not 0 < self.gram <= self.size:
            raise ValueError(f"a window of {self.size} units has no gram of {self.gram}")

    @property
    def block(self) -> int:
        """Windows in a block: what they have in common is a gram at least."""
        return min(BLOCK, self.size - self.gram + 1)

    def values(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Units of several texts, one after the other, and how many each has."""
        if self.units == "bytes":
            return np.frombuffer(b"".join(texts), dtype=np.uint8), np.array([len(t) for t in texts])
        found, first, _ = words(np.frombuffer(b" ".join(texts), dtype=np.uint8))
        edges = np.cumsum([len(t) + 1 for t in texts])
        return found, np.diff(np.searchsorted(first, edges), prepend=0)


@dataclass
class Runs:
    """Runs of windows: from ``first`` up to ``end`` they share the anchor at ``anchor_at``; ``begin`` is where their text begins."""

    grams: np.ndarray
    anchor: np.ndarray
    anchor_at: np.ndarray
    first: np.ndarray
    end: np.ndarray
    begin: np.ndarray
    doc: np.ndarray
    row: np.ndarray

    def of(self, keep: np.ndarray) -> dict:
        return {"anchor": _signed(self.anchor[keep]), "doc_id": self.doc[keep], "row_hash": self.row[keep]}


def runs(values: np.ndarray, counts: np.ndarray, doc: np.ndarray, row: np.ndarray, shape: Shape, skipped: int = 0) -> Runs | None:
    """The runs of texts that stand one after the other; no window reaches into the next text."""
    n_windows = np.maximum(counts - shape.size + 1, 0)
    if not n_windows.any():
        return None
    begins = np.cumsum(counts) - counts
    grams = windows(values, shape.gram)
    starts, owner = _ranges(begins, n_windows), np.repeat(np.arange(len(counts)), n_windows)
    place = least(grams, shape.size - shape.gram + 1)[starts]
    head = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])))
    first, last = starts[head], starts[np.append(head[1:], len(starts)) - 1]
    owner, place = owner[head], place[head]
    return Runs(grams, grams[place], place, first, last + 1, begins[owner] - skipped, doc[owner], row[owner])


def texts_of(batch: pa.RecordBatch) -> list[memoryview]:
    """The UTF-8 bytes of column ``text``, as views of the batch; a null is empty."""
    column = batch.column(batch.schema.get_field_index("text"))
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return []
    _, places, data = column.buffers()
    at = np.frombuffer(places, dtype=kind)[column.offset:column.offset + len(column) + 1].tolist()
    view = memoryview(data if data is not None else b"")
    return [view[lo:hi] for lo, hi in zip(at[:-1], at[1:], strict=True)]


def _chunks(batch: pa.RecordBatch, shape: Shape):
    """Runs of a batch: short texts together, so that work is done on long arrays; long texts in slices of whole windows."""
    doc, row = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("doc_id", "row_hash"))
    texts = texts_of(batch)
    held, size = [], 0
    for k, text in enumerate(texts):
        if len(text) > SLICE:
            values = shape.values([text])[0]
            for at in range(0, max(len(values) - shape.size + 1, 0), SLICE):
                part = values[at:at + SLICE + shape.size - 1]
                yield runs(part, np.array([len(part)]), doc[[k]], row[[k]], shape, at)
            continue
        held.append(k)
        size += len(text)
        if size > SLICE // 2:
            yield runs(*shape.values([texts[j] for j in held]), doc[held], row[held], shape)
            held, size = [], 0
    if held:
        yield runs(*shape.values([texts[j] for j in held]), doc[held], row[held], shape)


def _whole(of_first: np.ndarray, of_last: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Identifier of consecutive windows that overlap or touch: the first, the last and their number tell all their units."""
    return mix(of_first * U(0xD6E8FEB86659FD93) + mix(of_last + number.astype(U)))


def _based(docs: DataFrame) -> DataFrame:
    """Documents without an id stand before all others."""
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return docs.select(own.alias("doc_id"), F.hash("text").alias("row_hash"), "text")


def skipping(batch: pa.RecordBatch, bitmap: Bitmap) -> pa.RecordBatch:
    """The rows whose ``k`` is not in the bitmap."""
    keys = batch.column(batch.schema.get_field_index("k")).to_numpy(zero_copy_only=False)
    return batch.filter(pa.array(~bitmap.has(keys)))


def _scan(docs: tuple[DataFrame, DataFrame, Bitmap], shape: Shape, schema: str, rows) -> DataFrame:
    """``rows(runs)`` gives columns, or nothing.  ``docs``: all, those to read nevertheless, and a bitmap of what to skip."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    everything, rest, skip = docs

    def of(bitmap: Bitmap | None):
        def run(batches):
            for batch in batches:
                for piece in _chunks(batch if bitmap is None else skipping(batch, bitmap), shape):
                    out = rows(piece) if piece is not None else None
                    if out is not None:
                        yield pa.RecordBatch.from_arrays([_column(out[n]) for n in names], names)
        return run

    return everything.mapInArrow(of(skip), schema).unionByName(rest.mapInArrow(of(None), schema))


def _column(values) -> pa.Array:
    if isinstance(values, tuple):  # (values, how many for each row): a list column
        flat, number = values
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(number)).astype(np.int32)), pa.array(flat))
    return pa.array(values)


WHOLE = -1


def _copies(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of equal texts: all their rows with the first of each group, and the rows that are not that first one."""
    key = ["text_a", "text_b", "n"]
    own = base.select("doc_id", "row_hash", F.xxhash64("text").alias("text_a"), F.xxhash64(F.lit(1), "text").alias("text_b"),
                      F.length("text").alias("n")).where("n > 0")
    groups = own.groupBy(*key).agg(F.count("*").alias("n_rows"), F.min(F.struct("doc_id", "row_hash")).alias("first")).where("n_rows > 1")
    members = cut(own.join(groups, key).select("doc_id", "row_hash", (F.struct("doc_id", "row_hash") != F.col("first")).alias("later")))
    return members, members.where("later").select("doc_id", "row_hash").distinct()


def _without(base: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, Bitmap]:
    """The documents that are not in ``rows``, for ``_scan``: a bitmap sets most aside where they are read.

    What it sets aside wrongly is found by a join and read from a table of its own.
    """
    bitmap = Bitmap(cut(rows.select(key_of("doc_id", "row_hash").alias("k"))), "k")
    wrong = cut(base.where(bitmap.may("doc_id", "row_hash")).join(rows, ["doc_id", "row_hash"], "left_anti"))
    return base.withColumn("k", key_of("doc_id", "row_hash")), wrong, bitmap


def _ranges(first: np.ndarray, number: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each range, one after the other."""
    ends = np.cumsum(number)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + number, number)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _run_key(doc, row, start: np.ndarray, anchor: np.ndarray, side) -> np.ndarray:
    """The name of a run in a bitmap, for one side."""
    own = doc.astype(np.int64).view(U) * U(0x9E3779B97F4A7C15) + row.astype(np.int64).view(U)
    return mix(anchor ^ mix(mix(own) + start.astype(U) * U(2) + np.broadcast_to(side, len(own)).astype(U)))


def _repeated(rows: DataFrame, keys: list[str], first: bool) -> DataFrame:
    """Keys that more than one row has; with the first row where asked for."""
    what = [F.min(F.struct(*WHO)).alias("first")] if first else []
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), *what)


def _others(rows: DataFrame, groups: DataFrame, keys: list[str], keep_first: bool) -> DataFrame:
    """Spans of rows whose key repeats; without the first of each key where that one stays."""
    met = rows.join(groups.where("n_rows > 1"), keys)
    if keep_first:
        met = met.where(F.struct(*WHO) != F.col("first"))
    return met.select(*WHO, F.col("n_windows"))


def repeated_windows(docs: DataFrame, shape: Shape, keep_first: bool) -> DataFrame:
    """(doc_id, row_hash, start, n_windows): runs of windows that also stand elsewhere (earlier, where the first stays).

    ``n_windows`` is ``WHOLE`` where a whole text does.  ``docs`` is read four times; spans of one document may overlap.
    """
    gram, size = shape.gram, shape.size
    # copies of whole texts are settled first, and one of each goes on
    members, later = _copies(_based(docs))
    whole = members.where("later") if keep_first else members
    docs = _without(_based(docs), later)
    # anchors alone, counted
    counted = _scan(docs, shape, "anchor long", lambda r: {"anchor": _signed(r.anchor)}).groupBy("anchor").count()
    anchors = Bitmap(cut(counted.where("count > 1").select("anchor")), "anchor")

    def occurrences(r: Runs):
        keep = np.flatnonzero(anchors.has(_signed(r.anchor)))
        if not len(keep):
            return None
        first, end, at = r.first[keep], r.end[keep], r.anchor_at[keep]
        # grams of twice the length to either side, where a window of the run holds them
        has_right, has_left = at + 2 * gram <= end - 1 + size, at - gram >= first
        right, left = np.zeros((2, len(at)), dtype=U)
        right[has_right] = identifiers(r.grams, gram, 2 * gram, at[has_right])
        left[has_left] = identifiers(r.grams, gram, 2 * gram, at[has_left] - gram)
        whole = _whole(*[identifiers(r.grams, gram, size, p) for p in (first, end - 1)], end - first)
        return r.of(keep) | {"whole": _signed(whole), "to_left": _signed(left), "to_right": _signed(right),
                             "n_windows": (end - first).astype(np.int32), "start": first - r.begin[keep]}

    seen = cut(_scan(docs, shape, "anchor long, whole long, to_left long, to_right long, doc_id long, row_hash int, "
                     "n_windows int, start long", occurrences))
    kinds = cut(seen.groupBy("anchor", "whole").agg(
        F.count("*").alias("n_rows"), F.min(F.struct(*WHO)).alias("first"), F.first("to_left").alias("to_left"),
        F.first("to_right").alias("to_right")))
    spans = [_others(seen.select("anchor", "whole", *WHO, "n_windows"), kinds.select("anchor", "whole", "n_rows", "first"),
                     ["anchor", "whole"], keep_first)]
    # one run of each kind, where an anchor has several kinds
    several = kinds.groupBy("anchor").count().where("count > 1").select("anchor")
    several = kinds.join(several, "anchor").select("anchor", "first.*", "to_left", "to_right")
    spans += _refined(docs, shape, anchors, several, keep_first)
    spans.append(whole.select("doc_id", "row_hash", F.lit(0).cast("long").alias("start"), F.lit(WHOLE).alias("n_windows")))
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return out


def _refined(docs: tuple[DataFrame, DataFrame, Bitmap], shape: Shape, anchors: Bitmap, several: DataFrame, keep_first: bool) -> list[DataFrame]:
    gram, size, block = shape.gram, shape.size, shape.block
    several = cut(several)
    sides = several.select("anchor", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("to_left").alias("id")),
                                                       F.struct(F.lit(1).alias("side"), F.col("to_right").alias("id")))).alias("s"),
                           "doc_id", "row_hash", "start").select("anchor", "s.*", *WHO).where("id <> 0")
    both = sides.groupBy("anchor", "side", "id").count().where("count > 1").drop("count")
    alive = sides.join(both, ["anchor", "side", "id"]).select("anchor", "side", *WHO)
    if size < 3 * gram - 1:
        # windows between the two sides hold no such gram, so their runs go on whatever repeats
        alive = alive.unionByName(several.select("anchor", F.lit(2).alias("side"), *WHO))

    def name(batches):
        for b in batches:
            keys = _run_key(b["doc_id"].to_numpy(np.int64), b["row_hash"].to_numpy(np.int64), b["start"].to_numpy(np.int64),
                            b["anchor"].to_numpy(np.int64).view(U), b["side"].to_numpy(np.int64))
            yield pd.DataFrame({"k": _signed(keys)})

    names = Bitmap(cut(alive.mapInPandas(name, "k long")), "k")

    def survivors(r: Runs):
        known = np.flatnonzero(anchors.has(_signed(r.anchor)))
        sides = np.zeros((3, len(r.anchor)), dtype=bool)
        for k in range(3 if size < 3 * gram - 1 else 2):
            sides[k, known] = names.has(_signed(_run_key(r.doc[known], r.row[known], (r.first - r.begin)[known], r.anchor[known], k)))
        # a window at offset o behind its start holds the left gram from o = gram on, the right one up to size - 2 gram
        low, high = r.anchor_at - (r.end - 1), r.anchor_at - r.first
        high = np.where(sides[0], high, np.minimum(high, gram - 1))
        low = np.where(sides[1], low, np.maximum(low, size - 2 * gram + 1))
        keep = np.flatnonzero(sides.any(axis=0) & (low <= high))
        if not len(keep):
            return None
        at, low, high = r.anchor_at[keep], low[keep], high[keep]
        ids = identifiers(r.grams, gram, size, _ranges(at - high, high - low + 1))
        blocks = high // block - low // block + 1
        # cores from the lowest block up: at -8b, falling
        cores = identifiers(r.grams, gram, size - block + 1, np.repeat(at - block * (low // block), blocks)
                            - block * _ranges(np.zeros(len(blocks), dtype=np.int64), blocks))
        return r.of(keep) | {"ids": (_signed(ids), high - low + 1), "cores": (_signed(cores), blocks), "offset": high.astype(np.int32),
                             "start": at - high - r.begin[keep]}

    left = cut(_scan(docs, shape, "anchor long, ids array<long>, cores array<long>, doc_id long, row_hash int, offset int, start long",
                     survivors))
    # blocks of windows whose offsets have one quotient, so equal windows are in equal blocks; all windows of a
    # block hold its core, so where no other block of the anchor has that core, none of its windows repeats
    parts = F.transform(F.sequence(F.floor((F.col("offset") - F.size("ids") + 1) / block), F.floor(F.col("offset") / block)), lambda b, i: F.struct(
        b.alias("block"), F.get("cores", i).alias("core"), F.greatest(F.lit(0), F.col("offset") - (b + 1) * block + 1).cast("int").alias("lo"),
        F.least(F.size("ids") - 1, F.col("offset") - b * block).cast("int").alias("hi")))
    blocks = left.select("anchor", "doc_id", "row_hash", "start", "offset", "ids", F.explode(parts).alias("b")).select(
        "anchor", "b.block", "b.core", "doc_id", "row_hash", (F.col("start") + F.col("b.lo")).alias("start"),
        (F.col("offset") - F.col("b.lo")).alias("offset"), F.slice("ids", F.col("b.lo") + 1, F.col("b.hi") - F.col("b.lo") + 1).alias("ids"))
    blocks = blocks.select("*", F.xxhash64("ids").alias("whole"), F.size("ids").alias("n_windows"))
    keys = ["anchor", "block", "core", "whole"]
    groups = cut(_repeated(blocks, keys, True))
    spans = [_others(blocks.select(*keys, *WHO, "n_windows"), groups, keys, keep_first)]
    several = groups.groupBy("anchor", "block", "core").count().where("count > 1").drop("count")
    last = cut(groups.join(several, ["anchor", "block", "core"]).select(*keys, "first.*"))
    open_ = Bitmap(last.select(key_of(*keys, *WHO).alias("k")), "k").may(*keys, *WHO)
    ones = cut(blocks.select(*keys, *WHO, "ids").where(open_).join(last, [*keys, *WHO], "left_semi").select(
        "anchor", "doc_id", "row_hash", F.posexplode("ids").alias("k", "id"), "start")
        .select("anchor", "id", "doc_id", "row_hash", (F.col("start") + F.col("k")).alias("start"), F.lit(1).alias("n_windows")))
    return spans + [_others(ones, _repeated(ones, ["anchor", "id"], True), ["anchor", "id"], keep_first)]


def applied(docs: DataFrame, spans: DataFrame, size: int, made, schema: str) -> DataFrame:
    """``made(text, spans)`` of every document, as columns behind its doc_id; spans are merged, None where there are none."""
    end = F.when(F.col("n_windows") == WHOLE, F.lit(WHOLE)).otherwise(F.col("start") + F.col("n_windows") + size - 1)
    each = cut(spans.groupBy("doc_id", "row_hash").agg(F.collect_list(F.struct("start", end.alias("end"))).alias("spans")))
    # only texts that may have spans are shuffled to meet them
    bitmap = Bitmap(each.select(key_of("doc_id", "row_hash").alias("k")), "k")
    base = _based(docs)
    touched = base.where(bitmap.may("doc_id", "row_hash")).join(each, ["doc_id", "row_hash"], "left")
    types = [c.strip().split(" ") for c in schema.split(",")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def of(skip: Bitmap | None):
        def run(batches):
            for batch in batches:
                batch = batch if skip is None else skipping(batch, skip)
                ids = batch.column(batch.schema.get_field_index("doc_id"))
                found = batch.column(batch.schema.get_field_index("spans")) if skip is None else [None] * len(batch)
                rows = [made(bytes(t), s if s is None else s.as_py()) for t, s in zip(texts_of(batch), found, strict=True)]
                yield pa.RecordBatch.from_arrays([ids] + [pa.array([r[k] for r in rows], type=kinds[t])
                                                          for k, (_, t) in enumerate(types)], ["doc_id", *[n for n, _ in types]])
        return run

    out = (base.withColumn("k", key_of("doc_id", "row_hash")).select("doc_id", "text", "k").mapInArrow(of(bitmap), f"doc_id long, {schema}")
           .unionByName(touched.select("doc_id", "text", "spans").mapInArrow(of(None), f"doc_id long, {schema}")))
    return out.withColumn("doc_id", F.when(F.col("doc_id") > -(1 << 63), F.col("doc_id")))


def merged(spans, units: int, size: int) -> list[tuple[int, int]]:
    """Spans of a text of so many units, joined where they overlap or touch."""
    out: list[tuple[int, int]] = []
    if spans is not None and any(s["end"] == WHOLE for s in spans):
        return [(0, units)] if units >= size else []
    for first, end in sorted((s["start"], s["end"]) for s in spans) if spans is not None else ():
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out
