"""Benchmark passages in documents, by SimHash windows of an item's own length.

A window of as many words as an item has gets a 64-bit SimHash of its weighted
five-word shingles (weight: how often a shingle stands in the window).  The
fingerprints are cut into ``RADIUS + 1`` blocks; a window and an item of its length whose
fingerprints differ in at most ``RADIUS`` bits agree in one block at least, so
looking up blocks finds all of them.  Candidates within the radius are verified by the
exact weighted similarity of their shingles: sum of the lesser weights over sum of the
greater ones.  At similarity 0.8 the fingerprints differ in 10 bits, give or take 3; the
radius of 22 leaves out about one pair in a hundred thousand.

A window as similar as that holds a shingle of the item, so windows are made only
around words where a shingle of any item begins; nothing is lost by that.
The benchmark is read in blocks of at most ``ITEMS_PER_BLOCK`` items, each a broadcast of
bounded size and one pass over the documents.

Nulls and ties: null texts and items without words match nothing; a text shorter than
an item is one window; of windows as similar the first one is reported; items that
repeat are reported each; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import U, lowered, mix, utf8, windows, words

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 22
BITS = 64
ITEMS_PER_BLOCK = 20_000
SLICE = 4096

BOUNDS = np.linspace(0, BITS, RADIUS + 2).astype(int)


def word_hashes(text: str | None) -> np.ndarray:
    return words(lowered(utf8(text)))[0]


def signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle."""
    bits = np.unpackbits(np.ascontiguousarray(mix(shingles)).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def simhashes(shingles: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of every run of ``size`` shingles, as rows of 64 bits."""
    sums = np.zeros((len(shingles) + 1, BITS), dtype=np.int32)
    np.cumsum(signs(shingles), axis=0, out=sums[1:])
    return (sums[size:] - sums[:-size]) > 0


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two multisets of shingles."""
    values, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = (np.bincount(w, minlength=len(values)) for w in (where[:len(a)], where[len(a):]))
    return float(np.minimum(x, y).sum() / np.maximum(np.maximum(x, y).sum(), 1))


class Items:
    """Benchmark items by length, with their fingerprints' blocks sorted for lookup."""

    def __init__(self, ids: list, texts: list):
        self.by_length: dict[int, list] = {}
        self.sizes: set[int] = set()
        every: dict[int, list] = {}
        for item, text in zip(ids, texts, strict=True):
            h = word_hashes(text)
            if len(h):
                size = min(SHINGLE, len(h))
                s = windows(h, size)
                self.by_length.setdefault(len(h), []).append((item, s, simhashes(s, len(s))[0]))
                every.setdefault(size, []).append((np.unique(s), len(h)))
        # shingles in order, each beside the length of an item that has it
        self.shingles = {}
        for size, known in every.items():
            s = np.concatenate([x for x, _ in known])
            order = np.argsort(s, kind="stable")
            self.shingles[size] = (s[order], np.repeat([n for _, n in known], [len(x) for x, _ in known])[order])
        self.marked = {size: self._marks(s) for size, (s, _) in self.shingles.items()}
        self.longest = max(self.by_length, default=0)
        self.index = {n: self._blocks(np.stack([p for _, _, p in rows])) for n, rows in self.by_length.items()}

    @staticmethod
    def _marks(s: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << 20, dtype=bool)
        out[(s >> U(44)).astype(np.int64)] = True
        return out

    @staticmethod
    def _blocks(prints: np.ndarray) -> list:
        out = []
        for lo, hi in zip(BOUNDS[:-1], BOUNDS[1:], strict=True):
            value = prints[:, lo:hi] @ (1 << np.arange(hi - lo))
            order = np.argsort(value, kind="stable")
            out.append((value[order], order))
        return out

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, length): words where a shingle of an item of that length begins, in order."""
        at, lengths = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for size, (s, of) in self.shingles.items():
            w = windows(h, size)
            near = np.flatnonzero(self.marked[size][(w >> U(44)).astype(np.int64)])
            first, last = np.searchsorted(s, w[near], "left"), np.searchsorted(s, w[near], "right")
            n = last - first
            at.append(np.repeat(near, n))
            lengths.append(of[np.repeat(first - n.cumsum() + n, n) + np.arange(n.sum())])
        at, lengths = np.concatenate(at), np.concatenate(lengths)
        order = np.argsort(at, kind="stable")
        return at[order], lengths[order]

    def candidates(self, length: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs that agree in a block and lie within the radius."""
        rows, items = [], []
        for (value, order), lo, hi in zip(self.index[length], BOUNDS[:-1], BOUNDS[1:], strict=True):
            mine = prints[:, lo:hi] @ (1 << np.arange(hi - lo))
            first, last = np.searchsorted(value, mine, "left"), np.searchsorted(value, mine, "right")
            n = last - first
            rows.append(np.repeat(np.arange(len(mine)), n))
            items.append(order[np.repeat(first - n.cumsum() + n, n) + np.arange(n.sum())])
        width = len(self.by_length[length])
        both = np.unique(np.concatenate(rows) * width + np.concatenate(items))
        w, k = both // width, both % width
        known = np.stack([p for _, _, p in self.by_length[length]])
        near = (prints[w] != known[k]).sum(axis=1) <= RADIUS
        return w[near], k[near]

    def leaks(self, h: np.ndarray, least: float) -> list[tuple]:
        """(item, similarity, first word, words) of the best window of each item that is found."""
        best: dict = {}
        hits, lengths = self.hits(h)
        if not len(hits):
            return []
        for lo, hi in self._regions(hits, len(h)):
            # a window as similar as asked has a shingle of its item, so other lengths need no windows here
            for length in np.unique(lengths[np.searchsorted(hits, lo):np.searchsorted(hits, hi)]).tolist():
                rows = self.by_length[length]
                span = min(length, len(h))
                part, size = h[lo:hi], min(SHINGLE, length, span)
                if len(part) < span:
                    continue
                s = windows(part, size)
                per = span - size + 1
                w, k = self.candidates(length, simhashes(s, per))
                for at, item in zip(w.tolist(), k.tolist(), strict=True):
                    name, mine, _ = rows[item]
                    like = similarity(s[at:at + per], mine)
                    if like >= least and (-like, lo + at) < best.get((length, item), (1.0, 0, None))[:2]:
                        best[length, item] = (-like, lo + at, (name, like, lo + at, span))
        return [b[2] for b in best.values()]

    def _regions(self, hits: np.ndarray, n: int) -> list[tuple[int, int]]:
        """Stretches of words around hits that hold every window with a hit, in slices that overlap by a window."""
        out: list[list[int]] = []
        for at in hits.tolist():
            lo, hi = max(0, at - self.longest), min(n, at + self.longest + SHINGLE)
            if out and lo <= out[-1][1]:
                out[-1][1] = hi
            else:
                out.append([lo, hi])
        return [(k, min(hi, k + SLICE + self.longest)) for lo, hi in out for k in range(lo, hi, SLICE)]


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): benchmark items that a document holds a window of."""
    spark = docs.sparkSession
    total = benchmark.count()
    blocks = max(1, -(-total // ITEMS_PER_BLOCK))
    parts = []
    for k in range(blocks):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).select("item_id", "text").toPandas()
        rows = rows.sort_values(["item_id", "text"])
        items = Items([None if pd.isna(i) else int(i) for i in rows["item_id"]], rows["text"].tolist())
        parts.append(_matches(docs, spark.sparkContext.broadcast(items), least))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _matches(docs: DataFrame, shared, least: float) -> DataFrame:
    def run(batches):
        items = shared.value
        for batch in batches:
            rows = [(doc, *leak) for doc, text in zip(batch["doc_id"], batch["text"], strict=True)
                    for leak in items.leaks(word_hashes(text), least)]
            out = pd.DataFrame(rows, columns=["doc_id", "item_id", "similarity", "first_word", "n_words"])
            yield out.astype({"doc_id": "Int64", "item_id": "Int64", "similarity": "float64", "first_word": "int64", "n_words": "int64"})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, item_id long, similarity double, first_word long, n_words long")


def clean(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The documents that hold no benchmark passage; documents without an id have none removed."""
    found = leaks(docs, benchmark, least).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
