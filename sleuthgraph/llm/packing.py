"""Best-fit packing of documents into token sequences, after a Martello-Toth dominance reduction.

Only lengths decide how bins are filled, and a length lies between 1 and the
capacity.  So the packing is planned on the histogram of lengths, whose size is
bounded by the capacity and not by the corpus: the reduction fixes sets that
dominate every alternative, best-fit decreasing fills bins with the rest, and
equal bins stay one entry with a count.  The plan is a table of slots; a piece
finds its slot by its length and its rank among the pieces of that length.

Nulls and ties: a null text is an empty document (the end token alone); rows
are pieces of their own, also when they repeat; an empty table gives no rows.
Other columns of the input are not read.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sleuthgraph.plans.lineage import cut

END_TOKEN = 1
CAPACITY = 4096
SPLITS_PER_LENGTH = 64
CACHED_CHUNKS = 1_000_000
LONGEST_CACHED_CHUNK = 48
# How the vocabulary file splits lower-cased text, restricted to printable ASCII.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_encoders: dict[str, "ChunkEncoder"] = {}


class ChunkEncoder:
    """Token ids of a text as little-endian 32-bit bytes, from the ids of its blank-separated chunks.

    The vocabulary drops white space before it splits words, so the ids of a
    text are those of its chunks in order.  Ids of short chunks are remembered,
    in a store of bounded size.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.marks = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.mark, self.mark_id = next(iter(self.marks.items()), (None, None))
        self.known: dict[str, bytes] = {}

    def _single(self, chunk: str) -> bytes:
        return np.asarray(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, chunks: list[str]) -> None:
        """Encode new chunks: printable ASCII word by word, others in one call with the vocabulary's own mark between them."""
        model, rest = self.tokenizer.model, []
        for c in chunks:
            if c.isascii() and c.isprintable() and "<|" not in c:
                ids = [t.id for w in ASCII_WORDS.findall(c.lower()) for t in model.tokenize(w)]
                self.known[c] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                rest.append(c)
        self._learn_any(rest)

    def _learn_any(self, chunks: list[str]) -> None:
        plain = [c for c in chunks if not any(m in c for m in self.marks)] if self.mark else []
        for c in chunks if not plain else set(chunks).difference(plain):
            self.known[c] = self._single(c)
        if plain:
            ids = np.asarray(self.tokenizer.encode(self.mark.join(plain), add_special_tokens=False).ids, dtype="<u4")
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids)) * 4
            raw, begin = ids.tobytes(), 0
            for c, end in zip(plain, ends.tolist(), strict=True):
                self.known[c] = raw[begin:end]
                begin = end + 4

    def encode(self, texts: list[str]) -> list[bytes]:
        rows = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > CACHED_CHUNKS:
            self.known.clear()
        fresh = {c for row in rows for c in row}.difference(self.known)
        long = {c for c in fresh if len(c) > LONGEST_CACHED_CHUNK}
        self.learn(sorted(fresh - long))
        return [b"".join([self.known[c] if c not in long else self._single(c) for c in row]) if long.intersection(row)
                else b"".join(map(self.known.__getitem__, row)) for row in rows]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Every document as token ids and the end token, cut only where longer than ``capacity``."""
    end = np.asarray([END_TOKEN], dtype="<u4").tobytes()

    def run(batches):
        if tokenizer not in _encoders:
            _encoders[tokenizer] = ChunkEncoder(tokenizer)
        encoder = _encoders[tokenizer]
        for batch in batches:
            for at in range(0, len(batch), 256):
                part, out = batch.iloc[at:at + 256], []
                for doc, ids in zip(part["doc_id"], encoder.encode(part["text"].tolist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for k, start in enumerate(range(0, n, capacity)):
                        body = ids[4 * start:4 * (start + capacity)]
                        out.append((doc, k, start, len(body) // 4, zlib.crc32(body)))
                rows = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                yield rows.astype({"doc_id": "Int64"})

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, PIECES)


@dataclass(frozen=True)
class Bin:
    """``count`` equal bins; ``items`` holds (length, how many of it in each bin)."""

    items: tuple[tuple[int, int], ...]
    count: int
    reduced: bool


def dominated(counts: np.ndarray, capacity: int) -> list[Bin]:
    """Take from ``counts`` the sets that dominate every other set with the same largest item.

    For the largest item j with room r, let k be the largest item that fits
    beside it.  {j} is fixed when nothing fits; {j, k} when k fills the room,
    when no two further items fit beside j, or when at most two fit and no
    fitting pair is longer than k.  Items without such a set are left.
    """
    fixed = []
    for j in range(capacity, 0, -1):
        while counts[j]:
            room = capacity - j
            counts[j] -= 1  # what stands beside one item j
            sizes = np.flatnonzero(counts[:room + 1])
            if not len(sizes):
                counts[j] += 1
                fixed.append(Bin(((j, 1),), int(counts[j]), True))
                counts[j] = 0
                break
            k = int(sizes[-1])
            low = np.repeat(sizes[:3], np.minimum(counts[sizes[:3]], 3))[:3].tolist() + [room + 1] * 3
            fits = k == room or low[0] + low[1] > room
            if not fits and sum(low[:3]) > room:
                fits = _longest_pair(sizes, counts, room) <= k
            counts[j] += 1
            if not fits:
                break
            n = int(counts[j] // 2 if j == k else min(counts[j], counts[k]))
            fixed.append(Bin(((j, 2),) if j == k else ((j, 1), (k, 1)), n, True))
            counts[j] -= n
            counts[k] -= n
    return fixed


def _longest_pair(sizes: np.ndarray, counts: np.ndarray, room: int) -> int:
    """The largest sum of two items that is at most ``room``; 0 if there is none."""
    partner = np.searchsorted(sizes, room - sizes, side="right") - 1
    same = (partner >= 0) & (sizes[partner] == sizes) & (counts[sizes] < 2)
    partner = np.where(same, partner - 1, partner)
    sums = np.where(partner >= 0, sizes + sizes[np.maximum(partner, 0)], 0)
    return int(sums.max(initial=0))


def best_fit(counts: np.ndarray, capacity: int) -> list[Bin]:
    """Best-fit decreasing over the histogram: each item goes where the least room stays."""
    open_bins: dict[int, list[tuple[tuple, int]]] = {}
    rooms: list[int] = []

    def put(room: int, items: tuple, n: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            bisect.insort(rooms, room)
        open_bins[room].append((items, n))

    for size in range(capacity, 0, -1):
        left = int(counts[size])
        while left:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                room, items, n = capacity, (), left
            else:
                room = rooms[at]
                items, n = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(at)
            each = min(room // size, left)
            full = min(n, left // each)
            put(room - each * size, (*items, (size, each)), full)
            if n > full and items:
                put(room, items, n - full)
            left -= full * each
    return [Bin(items, n, False) for group in open_bins.values() for items, n in group]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[Bin]:
    """Bins for a histogram of lengths (``counts[length]``)."""
    counts = np.array(counts, dtype=np.int64)
    return dominated(counts, capacity) + best_fit(counts, capacity)


def slots(bins: list[Bin]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, items a bin, first bin, offset, reduced), sorted by first rank."""
    taken: dict[int, int] = {}
    found: dict[int, list] = {}
    first = 0
    for b in bins:
        offset = 0
        for size, each in b.items:
            rank = taken.get(size, 0)
            found.setdefault(size, []).append((rank, each, first, offset, int(b.reduced)))
            taken[size] = rank + each * b.count
            offset += size * each
        first += b.count
    return {size: np.asarray(rows, dtype=np.int64) for size, rows in found.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id``, ``offset`` and ``by_reduction`` to a table of pieces; it is read twice, so write it first.

    Ranks come from counts per length and part of it, so a length that a third
    of all pieces have is spread over ``SPLITS_PER_LENGTH`` tasks.
    """
    spark = pieces.sparkSession
    parted = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SPLITS_PER_LENGTH)))
    # at most capacity * SPLITS_PER_LENGTH rows, whatever the corpus
    sizes = parted.groupBy("length", "_part").count().toPandas()
    each_part = np.zeros((capacity + 1, SPLITS_PER_LENGTH), dtype=np.int64)
    each_part[sizes["length"].to_numpy(int), sizes["_part"].to_numpy(int)] = sizes["count"].to_numpy(int)
    counts = each_part.sum(axis=1)
    found = slots(plan(counts, capacity))
    # slots of all lengths under one another; a length begins at first_slot[length]
    table = np.concatenate([found[n] for n in sorted(found)]) if found else np.zeros((0, 5), dtype=np.int64)
    key = np.repeat(sorted(found), [len(found[n]) for n in sorted(found)]).astype(np.int64) << 48 | table[:, 0]
    shared = spark.sparkContext.broadcast((each_part.cumsum(axis=1) - each_part, key, table))
    order = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = parted.withColumn("_rank", F.row_number().over(order) - 1)

    def place(batches):
        before, key, table = shared.value
        for batch in batches:
            size = batch["length"].to_numpy(np.int64)
            rank = batch["_rank"].to_numpy(np.int64) + before[size, batch["_part"].to_numpy(np.int64)]
            row = table[np.searchsorted(key, size << 48 | rank, side="right") - 1]
            inner, each = rank - row[:, 0], row[:, 1]
            yield batch.drop(columns=["_part", "_rank"]).assign(
                sequence_id=row[:, 2] + inner // each, offset=row[:, 3] + inner % each * size, by_reduction=row[:, 4] == 1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInPandas(place, f"{schema}, sequence_id long, offset long, by_reduction boolean")


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their place in a sequence."""
    return pack(cut(token_pieces(docs, tokenizer, capacity)), capacity)
