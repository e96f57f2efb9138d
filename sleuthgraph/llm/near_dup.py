"""Near-duplicate documents by HyperMinHash registers, banding and verification on full shingle sets.

A shingle hash picks one of 256 buckets; the bucket keeps the leading-zero count
and ten mantissa bits of its least hash.  Six registers make a band.  Documents
with equal shingle sets are one class from the start, so copies of any number
cost one row each.  Class representatives that share a band are candidates:
first each against the member of its band that shares most bands with others, then, inside bands that still hold
more than one component, all pairs of different components, compared in blocks.
Every link is confirmed on the full sets.

The registers only make the band keys.  The estimate in blocks is made on a
sketch of its own, 512 one-byte min-hashes (Jaccard corrected for chance matches
of bytes): as many bytes as 256 registers but twice the draws, and its empty
buckets stay empty, while registers borrow from filled ones, so that equal
registers of a small set are no independent draws.  The first pass has no
estimate: its pairs go straight to the full sets.

42 bands of six registers miss a pair at similarity 0.85 with probability
0.62 ** 42, about 2e-9; a text with few shingles shares every band that no
differing shingle falls in.

Nulls and ties: null texts and texts without words have no shingles and are
linked with nothing; rows with one id are one node; rows without an id have no
component and stay; an empty table gives no rows.  ``near_duplicates`` returns
ids and sizes only, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleuthgraph.plans.lineage import cut

from .bitmaps import Bitmap, key_of
from .components import components
from .hashing import U, mix, shingles

SHINGLE = 5
PERCENT = 85
REGISTERS = 256
MANTISSA_BITS = 10
ROWS_PER_BAND = 6
BANDS = REGISTERS // ROWS_PER_BAND
COARSE = 512
BLOCK = 256
#: Pairs whose estimate lies so many standard deviations below the threshold are not verified.
DEVIATIONS = 5

SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, coarse binary, digests binary, bands array<long>"


def leasts(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The filled buckets, by the leading bits, and the least remainder in each."""
    h = np.sort(hashes)
    bucket = (h >> U(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return bucket[first], h[first] & U((1 << (64 - bits)) - 1)


def coarse_of(hashes: np.ndarray) -> np.ndarray:
    """One byte for each of ``COARSE`` buckets, 0 where it is empty: for estimates only."""
    out = np.zeros(COARSE, dtype=np.uint8)
    if len(hashes):
        bucket, rest = leasts(mix(hashes ^ U(0x27220A95FE1DBA6B)), COARSE.bit_length() - 1)
        out[bucket] = (mix(rest) % U(255)).astype(np.uint8) + np.uint8(1)
    return out


def registers(hashes: np.ndarray) -> np.ndarray:
    """The bucket registers of a shingle set; all 0 for the empty set."""
    out = np.zeros(REGISTERS, dtype=np.uint16)
    if len(hashes):
        bucket, rest = leasts(mix(hashes ^ U(0x5851F42D4C957F2D)), 8)
        least = np.full(REGISTERS, U((1 << 56) - 1))
        least[bucket] = rest
        full = np.zeros(REGISTERS, dtype=bool)
        full[bucket] = True
        width = np.frexp(least.astype(np.float64))[1].astype(np.int64)  # bits in use
        zeros = np.clip(56 - width, 0, 45)
        shift = np.maximum(56 - zeros - 1 - MANTISSA_BITS, 0).astype(U)
        mantissa = (least >> shift) & U((1 << MANTISSA_BITS) - 1)
        out[full] = ((zeros.astype(U) + U(1)) << U(MANTISSA_BITS) | mantissa).astype(np.uint16)[full]
        # an empty bucket borrows from the first filled one on a fixed walk of its own, so that small
        # sets agree in a register as often as large ones of the same similarity
        empty, step = np.flatnonzero(~full), 0
        while len(empty):
            step += 1
            there = (mix(empty.astype(U) * U(0x2545F4914F6CDD1D) + U(step)) >> U(56)).astype(np.int64)
            found = full[there]
            out[empty[found]] = out[there[found]]
            empty = empty[~found]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One key for each band; none for the empty set."""
    rows = regs[:BANDS * ROWS_PER_BAND].reshape(BANDS, ROWS_PER_BAND).astype(U)
    key = np.arange(1, BANDS + 1, dtype=U)
    for k in range(ROWS_PER_BAND):
        key = mix(key * U(0x9E3779B97F4A7C15) + rows[:, k])
    return key[rows.any(axis=1)]


def corrected(matches: np.ndarray, filled: np.ndarray, chance: float) -> np.ndarray:
    """Jaccard from the share of equal registers, without those that are equal by chance."""
    share = matches / np.maximum(filled, 1)
    return np.clip((share - chance) / (1 - chance), 0, 1)


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity of one coarse sketch to each of several."""
    filled = ((x > 0) | (y > 0)).sum(axis=1)
    return corrected(((x == y) & (x > 0)).sum(axis=1), filled, 1 / 255)


def bound(x: np.ndarray, y: np.ndarray, total: np.ndarray, least: float) -> np.ndarray:
    """The least estimate of a pair that may reach ``least``: the filled buckets are draws from the union without return."""
    filled = np.maximum(((x > 0) | (y > 0)).sum(axis=1), 1)
    union = np.maximum(total / (1 + least), filled + 1)
    return least - DEVIATIONS * np.sqrt(least * (1 - least) / filled * np.maximum(1 - filled / union, 0.05)) - 2 / filled


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                s = shingles(text, size)
                regs = registers(s)
                with np.errstate(over="ignore"):
                    a, b = (mix(s).sum(dtype=U), mix(s ^ U(0xD6E8FEB86659FD93)).sum(dtype=U))
                keys = band_keys(regs)
                rows.append((doc, len(s), a.view(np.int64), b.view(np.int64), coarse_of(s).tobytes(),
                             (keys >> U(32)).astype(np.uint32).tobytes(), keys.view(np.int64)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "set_a", "set_b", "coarse", "digests", "bands"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, SKETCH)


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    involved = Bitmap(pairs.select("a").union(pairs.select("b")).distinct().select(key_of("a").alias("id")), "id")
    texts = docs.select("doc_id", "text").where("doc_id is not null").where(involved.may("doc_id"))
    both = (pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left")), "a")
            .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right")), "b"))

    def run(batches):
        last, pivot = None, None
        for batch in batches:
            ok = []
            for left, right in zip(batch["left"], batch["right"], strict=True):
                if right != last:
                    last, pivot = right, shingles(right, size)
                x = shingles(left, size)
                common = len(np.intersect1d(x, pivot, assume_unique=True))
                ok.append(common > 0 and 100 * common >= percent * (len(x) + len(pivot) - common))
            yield batch.loc[ok, ["a", "b"]]

    return both.select("a", "b", "left", "right").mapInPandas(run, "a long, b long").distinct()


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components inside a band whose registers look alike, from blocks of at most about ``BLOCK`` rows."""
    counts = members.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y"))
    mixed = counts.where("x <> y").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    blocks = (members.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
              .groupBy("band", "key", "blocks", "block")
              .agg(F.collect_list(F.struct("node", "component", "n_shingles", "coarse", "digests")).alias("rows")))
    ahead = blocks.select("band", "key", F.col("rows").alias("here"), "block", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("other"))
    pairs = ahead.join(blocks.select("key", F.col("block").alias("other"), F.col("rows").alias("there")), ["key", "other"])

    def run(batches):
        for batch in batches:
            found = []
            for band, here, there in zip(batch["band"], batch["here"], batch["there"], strict=True):
                (xn, xc, xs, xr, xd), (yn, yc, ys, yr, yd) = _block(here), _block(there)
                for k in range(len(xn)):
                    low, high = np.minimum(ys, xs[k]), np.maximum(ys, xs[k])
                    near = np.flatnonzero((yc != xc[k]) & (100 * low >= percent * high))
                    # a pair is looked at in the first band that it shares
                    near = near[(yd[near] == xd[k]).argmax(axis=1) == band]
                    if len(near):
                        close = estimate(xr[k], yr[near]) >= bound(xr[k], yr[near], xs[k] + ys[near], percent / 100)
                        found += [(max(xn[k], y), min(xn[k], y)) for y in yn[near[close]]]
            yield pd.DataFrame(sorted(set(found)), columns=["a", "b"]).astype("int64")

    return pairs.select("band", "here", "there").mapInPandas(run, "a long, b long").distinct()


def _block(rows) -> tuple[np.ndarray, ...]:
    return (np.array([r["node"] for r in rows]), np.array([r["component"] for r in rows]), np.array([r["n_shingles"] for r in rows]),
            np.stack([np.frombuffer(r["coarse"], dtype=np.uint8) for r in rows]),
            np.stack([np.frombuffer(r["digests"], dtype=np.uint32) for r in rows]))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    known = cut(sketches(docs, size))
    # a class: documents with the same shingle set
    classes = known.where("doc_id is not null and n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("node"))
    member = cut(known.where("doc_id is not null and n_shingles > 0").select("doc_id", "set_a", "set_b", "n_shingles")
                 .join(classes, ["set_a", "set_b", "n_shingles"]).select("doc_id", "node"))
    nodes = (known.where("n_shingles > 1").select(F.col("doc_id").alias("node"), "bands", "n_shingles", "coarse", "digests")
             .join(member.where("doc_id = node").select("node").distinct(), "node", "left_semi"))
    bands = nodes.select(F.posexplode("bands").alias("band", "key"), "node")
    inside = cut(bands.join(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))
    # the pivot of a band is the member that shares most with others: of copies of one text, that text itself
    liked = inside.groupBy("node").agg(F.sum("n").alias("liked"))
    pivots = inside.join(liked, "node").groupBy("key").agg(F.max(F.struct("liked", (-F.col("node")).alias("m"))).alias("p"))
    sizes = nodes.select("node", "n_shingles")
    first = cut(inside.join(pivots.select("key", (-F.col("p.m")).alias("b")), "key").where("node <> b")
                .select(F.col("node").alias("a"), "b").distinct()
                .join(sizes.select(F.col("node").alias("a"), F.col("n_shingles").alias("x")), "a")
                .join(sizes.select(F.col("node").alias("b"), F.col("n_shingles").alias("y")), "b")
                .where(100 * F.least("x", "y") >= percent * F.greatest("x", "y")).select("a", "b"))
    links = cut(verified(first, docs, size, percent))
    found = components(links)
    labelled = (inside.select("band", "key", "node").join(found.withColumnRenamed("component", "_c"), "node", "left")
                .join(nodes.select("node", "n_shingles", "coarse", "digests"), "node")
                .select("band", "key", "node", F.coalesce("_c", "node").alias("component"), "n_shingles", "coarse", "digests"))
    done = first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    rest = cut(_across(cut(labelled), percent).join(done, ["a", "b"], "left_anti"))
    links = links.unionByName(verified(rest, docs, size, percent)).unionByName(
        member.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    found = components(links)
    out = known.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
