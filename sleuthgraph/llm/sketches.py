"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is the set of its paragraph digests (a line, long lines in pieces of
``PIECE`` code points; empty lines are left out), each with the number of times
it occurs.  Every element falls into one cell of each of three tables; a cell
holds the count, the combined digests and the combined checks of its elements.
Subtracting two sketches of one size cancels what the texts share.  Peeling
takes cells with one element left, removes that element from its other cells,
and goes on until nothing is left: the differing digests.  Where cells remain
the pair is sketched again with four times the cells.

Everything is DataFrame operations.  Documents are dealt once, by ranges of ids,
so that each meets the next one; cells and peeling stay in that partition, since
every grouping has the range in its key.

Nulls and ties: a null text is an empty one; null ids come after all others in
descending order; rows with one id are ordered by text, and each is a document; a single
document is its own next one; an empty table gives no rows.  Two empty sets are
alike (1.0).  Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sleuthgraph.plans.lineage import cut

PIECE = 128
TABLES = 3
ROUNDS = 7
SCALE = 2
GROWTH = 4
# ranges of ids for each shuffle partition: the cells of a range stay in memory
RANGES = 3


def _range_of(docs: DataFrame, column: str, ranges: int) -> tuple[Column, list]:
    """The number of the range that an id falls into, and the bounds; a range holds whole ids."""
    shares = [k / ranges for k in range(1, ranges)]
    bounds = sorted(set(docs.select(F.percentile_approx(column, shares, 100 * ranges).alias("b")).first()["b"] or [])) if shares else []
    if not bounds:
        return F.lit(0), bounds
    # binary search: steps of falling powers of two over the sorted bounds
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    table = F.lit(bounds)
    found = F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(
        (at + step <= len(bounds)) & (F.try_element_at(table, at + step) < F.col(column)), at + step).otherwise(at))
    return F.coalesce(found, F.lit(0)), bounds


def with_next(docs: DataFrame) -> DataFrame:
    """(range, row, doc_id, text, next_id, next): each document with the text of the one before it in ascending order.

    The last document of a range is also sent to the next range that has rows,
    and the last of all to the first, so no window spans more than a range.
    """
    ranges = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    number, _ = _range_of(base, "doc_id", ranges)
    # one row for each range: its largest id
    ends = base.groupBy(number.alias("r")).agg(F.max("doc_id").alias("top")).orderBy("r").collect()
    if not ends:
        return base.select(F.lit(0).alias("range"), F.lit(0).alias("row"), "doc_id", "text", F.col("doc_id").alias("next_id"),
                           F.lit("").alias("next"))
    to = {row["r"]: ends[(k + 1) % len(ends)]["r"] for k, row in enumerate(ends)}
    top = F.create_map(*[F.lit(v) for row in ends if row["top"] is not None for v in (row["r"], row["top"])]) \
        if any(row["top"] is not None for row in ends) else None
    target = F.create_map(*[F.lit(v) for pair in to.items() for v in pair])
    is_top = F.col("doc_id").isNull() if top is None else F.coalesce(F.col("doc_id") == top[F.col("_r")], F.lit(False))
    placed = base.withColumn("_r", number).withColumn("_to", F.explode(F.when(is_top, F.array(
        F.struct(F.col("_r").alias("range"), F.lit(False).alias("guest")),
        F.struct(target[F.col("_r")].alias("range"), F.lit(True).alias("guest")))).otherwise(F.array(
            F.struct(F.col("_r").alias("range"), F.lit(False).alias("guest"))))))
    placed = placed.select("_to.range", "_to.guest", "doc_id", "text").repartition(ranges, "range")
    order = Window.partitionBy("range").orderBy(F.col("guest").desc(), F.col("doc_id").asc_nulls_first(), "text")
    return (placed.withColumns({"next": F.lag("text").over(order), "next_id": F.lag("doc_id").over(order),
                                "row": F.row_number().over(order)}).where("not guest")
            .select("range", "row", "doc_id", "text", "next_id", "next"))


def edited(text: Column, other: Column) -> Column:
    """The text with its last half (rounded down) replaced by as many first code points of ``other``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(other, half))


def _pieces(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"([^\\n]{{1,{PIECE}}})"), 1), lambda p: F.xxhash64(p))


def _cells(elements: Column, scale: int) -> Column:
    """Cells of one table, a power of two, for a set of so many elements; sizes are comparable by folding."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(elements, F.lit(4)) * scale))).cast("int")


def _spot(key: Column, times: Column, table: int, cells: Column) -> Column:
    """The cell of an element in one table; the tables follow each other."""
    return F.lit(table) * cells + (F.xxhash64(key, times, F.lit(table)).bitwiseAND((cells - 1).cast("long"))).cast("int")


def _cell_text() -> Column:
    """One cell of a fingerprint: place, count, combined digests, combined checks."""
    return F.concat_ws(".", F.col("at").cast("string"), F.col("n").cast("string"), F.lower(F.hex("key")),
                       F.lower(F.hex(F.pmod("check", F.lit(1 << 16)))))


KEY = ["range", "row"]


def sketch(triples: DataFrame, scale: int, own_scale: int = SCALE) -> DataFrame:
    """The cells of the texts a, b and c of each row: kind 2 at their joint size, 0 and 1 at the own size of a and of b.

    ``triples`` has (range, row, info, a, b, c).  Only one row of a document
    carries ``info``, as a grouping key, so the buffers stay of fixed width.
    """
    sized = triples.select(*KEY, "info", *[_pieces(F.col(t)).alias(t) for t in "abc"])
    sized = sized.withColumns({f"n{k}": F.size(F.array_distinct(t)) for k, t in enumerate("abc")})
    # a fingerprint's own size depends on its text alone, also where the pair is sketched with more cells
    sizes = {f"z{k}": _cells(F.col(f"n{k}"), own_scale) for k in range(2)} | {
        "cells": F.greatest(*[_cells(F.col(f"n{k}"), scale) for k in range(3)])}
    sized = sized.withColumns(sizes).withColumn("info", F.struct("info.*", "n0", "n1", "n2"))
    none = F.lit(None).cast("long")

    def tagged(k: int, t: str) -> Column:
        return F.transform(t, lambda d: F.struct(d.alias("digest"), F.lit(k).alias("of"), F.lit(None).alias("info")))

    digests = sized.select(*KEY, "z0", "z1", "cells", F.explode(F.concat(
        F.array(F.struct(none.alias("digest"), F.lit(-1).alias("of"), F.col("info").alias("info"))),
        *[tagged(k, t) for k, t in enumerate("abc")])).alias("e")).select(*KEY, "z0", "z1", "cells", "e.*")
    times = [F.count(F.when(F.col("of") == k, 1)).cast("int").alias(f"m{k}") for k in range(3)]
    counted = digests.groupBy(*KEY, "z0", "z1", "cells", "info", "digest").agg(*times)
    # an element is a digest with its number of times: one for most digests, more where the texts differ in that number
    held = F.filter(F.array_distinct(F.array("m0", "m1", "m2")), lambda m: (m > 0) | F.col("digest").isNull())
    counted = counted.withColumn("times", F.explode(held))

    def spots(kind: int, cells: Column) -> Column:
        return F.array(*[F.struct(F.lit(kind).alias("kind"), _spot(F.col("digest"), F.col("times"), t, cells).alias("at")) for t in range(TABLES)])

    # kind 2: the joint size; 0 and 1: a text's own size, where that is another one
    empty = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(-1).alias("at")))
    nothing = F.slice(empty, 1, 0)
    own = [F.when((F.col(f"z{k}") != F.col("cells")) & (F.col(f"m{k}") == F.col("times")), spots(k, F.col(f"z{k}"))).otherwise(nothing) for k in (0, 1)]
    placed = counted.withColumn("p", F.explode(F.when(F.col("digest").isNull(), empty).otherwise(
        F.concat(spots(2, F.col("cells")), *own))))
    # the check proves that a cell holds one element
    parts = []
    for k in range(3):
        here = (F.col(f"m{k}") == F.col("times")) & F.col("digest").isNotNull() & ((F.col("p.kind") == 2) | (F.col("p.kind") == k))
        parts += [F.count(F.when(here, 1)).cast("int").alias(f"c{k}"),
                  F.coalesce(F.bit_xor(F.when(here, F.col("digest"))), F.lit(0)).alias(f"k{k}"),
                  F.coalesce(F.bit_xor(F.when(here, F.xxhash64("digest", "times"))), F.lit(0)).alias(f"h{k}"),
                  F.coalesce(F.bit_xor(F.when(here, F.col("times"))), F.lit(0)).alias(f"t{k}")]
    return placed.groupBy(*KEY, "z0", "z1", "cells", "info", "p.kind", "p.at").agg(*parts)


def differences(sketched: DataFrame) -> DataFrame:
    """Rows (pair, at, n, key, check, times): pairs 1 and 2 are a - b and a - c, pairs 3 and 4 the fingerprints of a and b.

    Pair 0 stands at -1 and carries ``info``.
    """
    def row(pair: int, n: Column, key: Column, check: Column, times: Column) -> Column:
        return F.struct(F.lit(pair).alias("pair"), F.col("at").alias("at"), n.cast("long").alias("n"), key.alias("key"),
                        check.alias("check"), times.alias("times"))

    def minus(k: int) -> Column:
        return row(k, F.col("c0") - F.col(f"c{k}"), *[F.col(f"{p}0").bitwiseXOR(F.col(f"{p}{k}")) for p in "kht"])

    def of(pair: int, k: int) -> Column:
        return row(pair, *[F.col(f"{p}{k}") for p in "ckht"])

    nothing = F.slice(F.array(of(0, 0)), 1, 0)
    joint = F.col("kind") == 2
    out = F.when(F.col("at") < 0, F.array(of(0, 0))).otherwise(F.concat(
        F.when(joint, F.array(minus(1), minus(2))).otherwise(nothing),
        *[F.when((joint & (F.col(f"z{k}") == F.col("cells")) | (F.col("kind") == k)) & (F.col(f"c{k}") > 0), F.array(of(3 + k, k)))
          .otherwise(nothing) for k in (0, 1)]))
    return (sketched.select(*KEY, "cells", "info", F.explode(out).alias("x")).select(*KEY, "cells", "info", "x.*")
            .where("pair = 0 or n <> 0 or key <> 0 or check <> 0"))


def peel(cells: DataFrame, table: int) -> DataFrame:
    """One round: elements alone in a cell of ``table`` leave all their cells and are counted at -1.

    An element has one cell in a table, so a round never takes it twice.
    """
    alone = (F.col("pair").isin(1, 2) & F.col("at").between(F.lit(table) * F.col("cells"), F.lit(table + 1) * F.col("cells") - 1)
             & (F.abs("n") == 1) & (F.xxhash64("key", "times") == F.col("check")))
    row = [F.col(c).alias(c) for c in ("pair", "at", "n", "key", "check", "times", "info")]
    kept = F.array(F.struct(*row))

    def out(other: int) -> Column:
        return F.struct(F.col("pair").alias("pair"), _spot(F.col("key"), F.col("times"), other, F.col("cells")).alias("at"), (-F.col("n")).alias("n"),
                        F.col("key").alias("key"), F.col("check").alias("check"), F.col("times").alias("times"),
                        F.col("info").alias("info"))

    counted = F.struct(F.col("pair").alias("pair"), F.lit(-1).alias("at"), F.lit(1).cast("long").alias("n"), F.col("key").alias("key"),
                       F.lit(0).cast("long").alias("check"), F.lit(0).alias("times"), F.col("info").alias("info"))
    taken = F.array(counted, *[out(t) for t in range(TABLES) if t != table])
    return (cells.select(*KEY, "cells", F.explode(F.when(alone, taken).otherwise(kept)).alias("x")).select(*KEY, "cells", "x.*")
            .groupBy(*KEY, "cells", "pair", "at", "info")
            .agg(F.sum("n").alias("n"), *[F.bit_xor(c).alias(c) for c in ("key", "check", "times")])
            .where("at < 0 or n <> 0 or key <> 0 or check <> 0"))


def compare(triples: DataFrame, scale: int, rounds: int = ROUNDS) -> DataFrame:
    """(info, print_a, print_b, near_b, near_c, failed): likeness of a to b and to c by the number of digests that peeling recovers."""
    cells = differences(sketch(triples, scale))
    for k in range(rounds):
        cells = peel(cells, k % TABLES)
    sums = [F.sum(F.when((F.col("pair") == k) & (F.col("at") < 0), F.col("n")).otherwise(0)).alias(f"d{k}") for k in (1, 2)]
    left = F.col("pair").isin(1, 2) & (F.col("at") >= 0)
    prints = [F.array_join(F.array_sort(F.collect_list(F.when(F.col("pair") == 3 + k, _cell_text()))), ";").alias(f"print_{t}")
              for k, t in enumerate("ab")]
    done = cells.groupBy(*KEY).agg(F.first("info", ignorenulls=True).alias("info"), *sums, *prints,
                                   (F.count(F.when(left, 1)) > 0).alias("failed"))

    def likeness(k: int) -> Column:
        total = F.col("info.n0") + F.col(f"info.n{k}")
        return F.when(total == 0, F.lit(1.0)).otherwise((total - F.col(f"d{k}")) / (total + F.col(f"d{k}")))

    return done.select("info", "print_a", "print_b", likeness(1).alias("near_b"), likeness(2).alias("near_c"), "failed")


def fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Fingerprints of each text and its edited text, and their likeness to each other and to the next document."""
    def triples(base: DataFrame) -> DataFrame:
        changed = with_next(base).withColumn("b", edited(F.col("text"), F.col("next")))
        return changed.select("range", "row", F.struct("doc_id", "next_id", F.length("text").cast("long").alias("n_chars"),
                                                       F.sha2("b", 256).alias("edited_sha256")).alias("info"),
                              F.col("text").alias("a"), "b", F.col("next").alias("c"))

    done = cut(compare(triples(docs), scale))
    out = done
    while True:
        # documents whose peeling failed are sketched again, with their next ones beside them and more cells
        failed = cut(done.where("failed").select("info.doc_id", "info.next_id").distinct())
        if not failed.head(1):
            break
        scale *= GROWTH
        again = failed.select(F.col("doc_id").alias("_id")).distinct()
        near = again.union(failed.select("next_id")).distinct()
        few = docs.join(near, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        pairs = triples(few).join(again, F.col("info.doc_id").eqNullSafe(F.col("_id")), "left_semi")
        done = cut(compare(pairs, scale))
        out = out.join(again, F.col("info.doc_id").eqNullSafe(F.col("_id")), "left_anti").unionByName(done)
    return out.select("info.doc_id", "info.n_chars", "info.edited_sha256", F.col("print_a").alias("fingerprint"),
                      F.col("print_b").alias("edited_fingerprint"), F.col("near_b").alias("near_edited"),
                      F.col("near_c").alias("near_next"))
