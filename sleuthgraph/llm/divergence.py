"""How the sources of a language diverge in their terms, from count-level bitmaps.

Terms are counted for each (language, source).  A language keeps the terms of at
least ``MIN_DOCS`` of its documents and numbers them by falling frequency.  For
each group and count the numbers of the terms with just that count are stored as
bitsets of 64 (``term_bitsets``).  Two sources have as many terms with the counts
i and j as the AND of two bitsets has bits; a term's share of the divergence
depends on its two counts only, so a pair of sources needs its joint cells and no
terms.  A term that a source lacks has count 0: those cells come by complement, from
the sizes of the levels and of the joint cells, and hold for absent words as well.

Frequent terms, with many different counts, share words with frequent ones, and
the long tail has few counts to a word.  Sources are dealt into slices of about
``SLICE``, so one task holds two slices and ``BLOCK`` terms, however many there are.

Nulls and ties: a null text, language or source is read as ''; each row is a document
of its own, also when ids repeat; groups without terms have their rows in part
``pair``; a language without kept terms gives value 0 for every pair; equal values
rank by item in UTF-8 order; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sleuthgraph.plans.lineage import cut

MIN_DOCS = 3
TOP = 200
UNIT = 1_000_000_000
BLOCK = 256
SLICE = 64
HELD = 400_000
PIECE = 4 << 20
# Bytes of letters (A-Z in lower case) and of characters beyond ASCII stay, others part terms.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTED = "lang string, source string, term binary, n long, docs long"


def _pieces(text: bytes):
    """The text in parts that end between terms."""
    at = 0
    while len(text) - at > PIECE:
        end = text.rfind(b" ", at, at + PIECE)
        end = text.find(b" ", at + PIECE) if end < at else end
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


def _counted(batches):
    """Occurrences and documents of each term by group; what a task holds is bounded."""
    found: dict[tuple, tuple[Counter, Counter]] = {}
    held = 0

    def rows():
        for (lang, source), (n, docs) in found.items():
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(n), pa.string()), "source": pa.array([source] * len(n), pa.string()),
                "term": pa.array(list(n), pa.binary()), "n": pa.array(n.values(), pa.int64()),
                "docs": pa.array([docs[t] for t in n], pa.int64())})

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            n, docs = found.setdefault((lang, source), (Counter(), Counter()))
            held -= len(n)
            seen: set[bytes] = set()
            for piece in _pieces(text.translate(LETTERS)):
                terms = piece.split()
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            held += len(n)
            if held > HELD:
                yield from rows()
                found.clear()
                held = 0
    yield from rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term by group."""
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")],
                        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return (plain.mapInArrow(_counted, COUNTED).withColumn("term", F.col("term").cast("string"))
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, number, total) of the terms that a language keeps, numbered by falling frequency.

    Numbers have gaps between the parts of the sort; only their order and nearness matter.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    order = ["lang", F.desc("total"), "term"]
    return (terms.repartitionByRange(parts, *order).sortWithinPartitions(*order)
            .select("lang", "term", F.monotonically_increasing_id().alias("number"), "total"))


def term_bitsets(cells: DataFrame) -> DataFrame:
    """(lang, source, n, word, bits): the numbers of the terms with count ``n`` in a group, as bits of words of 64."""
    return (cells.groupBy("lang", "source", "n", F.shiftright("number", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(number & 63 as int))")).alias("bits")))


def share(n: Column, total: Column, kinds: Column) -> Column:
    """The smoothed share of a count, in units of a thousand millionth, exact."""
    return (F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"),
                                       (total + kinds).cast("decimal(20,0)"))).cast("long")


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _joint(rows: pd.DataFrame) -> pd.DataFrame:
    """Joint cells of two slices of sources in one block of terms: AND, popcount, times the distance.

    For each pair: how many terms both have, and what those cells add to the sum that has them with count 0.
    """
    first, second = rows["first"].iloc[0], rows["second"].iloc[0]
    names, who = np.unique(rows["source"].to_numpy(str).astype(object), return_inverse=True)
    rows = rows.assign(who=who).sort_values(["word", "who"], kind="stable")
    word, who, slot = rows["word"].to_numpy(), rows["who"].to_numpy(), rows["slice"].to_numpy()
    bits, p, zero = rows["bits"].to_numpy(np.int64).view(np.uint64), rows["p"].to_numpy(np.int64), rows["zero"].to_numpy(np.int64)
    value, both = np.zeros(len(names) ** 2, dtype=np.int64), np.zeros(len(names) ** 2, dtype=np.int64)
    edges = np.flatnonzero(np.diff(word, prepend=word[0] - 1, append=word[-1] + 1))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        left = lo + np.flatnonzero(slot[lo:hi] == first)
        right = left if first == second else lo + np.flatnonzero(slot[lo:hi] == second)
        joint = np.bitwise_count(bits[left][:, None] & bits[right][None, :])
        i, j = np.nonzero(joint)
        n, i, j = joint[i, j].astype(np.int64), left[i], right[j]
        for a, b in ((i, j),) if first == second else ((i, j), (j, i)):
            at = who[a] * len(names) + who[b]
            np.add.at(both, at, n)
            np.add.at(value, at, n * (_far(p[a], p[b]) - _far(p[a], zero[b]) - _far(zero[a], p[b]) + _far(zero[a], zero[b])))
    at = np.flatnonzero(both)
    at = at[at // len(names) != at % len(names)]
    return pd.DataFrame({"lang": rows["lang"].iloc[0], "source": names[at // len(names)], "item": names[at % len(names)],
                         "more": value[at], "both": both[at]})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): each source against the others of its language, and its own terms."""
    counts = cut(term_counts(docs))
    kept = cut(kept_terms(counts, min_docs))
    cells = cut(counts.drop("docs").join(kept, ["lang", "term"]))
    bitsets = cut(term_bitsets(cells))
    sizes = bitsets.groupBy("lang", "source", "n").agg(F.sum(F.bit_count("bits").cast("long")).alias("terms"))
    mine = sizes.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("occurrences"), F.sum("terms").alias("kinds"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("total").alias("lang_occurrences"))
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    slices = named.groupBy("lang").agg(F.ceil(F.count("*") / SLICE).alias("slices"))
    # one row for each group
    groups = cut(named.join(mine, ["lang", "source"], "left").join(langs, "lang", "left").join(slices, "lang")
                 .na.fill(0, ["occurrences", "kinds", "vocabulary", "lang_occurrences"])
                 .withColumn("zero", F.when(F.col("vocabulary") > 0, share(F.lit(0), F.col("occurrences"), F.col("vocabulary"))))
                 .withColumn("slice", F.pmod(F.xxhash64("source"), "slices")))
    p = share(F.col("n"), F.col("occurrences"), F.col("vocabulary"))

    # joint cells, two slices of sources and a block of terms at a time
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))
    dealt = (bitsets.join(groups, ["lang", "source"]).withColumn("p", p).withColumn("other", other)
             .select("lang", "source", "word", "bits", "p", "zero", "slice", F.shiftright("word", (BLOCK // 64).bit_length() - 1).alias("block"),
                     F.least("slice", "other").alias("first"), F.greatest("slice", "other").alias("second")))
    joint = (dealt.groupBy("lang", "block", "first", "second")
             .applyInPandas(_joint, "lang string, source string, item string, more long, both long")
             .groupBy("lang", "source", "item").agg(F.sum("more").alias("more"), F.sum("both").alias("both")))

    # all sources of a language are the items of each: as many rows as the report has
    b = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"), F.col("kinds").alias("item_kinds"))
    pairs = groups.select("lang", "source", "zero", "kinds", "vocabulary").join(b, "lang").where("source <> item")
    levels = sizes.join(groups, ["lang", "source"]).select("lang", "source", "terms", p.alias("p"))
    zeros = b.select("lang", "item", "item_zero")
    # each level of a group against the zeros of the others, both ways
    alone = (levels.join(zeros, "lang").where("source <> item")
             .select("lang", "source", "item", (F.col("terms") * distance(F.col("p"), F.col("item_zero"))).alias("ours"),
                     (F.col("terms") * distance(F.col("item_zero"), F.col("p"))).alias("theirs"))
             .groupBy("lang", "source", "item").agg(F.sum("ours").alias("ours"), F.sum("theirs").alias("theirs")))
    back = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("theirs").alias("back"))
    key = ["lang", "source", "item"]
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    lacking = F.col("vocabulary") - F.col("kinds") - F.col("item_kinds")
    summed = none("ours") + none("back") + none("more") + lacking * distance(F.col("zero"), F.col("item_zero"))
    pair = (pairs.join(alone.drop("theirs"), key, "left").join(back, key, "left").join(joint, key, "left")
            .select("lang", "source", F.lit("pair").alias("part"), "item", F.when(F.col("vocabulary") > 0, summed).otherwise(0).alias("value")))

    q = share(F.col("total"), F.col("lang_occurrences"), F.col("vocabulary"))
    term = (cells.join(groups, ["lang", "source"]).withColumns({"p": p, "q": q}).where("p > q")
            .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value")))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    # the rank limit is applied before the shuffle as well
    return pair.withColumn("rank", rank).select(columns).unionByName(term.withColumn("rank", rank).where(F.col("rank") <= top).select(columns))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
vocab AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY lang),
named AS (SELECT DISTINCT lang, source FROM d),
cells AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
grp AS (SELECT named.lang, named.source, coalesce(max(v), 0) AS v, coalesce(max(lang_n), 0) AS lang_n, coalesce(sum(n), 0) AS all_n
        FROM named LEFT JOIN vocab USING (lang) LEFT JOIN cells USING (lang, source) GROUP BY named.lang, named.source),
full_p AS (SELECT grp.lang, grp.source, kept.term, coalesce(n, 0) AS n, lang_n, v, total,
        1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (all_n + v)::HUGEINT AS p
        FROM grp JOIN kept USING (lang) LEFT JOIN cells ON cells.lang = grp.lang AND cells.source = grp.source AND cells.term = kept.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
        FROM full_p a JOIN full_p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
all_pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
        FROM named a JOIN named b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
own AS (SELECT lang, source, 'term' AS part, term AS item, p, 1 + (1000000000::HUGEINT * (total + 1)) // (lang_n + v)::HUGEINT AS q
        FROM full_p WHERE n > 0),
both_parts AS (SELECT * FROM all_pairs UNION ALL SELECT lang, source, part, item, (p - q) * (p - q) // q FROM own WHERE p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
