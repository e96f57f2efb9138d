"""Line deduplication with levelled sorted runs of line hashes.

Documents are taken in batches of rising ids.  The line hashes already seen lie
in sorted runs, bucketed by hash; a batch merge-anti-joins the runs, what is
left is new and becomes a run of its own, and runs of a level are merged into
one run of the next level as soon as there are ``fan_out`` of them.  A line
that is in a run, or that a smaller id of the same batch holds, is dropped.
Only DataFrame operations are used.

A hash is 128 bits wide, in two columns.  Lines travel as hashes; a text
is shuffled once, by its document, when its dropped lines are taken out.

Nulls and ties: a null or empty text is one empty line; documents without an
id keep all lines and drop none of others; rows that share an id are one
document for the question who holds a line, and each is returned; an empty
table gives no rows.  Columns other than ``text`` pass through, whatever their
names; those named ``n_lines`` or ``n_dropped`` are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sleuthgraph.plans.lineage import new_folder

MIN_CHARS = 10
BATCHES = 4
FAN_OUT = 2
# The white space that keys lose at both ends, and the letters that they lower.
BLANKS = "\t\n\x0b\x0c\r "
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z lower-cased; other letters stay."""
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() is exact for ASCII; the slower letter map is for the rest
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


class Runs:
    """Sorted runs of hashes by level, as bucketed tables of the session's catalog."""

    def __init__(self, spark: SparkSession, buckets: int, fan_out: int):
        self.spark, self.buckets, self.fan_out = spark, buckets, fan_out
        self.levels: list[list[str]] = [[]]

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _write(self, hashes: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        (hashes.repartition(self.buckets, "h1").write.bucketBy(self.buckets, "h1").sortBy("h1", "h2")
         .option("path", new_folder(self.spark)).saveAsTable(name))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def unseen(self, batch: DataFrame) -> DataFrame:
        for name in self.names():
            batch = batch.join(self.spark.table(name), ["h1", "h2"], "left_anti")
        return batch

    def add(self, hashes: DataFrame) -> None:
        self._write(hashes, 0)
        level = 0
        while len(self.levels[level]) >= self.fan_out:
            full, self.levels[level] = self.levels[level], []
            merged = self.spark.table(full[0])
            for name in full[1:]:
                merged = merged.unionByName(self.spark.table(name))
            self._write(merged, level + 1)
            self.forget(full)
            level += 1

    def forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _batches(docs: DataFrame, batches: int) -> Column:
    """The batch of a document: ids in ascending order, cut at quantiles, so an id has one batch."""
    bounds = docs.select(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000).alias("b")).first()["b"] or []
    out = F.lit(0)
    for b in sorted(set(bounds)):
        out = out + (F.col("doc_id") > b).cast("int")
    return out


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fan_out: int = FAN_OUT) -> DataFrame:
    """(doc_id, h1, h2) of the lines that a smaller id also holds."""
    spark = docs.sparkSession
    keys = (docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
            .select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", line_key(F.col("line")).alias("key"))
            .where(F.length("key") >= min_chars).select("doc_id", *hashed(F.col("key"))))
    incoming, dropped = new_folder(spark), new_folder(spark)
    keys.withColumn("batch", _batches(docs, batches)).write.partitionBy("batch").parquet(incoming)
    lines = spark.read.schema("doc_id long, h1 long, h2 long, batch int").parquet(incoming)
    runs = Runs(spark, int(spark.conf.get("spark.sql.shuffle.partitions")), fan_out)
    for k in range(batches):
        batch = lines.where(F.col("batch") == k)
        # one row for each hash: pre-aggregated before the shuffle, so a line of every document is no hot key
        holders = batch.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
        new = new_folder(spark)
        runs.unseen(holders).write.parquet(new)
        fresh = spark.read.schema("h1 long, h2 long, first long").parquet(new)
        # a line stays where it is new and unshared, or in the new line's first document
        sole = fresh.select("h1", "h2", "first")
        (batch.select("doc_id", "h1", "h2").join(sole, ["h1", "h2"], "left").where("first is null or doc_id > first")
         .select("doc_id", "h1", "h2").write.mode("append").parquet(dropped))
        if k < batches - 1:
            runs.add(fresh.select("h1", "h2"))
    runs.forget(runs.names())
    return spark.read.schema("doc_id long, h1 long, h2 long").parquet(dropped)


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES,
                           fan_out: int = FAN_OUT) -> DataFrame:
    """The documents with ``text`` reduced to its kept lines, ``n_lines`` (before) and ``n_dropped``."""
    gone = repeated_lines(docs, min_chars, batches, fan_out)
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    # by position, so that no name of theirs meets one used here
    rest = F.struct(F.lit(0).alias("c"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep) if c not in ("doc_id", "text")])
    whole = docs.select("doc_id", F.lit(True).alias("_doc"), F.col("text").alias("_text"), rest.alias("_rest"))
    marks = gone.select("doc_id", F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
    # texts and the hashes of their dropped lines meet in one shuffle by id; all that follows stays in that partition
    placed = (whole.unionByName(marks, allowMissingColumns=True)
              .repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
              .withColumn("_row", F.monotonically_increasing_id()))
    split = F.when(F.col("_doc"), F.split(F.coalesce("_text", F.lit("")), "\n")).otherwise(F.array(F.lit(None).cast("string")))
    h1, h2 = hashed(line_key(F.col("_line")))
    same = Window.partitionBy("doc_id", "_h1", "_h2")
    lines = (placed.select("doc_id", "_row", "_doc", F.col("_text").isNull().alias("_null"), "_rest", "_h1", "_h2",
                           F.posexplode(split).alias("_at", "_line"))
             .withColumn("_rest", F.when(F.col("_at") == 0, F.col("_rest")))
             .withColumns({"_h1": F.when(F.col("_doc"), h1).otherwise(F.col("_h1")),
                           "_h2": F.when(F.col("_doc"), h2).otherwise(F.col("_h2"))})
             .withColumn("_gone", F.max(F.when(F.col("_doc").isNull(), 1)).over(same) == 1).where("_doc"))
    kept = F.col("_gone").isNull()
    joined = (lines.groupBy("doc_id", "_row").agg(
        F.count("*").alias("n_lines"), F.count("_gone").alias("n_dropped"), F.max("_null").alias("_null"),
        F.first("_rest", ignorenulls=True).alias("_rest"),
        F.collect_list(F.when(kept, F.struct("_at", "_line"))).alias("_kept")))
    text = F.when(~F.col("_null"), F.array_join(F.transform(F.array_sort("_kept"), lambda x: x["_line"]), "\n"))
    return joined.select(*[F.col("doc_id") if c == "doc_id" else text.alias("text") if c == "text" else F.col(f"_rest.c{k}").alias(c)
                           for k, c in enumerate(keep)], "n_lines", "n_dropped")


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, pos, line, (f.key IS NOT NULL AND k.doc_id <> first_doc) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
