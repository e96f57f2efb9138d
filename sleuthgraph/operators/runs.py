"""Collapsing consecutive equal rows of a globally ordered table.

The order is spread over tasks by a range sort.  Each partition finds its own
run starts; the last row of every partition is handed to the next through a
table with one row per partition.  No task ever holds the whole sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut


def number_runs(rows: DataFrame, order: list[str], same: list[str]) -> DataFrame:
    """``rows`` plus ``run_id`` (0, 1, ... in order) and ``_pos``; equal neighbours on ``same`` share a run."""
    # written first: a range sort runs its input twice, once to sample the order
    ordered = cut(cut(rows).orderBy(*order).withColumn("_pos", F.monotonically_increasing_id()))
    marked = ordered.withColumns({"_part": F.shiftright("_pos", 33), "_key": F.struct(*same)})
    lasts = marked.groupBy("_part").agg(F.max_by("_key", "_pos").alias("_last"))
    handed = lasts.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_handed"))
    inside = Window.partitionBy("_part").orderBy("_pos")
    before = F.coalesce(F.lag("_key").over(inside), F.col("_handed"))
    started = marked.join(handed, "_part").withColumn(
        "_start", F.when(before.isNull() | ~F.col("_key").eqNullSafe(before), 1).otherwise(0)).withColumn(
        "_run", F.sum("_start").over(inside))
    totals = started.groupBy("_part").agg(F.sum("_start").alias("_n"))
    offsets = totals.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"))
    return (started.join(offsets, "_part").withColumn("run_id", F.col("_offset") + F.col("_run") - 1)
            .select(*rows.columns, "run_id", "_pos"))


def summarize_runs(numbered: DataFrame, kept: list[str]) -> DataFrame:
    """One row per run: time, until (null for a single row), count, severity, first row's ``kept`` columns."""
    first: Column = F.min_by(F.struct("uid", *kept), F.col("_pos"))
    out = numbered.groupBy("run_id").agg(
        F.min("time").alias("time"), F.max("time").alias("_until"), F.count(F.lit(1)).alias("count"),
        F.max("severity").alias("severity"), first.alias("_first"))
    return out.select("run_id", "time", F.when(F.col("count") > 1, F.col("_until")).alias("until"),
                      "count", "severity", F.col("_first.uid").alias("first_uid"),
                      *[F.col(f"_first.{k}").alias(k) for k in kept])


def most_severe(entries: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` most severe entries (then earliest), back in order: a top-k report."""
    return entries.orderBy(F.desc("severity"), "run_id").limit(limit).orderBy("run_id")
