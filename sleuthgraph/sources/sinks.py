"""Writing events, graphs, indicator lists and report sections."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators.events import deduplicate, redact
from ..operators.graph import Graph, with_names
from ..operators.report import kind_rank
from ..plans.lineage import cut


def append_events(spark: SparkSession, events: DataFrame, path: str, by_record: bool = False) -> dict[str, dict[str, int]]:
    """Append unseen, redacted events to the table partitioned by day, and say what became of the batch.

    The batch is compared with the uids of the whole table: with ``by_record``, for uids that
    ``normalize`` makes of the records' text, only with days on which they can be (see ``_possible_days``).
    The stored side is filtered by the batch's uids where it is read; it is shuffled only if those
    are too many to broadcast.

    Returns normalized, added, duplicates and unmatched by source, counted while the rows are written.
    (If an executor is lost, tasks that run again before the first shuffle count again in ``normalized``.)
    """
    seen, added = Observation(), Observation()
    fresh = cut(redact(deduplicate(events.observe(seen, *_counts(F.lit(True))))))
    stored = spark.read.parquet(path) if _exists(spark, path) else None
    if stored is None:
        stored = fresh.where(F.lit(False))
    elif by_record:
        stored = stored.where(_possible_days(fresh))
    known = known_uids(stored, fresh).distinct().withColumn("_known", F.lit(True))
    # counted beside the known ones: a plan that finds out that nothing is new would leave out the count as well
    counted = fresh.join(known, "uid", "left").observe(added, *_counts(F.col("_known").isNull()))
    # AQE splits large days (and the one without a date) and joins small ones
    (counted.where("_known IS NULL").select(fresh.columns).hint("rebalance", "event_date").sortWithinPartitions("event_date", "time")
     .write.mode("append").partitionBy("event_date").parquet(path))
    return _account(_observed(seen), _observed(added))


def known_uids(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The uids of a batch that are stored.  The batch is the small side, also for the optimiser: it is a written table."""
    return stored.select("uid").join(batch.select("uid"), "uid", "left_semi")


def _possible_days(batch: DataFrame) -> Column:
    """A test of the partition column: the days on which an event of the batch may already be.

    The same record has the same month and day, whatever year is given to times without one; a day more
    on either side covers other session time zones.  Times that cannot be read have no day, and neither
    has 29 February without a year in most years.
    """
    near = batch.select(F.explode(F.array(*[F.date_add("event_date", k) for k in (-1, 0, 1)])).alias("day"))
    days = {r[0] for r in near.select(F.date_format("day", "MM-dd")).where("day IS NOT NULL").distinct().collect()}  # 366 at most
    if not batch.where("event_date IS NULL").isEmpty() or days & {"02-28", "02-29", "03-01"}:
        days |= {"02-28", "02-29", "03-01"}
    return F.col("event_date").isNull() | F.date_format("event_date", "MM-dd").isin(sorted(days))


def _counts(test: Column) -> list[Column]:
    return [*[F.count_if(test & (F.col("source") == s)).alias(s) for s in fixed.SOURCES], F.count_if(test).alias("all")]


def _observed(counts: Observation) -> dict:
    try:
        return dict(counts.get)
    except Py4JJavaError:  # a batch known to be empty: the plan holds no rows to count
        return dict.fromkeys((*fixed.SOURCES, "all"), 0)


def _account(seen: dict, added: dict) -> dict[str, dict[str, int]]:
    """Counts by source; ``other`` are those of own formats."""
    for row in (seen, added):
        row["other"] = row["all"] - sum(row[s] for s in fixed.SOURCES)
    return {s: {"normalized": seen[s], "added": added[s], "duplicates": seen[s] - added[s], "unmatched": seen[s] if s == "generic" else 0}
            for s in (*fixed.SOURCES, "other", "all")}


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def write_graph(graph: Graph, path: str, fmt: str = "parquet") -> None:
    """The whole graph, no node cap."""
    with_names(graph.nodes).write.mode("overwrite").format(fmt).save(f"{path}/nodes")
    with_names(graph.links).write.mode("overwrite").format(fmt).save(f"{path}/links")


def write_indicator_list(indicators: DataFrame, path: str) -> None:
    """One value per line, kinds in order, riskiest first; part files keep the order."""
    ordered = indicators.orderBy(kind_rank(F.col("kind")), F.desc("risk"), "value")
    ordered.select(F.col("value")).write.mode("overwrite").text(path)


def write_stix(objects: DataFrame, path: str) -> None:
    objects.select(F.col("object").alias("value")).write.mode("overwrite").text(path)


def write_sections(sections: dict[str, DataFrame], path: str) -> None:
    """Report sections as JSON folders."""
    for name, section in sections.items():
        section.write.mode("overwrite").json(f"{path}/{name}")

