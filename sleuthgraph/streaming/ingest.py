"""Continuous ingest of landed exports: the batch projections over a stream of lines."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import canon
from ..operators.normalize import normalize
from ..sources import folder
from ..sources.records import ndjson_rejects, parse_ndjson
from ..sources.sinks import append_events
from ..sources.textlogs import parse_lines


def line_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Lines of text files as they land in a folder."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return rows.select(canon.strip(F.col("value")).alias("line"), F.input_file_name().alias("origin_file")).where("line <> ''")


def event_stream(lines: DataFrame, ingest_time: dt.datetime | None = None) -> DataFrame:
    """Normalised events of a stream of lines; without a watermark, so that none is too late."""
    return normalize(parse_lines(lines), ingest_time)


def live_timeline(events: DataFrame, width: str = "5 minutes", lateness: str = "1 hour") -> DataFrame:
    """Events per tumbling window, each uid once; windows close after the lateness bound."""
    once = events.withWatermark("time", lateness).dropDuplicatesWithinWatermark(["uid"])
    return once.groupBy(F.window("time", width)).agg(
        F.count(F.lit(1)).alias("count"), F.max("severity").alias("max_severity"))


def append_stream(lines: DataFrame, table: str, checkpoint: str, ingest_time: dt.datetime | None = None, side: str | None = None,
                  **trigger) -> StreamingQuery:
    """Normalise and append every micro-batch of lines to the event table.

    The table knows which uids it has, so late events are stored and a repeated
    batch adds nothing.  The ingest time is that of the batch unless given.
    Of files named as JSON, what holds no object is no event: it goes to ``side``.
    """
    def write(batch: DataFrame, number: int) -> None:
        named = F.col("origin_file").rlike(r"(?i)\.(nd)?json$")
        records = parse_lines(batch.where(~named)).unionByName(parse_ndjson(batch.where(named)))
        _append(records, ndjson_rejects(batch.where(named)), table, number, ingest_time, side)

    return _start(lines, write, checkpoint, trigger)


def append_folder_stream(spark: SparkSession, path: str, table: str, checkpoint: str, ingest_time: dt.datetime | None = None,
                         side: str | None = None, files_per_trigger: int = 1000, **trigger) -> StreamingQuery:
    """Append the files that land in a folder, each read by its content as a whole: JSON documents and tables too.

    The stream only carries the names of new files; a micro-batch reads them like any folder.
    """
    names = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
             .option("recursiveFileLookup", "true").option("pathGlobFilter", folder.glob()).option("maxFilesPerTrigger", files_per_trigger)
             .load(path).select("path"))

    def write(batch: DataFrame, number: int) -> None:
        landed = folder.Folder(batch.sparkSession, [folder.literal(r["path"]) for r in batch.collect()])  # at most files_per_trigger names
        _append(landed.records(), landed.rejects(), table, number, ingest_time, side)

    return _start(names, write, checkpoint, trigger)


def _start(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict) -> StreamingQuery:
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _append(records: DataFrame, rejects: DataFrame, table: str, number: int, ingest_time: dt.datetime | None, side: str | None) -> None:
    """Events to the table; under ``side`` the rejects and the account of the batch, which a repeated batch replaces."""
    spark = records.sparkSession
    account = append_events(spark, normalize(records, ingest_time), table, by_record=True)
    if side:
        rejects.write.mode("overwrite").json(f"{side}/rejects/batch={number}")
        rows = [(source, *counts.values()) for source, counts in account.items() if source != "all"]
        spark.createDataFrame(rows, "source string, normalized long, added long, duplicates long, unmatched long").coalesce(1).write.mode(
            "overwrite").json(f"{side}/accounts/batch={number}")
