"""Folders of exports: what a file is shows in its first lines, and only then is it read.

The first pass takes two lines of each file; the second reads every file once, as its kind:

* ``document``: one JSON text over several lines, read whole, if it is at most ``DOCUMENT_BYTES``;
* ``values``: JSON values line by line, split over tasks like any text;
* ``delimited``: a table under a header; rows meet their file's header by a join, so files
  with other headers share one scan; files with line breaks inside quotes are read whole;
* ``lines``: CEF, LEEF, syslog and JSON lines, each by its own shape.

The suffix, in any case, says which files are exports, and decides where the content does not.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canon
from .records import RECORD_DDL, _delimited, _records, json_values, last_wins_map, ndjson_rejects, parse_ndjson, unwrap
from .textlogs import parse_lines

# Suffixes of exports and marks between columns.
SUFFIXES = ("json", "ndjson", "csv", "cef", "log", "txt")
MARKS = (",", ";", "\t", "|")
KINDS = ("document", "values", "delimited", "lines")
DOCUMENT_BYTES = 1 << 30
#: A list whose brackets stand on lines of their own is read whole up to this size, beyond it line by line.
LIST_BYTES = 64 << 20


def _files(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, suffix) of every file, from the listing alone."""
    listed = spark.read.format("binaryFile").options(**{"recursiveFileLookup": "true", **options}).load(path)
    return listed.select("path", F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("suffix"))


def skipped_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, suffix) of the files that are no exports by their suffix and stay unread."""
    return _files(spark, path).where(~F.col("suffix").isin(*SUFFIXES))


def glob(suffixes: Sequence[str] = SUFFIXES) -> str:
    """A glob for the suffixes in any case."""
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in s) for s in suffixes) + "}"


def _text(spark: SparkSession, path, **options) -> DataFrame:
    rows = spark.read.options(**options).text(path)
    return rows.select(canon.strip(F.regexp_replace("value", "^﻿", "")).alias("line"), F.col("_metadata.file_path").alias("origin_file"),
                       F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"))


def file_kinds(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """(origin_file, kind, header, mark, multi_line) of every export under a path."""
    given = {"recursiveFileLookup": "true", "pathGlobFilter": glob(), **options}
    rows = _text(spark, path, **given).where("line <> ''").withColumn("n", F.monotonically_increasing_id())
    line, start = F.col("line"), F.col("block") == 0
    seen = rows.groupBy("origin_file").agg(
        F.min_by("line", F.when(start, F.col("n"))).alias("first"),
        F.min_by("line", F.when(start & (line != "["), F.col("n"))).alias("lead"), F.max("size").alias("size"),
        F.max(start & line.startswith("{")).alias("objects"),
        # a quote that stays open at the end of a line
        F.max((F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2).alias("open"))
    first, suffix = F.col("first"), F.lower(F.regexp_extract("origin_file", r"\.([^./]*)$", 1))
    json_file = suffix.isin("json", "ndjson") & F.col("objects")
    whole = F.when((first == "[") & (F.col("size") <= LIST_BYTES), False).otherwise(json_values(F.col("lead")).isNotNull())
    as_json = F.when(whole | (F.col("size") > DOCUMENT_BYTES), "values").otherwise("document")
    counts = [F.length(first) - F.length(F.replace(first, F.lit(m), F.lit(""))) for m in MARKS]
    most = F.greatest(*counts)
    mark = reduce(lambda acc, k: acc.when(counts[k] == most, MARKS[k]), range(1, len(MARKS)), F.when(counts[0] == most, MARKS[0]))
    logged = first.rlike(r"CEF:\d|LEEF:\d|^<\d{1,3}>") | first.rlike(r"[{}\[\]]")
    table = ~logged & ((most >= 2) & ~F.substring(first, 1, 40).contains("=") | (suffix == "csv"))
    kind = (F.when(first.rlike(r"^[\[{]"), as_json).when(json_file, "values").when(table, "delimited")
            .when(suffix.isin("json", "ndjson"), "values").otherwise("lines"))
    return seen.select("origin_file", kind.alias("kind"), first.alias("header"), mark.alias("mark"), (F.col("open") == 1).alias("multi_line"))


def literal(path: str) -> str:
    """A path in which nothing is a pattern."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def _paths(rows: list) -> list[str]:
    """Paths to read, from file names as Spark reports them."""
    return [literal(unquote(r["origin_file"])) for r in rows]


class Folder:
    """The exports under a path by kind.  The driver holds one row a file, as it does for the listing itself."""

    def __init__(self, spark: SparkSession, path: str | list[str], **options):
        self.spark = spark
        self.found: dict[str, list] = {k: [] for k in KINDS}
        for row in file_kinds(spark, path, **options).orderBy("origin_file").toLocalIterator():
            self.found[row["kind"]].append(row)

    def _lines(self, rows: list) -> DataFrame:
        return _text(self.spark, _paths(rows)).where("line <> ''").select("line", "origin_file")

    def documents(self) -> DataFrame | None:
        """(value, whole, origin_file): files read whole; those that turn out to be no JSON are read by line."""
        if not self.found["document"]:
            return None
        rows = self.spark.read.text(_paths(self.found["document"]), wholetext=True)
        text = F.regexp_replace("value", "^﻿", "")
        rows = rows.select(text.alias("text"), F.col("_metadata.file_path").alias("origin_file")).withColumn("_values", json_values(F.col("text")))
        return rows.select("text", "_values", "origin_file")

    def value_lines(self) -> list[DataFrame]:
        """Lines of files with values line by line, and of documents that are none."""
        out = [self._lines(self.found["values"])] if self.found["values"] else []
        if (docs := self.documents()) is not None:
            split = docs.where("_values IS NULL").select(F.explode(F.split("text", "\r?\n")).alias("line"), "origin_file")
            out.append(split.select(canon.strip(F.col("line")).alias("line"), "origin_file").where("line <> ''"))
        return out

    def document_values(self) -> DataFrame | None:
        docs = self.documents()
        return None if docs is None else unwrap(docs.select(F.explode("_values").alias("value"), "origin_file"), "value")

    def tables(self) -> list[DataFrame]:
        """Delimited files: one scan for each mark between columns, whatever the headers are."""
        out, by_mark, whole = [], {}, {}
        for row in self.found["delimited"]:
            if row["multi_line"]:
                whole.setdefault((row["header"], row["mark"]), []).append(row)
            else:
                by_mark.setdefault(row["mark"], []).append(row)
        for (_, mark), rows in whole.items():
            out.append(_delimited(self.spark, _paths(rows), mark, True))
        for mark, rows in by_mark.items():
            headers = self.spark.createDataFrame([(r["origin_file"], r["header"]) for r in rows], "origin_file string, header string")
            out.append(parse_delimited(self._lines(rows).join(headers, "origin_file"), mark, max(r["header"].count(mark) for r in rows) + 1))
        return out

    def records(self, kinds: Sequence[str] = KINDS) -> DataFrame:
        parts = []
        if "values" in kinds:
            parts += [parse_ndjson(lines) for lines in self.value_lines()]
        if "document" in kinds and (values := self.document_values()) is not None:
            parts.append(_records(values))
        if "delimited" in kinds:
            parts += self.tables()
        if "lines" in kinds and self.found["lines"]:
            parts.append(parse_lines(self._lines(self.found["lines"])))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], RECORD_DDL)

    def rejects(self) -> DataFrame:
        parts = [ndjson_rejects(lines) for lines in self.value_lines()]
        if (values := self.document_values()) is not None:
            parts.append(values.select(F.explode("others").alias("line"), "origin_file"))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], "line string, origin_file string")


def parse_delimited(lines: DataFrame, mark: str, width: int) -> DataFrame:
    """``line`` rows, each with the ``header`` above it, of at most ``width`` columns; surplus cells are dropped."""
    schema = ", ".join(f"c{k} string" for k in range(width))
    options = {"sep": mark, "escape": '"'}
    cells = lambda c: F.array(*[F.from_csv(c, schema, options)[f"c{k}"] for k in range(width)])
    columns = F.size(F.split("header", "\\Q" + mark + "\\E"))
    named = F.transform(F.slice(cells(F.col("header")), F.lit(1), F.least(columns, F.lit(width))),
                        lambda c, i: F.coalesce(c, F.concat(F.lit("_c"), i.cast("string"))))
    rows = lines.where("line <> header").withColumns({"_names": named, "_cells": cells(F.col("line"))})
    rows = rows.withColumn("_cells", F.slice("_cells", F.lit(1), F.size("_names")))
    made = rows.select(last_wins_map(F.col("_names"), F.col("_cells")).alias("record"), "origin_file")
    return made.select("record", F.to_json("record", {"ignoreNullFields": "false"}).alias("raw"), "origin_file")


def read_files(spark: SparkSession, path: str, kinds: Sequence[str] = KINDS, **options) -> DataFrame:
    """The records of all exports under a path."""
    return Folder(spark, path, **options).records(kinds)


def rejects(spark: SparkSession, path: str, **options) -> DataFrame:
    """(line, origin_file): lines of JSON files that are no JSON, and values that are no objects."""
    return Folder(spark, path, **options).rejects()
