"""Exports -> record tables: ``record map<string,string>, raw string, origin_file string``.

Each reader is a projection over a text or CSV scan; nothing is parsed on the
driver.  Nested values stay as JSON text inside the map.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canon
from ..functions.values import unnest

# Envelope keys tried in order (fixed values).
ENVELOPE_KEYS = ["results", "events", "value", "records", "data", "hits", "rows"]
MAP = "map<string,string>"
MAPS = f"array<{MAP}>"
TEXTS = "array<string>"
RECORD_DDL = "record map<string,string>, raw string, origin_file string"


def last_wins_map(keys: Column, vals: Column) -> Column:
    """Map of parallel arrays in which the last of equal keys counts.

    Pass plain columns: the arguments are referred to several times, also once
    per entry when keys do repeat.
    """
    back = F.reverse(keys)
    slow = F.map_from_arrays(F.array_distinct(back), F.transform(
        F.array_distinct(back), lambda k: F.element_at(vals, (F.size(keys) - F.array_position(F.reverse(keys), k) + 1).cast("int"))))
    unique = F.size(F.array_distinct(keys)) == F.size(keys)
    return F.when(unique, F.map_from_arrays(keys, vals)).otherwise(slow)


def with_entry(record: Column, key: str, value: Column) -> Column:
    """The map with an entry added when the key is absent."""
    return F.when(F.map_contains_key(record, F.lit(key)), record).otherwise(
        F.map_concat(record, F.create_map(F.lit(key), value)))


def marked(values: str, value: str, known: str) -> Column:
    """The texts of an array column as structs with a mark that they are known; a null array as one null text that is not."""
    one = lambda text, flag: F.struct(text.cast("string").alias(value), F.lit(flag).alias(known))
    return F.coalesce(F.transform(values, lambda v: one(v, True)), F.array(one(F.lit(None), False)))


# --- JSON -------------------------------------------------------------------------------

def _starts(text: Column, mark: str) -> Column:
    return F.coalesce(F.ltrim(text).startswith(mark), F.lit(False))


# Up to a closing bracket that another value follows, strings taken as a whole; inside one value no such pair is valid.
_GLUED = r'\G((?:[^"}\]]|"(?:[^"\\]|\\.)*+"|[}\]](?!\s*[{\[]))*+[}\]])\s*(?=[{\[])'


def json_values(text: Column) -> Column:
    """The JSON values that a text consists of, one after the other, as texts; null unless all of it is JSON.

    The values are parsed as one array with a mark at its end: where parsing stops early, the mark is missing.
    """
    end = F.md5(text)
    bare = F.rtrim(F.rtrim(text), F.lit(","))
    many = F.when(bare.rlike(r"[}\]]\s*[{\[]"), F.regexp_replace(bare, _GLUED, "$1,")).otherwise(bare)
    found = F.from_json(F.concat(F.lit("["), many, F.lit(', "'), end, F.lit('"]')), TEXTS)
    return F.when(F.get(found, F.size(found) - 1) == end, F.slice(found, F.lit(1), F.size(found) - 1))


def _tables_of(text: Column) -> Column:
    """``[{name, columns, rows}]`` with plain column names."""
    parsed = F.from_json(text, "array<struct<name:string,columns:array<string>,rows:array<array<string>>>>")
    return F.transform(parsed, lambda t: F.struct(
        F.coalesce(t["name"], F.lit("")).alias("name"), t["rows"].alias("rows"),
        F.transform(t["columns"], lambda c: F.coalesce(F.get_json_object(c, "$.name"), c)).alias("names")))


def _table_rows(tables: Column) -> Column:
    """Rows as maps; surplus cells are dropped and ``Type`` defaults to the table name."""
    def row_map(table: Column, row: Column) -> Column:
        n = F.least(F.size(table["names"]), F.size(row))
        made = last_wins_map(F.slice(table["names"], F.lit(1), n), F.slice(row, F.lit(1), n))
        return with_entry(made, "Type", table["name"])

    return F.flatten(F.transform(tables, lambda t: F.transform(
        F.coalesce(t["rows"], F.array().cast("array<array<string>>")), lambda r: row_map(t, r))))


def unwrap(rows: DataFrame, text: str) -> DataFrame:
    """Adds ``records``, the record maps in a JSON text column, and ``others``, the values in it that are no records.

    Accepts a plain array, a vendor envelope, search hits, tables or one object.
    Each step is a column of its own so that no text is parsed twice.
    """
    field = lambda k: F.try_element_at("_doc", F.lit(k))
    staged = rows.withColumn("_doc", F.when(_starts(F.col(text), "{"), F.from_json(text, MAP)))
    staged = staged.withColumn("_hits", F.when(_starts(field("hits"), "{"), F.get_json_object(field("hits"), "$.hits")))
    chosen = F.when(_starts(F.col(text), "["), F.struct(F.col(text).alias("list"), F.lit(False).alias("hits")))
    for key in ENVELOPE_KEYS:
        chosen = chosen.when(_starts(field(key), "["), F.struct(field(key).alias("list"), F.lit(False).alias("hits")))
        if key == "hits":
            chosen = chosen.when(_starts(F.col("_hits"), "["), F.struct(F.col("_hits").alias("list"), F.lit(True).alias("hits")))
    staged = staged.withColumn("_chosen", chosen)
    staged = staged.withColumn("_all", F.from_json("_chosen.list", TEXTS)).withColumns({
        "_items": F.filter("_all", lambda i: _starts(i, "{")),
        "_tables": F.when(F.col("_chosen").isNull() & _starts(field("tables"), "["), _tables_of(field("tables"))),
    })
    body = F.when(F.col("_chosen.hits"), F.transform("_items", lambda i: F.coalesce(F.get_json_object(i, "$._source"), i))).otherwise(F.col("_items"))
    maps = F.filter(F.transform(body, lambda i: F.from_json(i, MAP)), lambda m: m.isNotNull())
    records = (F.when(F.col("_chosen").isNotNull(), maps).when(F.col("_tables").isNotNull(), _table_rows(F.col("_tables")))
               .when(F.col("_doc").isNotNull(), F.array("_doc")))
    spare = F.when(F.col("_chosen").isNotNull(), F.transform(F.filter("_all", lambda i: ~_starts(i, "{")), lambda i: F.coalesce(i, F.lit("null"))))
    spare = spare.when(F.col("_tables").isNull() & F.col("_doc").isNull() & F.col(text).isNotNull(), F.array(text))
    return staged.withColumns({"records": F.coalesce(records, F.array().cast(MAPS)), "others": F.coalesce(spare, F.array().cast(TEXTS))}).drop(
        "_doc", "_hits", "_chosen", "_all", "_items", "_tables")


def _records(rows: DataFrame) -> DataFrame:
    """One row per record map of ``records``; ``raw`` is the record as JSON."""
    made = rows.select("origin_file", F.explode_outer("records").alias("record")).where("record IS NOT NULL")
    return made.select("record", F.to_json("record", {"ignoreNullFields": "false"}).alias("raw"), "origin_file")


def _lines(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.options(**options).text(path).select(
        canon.strip(F.col("value")).alias("line"), F.input_file_name().alias("origin_file")).where("line <> ''")


def _line_values(lines: DataFrame) -> DataFrame:
    """One row for each JSON value of ``line`` rows; lines that are no JSON have a null ``value``.  Bracket lines are skipped.

    ``json`` comes out of the array as well: a test on a column beside it would be pushed below and parse each line again.
    """
    found = lines.where(~F.rtrim(F.col("line"), F.lit(",")).isin("", "[", "]")).withColumn("_values", json_values(F.col("line")))
    return unnest(found, [F.col(c) for c in lines.columns], marked("_values", "value", "json"), "json")


def parse_ndjson(lines: DataFrame) -> DataFrame:
    """``line`` rows of JSON values, several in a line too; trailing commas and bracket lines are skipped."""
    return _records(unwrap(_line_values(lines).where("json"), "value"))


def ndjson_rejects(lines: DataFrame) -> DataFrame:
    """What ``parse_ndjson`` leaves out: lines that are no JSON and values that are no objects."""
    values = unwrap(_line_values(lines), "value")
    left = F.when(~F.col("json"), F.array("line")).when(F.col("value").isNull(), F.array(F.lit("null"))).otherwise(F.col("others"))
    return values.select(F.explode(left).alias("line"), *[c for c in lines.columns if c != "line"])


def read_ndjson(spark: SparkSession, path: str, **options) -> DataFrame:
    return parse_ndjson(_lines(spark, path, **options))


def parse_search_export(lines: DataFrame) -> DataFrame:
    """``{preview, result | results}`` lines: finished results only."""
    field = lambda k: F.try_element_at("_doc", F.lit(k))
    docs = lines.withColumn("_doc", F.from_json("line", MAP)).where(F.coalesce(field("preview"), F.lit("false")) != "true")
    single = F.when(_starts(field("result"), "{"), F.array(field("result")))
    many = F.when(_starts(field("results"), "["), F.filter(F.from_json(field("results"), TEXTS), lambda i: _starts(i, "{")))
    made = docs.withColumn("_items", F.coalesce(single, many)).withColumn(
        "records", F.transform("_items", lambda i: F.from_json(i, MAP)))
    return _records(made)


def read_search_export(spark: SparkSession, path: str, **options) -> DataFrame:
    return parse_search_export(_lines(spark, path, **options))


# --- delimited ----------------------------------------------------------------------------

def _headers(spark: SparkSession, path: str, **options) -> dict[str, list[str]]:
    """Files of each header line.  The driver gets one line a file, as it does for the file listing itself."""
    rows = spark.read.options(**options).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"))
    first = rows.where("block = 0").groupBy("file").agg(F.min_by("value", "n").alias("header"))
    found: dict[str, list[str]] = {}
    for row in first.orderBy("file").toLocalIterator():
        found.setdefault(row["header"], []).append(row["file"])
    return found


def read_delimited(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = False, **options) -> DataFrame:
    """Header files, each under its own header; surplus columns are dropped.

    ``multi_line`` allows line breaks inside quotes, at the price of one task a file.
    """
    groups = _headers(spark, path, **options)
    parts = [_delimited(spark, files, sep, multi_line) for files in groups.values()]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], RECORD_DDL)


def _delimited(spark: SparkSession, files: list[str], sep: str, multi_line: bool) -> DataFrame:
    table = spark.read.csv(files, header=True, sep=sep, mode="PERMISSIVE", escape='"', multiLine=multi_line)
    pairs = [x for c in table.columns for x in (F.lit(c), F.col(f"`{c}`"))]
    made = table.select(F.create_map(*pairs).alias("record"), F.input_file_name().alias("origin_file"))
    return made.select("record", F.to_json("record", {"ignoreNullFields": "false"}).alias("raw"), "origin_file")


# --- whole folders -------------------------------------------------------------------------

def read_json(spark: SparkSession, path: str, **options) -> DataFrame:
    """JSON files by content: one document (array, envelope or object), else values line by line."""
    from .folder import read_files
    return read_files(spark, path, kinds=("document", "values"), **options)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Every export under a folder, each file read as what its first lines show."""
    from .folder import read_files
    return read_files(spark, path)


def folder_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(line, origin_file) of a folder's JSON files that became no record; other formats keep every line as a record."""
    from .folder import rejects
    return rejects(spark, path)


def totals_by_file(records: DataFrame) -> DataFrame:
    return records.groupBy("origin_file").agg(F.count(F.lit(1)).alias("records"))


def limited(records: DataFrame, limit: int | None = None) -> DataFrame:
    """At most as many rows as the caller asks for; all without a number."""
    return records if limit is None else records.limit(limit)
