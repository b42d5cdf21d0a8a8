"""Many files of different kinds as one table of records, each with the cells of its row.

A record is ``(source_id, ord, cells)``: the file, the place in it and an array of ``(field, text, kind)``. Files keep
their own header, delimiter and fields; nothing is widened to a common schema, so a folder of thousands of layouts is
still one narrow table, and everything about fields is told by a second table with a row per (file, field).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.scalars import NUMBER_PATTERN, SPECIAL_NUMBER_PATTERN, typed_number, typed_text
from tracelake.schema import MISSING_TOKENS, SUFFIX_TYPES
from tracelake.session import materialize
from tracelake.sources.files import cells_of_lines, dialects, source_type, too_wide
from tracelake.sources.lines import log_rows, read_lines

TABULAR = ("csv", "jsonl", "text_table")
#: fields of a text file that is no table
LOG_FIELDS = ("line_number", "message")


def suffix_glob(kinds: tuple[str, ...]) -> str:
    """A glob over the suffixes of some source types, in either case."""
    either = lambda text: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in text)
    return "*.{" + ",".join(either(suffix) for kind in kinds for suffix in SUFFIX_TYPES[kind]) + "}"


def _cell(field: Column, text: Column, kind: Column) -> Column:
    return F.struct(field.alias("field"), text.alias("text"), kind.alias("kind"))


def _present(text: Column) -> Column:
    return F.when(~F.trim(text).isin(*MISSING_TOKENS), text)


def table_records(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Records of the delimited lines of files with their dialects; columns without a name are left out."""
    parsed = cells_of_lines(lines, found)
    place = (F.col("line_number") - F.coalesce("header_line", F.lit(0))).cast("bigint")
    cell = lambda name, text: _cell(name, _present(text), F.lit("text"))
    return parsed.select(
        F.col("file").alias("source_id"),
        place.alias("ord"),
        F.zip_with("names", F.slice("cells", F.lit(1), F.size("names")), cell).alias("cells"),
        too_wide().alias("too_wide"),
    )


def log_records(lines: DataFrame) -> DataFrame:
    """Records of log lines: the number of the line and its text."""
    rows = log_rows(lines)
    cells = F.array(
        _cell(F.lit(LOG_FIELDS[0]), F.col("line_number").cast("string"), F.lit("bigint")),
        _cell(F.lit(LOG_FIELDS[1]), F.col("message"), F.lit("string")),
    )
    return rows.select(F.col("file").alias("source_id"), F.col("line_number").alias("ord"), cells.alias("cells"), F.lit(False).alias("too_wide"))


def json_records(lines: DataFrame) -> DataFrame:
    """Records of JSON lines, objects one level deep flattened as ``parent.child``; null ``cells`` where no object is."""
    value = F.try_parse_json(F.trim("text"))
    parsed = lines.filter(F.trim("text") != "").withColumn("_v", value)
    is_object = F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT"))
    entries = lambda v: F.map_entries(v.cast("map<string, variant>"))

    def cell(name: Column, v: Column) -> Column:
        told = F.schema_of_variant(v)
        kind = (
            F.when(told == "BIGINT", F.lit("bigint"))
            .when((told == "DOUBLE") | F.startswith(told, F.lit("DECIMAL")), F.lit("double"))
            .when(told == "BOOLEAN", F.lit("boolean"))
            .otherwise(F.lit("string"))
        )
        return _cell(name, v.cast("string"), kind)

    def flat(entry: Column) -> Column:
        key, v = entry["key"], entry["value"]
        inner = F.transform(entries(v), lambda sub: cell(F.concat(key, F.lit("."), sub["key"]), sub["value"]))
        return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), inner).otherwise(F.array(cell(key, v)))

    cells = F.when(is_object, F.flatten(F.transform(entries(F.col("_v")), flat)))
    return parsed.select(F.col("file").alias("source_id"), F.col("line_number").alias("ord"), cells.alias("cells"), F.lit(False).alias("too_wide"))


def read_records(spark: SparkSession, patterns: str | list[str], options: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of all tabular files below paths or globs, found by suffix; other files are not opened.

    Every CSV, text and JSON-lines file is read by its own dialect. Rejects ``(source_id, ord, reason)`` are lines with
    more cells than columns, and JSON lines that are no object. Both tables are written once to the shared folder.
    """
    reader = {"recursiveFileLookup": "true", "pathGlobFilter": suffix_glob(TABULAR)}
    lines = read_lines(spark, patterns, reader).withColumn("_type", source_type(F.col("file")))
    of = lambda kind: lines.filter(F.col("_type") == kind).drop("_type")
    told = materialize(
        dialects(of("csv"), options, "csv").unionByName(dialects(of("text_table"), options, "text")), "dialects"
    )
    tables = told.filter("delimiter is not null")
    logs = of("text_table").join(told.filter("delimiter is null").select("file"), "file", "left_semi")
    every = (
        table_records(lines.filter(F.col("_type").isin("csv", "text_table")).drop("_type"), tables)
        .unionByName(log_records(logs))
        .unionByName(json_records(of("jsonl")))
    )
    every = materialize(every, "records")
    good = F.col("cells").isNotNull() & ~F.col("too_wide")
    reason = F.when(F.col("cells").isNull(), F.lit("not a JSON object")).otherwise(F.lit("more cells than columns"))
    return every.filter(good).drop("too_wide"), every.filter(~good).select("source_id", "ord", reason.alias("reason"))


def record_fields(records: DataFrame) -> DataFrame:
    """``(source_id, position, field, dtype, is_numeric, rows)``: the fields of every file, one aggregation over all cells.

    The type is the narrowest one that all present cells of the field have: texts of tables are judged by how they read,
    JSON values by what they are. Fields of tables stand in the order of their columns, those of JSON lines by name.
    """
    cells = records.select("source_id", F.posexplode_outer("cells").alias("at", "c")).select("source_id", "at", "c.*")
    text, kind = F.trim("text"), F.col("kind")
    told = kind != "text"
    whole = F.when(told, kind == "bigint").otherwise(text.rlike(r"^[+-]?\d+$") & text.try_cast("bigint").isNotNull())
    number = F.when(told, kind.isin("bigint", "double")).otherwise(text.rlike(NUMBER_PATTERN) | text.rlike(SPECIAL_NUMBER_PATTERN))
    flag = F.when(told, kind == "boolean").otherwise(F.lower(text).isin("true", "false"))
    has = F.col("text").isNotNull()
    found = cells.filter("field is not null").groupBy("source_id", "field").agg(
        F.min(F.when(told, 0).otherwise(F.col("at"))).alias("at"),
        F.count("text").alias("n"),
        *[F.min(F.when(has, test)).alias(name) for name, test in (("i", whole), ("d", number), ("b", flag))],
    )
    dtype = (
        F.when((F.col("n") == 0) | F.col("i").isNull(), F.lit("double"))
        .when(F.col("i"), F.lit("bigint"))
        .when(F.col("d"), F.lit("double"))
        .when(F.col("b"), F.lit("boolean"))
        .otherwise(F.lit("string"))
    )
    rows = records.groupBy("source_id").agg(F.count(F.lit(1)).alias("rows"))
    place = F.row_number().over(W.partitionBy("source_id").orderBy("at", "field")) - 1
    named = found.select("source_id", place.alias("position"), "field", dtype.alias("dtype"))
    return named.withColumn("is_numeric", F.col("dtype") != "string").join(rows, "source_id")


def record_cells(records: DataFrame, fields: DataFrame) -> DataFrame:
    """Cells of records as profiles read them: ``(source_id, position, ord, text, number, micros, is_text)``, missing
    ones left out. ``fields`` is a small catalogue: written, it meets the cells at its runtime size."""
    cells = records.select("source_id", "ord", F.explode("cells").alias("c")).select("source_id", "ord", "c.field", "c.text")
    joined = cells.filter("text is not null").join(fields.select("source_id", "field", "position", "dtype"), ["source_id", "field"])
    dtype = F.col("dtype")
    return joined.select(
        "source_id",
        "position",
        "ord",
        typed_text(F.col("text"), dtype).alias("text"),
        typed_number(F.col("text"), dtype).alias("number"),
        F.lit(None).cast("bigint").alias("micros"),
        (dtype == "string").alias("is_text"),
    )
