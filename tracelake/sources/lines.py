"""Lines of text: numbering, log rows, delimiter detection, all as jobs over a lines table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.session import materialize


# fixed values: delimiter name -> character
DELIMITERS = {"tab": "\t", "comma": ",", "semicolon": ";", "pipe": "|"}


def number_rows(df: DataFrame, name: str) -> DataFrame:
    """Number the rows of each file from 1, in file order, without sorting rows.

    Rows of one split come in order, so a running id gives the place inside the split; one count per split
    gives the rows before it. The counts, one row per split, are written once to the shared folder, so the join sees
    how small they are. Needs the columns ``file``, ``block`` (start of the split) and ``place`` (running id). Both scans
    must cut files alike: call :func:`tracelake.session.configure` once where executors come and go.
    """
    splits = df.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"), F.min("place").alias("_first"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.select(
        F.col("file").alias("_file"),
        F.col("block").alias("_block"),
        "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    offsets = materialize(offsets, "splits")
    same = (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))
    numbered = df.join(offsets, same).withColumn(name, F.col("_before") + F.col("place") - F.col("_first") + 1)
    return numbered.drop("_file", "_block", "_first", "_before", "block", "place")


def read_lines(spark: SparkSession, path: str | list[str], options: dict | None = None) -> DataFrame:
    """``(file, line_number, text)`` of text files; every line counts, blank ones too. ``options`` go to the reader."""
    lines = spark.read.options(**(options or {})).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value").alias("text"),
    )
    numbered = number_rows(lines, "line_number")
    bare = F.regexp_replace("text", "\r$", "")
    first = F.col("line_number") == 1
    return numbered.withColumn("text", F.when(first, F.regexp_replace(bare, "^﻿", "")).otherwise(bare))


def split_lines(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Lines of a text column, numbered from 1: ``keys + (line_number, text)``."""
    parts = F.split(F.regexp_replace(F.col(text), "\r\n", "\n"), "\n", -1)
    return df.select(*keys, F.posexplode(parts).alias("_p", "text")).select(
        *keys, (F.col("_p") + 1).cast("bigint").alias("line_number"), "text"
    )


def is_blank(text: Column) -> Column:
    return text.rlike(r"^\s*$")


def log_rows(lines: DataFrame) -> DataFrame:
    """Log messages: blank lines are left out but keep their numbers."""
    return lines.filter(~is_blank(F.col("text"))).withColumnRenamed("text", "message")


# a cell of a line that reads as a number
_NUMBER_CELL = (
    r"(^|\s)[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?|(?i:nan|inf|infinity))(\s|$)"
)


def _width(text: Column, delimiter: str) -> Column:
    """Number of cells of a line."""
    if delimiter == "whitespace":
        return F.size(F.split(F.trim(text), r"\s+", -1))
    # a delimiter inside quotes does not count
    bare = F.trim(text)
    bare = F.when(bare.contains('"'), F.regexp_replace(bare, '"[^"]*"', '""')).otherwise(bare)
    return F.length(bare) - F.length(F.replace(bare, F.lit(DELIMITERS[delimiter]), F.lit(""))) + 1


def line_widths(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Non-blank lines per (source, delimiter, number of cells), and how many of them hold a number."""
    text = F.col("text")
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("delimiter"),
                _width(text, name).alias("width"),
                (text.rlike(_NUMBER_CELL) if name == "whitespace" else F.lit(True)).alias("has_number"),
            )
            for name in (*DELIMITERS, "whitespace")
        ]
    )
    return (
        lines.filter(~is_blank(text))
        .select(*keys, F.explode(cells).alias("_c"))
        .groupBy(*keys, F.col("_c.delimiter").alias("delimiter"), F.col("_c.width").alias("width"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_c.has_number")).alias("numeric_lines"))
    )


def modal_widths(widths: DataFrame, keys: list[str]) -> DataFrame:
    """The most common width per (source, delimiter), the smaller one of equals, and its share of the lines."""
    return widths.groupBy(*keys, "delimiter").agg(
        F.max_by("width", F.struct("n", -F.col("width"))).alias("modal_width"),
        F.max("n").alias("modal_lines"),
        F.sum("n").alias("lines"),
        F.sum("numeric_lines").alias("numeric_lines"),
    ).withColumn("share", F.col("modal_lines").cast("double") / F.col("lines"))


def sniff_delimiters(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Delimiter and width of each source; no row for sources that are not tables.

    A delimiter counts where at least 90 % of two or more lines have the same width above 1; whitespace also
    needs a number on half of the lines. The widest wins, then the name that sorts last.
    """
    modal = modal_widths(line_widths(lines, keys), keys)
    numbers = (F.col("delimiter") != "whitespace") | (F.col("numeric_lines").cast("double") / F.col("lines") >= 0.5)
    stable = modal.filter((F.col("lines") >= 2) & (F.col("modal_width") > 1) & (F.col("share") >= 0.9) & numbers)
    best = F.max(F.struct(F.col("modal_width").alias("width"), "delimiter"))
    return stable.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.delimiter", "_b.width")
