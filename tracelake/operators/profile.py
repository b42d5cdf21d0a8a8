"""Field and timeline profiles of wide frames, many sources at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.scalars import (
    auto_seconds,
    axis,
    clean,
    finite,
    is_numeric_type,
    parse_datetime,
    to_number,
    unit_tag,
)
from tracelake.operators.index import as_column, column

# rows of one source that one task orders: positions are cut every 2**20
_CHUNK_BITS = 20


def long_cells(df: DataFrame, source_id: str | Column, ord: str, fields: list[str]) -> DataFrame:
    """One row per cell ``(source_id, position, ord, filled, number, text, micros)``: a single scan, and one
    set of expressions for all fields. Numbers, texts and clocks sit in their own columns."""
    kinds = dict(df.dtypes)
    cells = []
    for i, name in enumerate(fields):
        kind, value = kinds[name], clean(column(name), kinds[name])
        plain = kind == "boolean" or is_numeric_type(kind)
        clock = kind in ("timestamp", "timestamp_ntz", "date")
        text = F.to_json(value) if kind.startswith(("array", "map", "struct")) else value.cast("string")
        cells.append(
            F.struct(
                F.lit(i).alias("position"),
                text.alias("text"),
                (value.cast("double") if plain else F.lit(None).cast("double")).alias("number"),
                (F.unix_micros(value.cast("timestamp")) if clock else F.lit(None).cast("bigint")).alias("micros"),
                F.lit(kind == "string").alias("is_text"),
            )
        )
    return df.select(
        as_column(source_id).cast("string").alias("source_id"),
        column(ord).cast("bigint").alias("ord"),
        F.explode(F.array(*cells)).alias("_c"),
    ).select("source_id", "ord", "_c.*")


def monotonic(rows: DataFrame, group: list[str], ord: str, value: str) -> DataFrame:
    """Per group: whether the present values never fall in source order, as ``monotonic``.

    Order is checked inside chunks of source positions, then between the last and first values of chunks,
    so that a source of any size is spread over tasks.
    """
    # no filter on the value: it would be computed a second time below the shuffle
    keyed = rows.select(
        *group,
        F.shiftright(ord, _CHUNK_BITS).alias("_chunk"),
        F.col(ord).alias("_ord"),
        F.col(value).alias("_value"),
    )
    before = W.partitionBy(*group, "_chunk").orderBy("_ord").rowsBetween(W.unboundedPreceding, -1)
    fall = F.col("_value") < F.last("_value", ignorenulls=True).over(before)
    at = F.when(F.col("_value").isNotNull(), F.col("_ord"))
    chunks = (
        keyed.withColumn("_fall", fall)
        .groupBy(*group, "_chunk")
        .agg(
            F.max("_fall").alias("_fall"),
            F.min_by("_value", at).alias("_first"),
            F.max_by("_value", at).alias("_last"),
        )
        .filter(F.col("_last").isNotNull())
    )
    jump = F.col("_first") < F.lag("_last").over(W.partitionBy(*group).orderBy("_chunk"))
    either = F.coalesce(F.col("_fall"), F.lit(False)) | F.coalesce(F.col("_jump"), F.lit(False))
    return chunks.withColumn("_jump", jump).groupBy(*group).agg((~F.max(either)).alias("monotonic"))


def field_catalogue(df: DataFrame, fields: list[str]) -> Column:
    """The fields of a frame as an array of ``(position, field, dtype, is_numeric)``."""
    kinds = dict(df.dtypes)
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("field"),
                F.lit(kinds[name]).alias("dtype"),
                F.lit(is_number_field(kinds[name])).alias("is_numeric"),
            )
            for i, name in enumerate(fields)
        ]
    )


def field_profiles(
    df: DataFrame,
    source_id: str | Column,
    ord: str,
    fields: list[str] | None = None,
    with_order: bool = True,
) -> DataFrame:
    """One row per (source, field): missing cells, and how the field reads as a timeline.

    ``with_order=False`` leaves out the monotonic flag, the only part that orders rows.
    """
    named = fields or [name for name in df.columns if name != ord]
    return cell_profiles(long_cells(df, source_id, ord, named), field_catalogue(df, named), with_order)


def name_fields(stats: DataFrame, catalogue: Column | DataFrame, counts: list[str]) -> DataFrame:
    """Name the fields that ``(source_id, position)`` stands for: add ``field``, ``dtype``, ``is_numeric``.

    The catalogue of one frame is an array literal (:func:`field_catalogue`). That of many sources is a table
    ``(source_id, position, field, dtype, is_numeric, rows)``; there missing cells are no rows, so a field without any
    cell has no statistics yet: its ``counts`` are 0, and ``row_count`` is that of its source.
    """
    if isinstance(catalogue, Column):
        known = F.get(catalogue, F.col("position"))
        return stats.select("*", known.alias("_f")).select("*", "_f.field", "_f.dtype", "_f.is_numeric").drop("_f")
    joined = catalogue.join(stats.drop("row_count"), ["source_id", "position"], "left")
    return joined.withColumnRenamed("rows", "row_count").fillna(0, counts)


def cell_profiles(cells: DataFrame, catalogue: Column | DataFrame, with_order: bool = True) -> DataFrame:
    """:func:`field_profiles` of long cells; see :func:`name_fields` for the catalogue."""
    cells = cells.withColumn("number", F.coalesce(finite(F.col("number")), F.when(F.col("is_text"), to_number(F.col("text")))))
    cells = cells.withColumn(
        "seconds",
        F.when(F.col("number").isNotNull(), auto_seconds(F.col("number"))).otherwise(
            F.coalesce(F.col("micros") / F.lit(1e6), F.when(F.col("is_text"), parse_datetime(F.col("text"))))
        ),
    ).withColumn("unit", unit_tag(F.col("seconds"), F.col("number")))
    unit = F.col("unit")
    stats = cells.groupBy("source_id", "position").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("text").alias("non_null_count"),
        F.count(unit).alias("_parsed"),
        F.min(unit).alias("_low"),
        F.max(unit).alias("_high"),
        F.min_by(unit, F.when(unit.isNotNull(), F.col("ord"))).alias("first_time_unit"),
    )
    if with_order:
        flags = monotonic(cells, ["source_id", "position"], "ord", "seconds")
        stats = stats.join(flags, ["source_id", "position"], "left")
    else:
        stats = stats.withColumn("monotonic", F.lit(None).cast("boolean"))
    stats = name_fields(stats, catalogue, ["non_null_count", "_parsed"])
    rows, filled, parsed = F.col("row_count"), F.col("non_null_count"), F.col("_parsed")
    return stats.select(
        "source_id",
        "position",
        "field",
        "dtype",
        "row_count",
        (rows - filled).alias("null_count"),
        F.round((rows - filled).cast("double") / rows, 6).alias("null_ratio"),
        "non_null_count",
        axis(F.col("field")).alias("axis"),
        F.when(filled > 0, F.round(parsed.cast("double") / filled, 6)).otherwise(0.0).alias("time_parse_ratio"),
        F.col("monotonic").alias("time_monotonic"),
        F.when(F.col("_low") == F.col("_high"), F.col("_low")).when(parsed > 0, F.lit("mixed")).alias("inferred_time_unit"),
        "first_time_unit",
    )


def timeline_profiles(profiles: DataFrame, timelines: DataFrame) -> DataFrame:
    """Profile of each source's timeline ``(source_id, time_key)``; ``present`` tells whether it has one."""
    chosen = profiles.select(
        "source_id",
        F.col("field").alias("time_key"),
        F.lit(True).alias("present"),
        "row_count",
        "null_count",
        "null_ratio",
        F.col("time_monotonic").alias("monotonic"),
        F.col("time_parse_ratio").alias("parse_ratio"),
        F.col("inferred_time_unit").alias("inferred_unit"),
        F.col("first_time_unit").alias("first_unit"),
    )
    joined = timelines.select("source_id", "time_key").join(chosen, ["source_id", "time_key"], "left")
    return joined.select(
        "source_id",
        "time_key",
        F.coalesce("present", F.lit(False)).alias("present"),
        "row_count",
        "null_count",
        "null_ratio",
        "monotonic",
        F.coalesce("parse_ratio", F.lit(0.0)).alias("parse_ratio"),
        "inferred_unit",
        "first_unit",
        F.coalesce(F.col("inferred_unit") == "mixed", F.lit(False)).alias("mixed_units"),
    )


def source_counts(df: DataFrame, source_id: str | Column) -> DataFrame:
    """Rows and columns of a source."""
    width = len(df.columns)
    return (
        df.groupBy(as_column(source_id).cast("string").alias("source_id"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("columns", F.lit(width).cast("bigint"))
    )


def is_number_field(dtype: str) -> bool:
    """Whether a field counts as numeric for inference; bools do."""
    return dtype == "boolean" or is_numeric_type(dtype)
