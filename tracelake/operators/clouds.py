"""Statistics and signals of point tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.scalars import cloud_time
from tracelake.operators.geometry import finite_point
from tracelake.operators.ordered import with_rank
from tracelake.schema import SIGNAL_COLUMNS


def finite_points(points: DataFrame) -> DataFrame:
    return points.filter(finite_point(F.col("x"), F.col("y"), F.col("z")))


def point_stats(points: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Point count and bounds per file; files of the listing without points count 0."""
    bounds = [f(name).alias(f"{label}_{name}") for label, f in (("min", F.min), ("max", F.max)) for name in "xyz"]
    stats = finite_points(points).groupBy("file").agg(F.count(F.lit(1)).alias("point_count"), *bounds)
    if files is not None:
        stats = files.select("file").join(stats, "file", "left")
    return stats.withColumn("point_count", F.coalesce("point_count", F.lit(0)).cast("bigint"))


def stem_of(file):
    name = F.element_at(F.split(file, "/", -1), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def with_cloud_times(stats: DataFrame, chunks: int | None = None) -> DataFrame:
    """Add ``ord``, the place in path order, and ``time``, read from the file name where it is a number."""
    ranked = with_rank(stats, [], ["file"], "ord", chunks).withColumn("ord", F.col("ord") - 1)
    return ranked.withColumn("time", cloud_time(stem_of(F.col("file")), F.col("ord")))


def cloud_totals(timed: DataFrame) -> DataFrame:
    """One row over all files."""
    return timed.agg(
        F.count(F.lit(1)).alias("point_cloud_count"),
        F.min("point_count").alias("point_count_min"),
        F.max("point_count").alias("point_count_max"),
        F.avg("point_count").alias("point_count_mean"),
        F.min("time").alias("start_time"),
        F.max("time").alias("end_time"),
    )


def cloud_signals(timed: DataFrame, recording_id: str, source_id: str) -> DataFrame:
    """Three signal rows per file: name, point count and format."""
    suffix = F.lower(F.regexp_extract("file", r"\.([^./]*)$", 1))
    nothing = F.lit(None)

    def cell(key: str, kind: str, number, text):
        return F.struct(
            F.lit(key).alias("key"),
            F.lit(kind).alias("value_type"),
            number.cast("double").alias("value_num"),
            text.cast("string").alias("value_str"),
        )

    cells = F.array(
        cell("file", "string", nothing, F.element_at(F.split("file", "/", -1), -1)),
        cell("point_count", "int", F.col("point_count"), nothing),
        cell("format", "string", nothing, suffix),
    )
    return timed.select(
        F.lit(recording_id).alias("recording_id"),
        F.lit(source_id).alias("source_id"),
        "time",
        F.lit("/sensors/lidar/points").alias("entity_path"),
        F.lit("points3d").alias("semantic_type"),
        "ord",
        F.explode(cells).alias("_c"),
    ).select("recording_id", "source_id", "time", "entity_path", "semantic_type", "ord", "_c.*").select(*SIGNAL_COLUMNS)
