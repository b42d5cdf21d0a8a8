"""Text point files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.scalars import finite, to_number
from tracelake.operators.geometry import clamp_color
from tracelake.sources.files import suffix_of
from tracelake.sources.lines import read_lines


def read_points(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, line_number, x, y, z, color)`` of text point files."""
    return parse_points(read_lines(spark, path))


def parse_points(lines: DataFrame) -> DataFrame:
    """Points of numbered lines ``(file, line_number, text)``.

    Comments, short lines and lines whose first three cells are not finite numbers are left out, so a leading
    point count is too. Colours are kept for ``.xyzrgb`` files in which every point has one.
    """
    text = F.trim("text")
    data = lines.filter((text != "") & ~text.rlike(r"^(#|//|;)"))
    cells = F.split(F.trim(F.regexp_replace(text, ",", " ")), r"\s+", -1)
    values = data.select("file", "line_number", cells.alias("_v"))
    number = [finite(to_number(F.get("_v", F.lit(i)))) for i in range(6)]
    rgb = F.array(*[clamp_color(value) for value in number[3:]])
    has_rgb = (suffix_of(F.col("file")) == "xyzrgb") & ~F.exists(rgb, lambda c: c.isNull())
    points = values.select(
        "file",
        "line_number",
        number[0].alias("x"),
        number[1].alias("y"),
        number[2].alias("z"),
        F.when(has_rgb, rgb).alias("color"),
    ).filter("x is not null and y is not null and z is not null")
    colored = points.groupBy(F.col("file").alias("_file")).agg(
        (F.count(F.lit(1)) == F.count("color")).alias("_colored")
    )
    joined = points.join(colored, F.col("file") == F.col("_file"))
    return joined.withColumn("color", F.when(F.col("_colored"), F.col("color"))).drop("_file", "_colored")
