"""Coordinates, boxes and transforms out of wide rows, and the typed record tables of a build."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.scalars import clean
from tracelake.operators.index import (
    as_column,
    column,
    enabled_streams,
    first_present_field,
    log_level,
    log_message,
    text_of,
    with_row_sequence,
    with_row_time,
)

_SIZE_WORDS = {"width": "w", "height": "h"}


def role_of(field: str) -> str:
    """Coordinate role of a mapped field; the mapping is a driver-side spec."""
    token = re.split(r"[./_-]", field.lower())[-1]
    if "quat" in field.lower() and token[-1:] in tuple("xyzw"):
        return "q" + token[-1]
    return _SIZE_WORDS.get(token, token)


def _number(df: DataFrame, name: str) -> Column:
    return clean(column(name), dict(df.dtypes)[name]).try_cast("double")


def coordinates(df: DataFrame, fields: list[str], roles: tuple[str, ...]) -> Column:
    """Array of the fields that play the roles; null unless all are mapped and filled."""
    by_role = {role_of(name): name for name in fields if name in df.columns}
    if any(role not in by_role for role in roles):
        return F.lit(None).cast("array<double>")
    values = [_number(df, by_role[role]) for role in roles]
    filled = values[0].isNotNull()
    for value in values[1:]:
        filled = filled & value.isNotNull()
    return F.when(filled, F.array(*values))


def box(df: DataFrame, fields: list[str]) -> Column:
    """``[x, y, width, height]`` from x/y/w/h fields, else from corner fields."""
    corners = coordinates(df, fields, ("xmin", "ymin", "xmax", "ymax"))
    from_corners = F.when(
        corners.isNotNull(),
        F.array(corners[0], corners[1], corners[2] - corners[0], corners[3] - corners[1]),
    )
    return F.coalesce(coordinates(df, fields, ("x", "y", "w", "h")), from_corners)


def transform(df: DataFrame, fields: list[str]) -> Column:
    """Translation with an optional quaternion; null without a translation."""
    place = coordinates(df, fields, ("x", "y", "z"))
    turn = coordinates(df, fields, ("qx", "qy", "qz", "qw"))
    return F.when(place.isNotNull(), F.struct(place.alias("translation"), turn.alias("quaternion")))


def finite_point(*values: Column) -> Column:
    """True where every coordinate is a finite number."""
    test = F.lit(True)
    for value in values:
        test = test & value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return test


def clamp_color(value: Column) -> Column:
    """Colour channel: rounded half to even, kept in 0..255."""
    kept = F.least(F.greatest(F.bround(value, 0), F.lit(0.0)), F.lit(255.0))
    # least and greatest pass over nulls
    return F.when(value.isNotNull(), kept.cast("int"))


def build_tables(
    df: DataFrame,
    mapping: dict,
    recording_id: str | Column,
    ord: str,
    chunks: int | None = None,
) -> dict[str, DataFrame]:
    """Typed record tables of a recording: ``scalars``, ``states``, ``logs`` and ``geometry``.

    Every record carries ``row``, its position in the final order, and ``time`` where the row has one.
    """
    # own names, so that source columns of the same names stay readable
    rows = with_row_time(df, mapping, "_time").withColumn("_recording", as_column(recording_id).cast("string"))
    rows = rows.withColumn("_position", column(ord).cast("bigint"))
    sort = mapping.get("timeline_sort") or "source"
    rows = with_row_sequence(rows, ["_recording"], sort, chunks, time="_time", ord="_position", name="_row")

    def record(kind: str, path: str, **values: Column) -> Column:
        named = [F.lit(path).alias("entity_path"), F.lit(kind).alias("semantic_type")]
        return F.struct(*named, *[value.alias(name) for name, value in values.items()])

    cells: dict[str, list[Column]] = {"scalars": [], "states": [], "logs": [], "geometry": []}
    no_array = F.lit(None).cast("array<double>")
    for stream in enabled_streams(mapping):
        kind, path = stream.get("semantic_type"), stream.get("entity_path")
        fields = list(stream.get("source_fields", []))
        first = first_present_field(df, fields)
        if not path or first is None:
            continue
        if kind == "scalar":
            cells["scalars"].append(record(kind, path, value=_number(df, first)))
        elif kind == "scalar_group":
            cells["scalars"] += [
                record(kind, f"{path}/{name}", value=_number(df, name)) for name in fields if name in df.columns
            ]
        elif kind == "state":
            cells["states"].append(record(kind, path, value=text_of(df, first)))
        elif kind == "text_log":
            cells["logs"].append(
                record(kind, path, value=log_message(df, fields), level=log_level(df, fields))
            )
        elif kind == "points2d":
            cells["geometry"].append(record(kind, path, value=coordinates(df, fields, ("x", "y")), turn=no_array))
        elif kind in ("points3d", "trajectory3d"):
            place = coordinates(df, fields, ("x", "y", "z"))
            cells["geometry"].append(record(kind, path, value=place, turn=no_array))
        elif kind == "boxes2d":
            cells["geometry"].append(record(kind, path, value=box(df, fields), turn=no_array))
        elif kind == "transform3d":
            moved = transform(df, fields)
            cells["geometry"].append(
                record(kind, path, value=moved["translation"], turn=moved["quaternion"])
            )
    tables = {}
    for name, records in cells.items():
        if records:
            tables[name] = (
                rows.select("_recording", "_row", "_time", F.explode(F.array(*records)).alias("cell"))
                .select(
                    F.col("_recording").alias("recording_id"), F.col("_row").alias("row"), F.col("_time").alias("time"), "cell.*"
                )
                .filter(F.col("value").isNotNull())
            )
    return tables
