"""What a wide frame means: its timeline, its streams, and the template that suits it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.scalars import (
    archetype,
    axis_letter,
    axis_prefix,
    contains_any,
    entity_path,
    parse_datetime,
    safe_slug,
    view,
)
from tracelake.operators.profile import field_catalogue, long_cells, monotonic, name_fields
from tracelake.schema import TIME_COLUMN_NAMES

# fixed values: words and weights of the inference rules
_MEASURE_WORDS = ("battery", "cpu", "memory", "temp", "loss", "accuracy")
_STATE_WORDS = ("state", "status", "mode")
_LEVEL_NAMES = ("level", "severity")
_MESSAGE_NAMES = ("message", "msg", "log", "error", "error_code")
_LONG_TEXT = 40


def field_stats(
    df: DataFrame, source_id: str | Column, ord: str, fields: list[str] | None = None
) -> DataFrame:
    """One row per (source, field) with what inference needs: counts, exact distinct count, share of values
    in [0, 1], median text length, share of date texts, and whether numbers never fall.

    Distinct values are counted in two steps, combined before each shuffle, by the length and 128-bit
    hash of a text: no whole text is shuffled as a key. The result is a small catalogue table that several
    steps read: write it once.
    """
    named = fields or [name for name in df.columns if name != ord]
    return cell_stats(long_cells(df, source_id, ord, named), field_catalogue(df, named))


def cell_stats(cells: DataFrame, catalogue: Column | DataFrame) -> DataFrame:
    """:func:`field_stats` of long cells; see :func:`tracelake.operators.profile.name_fields` for the catalogue."""
    keys = ["source_id", "position"]
    told = cells.select(
        *keys,
        "number",
        F.length("text").alias("length"),
        F.md5("text").alias("digest"),
        parse_datetime(F.col("text")).isNotNull().alias("is_date"),
    )
    values = told.groupBy(*keys, "length", "digest", "is_date").agg(
        F.count(F.lit(1)).alias("n"), F.max("number").alias("number")
    )
    size = F.when(F.col("digest").isNotNull(), F.col("n")).otherwise(0)
    lengths = values.groupBy(*keys, "length").agg(
        F.sum("n").alias("row_count"),
        F.sum(size).alias("n"),
        F.count("digest").alias("distinct_count"),
        F.sum(F.when(F.col("is_date"), F.col("n")).otherwise(0)).alias("dates"),
        F.sum(F.when(F.col("number").between(0, 1), F.col("n")).otherwise(0)).alias("unit"),
    )
    stats = lengths.groupBy(*keys).agg(
        F.sum("row_count").alias("row_count"),
        F.sum("n").alias("n"),
        F.sum("distinct_count").alias("distinct_count"),
        F.percentile("length", F.lit(0.5), F.col("n")).alias("median_length"),
        F.sum("dates").alias("_dates"),
        F.sum("unit").alias("_unit"),
    )
    flags = monotonic(cells, keys, "ord", "number")
    joined = name_fields(stats.join(flags, keys, "left"), catalogue, ["n", "distinct_count", "_dates", "_unit"])
    count = F.col("n")
    return joined.select(
        "source_id",
        "position",
        "field",
        "dtype",
        "is_numeric",
        "row_count",
        "n",
        "distinct_count",
        F.when(count > 0, F.col("distinct_count").cast("double") / count).alias("distinct_ratio"),
        F.when(F.col("is_numeric") & (count > 0), F.col("_unit").cast("double") / count).alias("unit_share"),
        F.when(~F.col("is_numeric"), F.col("median_length")).alias("median_length"),
        F.when(~F.col("is_numeric") & (count > 0), F.col("_dates").cast("double") / count).alias("date_share"),
        "monotonic",
    )


def timeline_scores(stats: DataFrame) -> DataFrame:
    """Score of each field as a timeline; an exact time name beats every score."""
    low = F.lower("field")
    named = reduce(
        lambda chain, item: chain.when(low == item[1], F.lit(item[0])),
        enumerate(TIME_COLUMN_NAMES[1:], start=1),
        F.when(low == TIME_COLUMN_NAMES[0], F.lit(0)),
    )
    points = F.when(contains_any(low, ("time", "date")), 0.35).otherwise(0.0)
    points += F.when(F.col("is_numeric") & F.col("monotonic"), 0.45).otherwise(0.0)
    points += F.when(F.col("is_numeric") & (F.col("distinct_count") == F.col("n")), 0.15).otherwise(0.0)
    points += F.when(~F.col("is_numeric") & (F.col("date_share") > 0.8), 0.6).otherwise(0.0)
    return stats.withColumn("name_rank", named).withColumn(
        "score", F.round(F.when(F.col("n") > 0, points).otherwise(0.0), 6)
    )


def detect_timeline(stats: DataFrame) -> DataFrame:
    """``(source_id, time_key)``: the exact time name of best priority, else the best score of at least 0.6."""
    scored = timeline_scores(stats)
    exact = F.col("name_rank").isNotNull()
    enough = F.col("score") >= 0.6
    return scored.groupBy("source_id").agg(
        F.coalesce(
            F.min_by(F.when(exact, F.col("field")), F.when(exact, F.struct("name_rank", -F.col("position")))),
            F.max_by(F.when(enough, F.col("field")), F.when(enough, F.struct("score", -F.col("position")))),
        ).alias("time_key")
    )


def numeric_confidence(field: Column, unit_share: Column) -> Column:
    bonus = F.when(contains_any(F.lower(field), _MEASURE_WORDS), 0.14).otherwise(0.0)
    share = F.when(unit_share > 0.95, 0.04).otherwise(0.0)
    return F.round(F.least(F.lit(0.72) + bonus + share, F.lit(0.95)), 6)


def string_kind(field: Column, n: Column, distinct_count: Column) -> Column:
    """Struct ``(semantic_type, confidence)`` of a text field that is not part of a log."""

    def outcome(kind: str, confidence: float) -> Column:
        return F.struct(F.lit(kind).alias("semantic_type"), F.lit(confidence).alias("confidence"))

    few = F.least(F.lit(20), F.greatest(F.lit(5), F.ceil(n * 0.1)))
    return (
        F.when(n == 0, outcome("state", 0.55))
        .when(contains_any(F.lower(field), _STATE_WORDS), outcome("state", 0.88))
        .when((distinct_count.cast("double") / n <= 0.2) | (distinct_count <= few), outcome("state", 0.76))
        .otherwise(outcome("text_log", 0.62))
    )


def axis_groups(fields: DataFrame) -> DataFrame:
    """x/y/z fields of one vector: a row per prefix that has at least two of them."""
    lettered = fields.select(
        "source_id",
        "position",
        "field",
        axis_prefix(F.col("field")).alias("prefix"),
        axis_letter(F.col("field")).alias("letter"),
    ).filter(F.col("prefix").isNotNull())
    grouped = lettered.groupBy("source_id", "prefix").agg(
        F.min("position").alias("position"),
        *[
            F.max_by(F.when(F.col("letter") == letter, F.col("field")), F.when(F.col("letter") == letter, F.col("position"))).alias(letter)
            for letter in "xyz"
        ],
    )
    members = F.array_compact(F.array("x", "y", "z"))
    return grouped.select("source_id", "prefix", "position", members.alias("fields")).filter(F.size("fields") >= 2)


def infer_streams(stats: DataFrame, timelines: DataFrame | None = None) -> DataFrame:
    """Streams of each source: vectors, scalars, one log, states and texts, the timeline left out."""
    timelines = detect_timeline(stats) if timelines is None else timelines
    fields = stats.join(timelines, "source_id", "left").filter(
        F.col("time_key").isNull() | (F.col("field") != F.col("time_key"))
    )
    numbers, texts = fields.filter("is_numeric"), fields.filter("not is_numeric")

    groups = axis_groups(numbers)
    vectors = groups.select(
        "source_id",
        F.lit(0).alias("part"),
        "position",
        safe_slug(F.col("prefix")).alias("name"),
        F.lit("scalar_group").alias("semantic_type"),
        "fields",
        F.lit(0.86).alias("confidence"),
    )
    used = groups.select("source_id", F.explode("fields").alias("field"))
    scalars = numbers.join(used, ["source_id", "field"], "left_anti").select(
        "source_id",
        F.lit(1).alias("part"),
        "position",
        F.col("field").alias("name"),
        F.lit("scalar").alias("semantic_type"),
        F.array("field").alias("fields"),
        numeric_confidence(F.col("field"), F.col("unit_share")).alias("confidence"),
    )

    low = F.lower("field")
    per_source = W.partitionBy("source_id")
    # rank 0 for the first level name a source has, then the message names in their order
    rank = F.when(low == _LEVEL_NAMES[0], 0).when(low == _LEVEL_NAMES[1], 1)
    for i, name in enumerate(_MESSAGE_NAMES):
        rank = rank.when(low == name, i + 2)
    ranked = texts.withColumn("_rank", rank)
    best_level = F.min(F.when(F.col("_rank") < 2, F.col("_rank"))).over(per_source)
    in_log = F.col("_rank").isNotNull() & ((F.col("_rank") >= 2) | (F.col("_rank") == best_level))
    latest = F.max("position").over(W.partitionBy("source_id", "_rank"))
    ranked = ranked.withColumn("_named", in_log & (F.col("position") == latest))
    any_named = F.max("_named").over(per_source)
    long_text = F.coalesce(F.col("median_length") >= _LONG_TEXT, F.lit(False))
    first_long = F.min(F.when(long_text, F.col("position"))).over(per_source)
    ranked = ranked.withColumn(
        "_log", F.when(any_named, F.col("_named")).otherwise(F.coalesce(F.col("position") == first_long, F.lit(False)))
    )
    entry = F.struct(F.coalesce("_rank", F.lit(0)).alias("r"), "position", "field")
    logs = (
        ranked.filter("_log")
        .groupBy("source_id")
        .agg(F.min("position").alias("position"), F.array_sort(F.collect_list(entry)).alias("_fields"))
        .select(
            "source_id",
            F.lit(2).alias("part"),
            "position",
            F.lit("system_log").alias("name"),
            F.lit("text_log").alias("semantic_type"),
            F.transform("_fields", lambda item: item["field"]).alias("fields"),
            F.lit(0.88).alias("confidence"),
        )
    )
    kind = string_kind(F.col("field"), F.col("n"), F.col("distinct_count"))
    others = ranked.filter("not _log").select(
        "source_id",
        F.lit(3).alias("part"),
        "position",
        F.col("field").alias("name"),
        kind["semantic_type"].alias("semantic_type"),
        F.array("field").alias("fields"),
        kind["confidence"].alias("confidence"),
    )
    streams = reduce(DataFrame.unionByName, [vectors, scalars, logs, others])
    return streams.join(timelines, "source_id", "left").withColumn(
        "stream_id", F.concat(F.lit("stream_"), safe_slug(F.col("name")))
    )


def suggest_mapping(streams: DataFrame) -> DataFrame:
    """Mapping rows of inferred streams: path, archetype and view added."""
    role = F.col("role") if "role" in streams.columns else F.lit(None).cast("string")
    kind = F.col("semantic_type")
    return streams.select(
        "source_id",
        (F.col("part") * 100000 + F.col("position")).alias("pos"),
        "stream_id",
        "name",
        F.col("fields").alias("source_fields"),
        "semantic_type",
        entity_path(kind, role, F.col("name")).alias("entity_path"),
        archetype(kind).alias("archetype"),
        view(kind).alias("view"),
        F.round("confidence", 3).alias("confidence"),
        F.lit(True).alias("enabled"),
        F.lit(False).alias("required"),
        F.lit("inferred").alias("origin"),
        F.concat(F.lit("inferred:"), F.col("stream_id")).alias("rule_key"),
        "time_key",
    )


# fixed values: template -> (types, weight of having any of them)
_TEMPLATE_POINTS = {
    "cv_detection": ((("image",), 0.55), (("boxes2d",), 0.35), (("points2d", "segmentation"), 0.15)),
    "robotics_debug": (
        (("mcap",), 0.45),
        (("points3d",), 0.25),
        (("transform3d",), 0.2),
        (("trajectory3d",), 0.1),
        (("asset3d",), 0.1),
    ),
    "sensor_monitor": ((("scalar", "scalar_group"), 0.45), (("state",), 0.25), (("text_log",), 0.2)),
}
_TEMPLATE_NAMES = {
    "cv_detection": "CV Detection",
    "robotics_debug": "Robotics Debug",
    "sensor_monitor": "Sensor Monitor",
}


def template_scores(streams: DataFrame) -> DataFrame:
    """Score of each template per source, best first; the sensor template is always listed.

    Reads ``semantic_type`` and, where present, ``role`` and ``message_encoding``.
    """
    for name in ("role", "message_encoding"):
        if name not in streams.columns:
            streams = streams.withColumn(name, F.lit(None).cast("string"))

    def any_of(test: Column, weight: float) -> Column:
        return F.max(F.when(test, weight).otherwise(0.0))

    sums = {
        template: [any_of(F.col("semantic_type").isin(*kinds), weight) for kinds, weight in rules]
        for template, rules in _TEMPLATE_POINTS.items()
    }
    sums["cv_detection"].append(any_of(F.col("role") == "pred_scores", 0.1))
    sums["robotics_debug"].append(any_of(F.coalesce(F.col("message_encoding"), F.lit("")) != "", 0.6))
    sums["sensor_monitor"].append(F.max(F.lit(0.1)))
    totals = streams.groupBy("source_id").agg(
        *[
            F.round(F.least(sum(parts[1:], parts[0]), F.lit(1.0 if template == "robotics_debug" else 9.0)), 3).alias(template)
            for template, parts in sums.items()
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(template).alias("template_id"),
                F.lit(_TEMPLATE_NAMES[template]).alias("name"),
                F.col(template).alias("score"),
            )
            for i, template in enumerate(sums)
        ]
    )
    listed = totals.select("source_id", F.explode(rows).alias("_t")).select("source_id", "_t.*")
    listed = listed.filter((F.col("score") > 0) | (F.col("template_id") == "sensor_monitor"))
    best_first = W.partitionBy("source_id").orderBy(F.col("score").desc(), "position")
    return listed.withColumn("rank", F.row_number().over(best_first)).drop("position")


def pick_template(streams: DataFrame) -> DataFrame:
    """Default template per source."""
    if "message_encoding" not in streams.columns:
        streams = streams.withColumn("message_encoding", F.lit(None).cast("string"))
    kind = F.col("semantic_type")
    flags = streams.groupBy("source_id").agg(
        F.max((kind == "mcap") | (F.coalesce(F.col("message_encoding"), F.lit("")) != "")).alias("_bag"),
        F.max(kind.isin("points3d", "transform3d", "trajectory3d", "asset3d")).alias("_space"),
        F.max(kind == "image").alias("_image"),
    )
    picked = (
        F.when(F.col("_bag") | F.col("_space"), "robotics_debug").when(F.col("_image"), "cv_detection").otherwise("sensor_monitor")
    )
    return flags.select("source_id", picked.alias("template_id"))
