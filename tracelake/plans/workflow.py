"""From a file to an indexed recording: read, profile, infer, map, validate, melt."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import inference as I
from tracelake.operators.index import index_frame, mapping_rules, melt_records
from tracelake.operators.mapping import spec_from_streams
from tracelake.operators.profile import cell_profiles, field_profiles
from tracelake.operators.validate import validate
from tracelake.session import materialize
from tracelake.sources.files import ORD, load_source, name_recordings
from tracelake.sources.mixed import LOG_FIELDS, read_records, record_cells, record_fields


@dataclass
class Imported:
    """What an import yields; all but ``mapping`` and ``template_id`` are frames."""

    frame: DataFrame
    profiles: DataFrame
    streams: DataFrame
    mapping: dict
    template_id: str
    report: DataFrame
    issues: DataFrame
    signals: DataFrame


def import_source(
    spark: SparkSession,
    path: str,
    recording_id: str,
    source_id: str,
    options: dict | None = None,
    timeline_sort: str = "source",
) -> Imported:
    """Import one tabular source as one recording; :func:`import_folder` takes many."""
    if not isinstance(path, str):
        raise TypeError("a source is one path; import_folder makes a recording of every file")
    frame = load_source(spark, path, options)
    fields = [name for name in frame.columns if name not in (ORD, "_file")]
    # small catalogue tables, read by several steps below
    stats = materialize(I.field_stats(frame, source_id, ORD, fields), "field-stats")
    profiles = materialize(field_profiles(frame, source_id, ORD, fields), "field-profiles")
    log = fields == ["line_number", "message"]
    timelines = I.detect_timeline(stats)
    if log:
        timelines = timelines.withColumn("time_key", F.lit("line_number"))
    inferred = I.infer_streams(stats, timelines)
    streams = materialize(I.suggest_mapping(inferred), "streams")
    rows = streams.orderBy("pos").collect()
    time_key = timelines.first().time_key
    mapping = spec_from_streams(rows, source_id, time_key, timeline_sort)
    mappings = spark.createDataFrame(
        [(source_id, "tabular", time_key or "", "auto", timeline_sort)],
        "source_id string, family string, primary_timeline string, timeline_unit string, timeline_sort string",
    )
    mapped = _as_mapped(streams)
    report, issues = validate(mappings, mapped, profiles)
    mapping["effective_unit"] = report.first().effective_timeline_unit
    template_id = I.pick_template(inferred).first().template_id
    signals = index_frame(frame, mapping, recording_id, source_id, ORD)
    return Imported(frame, profiles, streams, mapping, template_id, report, issues, signals)


def _as_mapped(streams: DataFrame) -> DataFrame:
    """Inferred streams with the columns that only template matching fills."""
    return streams.selectExpr(
        "*",
        "cast(null as string) expected_unit",
        "cast(null as string) source_unit",
        "cast(array() as array<string>) template_missing_fields",
        "cast(array() as array<struct<field: string, candidates: array<string>>>) match_candidates",
        "false match_ambiguous",
    )


@dataclass
class ImportedFolder:
    """What an import of many files yields, all as tables with a row or rows per ``source_id``, the path of a file."""

    recordings: DataFrame
    fields: DataFrame
    profiles: DataFrame
    streams: DataFrame
    rules: DataFrame
    report: DataFrame
    issues: DataFrame
    rejects: DataFrame
    signals: DataFrame


def import_folder(
    spark: SparkSession,
    patterns: str | list[str],
    prefix: str = "recording",
    options: dict | None = None,
    streams: DataFrame | None = None,
    timeline_sort: str = "source",
) -> ImportedFolder:
    """Import every tabular file below paths or globs as a recording of its own: ``prefix_001``, ... in path order.

    Files may differ in kind, header and fields. No step is done per file: records, fields, profiles, inferred streams,
    validation and the melt are each one job over all files, keyed by ``source_id``, and a row's place is its file and
    the line in it. ``streams`` are mapping rows to use instead of inferred ones (files without any are left empty).
    """
    records, rejects = read_records(spark, patterns, options)
    fields = materialize(record_fields(records), "record-fields")
    cells = record_cells(records, fields)
    profiles = materialize(cell_profiles(cells, fields), "field-profiles")
    stats = materialize(I.cell_stats(cells, fields), "field-stats")
    is_log = F.bool_and(F.col("field").isin(*LOG_FIELDS)) & (F.count("*") == len(LOG_FIELDS))
    logs = fields.groupBy("source_id").agg(is_log.alias("is_log"))
    timelines = I.detect_timeline(stats).join(logs, "source_id").select(
        "source_id", F.when(F.col("is_log"), F.lit(LOG_FIELDS[0])).otherwise(F.col("time_key")).alias("time_key")
    )
    timelines = materialize(timelines, "timelines")
    if streams is None:
        streams = I.suggest_mapping(I.infer_streams(stats, timelines))
    streams = materialize(streams, "streams")
    mappings = timelines.select(
        "source_id",
        F.lit("tabular").alias("family"),
        F.coalesce("time_key", F.lit("")).alias("primary_timeline"),
        F.lit("auto").alias("timeline_unit"),
        F.lit(timeline_sort).alias("timeline_sort"),
    )
    report, issues = validate(mappings, _as_mapped(streams), profiles)
    files = fields.select(F.col("source_id").alias("path")).distinct()
    named = name_recordings(files, prefix).select(F.col("path").alias("source_id"), "recording_id")
    recordings = materialize(named.join(fields.groupBy("source_id").agg(F.max("rows").alias("rows"), F.count("*").alias("fields")), "source_id"), "recordings")
    units = report.select("source_id", F.col("effective_timeline_unit").alias("unit"))
    timed = timelines.join(units, "source_id").join(recordings.select("source_id", "recording_id"), "source_id")
    rules = materialize(mapping_rules(streams, fields, timed), "rules")
    signals = melt_records(records, rules)
    return ImportedFolder(recordings, fields, profiles, streams, rules, report, issues, rejects, signals)
