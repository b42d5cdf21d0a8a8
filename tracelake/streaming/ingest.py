"""Incremental ingest of a drop folder and filters on a stream of signals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.operators.index import as_column, index_frame
from tracelake.plans.store import snapshot
from tracelake.schema import SIGNAL_SCHEMA

_CORRUPT = "_corrupt_record"


def _run(stream: DataFrame, target: str, checkpoint: str | None, partition: str | None = None):
    """Process what is new and stop. Progress lives next to the target, so a restarted run goes on where the
    last one ended and no file is taken twice."""
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint or f"{target}/_progress")
        .trigger(availableNow=True)
    )
    if partition:
        writer = writer.partitionBy(partition)
    query = writer.start()
    query.awaitTermination()
    return query


def read_drop_folder(spark: SparkSession, folder: str, fmt: str, schema, options: dict | None = None) -> DataFrame:
    """Stream of the rows of new files. JSON and CSV rows that do not fit the schema keep their text in
    ``_corrupt_record``."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    reader = spark.readStream.format(fmt)
    if fmt in ("json", "csv"):
        schema = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT)
    for name, value in (options or {}).items():
        reader = reader.option(name, value)
    return reader.schema(schema).load(folder)


def ingest_folder(
    spark: SparkSession,
    folder: str,
    fmt: str,
    schema,
    mapping: dict,
    recording_id: str | Column,
    source_id: str | Column,
    target: str,
    ord: str | Column | None = None,
    options: dict | None = None,
    rejects: str | None = None,
    partition_by: str | None = None,
):
    """Melt new files of a folder into the signals table, each file once; ``rejects`` names a folder for rows
    that could not be read.

    Files are appended unpartitioned unless ``partition_by`` names a column: every task would else write a file
    per recording it meets. :func:`tracelake.plans.sinks.compact_signals` moves them into the store in larger steps.
    """
    rows = read_drop_folder(spark, folder, fmt, schema, options)
    good = rows
    if _CORRUPT in rows.columns:
        good = rows.filter(F.col(_CORRUPT).isNull()).drop(_CORRUPT)
        if rejects:
            # what could be read of a bad row is kept next to its text
            read = F.to_json(F.struct(*[name for name in rows.columns if name != _CORRUPT])).alias("read")
            bad = rows.filter(F.col(_CORRUPT).isNotNull()).select(
                F.col("_metadata.file_path").alias("file"), F.col(_CORRUPT).alias("text"), read
            )
            _run(bad, rejects, None)
    signals = index_frame(good, mapping, as_column(recording_id), as_column(source_id), ord)
    return _run(signals, target, None, partition_by)


def read_signal_stream(spark: SparkSession, path: str) -> DataFrame:
    """Stream of the signals that land below a path; of a store, of the data files of all its commits as they come."""
    stored = snapshot(spark, path).version
    return spark.readStream.schema(SIGNAL_SCHEMA).parquet(f"{path}/data/*" if stored else path)


def filter_stream(signals: DataFrame, template: Callable[[DataFrame], DataFrame], target: str):
    """Run a stateless template or filter over a stream of signals and append what it finds."""
    return _run(template(signals), target, None)
