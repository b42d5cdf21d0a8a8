"""Recordings, sources and ingest status as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_project(signals: DataFrame, recordings: DataFrame, project_id: str) -> DataFrame:
    """Signals of the recordings of a project; how the two meet is left to the optimizer and its runtime sizes."""
    wanted = recordings.filter(F.col("project_id") == project_id).select("recording_id")
    return signals.join(wanted, "recording_id", "left_semi")


def with_sources(recordings: DataFrame, sources: DataFrame) -> DataFrame:
    """Recordings with their source attributes; a recording without a source stays."""
    return recordings.join(sources, "source_id", "left")


def unknown_recordings(requested: DataFrame, recordings: DataFrame) -> DataFrame:
    """Requested ids that no recording has."""
    return requested.select("recording_id").distinct().join(recordings, "recording_id", "left_anti")


def newest_first(catalog: DataFrame, limit: int | None = None, status: str | None = None, tie: str | None = None) -> DataFrame:
    """Catalogue rows by creation time, newest first: all of them, or the first ``limit``."""
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    rows = catalog if status is None else catalog.filter(F.col("status") == status)
    order = [F.col("created_at").desc()] + ([F.col(tie).asc()] if tie else [])
    ordered = rows.orderBy(*order)
    return ordered if limit is None else ordered.limit(int(limit))


def ingest_rollup(items: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Counts per status and the status of each batch: running, else failed, else cancelled, else succeeded."""

    def number(*names: str) -> Column:
        return F.count_if(F.col("status").isin(*names))

    counts = items.groupBy(batch).agg(
        F.count(F.lit(1)).alias("total"),
        number("succeeded").alias("succeeded"),
        number("failed").alias("failed"),
        number("cancelled").alias("cancelled"),
        number("pending", "running", "cancel_requested").alias("active"),
    )
    status = (
        F.when(F.col("active") > 0, "running")
        .when(F.col("failed") > 0, "failed")
        .when(F.col("cancelled") > 0, "cancelled")
        .otherwise("succeeded")
    )
    return counts.withColumn("status", status)


def pending_items(items: DataFrame) -> DataFrame:
    """What a resumed batch still has to do."""
    return items.filter(F.col("status") != "succeeded")


def edit_tags(tags: Column, add: list[str] | Column | None = None, remove: list[str] | Column | None = None) -> Column:
    """Tags with new ones appended once, in order, and others taken out."""

    def listed(names) -> Column:
        if isinstance(names, Column):
            return names
        return F.array(*[F.lit(name) for name in names or []]).cast("array<string>")

    added = listed(add)
    fresh = F.array_except(F.array_distinct(added), tags)
    return F.filter(F.concat(tags, fresh), lambda tag: ~F.array_contains(listed(remove), tag))


def merge_params(params: Column, new: Column) -> Column:
    """Parameters with new values put over old ones."""
    kept = F.map_filter(params, lambda key, _: ~F.map_contains_key(new, key))
    return F.map_concat(kept, new)
