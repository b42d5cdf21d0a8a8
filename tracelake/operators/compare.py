"""Comparison of recordings: numeric summaries, state histograms, raw series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.scalars import value_text
from tracelake.operators.query import filter_recordings, filter_tokens

GROUP = ["recording_id", "entity_path", "key"]


def candidates(
    signals: DataFrame, recording_ids: list[str] | None = None, metric_keys: list[str] | None = None
) -> DataFrame:
    """Scalar and state rows that take part in a comparison; scalars need a number."""
    kind = F.col("semantic_type")
    rows = filter_recordings(signals, recording_ids).filter(
        kind.isin("scalar", "scalar_group", "state") & ((kind == "state") | F.col("value_num").isNotNull())
    )
    return filter_tokens(rows, metric_keys)


def _latest():
    """Last value of a group in canonical order; a missing time sorts before all others."""
    at = F.struct(F.coalesce(F.col("time"), F.lit(float("-inf"))), F.col("ord"))
    return F.max_by(F.struct(F.col("value_num").alias("num"), value_text().alias("text")), at)


def compare_summary(
    signals: DataFrame, recording_ids: list[str] | None = None, metric_keys: list[str] | None = None
) -> DataFrame:
    """One row per (recording, path, key). Groups with numbers get count, min, max and mean of those;
    other groups get the row count. ``latest`` is the last value of the group."""
    rows = candidates(signals, recording_ids, metric_keys)
    number = F.col("value_num")
    grouped = rows.groupBy(*GROUP).agg(
        F.count(number).alias("_numbers"),
        F.count(F.lit(1)).alias("_rows"),
        F.min(number).alias("min"),
        F.max(number).alias("max"),
        F.avg(number).alias("mean"),
        _latest().alias("_latest"),
    )
    numeric = F.col("_numbers") > 0
    return grouped.select(
        *GROUP,
        F.when(numeric, "numeric").otherwise("state").alias("kind"),
        F.when(numeric, F.col("_numbers")).otherwise(F.col("_rows")).alias("count"),
        "min",
        "max",
        "mean",
        F.col("_latest.num").alias("latest_num"),
        F.col("_latest.text").alias("latest"),
    )


def compare_states(
    signals: DataFrame, recording_ids: list[str] | None = None, metric_keys: list[str] | None = None
) -> DataFrame:
    """Histogram of the groups without numbers: one row per (group, state). Counts are combined before
    the shuffle, so a group of any size costs one row per state and task."""
    rows = candidates(signals, recording_ids, metric_keys)
    per_state = rows.groupBy(*GROUP, value_text().alias("state")).agg(
        F.count(F.lit(1)).alias("n"), F.count("value_num").alias("_numbers")
    )
    with_numbers = per_state.filter(F.col("_numbers") > 0).select(*GROUP).distinct()
    return per_state.join(with_numbers, GROUP, "left_anti").drop("_numbers")


def compare_series(
    signals: DataFrame, recording_ids: list[str] | None = None, metric_keys: list[str] | None = None
) -> DataFrame:
    """The candidate rows themselves."""
    return candidates(signals, recording_ids, metric_keys)


def compare(
    signals: DataFrame,
    recording_ids: list[str] | None = None,
    metric_keys: list[str] | None = None,
    mode: str = "summary",
) -> DataFrame:
    modes = {"summary": compare_summary, "states": compare_states, "series": compare_series}
    if mode not in modes:
        raise ValueError(f"Unsupported compare mode: {mode}")
    return modes[mode](signals, recording_ids, metric_keys)
