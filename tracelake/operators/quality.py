"""Time series and value checks per signal, safe for signals of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.scalars import float_or_none, value_text
from tracelake.operators.ordered import (
    join_to_groups,
    lower_hinge_ranks,
    median_ranks,
    order_statistics,
    upper_hinge_ranks,
    with_previous,
)
from tracelake.session import materialize

PATH = ["recording_id", "source_id", "entity_path"]
SIGNAL = [*PATH, "key"]


def measured(signals: DataFrame) -> DataFrame:
    """The rows quality checks read."""
    return signals.filter(F.col("semantic_type").isin("scalar", "scalar_group", "state"))


def counted(rows: DataFrame) -> DataFrame:
    """Distinct times per path (``kind`` time, no key) and distinct numbers per signal (``kind`` number), each with how
    many rows have it (``n``): one scan and one aggregation, combined before the shuffle. All that follows reads it."""
    number, time = float_or_none(), F.col("time")
    entry = lambda kind, key, value: F.struct(F.lit(kind).alias("kind"), key.alias("key"), value.alias("value"))
    entries = F.array(
        F.when(time.isNotNull(), entry("time", F.lit(None).cast("string"), time)),
        F.when(number.isNotNull(), entry("number", F.col("key"), number)),
    )
    told = rows.select(*PATH, F.explode(F.array_compact(entries)).alias("_e")).select(*PATH, "_e.*")
    return told.groupBy("kind", *SIGNAL, "value").agg(F.count(F.lit(1)).alias("n"))


def _of(counts: DataFrame, kind: str) -> DataFrame:
    return counts.filter(F.col("kind") == kind)


def repeated_times(counts: DataFrame) -> DataFrame:
    """Paths of at least 3 timed rows where times repeat."""
    return (
        _of(counts, "time")
        .groupBy(*PATH)
        .agg(F.sum("n").alias("sample_count"), (F.sum("n") - F.count(F.lit(1))).alias("duplicate_count"))
        .filter((F.col("sample_count") >= 3) & (F.col("duplicate_count") > 0))
    )


def duplicate_timestamps(rows: DataFrame) -> DataFrame:
    """Paths of at least 3 timed rows where times repeat."""
    return repeated_times(counted(rows))


def gap_counts(counts: DataFrame, chunks: int | None = None) -> DataFrame:
    """The distinct positive gaps between neighbouring times of each path, with how often each occurs."""
    times = with_previous(_of(counts, "time"), PATH, ["value"], "value", "_before", chunks)
    gaps = times.select(*PATH, (F.col("value") - F.col("_before")).alias("value")).filter(F.col("value") > 0)
    return gaps.groupBy(*PATH, "value").agg(F.count(F.lit(1)).alias("n"))


_GAP_RANKS = {"typical_gap_s": median_ranks, "max_gap_s": lambda size: [size]}
_HINGE_RANKS = {"q1": lower_hinge_ranks, "q3": upper_hinge_ranks}


def gap_statistics(rows: DataFrame, chunks: int | None = None) -> DataFrame:
    """Exact median and largest of the positive gaps of each path that has at least 3 of them."""
    found = order_statistics(gap_counts(counted(rows), chunks), PATH, "value", "n", _GAP_RANKS, chunks)
    return found.filter(F.col("n") >= 3).withColumnRenamed("n", "gap_count")


def _large(gaps: DataFrame, factor: float) -> DataFrame:
    return gaps.filter((F.col("typical_gap_s") > 0) & (F.col("max_gap_s") >= F.col("typical_gap_s") * F.lit(float(factor))))


def large_gaps(rows: DataFrame, factor: float = 5.0, chunks: int | None = None) -> DataFrame:
    """Paths whose largest gap is at least ``factor`` times the median gap."""
    return _large(gap_statistics(rows, chunks), factor)


def equal_numbers(counts: DataFrame) -> DataFrame:
    """Signals of at least 3 numbers that are all the same."""
    return (
        _of(counts, "number")
        .groupBy(*SIGNAL)
        .agg(F.sum("n").alias("sample_count"), F.min("value").alias("value"), F.max("value").alias("_max"))
        .filter((F.col("sample_count") >= 3) & (F.col("value") == F.col("_max")))
        .drop("_max")
    )


def constant_numeric(rows: DataFrame) -> DataFrame:
    """Signals of at least 3 numbers that are all the same: two extremes and a count, no distinct values."""
    return (
        rows.withColumn("number", float_or_none())
        .groupBy(*SIGNAL)
        .agg(F.count("number").alias("sample_count"), F.min("number").alias("value"), F.max("number").alias("_max"))
        .filter((F.col("sample_count") >= 3) & (F.col("value") == F.col("_max")))
        .drop("_max")
    )


def hinges(rows: DataFrame, chunks: int | None = None) -> DataFrame:
    """Medians of the lower and the upper half of each signal's numbers, the middle one left out."""
    numbers = _of(counted(rows.withColumn("time", F.lit(None).cast("double"))), "number")
    return order_statistics(numbers, SIGNAL, "value", "n", _HINGE_RANKS, chunks).withColumnRenamed("n", "sample_count")


def _outside(counts: DataFrame, hinged: DataFrame, multiplier: float, chunks: int | None) -> DataFrame:
    spread = F.col("q3") - F.col("q1")
    bounds = (
        hinged.filter((F.col("sample_count") >= 4) & (spread > 0))
        .withColumn("lower_bound", F.col("q1") - F.lit(float(multiplier)) * spread)
        .withColumn("upper_bound", F.col("q3") + F.lit(float(multiplier)) * spread)
    )
    outside = (F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))
    return (
        join_to_groups(_of(counts, "number").drop("kind"), bounds, SIGNAL, "value", chunks)
        .filter(outside)
        .groupBy(*SIGNAL, "sample_count", "q1", "q3", "lower_bound", "upper_bound")
        .agg(F.sum("n").alias("outlier_count"))
    )


def iqr_outliers(rows: DataFrame, multiplier: float = 1.5, chunks: int | None = None) -> DataFrame:
    """Signals with numbers outside ``q1 - m*iqr .. q3 + m*iqr``; needs 4 numbers and a positive iqr."""
    counts = materialize(counted(rows.withColumn("time", F.lit(None).cast("double"))), "counts")
    found = order_statistics(_of(counts, "number"), SIGNAL, "value", "n", _HINGE_RANKS, chunks)
    return _outside(counts, found.withColumnRenamed("n", "sample_count"), multiplier, chunks)


def gaps_and_outliers(
    counts: DataFrame, factor: float, multiplier: float, chunks: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(large gaps, outliers) from one table of counts, which should be written: gaps between times and numbers of
    signals go through one pass of order statistics together."""
    none = F.lit(None).cast("string")
    gaps = gap_counts(counts, chunks).select(F.lit("gap").alias("kind"), *PATH, none.alias("key"), "value", "n")
    both = gaps.unionByName(_of(counts, "number"))
    found = order_statistics(both, ["kind", *SIGNAL], "value", "n", _GAP_RANKS | _HINGE_RANKS, chunks)
    found = materialize(found, "order-statistics")
    held = _of(found, "gap").filter(F.col("n") >= 3).withColumnRenamed("n", "gap_count")
    hinged = _of(found, "number").withColumnRenamed("n", "sample_count").select(*SIGNAL, "sample_count", "q1", "q3")
    return _large(held, factor), _outside(counts, hinged, multiplier, chunks)


def constant_state(rows: DataFrame) -> DataFrame:
    """State signals of at least 3 texts that never change."""
    text = F.when((F.col("semantic_type") == "state") & float_or_none().isNull(), value_text())
    return (
        rows.withColumn("text", text)
        .groupBy(*SIGNAL)
        .agg(F.count("text").alias("sample_count"), F.min("text").alias("value"), F.max("text").alias("_max"))
        .filter((F.col("sample_count") >= 3) & (F.col("value") == F.col("_max")))
        .drop("_max")
    )
