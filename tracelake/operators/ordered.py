"""Ordered work on groups of any size: next and previous row, running totals, exact order statistics.

A plain window sends each group to one task. Here the rows are first ranged by ``group columns, order columns`` and
written to the shared folder with the number of their range as the chunk, so that one group may span many chunks, every
later reader and every retried task sees the same chunks, and the input is read once. Windows run inside (group, chunk);
what crosses chunk borders is settled on one row per (group, chunk). There is one way for inputs of every size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.session import materialize

# tasks a hot group is spread over when per-group values are joined to its rows
SALTS = 16

_CHUNK = "_chunk"


def with_chunks(df: DataFrame, keys: list[str], chunks: int | None = None) -> DataFrame:
    """The rows, written once, with the chunk each is in; chunks follow the order of ``keys`` (nulls first).

    ``chunks`` asks for so many; by default there are as many as shuffle partitions, joined where they are small.
    """
    order = [F.col(name).asc_nulls_first() for name in keys]
    ranged = df.repartitionByRange(chunks, *order) if chunks else df.repartitionByRange(*order)
    return materialize(ranged.withColumn(_CHUNK, F.spark_partition_id()), "chunks")


def _join_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be null; the right side brings its other columns."""
    renamed = right
    for name in keys:
        renamed = renamed.withColumnRenamed(name, f"_r_{name}")
    condition = [left[name].eqNullSafe(renamed[f"_r_{name}"]) for name in keys]
    return left.join(renamed, condition, "left").drop(*[f"_r_{name}" for name in keys])


def _neighbour(
    df: DataFrame,
    group: list[str],
    order: list[str],
    value: str,
    name: str,
    chunks: int | None,
    forward: bool,
) -> DataFrame:
    shift = F.lead if forward else F.lag
    chunked = with_chunks(df, group + order, chunks)
    keys = group + [_CHUNK]
    local = chunked.withColumn(name, shift(value).over(W.partitionBy(*keys).orderBy(*order)))
    best = F.min if forward else F.max
    if value == order[0]:
        # the first row of a chunk has its least value: a hash aggregate finds it
        edges = chunked.groupBy(*keys).agg(best(value).alias("_edge"))
    else:
        place = F.struct(*order, F.col(value).alias("_value"))
        edges = chunked.groupBy(*keys).agg(best(place)["_value"].alias("_edge"))
    across = shift("_edge").over(W.partitionBy(*group).orderBy(_CHUNK))
    borders = edges.select(*keys, across.alias("_across"))
    joined = _join_on(local, borders, keys)
    return joined.withColumn(name, F.coalesce(name, "_across")).drop("_across", _CHUNK)


def with_next(
    df: DataFrame, group: list[str], order: list[str], value: str, name: str, chunks: int | None = None
) -> DataFrame:
    """Add ``name``: the (never null) ``value`` of the following row of the group, null on the last."""
    return _neighbour(df, group, order, value, name, chunks, forward=True)


def with_previous(
    df: DataFrame, group: list[str], order: list[str], value: str, name: str, chunks: int | None = None
) -> DataFrame:
    """Add ``name``: the (never null) ``value`` of the preceding row of the group, null on the first."""
    return _neighbour(df, group, order, value, name, chunks, forward=False)


def with_rank(
    df: DataFrame, group: list[str], order: list[str], name: str, chunks: int | None = None
) -> DataFrame:
    """Add ``name``: the position of the row in its group, counted from 1."""
    chunked = with_chunks(df, group + order, chunks)
    keys = group + [_CHUNK]
    local = chunked.withColumn(
        name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint")
    )
    joined = _join_on(local, _offsets(chunked, group, F.count(F.lit(1))), keys)
    return joined.withColumn(name, F.col(name) + F.col("_before")).drop("_before", "_size", "_total", _CHUNK)


def _offsets(chunked: DataFrame, group: list[str], size: Column) -> DataFrame:
    """Per (group, chunk): its rows, those in earlier chunks of the group, and those of the whole group."""
    keys = group + [_CHUNK]
    sizes = chunked.groupBy(*keys).agg(size.alias("_size"))
    by_chunk = W.partitionBy(*group).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1)
    return sizes.select(
        *keys,
        "_size",
        F.coalesce(F.sum("_size").over(by_chunk), F.lit(0)).alias("_before"),
        F.sum("_size").over(W.partitionBy(*group)).alias("_total"),
    )


def order_statistics(
    counted: DataFrame,
    group: list[str],
    value: str,
    weight: str,
    wanted: dict[str, Callable[[Column], list[Column]]],
    chunks: int | None = None,
) -> DataFrame:
    """Exact order statistics per group from distinct values and their counts.

    ``wanted`` maps a result name to a function from the group size to ranks (from 1); the result is the
    mean of the values at those ranks. Only the chunks that hold a wanted rank are sorted.
    """

    def picks(size: Column) -> Column:
        return F.array(
            *[
                F.struct(F.lit(name).alias("tag"), rank.cast("bigint").alias("rank"))
                for name, ranks in wanted.items()
                for rank in ranks(size)
            ]
        )

    chunked = with_chunks(counted, group + [value], chunks)
    keys = group + [_CHUNK]
    sizes = _offsets(chunked, group, F.sum(weight))
    targets = (
        sizes.select("*", F.explode(picks(F.col("_total"))).alias("_pick"))
        .filter((F.col("_pick.rank") > F.col("_before")) & (F.col("_pick.rank") <= F.col("_before") + F.col("_size")))
        .groupBy(*keys, "_before", "_total")
        .agg(F.collect_list("_pick").alias("_picks"))
    )
    rows = _join_on(chunked, targets, keys).filter(F.col("_picks").isNotNull())
    running = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_upto", F.sum(weight).over(running) + F.col("_before"))
    hit = F.filter(
        "_picks",
        lambda pick: (pick["rank"] <= F.col("_upto")) & (pick["rank"] > F.col("_upto") - F.col(weight)),
    )
    found = rows.select(*group, F.col(value).alias("_value"), "_total", F.explode(hit).alias("_pick"))
    means = [F.avg(F.when(F.col("_pick.tag") == name, F.col("_value"))).alias(name) for name in wanted]
    return found.groupBy(*group).agg(F.max("_total").alias("n"), *means)


def join_to_groups(
    rows: DataFrame, groups: DataFrame, keys: list[str], spread: str, salts: int | None = None
) -> DataFrame:
    """Join one row per group to the many rows of each group.

    The rows of a group are spread over ``salts`` tasks by their ``spread`` column and the group row is repeated
    for each, so a hot group does not meet in one task.
    """
    count = salts or SALTS
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(count)).cast("int"))
    repeated = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return salted.join(repeated, [*keys, "_salt"]).drop("_salt")


def median_ranks(size: Column) -> list[Column]:
    return [F.floor((size + 1) / 2), F.floor(size / 2) + 1]


def lower_hinge_ranks(size: Column) -> list[Column]:
    """Ranks whose mean is the median of the lower half, the middle value left out."""
    return median_ranks(F.floor(size / 2))


def upper_hinge_ranks(size: Column) -> list[Column]:
    shift = F.floor((size + 1) / 2)
    return [rank + shift for rank in median_ranks(F.floor(size / 2))]
