"""Contiguous shards of equal bytes from global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import inner_names, written


def text_size(text) -> F.Column:
    """UTF-8 bytes plus one; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def assign(
    rows: DataFrame, size: str, order: list[str], group: list[str], shards: int = 8, slack: float = 0.05
) -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    Rows are put in one global order (``order``; equal rows in the order they were read) by a range shuffle. Each
    partition adds up its own sizes and counts; the totals, one row for each partition, give every partition its
    start, and so every row its global offset. Shard i ends at the row whose middle passes ``total * (i + 1) /
    shards``. ``group`` names leading order columns whose equal values should stay together: a cut inside such a group
    moves to the group's nearer end if the group is at most ``slack`` of a shard; larger groups are cut where the
    target falls, so shards stay near equal. Sizes must be positive. Null order values sort first; an empty table gives
    an empty result; fewer rows than shards leave shards empty. Columns named shard and slot are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    rows = rows.drop("shard", "slot")
    place, part, end, number = inner_names(rows, "place", "part", "end", "number")
    keys = [F.col(c).asc_nulls_first() for c in order]
    ranged = rows.withColumn(place, F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(*keys, F.col(place)).sortWithinPartitions(*keys, F.col(place)).drop(place)
    schema = T.StructType([*ranged.schema.fields, T.StructField(end, T.LongType()), T.StructField(number, T.LongType())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_so_far, rows_so_far = 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.cumsum(pc.cast(batch.column(batch.schema.get_field_index(size)), pa.int64()).to_numpy())
            ends = sizes + bytes_so_far
            numbers = np.arange(rows_so_far, rows_so_far + batch.num_rows)
            bytes_so_far, rows_so_far = int(ends[-1]), rows_so_far + batch.num_rows
            arrays = [*batch.columns, pa.array(ends, pa.int64()), pa.array(numbers, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, end, number])

    summed = written(ranged.mapInArrow(sums, schema).withColumn(part, F.spark_partition_id()), "prefix")
    # one row for each partition
    totals = sorted(tuple(r) for r in summed.groupBy(part).agg(F.max(end), F.max(number)).collect())
    starts, total, count = [], 0, 0
    for key, most, last in totals:
        starts.append((key, total, count))
        total, count = total + most, count + last + 1
    spark = rows.sparkSession
    base, first = inner_names(summed, "base", "first")
    bases = spark.createDataFrame(starts, f"`{part}` int, `{base}` long, `{first}` long")
    placed = summed.join(F.broadcast(bases), part)
    placed = placed.withColumns({end: F.col(end) + F.col(base), number: F.col(number) + F.col(first)}).drop(base, first, part)
    cuts = _cuts(placed, size, end, group, total, shards, slack)
    middle = F.col(end) * 2 - F.col(size)
    shard = sum((F.when(middle > 2 * cut, 1).otherwise(0) for cut in cuts), F.lit(0)).cast("int")
    placed = placed.withColumn("shard", shard)
    heads = {r[0]: r[1] for r in placed.groupBy("shard").agg(F.min(number)).collect()}  # at most `shards` rows
    if not heads:
        return placed.withColumn("slot", F.col(number)).drop(end, number)
    head = F.element_at(F.create_map(*[F.lit(x) for pair in heads.items() for x in pair]), F.col("shard"))
    return placed.withColumn("slot", (F.col(number) - head).cast("long")).drop(end, number)


def _cuts(placed: DataFrame, size: str, end: str, group: list[str], total: int, shards: int, slack: float) -> list[int]:
    """Offsets where shards end: the targets, moved to the end of a small group that they fall into."""
    targets = [total * i // shards for i in range(1, shards)]
    if not group or not targets or not total:
        return targets
    inside = F.lit(False)
    for t in targets:
        inside = inside | ((F.col(end) >= t) & (F.col(end) - F.col(size) < t))
    # at most one row for each target
    hit = placed.where(inside).select(*group).distinct()
    names = inner_names(placed, *[f"g{i}" for i in range(len(group))])
    hit = F.broadcast(hit.select(*[F.col(g).alias(n) for g, n in zip(group, names)]))
    same = F.lit(True)
    for g, n in zip(group, names):
        same = same & placed[g].eqNullSafe(hit[n])
    spans = placed.join(hit, same).groupBy(*names).agg(F.min(placed[end] - placed[size]), F.max(placed[end])).collect()
    out = []
    for t in targets:
        low, high = next(((r[-2], r[-1]) for r in spans if r[-2] < t <= r[-1]), (t, t))
        if high - low <= slack * total / shards:
            t = low if t - low <= high - t else high
        out.append(t)
    return out


def write(assigned: DataFrame, path: str) -> None:
    """Shards as Parquet folders ``shard=0`` and so on, rows in slot order inside the files."""
    assigned.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
