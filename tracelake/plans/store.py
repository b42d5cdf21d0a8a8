"""A store of rows by recording: data files, and a log of commits that tells which of them count.

A commit writes new data files, then one row per (file, recording) with counts and time ranges, and last a marker with the
next number. Markers are created and never overwritten: a commit is there as a whole or not at all, of two writers with
one number the second fails, and a reader keeps the version it began with. Replacing a recording writes its new rows and
nothing else: a (file, recording) pair counts if no later commit replaces the recording. Landed files that a commit has
taken in stand in the same commit, so they are taken once, however often the call is made or broken off.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTENTS = "n bigint, replaces boolean, file string, recording_id string, rows bigint, time_low double, time_high double"
TAKEN = "path string, size bigint, modified timestamp"
# landed rows are taken in parts of about so many rows, up to so many parts, each with all rows of its recordings
PART_ROWS, MOST_PARTS = 8_000_000, 16
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Conflict(RuntimeError):
    """Another writer has made the commit that this one was to be."""


@dataclass
class Snapshot:
    """The commits of a store up to one version."""

    spark: SparkSession
    path: str
    commits: dict[int, str] = field(default_factory=dict)

    @property
    def version(self) -> int:
        return max(self.commits, default=0)

    def _log(self, part: str, schema: str) -> DataFrame:
        folders = [f"{self.path}/log/{commit}/{part}" for commit in self.commits.values()]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def contents(self) -> DataFrame:
        """``(n, replaces, file, recording_id, rows, time_low, time_high, live)`` of every commit; ``live`` tells whether
        the rows of the recording in the file still count."""
        told = self._log("contents", CONTENTS)
        since = told.filter("replaces").groupBy(F.col("recording_id").alias("_id")).agg(F.max("n").alias("_since"))
        joined = told.join(since, F.col("recording_id").eqNullSafe(F.col("_id")), "left")
        return joined.withColumn("live", F.col("n") >= F.coalesce("_since", F.lit(0))).drop("_id", "_since")

    def taken(self) -> DataFrame:
        """Landed files that commits have taken in."""
        return self._log("taken", TAKEN)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """The store as of a version, by default the latest; an empty one where nothing is stored yet."""
    files, markers = _file_system(spark, f"{path}/commits")
    if not files.exists(markers):
        return Snapshot(spark, path)
    rows = spark.read.text(f"{path}/commits").select(F.substring_index("_metadata.file_name", ".", 1).cast("int"), "value").collect()
    return Snapshot(spark, path, {n: commit for n, commit in sorted(rows) if version is None or n <= version})


def _commit(seen: Snapshot, commit: str) -> int:
    number = seen.version + 1
    files, marker = _file_system(seen.spark, f"{seen.path}/commits/{number:09d}.txt")
    if files.exists(marker):
        raise Conflict(f"version {number} of {seen.path} is there already")
    try:
        out = files.create(marker, False)
    except Exception as error:
        if files.exists(marker):
            raise Conflict(f"version {number} of {seen.path} was made meanwhile") from error
        raise
    out.write(bytearray(commit.encode()))
    out.close()
    return number


def _file_name() -> Column:
    """Folder of the commit and name of the file that a row was read from."""
    return F.substring_index("_metadata.file_path", "/", -2)


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Shuffle files of every query that begins here go when it ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def append(
    rows: DataFrame, seen: Snapshot, order: list[str], replaces: bool = False, taken: DataFrame | None = None, time: str = "time"
) -> int:
    """Write rows as the commit after ``seen`` and return its number. With ``replaces``, earlier rows of the recordings
    among them no longer count. Raises :class:`Conflict`, and changes nothing, if another commit came first.

    Files are ranged and sorted by ``order``, so a large recording is written by many tasks and scans skip row groups.
    What the log holds of a file is read from it after it was written: two columns, grouped where they stand.
    """
    return _append_parts([lambda: (rows, replaces)], seen, order, taken, time)


def _append_parts(
    parts: list[Callable[[], tuple[DataFrame, bool]]], seen: Snapshot, order: list[str], taken: DataFrame | None = None, time: str = "time"
) -> int:
    """One commit of several parts, ``(rows, replaces)`` with recordings of their own, written one after the other: what
    a part needs of disk to be sorted is free again before the next one begins."""
    spark, commit = seen.spark, uuid.uuid4().hex
    with _shuffles_removed(spark):
        for number, part in enumerate(parts):
            rows, replaces = part()
            folder = f"{seen.path}/data/{commit}" + (f"-{number}" if len(parts) > 1 else "")
            rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", "zstd").parquet(folder)
            clock = F.col(time) if time in rows.columns else F.lit(None).cast("double")
            written = spark.read.schema(rows.schema).parquet(folder).select(_file_name().alias("file"), "recording_id", clock.alias("_t"))
            told = written.groupBy("file", "recording_id").agg(
                F.count("*").alias("rows"), F.min("_t").alias("time_low"), F.max("_t").alias("time_high")
            )
            told = told.select(
                F.lit(seen.version + 1).cast("long").alias("n"), F.lit(replaces).alias("replaces"), "file", "recording_id", "rows", "time_low", "time_high"
            )
            told.write.mode("append").parquet(f"{seen.path}/log/{commit}/contents")
        if taken is None:
            taken = spark.createDataFrame([], TAKEN)
        taken.write.parquet(f"{seen.path}/log/{commit}/taken")
    return _commit(seen, commit)


def read(
    seen: Snapshot,
    schema: T.StructType,
    recordings: list[str] | DataFrame | None = None,
    times: tuple[float | None, float | None] | None = None,
) -> DataFrame:
    """Rows of a snapshot. ``recordings`` (ids, or a table with ``recording_id``) and ``times`` (closed range) leave out
    whole files by the log, then row groups, then rows."""
    spark = seen.spark
    told = seen.contents()
    if isinstance(recordings, DataFrame):
        wanted = recordings.select(F.col("recording_id").alias("_id")).distinct()
        told = told.join(wanted, F.col("recording_id").eqNullSafe(F.col("_id")), "left_semi")
    elif recordings is not None:
        told = told.filter(F.col("recording_id").isin(*recordings))
    low, high = times or (None, None)
    meets = F.col("live")
    if low is not None:
        meets &= F.col("time_high") >= low
    if high is not None:
        meets &= F.col("time_low") <= high
    files = told.groupBy("file").agg(F.coalesce(F.max(meets), F.lit(False)).alias("meets"), F.max(~F.col("live")).alias("partly"))
    files = files.filter("meets").collect()
    out = None
    for partly in (False, True):
        paths = sorted(f"{seen.path}/data/{row.file}" for row in files if row.partly == partly)
        if not paths:
            continue
        rows = spark.read.schema(schema).parquet(*paths)
        if partly:
            dead = told.filter(~F.col("live")).select(F.col("file").alias("_file"), F.col("recording_id").alias("_id"))
            here = rows.withColumn("_from", _file_name())
            same = (F.col("_from") == F.col("_file")) & F.col("recording_id").eqNullSafe(F.col("_id"))
            rows = here.join(dead, same, "left_anti").drop("_from")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], schema)
    if isinstance(recordings, DataFrame):
        out = out.join(wanted, F.col("recording_id").eqNullSafe(F.col("_id")), "left_semi")
    elif recordings is not None:
        out = out.filter(F.col("recording_id").isin(*recordings))
    if low is not None:
        out = out.filter(F.col("time") >= low)
    if high is not None:
        out = out.filter(F.col("time") <= high)
    return out


def landed_files(spark: SparkSession, landed: str) -> DataFrame:
    """Parquet files below a folder, told by their listing; a streaming sink's own log decides which files count."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(landed)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def take_landed(spark: SparkSession, landed: str, path: str, schema: T.StructType, order: list[str], identity: list[str]) -> int | None:
    """Take files that have landed since the last call into the store; the number of the commit, None if there are none.

    Only files that no commit has taken are opened, and of the store only the recordings that they touch. Rows that the
    store has already, by ``identity``, are replaced; else the new rows are just added. Many rows are taken in parts by
    the hash of their recording, so that a part of them is shuffled at a time; it is one commit all the same.
    """
    with _shuffles_removed(spark):
        return _take_landed(spark, landed, path, schema, order, identity)


def _take_landed(spark: SparkSession, landed: str, path: str, schema: T.StructType, order: list[str], identity: list[str]) -> int | None:
    seen = snapshot(spark, path)
    fresh = landed_files(spark, landed).join(seen.taken(), ["path", "size", "modified"], "left_anti").collect()
    if not fresh:
        return None
    rows = spark.read.schema(schema).parquet(*[row.path for row in fresh])
    taken = spark.createDataFrame(fresh, TAKEN)
    touched = rows.select("recording_id").distinct()
    mine = F.col("recording_id").eqNullSafe(F.col("_id"))
    told = seen.contents().filter("live").join(touched.withColumnRenamed("recording_id", "_id"), mine, "left_semi")
    held = told.agg(F.sum("rows")).first()[0] or 0
    # powers of two: a part meets stored files of few other parts
    count = min(MOST_PARTS, 2 ** max(0, math.ceil(math.log2(max(1, rows.count() + held) / PART_ROWS))))

    def part(number: int) -> tuple[DataFrame, bool]:
        new = rows if count == 1 else rows.filter(F.pmod(F.xxhash64("recording_id"), F.lit(count)) == number)
        if not held:
            return new, False
        stored = read(seen, schema, new.select("recording_id"))
        keys = new.select(*[F.col(name).alias(f"_n_{name}") for name in identity])
        same = [F.col(name).eqNullSafe(F.col(f"_n_{name}")) for name in identity]
        if stored.join(keys, same, "left_semi").isEmpty():
            return new, False
        return stored.join(keys, same, "left_anti").unionByName(new), True

    return _append_parts([partial(part, number) for number in range(count)], seen, order, taken)


def rewrite(seen: Snapshot, schema: T.StructType, order: list[str], files_per_recording: int = 4) -> int | None:
    """Write recordings anew that stand in more than so many files, or beside rows that no longer count."""
    told = seen.contents()
    marked = told.groupBy("file").agg(F.max(~F.col("live")).alias("_partly"))
    live = told.filter("live").join(marked, "file")
    worn = live.groupBy("recording_id").agg(F.count("*").alias("_files"), F.max("_partly").alias("_partly"))
    worn = worn.filter((F.col("_files") > files_per_recording) | F.col("_partly")).select("recording_id")
    if worn.isEmpty():
        return None
    return append(read(seen, schema, worn), seen, order, True)


def expire(seen: Snapshot) -> int:
    """Delete data files in which nothing counts as of ``seen``; older versions can no longer be read. Returns how many."""
    dead = seen.contents().groupBy("file").agg(F.max("live").alias("live")).filter(~F.col("live")).collect()
    for row in dead:
        files, place = _file_system(seen.spark, f"{seen.path}/data/{row.file}")
        files.delete(place, False)
    return len(dead)
