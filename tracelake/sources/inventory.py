"""Checksums of files and folders, and what changed since they were stored."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# a file above this is digested in blocks instead of as one cell
WHOLE_FILE_BYTES = 256 * 1024 * 1024
_BLOCK_BYTES = 8 * 1024 * 1024


def _digest_in_blocks(batches):
    """Digest files block by block; one task works on some files and holds one block at a time."""
    from pyarrow import fs

    for batch in batches:
        digests = []
        for uri in batch["path"]:
            store, name = fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))
            digest = hashlib.sha256()
            with store.open_input_stream(name) as stream:
                while block := stream.read(_BLOCK_BYTES):
                    digest.update(block)
            digests.append(digest.hexdigest())
        yield batch.assign(checksum=digests)


def file_inventory(spark: SparkSession, path: str | list[str], whole_file_bytes: int = WHOLE_FILE_BYTES) -> DataFrame:
    """``(path, size, checksum)`` with the SHA-256 of every file below the path."""

    def files() -> DataFrame:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)

    small = files().filter(F.col("length") <= whole_file_bytes).select(
        "path", F.col("length").alias("size"), F.sha2("content", 256).alias("checksum")
    )
    large = files().filter(F.col("length") > whole_file_bytes).select("path", F.col("length").alias("size"))
    spread = large.repartition("path")
    return small.unionByName(spread.mapInPandas(_digest_in_blocks, "path string, size bigint, checksum string"))


def folder_digest(files: DataFrame, root: str = "root", relative: str = "relative_path") -> DataFrame:
    """One digest per folder over its relative paths and checksums, in path order.

    Files are digested in 4096 groups by path hash, then the groups: no task sees a whole large folder.
    """
    entry = F.concat_ws(":", F.col(relative), F.col("checksum"))
    bucket = F.substring(F.sha2(F.col(relative), 256), 1, 3)
    grouped = files.groupBy(F.col(root), bucket.alias("_bucket")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "\n"), 256).alias("_digest"),
        F.count(F.lit(1)).alias("_files"),
        F.sum("size").alias("_size"),
    )
    parts = F.array_sort(F.collect_list(F.concat_ws(":", "_bucket", "_digest")))
    return grouped.groupBy(F.col(root)).agg(
        F.sha2(F.array_join(parts, "\n"), 256).alias("checksum"),
        F.sum("_files").alias("files"),
        F.sum("_size").alias("size"),
    )


def change_status(stored: Column, fresh: Column) -> Column:
    return (
        F.when(fresh.isNull(), "source_unavailable")
        .when(stored.isNull(), "source_added")
        .when(stored != fresh, "source_changed")
        .otherwise("unchanged")
    )


def inventory_changes(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored manifest against a fresh one, both ``(path, checksum)``."""
    left = stored.select("path", F.col("checksum").alias("stored_checksum"))
    right = fresh.select("path", F.col("checksum").alias("fresh_checksum"))
    return left.join(right, "path", "full_outer").withColumn(
        "status", change_status(F.col("stored_checksum"), F.col("fresh_checksum"))
    )
