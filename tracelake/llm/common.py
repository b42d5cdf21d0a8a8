"""Helpers shared by the corpus operators: the shared folder, written intermediates, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one that the cluster names in ``spark.checkpoint.dir``.

    Only a session of one machine (master ``local``), as in tests, may name none; it then gets a temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: several readers then share one computation, and a lost
    executor costs no recomputation of what came before."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def inner_names(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that clash with no column of the table, whatever it is called there."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shingles_of(text: Column, words: int) -> Column:
    """Hashes of all runs of ``words`` words of a text, ASCII letters without case; of all of it if it has fewer."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # a let: the words are cut once
    known = F.array(F.transform(F.filter(F.split(lower, "[ \\t-\\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w)))
    places = lambda own: F.sequence(F.lit(1), F.greatest(F.size(own) - (words - 1), F.lit(1)))
    # words are named, not sliced; there are nulls behind the last one, and they add nothing
    run = lambda own, i: F.xxhash64(*(F.get(own, i + (k - 1)) for k in range(words)))
    return F.flatten(F.transform(known, lambda own: F.transform(places(own), lambda i: run(own, i))))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``(node, root)`` of all nodes in ``edges (a, b)``; ``root`` is the smallest node of the component.

    Alternates two contractions until nothing changes: every node hands its larger neighbours to the smallest one
    (large star), then its smaller neighbours (small star). Each is one grouped minimum, combined before the shuffle,
    and one join that can be split on a hot node. Every round is written to the shared folder, so its plan does not
    grow; the number of rounds is logarithmic in the size of a component. Raises if ``rounds`` do not suffice.
    """
    spark = edges.sparkSession

    def star(frame: DataFrame, larger: bool) -> DataFrame:
        both = frame.select("a", "b")
        if larger:
            both = both.union(frame.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        if larger:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        kept = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return kept.union(least.where("a != m").select("a", F.col("m").alias("b"))).distinct()

    def mark(frame: DataFrame):
        sums = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        return tuple(frame.agg(F.count("*"), sums).first())

    current = written(edges.where("a != b").select("a", "b").distinct(), "edges")
    before = mark(current)
    for _ in range(rounds):
        if before[0] == 0:
            break
        # the stars hold a node with its smaller partner; every edge is kept as (larger, smaller)
        current = written(star(star(current, True), False), "edges")
        after = mark(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots).distinct()


def meet(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, how: str = "inner", share: int = 10_000) -> DataFrame:
    """``rows`` joined with ``table``, one row of which belongs to each key, however many rows share a key.

    ``table[weight]`` counts the rows of a key. Keys that hold one in ``share`` of all counted rows or more are met by
    broadcast: there can be no more than ``share`` of them. What is left is shuffled, and no key of it is large. ``how``
    is inner or left. Both tables are read more than once: hand in written ones. Null keys meet nothing.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) * share >= total
    hot = F.broadcast(table.where(heavy))
    cold = rows.join(F.broadcast(table.where(heavy).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(cold.join(table.where(~heavy), keys, how))
