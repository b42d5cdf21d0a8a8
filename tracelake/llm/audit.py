"""Interaction of filters, audited by survival words.

A row that fails some of five filters survives every subset of them that holds none of those. Its truth table over the
32 subsets is a word of 32 bits, and how many rows each subset would leave is a count of set bits by position. Words are
added up with carry-save adders: three words of one weight become a word of sums and a word of carries of twice the
weight, for all 32 positions at once. What any order of the filters keeps, removes or repeats follows from the counts of
its prefixes, so no order is ever applied to rows.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tracelake.llm.common import inner_names

LETTERS = "ABCDE"
SUBSETS = 1 << len(LETTERS)
#: by failed filters (bit 0: A): the subsets of filters that the row survives, as a word
SURVIVAL = np.array([sum(1 << s for s in range(SUBSETS) if not s & f) for f in range(SUBSETS)], np.uint32)
MARKS = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(65, 91))
OTHERS = bytes(i for i in range(256) if i not in CAPITALS)


def text_failures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without texts, with ``fails`` (int: bits of the failed filters A to D) and ``digest`` (SHA-256 of the text).

    Words are what stands between ASCII blanks. A: under 50 words. B: distinct words under 65 % of them. C: capitals A to
    Z are over 5 % of the code points. D: one of ``#$%&*|``. Null texts count as empty. Columns named fails or digest are
    replaced; any other column stays.
    """
    docs = docs.drop("fails", "digest")
    at = docs.columns.index(text)
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField("fails", T.IntegerType()), T.StructField("digest", T.BinaryType())])

    def one(data: bytes, points: int) -> int:
        words = data.split()
        return (
            (len(words) < 50)
            | (100 * len(set(words)) < 65 * len(words)) << 1
            | (100 * len(data.translate(None, OTHERS)) > 5 * points) << 2
            | (MARKS.search(data) is not None) << 3
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                texts = pc.fill_null(batch.column(at), "")
                points = pc.utf8_length(texts).to_pylist()
                fails, digests = [], []
                for value, n in zip(texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()), points):
                    data = value.as_py()
                    fails.append(one(data, n))
                    digests.append(hashlib.sha256(data).digest())
                columns = [c for j, c in enumerate(batch.columns) if j != at]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(fails, pa.int32()), pa.array(digests, pa.binary())], names=schema.names
                )

    return docs.mapInArrow(work, schema)


def mark_repeats(rows: DataFrame, id: str = "doc_id", digest: str = "digest", bit: int = 4) -> DataFrame:
    """``rows`` with ``bit`` set in ``fails`` where a row with a smaller id has the same digest.

    The first id of every digest is a minimum that is combined before the shuffle. It is met by id and digest together,
    so a text that a third of all rows share is spread like any other. A null id is neither smaller nor larger than any.
    ``rows`` is read twice: hand in a written table.
    """
    key, same = inner_names(rows, "first_id", "first_digest")
    firsts = rows.where(F.col(id).isNotNull()).groupBy(F.col(digest).alias(same)).agg(F.min(id).alias(key))
    joined = rows.join(firsts, (F.col(id) == F.col(key)) & (F.col(digest) == F.col(same)), "left")
    again = F.col(id).isNotNull() & F.col(key).isNull()
    fails = F.when(again, F.col("fails").bitwiseOR(F.lit(1 << bit))).otherwise(F.col("fails"))
    return joined.withColumn("fails", fails).drop(key, same)


def popcounts(words: np.ndarray) -> np.ndarray:
    """How many of the words have each bit set, by carry-save adders."""
    counts, weight = np.zeros(32, np.int64), 1
    places = np.arange(32, dtype=np.uint32)
    while words.size:
        carries = []
        while words.size > 2:
            n = words.size // 3
            a, b, c = words[:n], words[n : 2 * n], words[2 * n : 3 * n]
            half = a ^ b
            carries.append(a & b | half & c)
            words = np.concatenate([half ^ c, words[3 * n :]])
        counts += weight * ((words[:, None] >> places) & np.uint32(1)).sum(axis=0, dtype=np.int64)
        words = np.concatenate(carries) if carries else words[:0]
        weight *= 2
    return counts


def survivors(rows: DataFrame, part: Column, labels: dict[str, Column]) -> DataFrame:
    """``(part, subset, n)`` and a count for every label: the rows that each subset of the filters (bits) would leave.

    ``rows`` has ``fails`` (bits of failed filters); ``labels`` names conditions, null is false; a null part is an empty string. Every part that has rows
    has all 32 subsets. An empty table gives no rows. Counts leave a task once per batch, part and set of labels.
    """
    label = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(labels.values())), F.lit(0))
    width = len(labels)
    picked = rows.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), label.cast("int").alias("label"), F.col("fails").cast("int"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            named = batch.column(0).dictionary_encode()
            parts = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            codes = parts << width | batch.column(1).to_numpy(zero_copy_only=False)
            words = SURVIVAL[batch.column(2).to_numpy(zero_copy_only=False)]
            order = np.argsort(codes, kind="stable")
            codes, words = codes[order], words[order]
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            counts = [popcounts(w) for w in np.split(words, starts[1:])]
            names = named.dictionary.to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[c >> width] for c in codes[starts].tolist()], pa.string()),
                    pa.array((codes[starts] & ((1 << width) - 1)).astype(np.int32)),
                    pa.array([c.tolist() for c in counts], pa.list_(pa.int64())),
                ],
                names=["part", "label", "counts"],
            )

    counted = picked.mapInArrow(work, "part string, label int, counts array<long>")
    by_subset = counted.select("part", "label", F.posexplode("counts").alias("subset", "n"))
    held = [
        F.sum(F.when(F.col("label").bitwiseAND(F.lit(1 << i)) != 0, F.col("n")).otherwise(0)).alias(name)
        for i, name in enumerate(labels)
    ]
    return by_subset.groupBy("part", "subset").agg(F.sum("n").alias("n"), *held)


def order_effects(counts: DataFrame, lost: dict[str, str]) -> DataFrame:
    """One row for every part, order of the filters and step: what the step keeps, removes, repeats and would miss.

    ``counts`` comes from :func:`survivors`; ``lost`` maps output columns to label columns of it. ``kept``: left after
    the step; ``removed``: by it; ``redundant``: failing its filter but gone before; ``unique_fails``: failing no other
    filter; ``shapley``: removed by its filter, summed over all orders.
    """
    full = SUBSETS - 1
    names = ["n", *lost.values()]
    tables = counts.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", *names))).alias("left"))
    # every step of every order as text: the order, the step, the bit of its filter, the bits of those before it
    plan = ",".join(
        f"{''.join(order)} {step + 1} {1 << LETTERS.index(order[step])} {sum(1 << LETTERS.index(x) for x in order[:step])}"
        for order in itertools.permutations(LETTERS)
        for step in range(len(LETTERS))
    )
    steps = tables.select("part", "left", F.explode(F.split(F.lit(plan), ",")).alias("plan")).select(
        "part", "left", F.split("plan", " ").alias("plan")
    )
    field = lambda i: F.get("plan", F.lit(i))
    steps = steps.select(
        "part",
        "left",
        field(0).alias("filter_order"),
        *[field(i).cast("int").alias(name) for i, name in enumerate(["step", "own", "before"], 1)],
    )
    at = lambda subset, name="n": F.get("left", subset)[name]
    after = F.col("before") + F.col("own")
    failing = at(F.lit(0)) - at(F.col("own"))
    removed = at(F.col("before")) - at(after)
    found = steps.select(
        "part",
        "filter_order",
        "step",
        "own",
        at(after).alias("kept"),
        removed.alias("removed"),
        (failing - removed).alias("redundant"),
        (at(F.lit(full) - F.col("own")) - at(F.lit(full))).alias("unique_fails"),
        *[(at(F.col("before"), name) - at(after, name)).alias(out) for out, name in lost.items()],
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "own"))
    return found.withColumn("shapley", shapley).drop("own")
