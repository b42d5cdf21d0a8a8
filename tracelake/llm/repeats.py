"""Removal of passages that a document shares with an earlier one, by seeds that are extended both ways.

Of the runs of ``seed_words`` words that begin in a passage-long window, the one with the least hash is the window's
seed, so equal windows have equal seeds at equal places. Neighbouring windows mostly share a seed; from it, the windows
that chose it reach so far to the left and so far to the right, and all of them together are the seed's reach. Documents
meet on seeds. Two that agree on the whole reach agree on all its windows: the smallest id keeps it, and the others lose
it at once. Where the reaches of one seed differ, the match ends somewhere inside: there, one document of each distinct
reach lays open its windows one by one, and these are looked up among each other. So every window is judged against all
documents with smaller ids, and windows that match run together to maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import inner_names, meet, written

#: words that are hashed together, at most; one longer text is a block of its own
BLOCK = 400_000


class WordHashes(dict):
    """XXH3 of words, kept for words that were met before."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 300_000:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


def mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One hash of two, in their order."""
    z = x * np.uint64(0x9E3779B97F4A7C15)
    z ^= z >> np.uint64(29)
    z += y * np.uint64(0xC2B2AE3D27D4EB4F)
    z ^= z >> np.uint64(32)
    z *= np.uint64(0xD6E8FEB86659FD93)
    z ^= z >> np.uint64(31)
    return z


def run_hashes(words: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """Hashes of all runs of each length (ascending): runs of powers of two by doubling, others from two that overlap."""
    out, power, known = [], 1, words
    for length in lengths:
        while 2 * power <= length:
            known = mixed(known[: max(0, len(known) - power)], known[power:])
            power *= 2
        rest = length - power
        out.append(mixed(known[: len(known) - rest], known[rest:]) if 0 < rest <= len(known) else known[: len(known) if not rest else 0])
    return out


def leftmost_least(values: np.ndarray, wide: int) -> np.ndarray:
    """For every start of ``wide`` values the place of the least of them, the leftmost of equal ones."""
    places, best, done = np.arange(len(values)), values, 1
    while done < wide and len(best):
        step = min(done, wide - done)
        later, now = best[step:], best[: max(0, len(best) - step)]
        right = later < now
        places = np.where(right, places[step:], places[: len(now)])
        best = np.where(right, later, now)
        done += step
    return places


def seeds_of(words: np.ndarray, ends: np.ndarray, seed_words: int, passage_words: int) -> tuple[np.ndarray, ...]:
    """Seeds of documents that stand one behind the other: place of the first window, number of windows, hash, reach."""
    seeds, windows = run_hashes(words, seed_words, passage_words)
    starts = np.r_[0, ends[:-1]]
    inside = np.zeros(len(words) + 1, np.int32)
    # a window begins where it also ends in its document
    last = np.maximum(starts, ends - passage_words + 1)
    np.add.at(inside, starts, 1)
    np.add.at(inside, last, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    place = leftmost_least(seeds, passage_words - seed_words + 1)[at]
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    first, final = at[new], at[np.r_[new[1:] - 1, len(at) - 1]]
    count = final - first + 1
    reach = mixed(windows[first], windows[final]) + count.astype(np.uint64)
    return first, count, seeds[place[new]], reach


def blocks(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Words of consecutive texts, so many together as a block holds: number of the first text, words of each."""
    binary = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    held, total, first = [], 0, 0
    for i, value in enumerate(pc.fill_null(texts, "").cast(binary)):
        words = value.as_py().split()
        if held and total + len(words) > BLOCK:
            yield first, held
            held, total, first = [], 0, i
        held.append(words)
        total += len(words)
    if held:
        yield first, held


def hashed(documents: list[list[bytes]], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of documents, one behind the other, and where each document ends."""
    ends = np.cumsum([len(words) for words in documents])
    words = np.fromiter((h for words in documents for h in map(known.__getitem__, words)), np.uint64, int(ends[-1]))
    return words, ends


def seeds(docs: DataFrame, passage_words: int, seed_words: int) -> DataFrame:
    """``(id, key, seeds)`` of ``docs (id, key, text)``: structs of hash ``h``, reach ``s``, first window ``q``, windows ``n``."""
    kind = pa.list_(pa.struct([("h", pa.int64()), ("s", pa.int64()), ("q", pa.int32()), ("n", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for first, documents in blocks(batch.column(2)):
                words, ends = hashed(documents, known)
                q, n, h, s = seeds_of(words, ends, seed_words, passage_words)
                offsets = np.r_[0, np.searchsorted(q, ends)].astype(np.int32)
                starts = np.repeat(np.r_[0, ends[:-1]], np.diff(offsets))
                arrays = [h.view(np.int64), s.view(np.int64), (q - starts).astype(np.int32), n.astype(np.int32)]
                found = pa.StructArray.from_arrays([pa.array(x) for x in arrays], fields=list(kind.value_type))
                part = batch.slice(first, len(documents))
                lists = pa.ListArray.from_arrays(pa.array(offsets), found)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["id", "key", "seeds"])

    return docs.mapInArrow(work, "id long, key long, seeds array<struct<h: long, s: long, q: int, n: int>>")


def opened(docs: DataFrame, passage_words: int) -> DataFrame:
    """``(id, h, w, key, q)``: the windows ``w`` of chosen seeds, one row each; ``docs (id, key, text, chosen)``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for first, documents in blocks(batch.column(2)):
                words, ends = hashed(documents, known)
                (windows,) = run_hashes(words, passage_words)
                part = batch.slice(first, len(documents))
                chosen = part.column(3)
                flat, sizes = chosen.flatten(), np.diff(chosen.offsets.to_numpy())
                h, q, n = (flat.field(i).to_numpy() for i in range(3))
                of = np.repeat(np.arange(len(documents)), sizes)
                rows = np.repeat(np.arange(len(h)), n)
                places = q[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
                starts = np.r_[0, ends[:-1]]
                of_row = of[rows]
                w = windows[starts[of_row] + places]
                picked = pa.array(of_row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(picked), pa.array(h[rows]), pa.array(w.view(np.int64)), part.column(1).take(picked), pa.array(places.astype(np.int32))],
                    names=["id", "h", "w", "key", "q"],
                )

    return docs.mapInArrow(work, "id long, h long, w long, key long, q int")


def shared_runs(docs: DataFrame, passage_words: int = 50, seed_words: int = 16) -> DataFrame:
    """``(id, key, a, b)``: words ``a`` up to ``b`` of a document whose windows all begin in documents with smaller ids too.

    ``docs`` has ``id`` (long), ``key`` (long, tells rows of one id apart) and ``text``. Runs overlap and together are
    all that is shared. Seeds, reaches and windows travel as 64-bit hashes, and windows only meet under equal seeds, so
    two windows are taken for one with the chance of a 128-bit collision.

    Minima are combined before the shuffle. What so many documents share that its rows would weigh on one task is met by
    broadcast (:func:`tracelake.llm.common.meet`); the windows of a common seed are dealt by window.
    """
    found = written(seeds(docs.where("id is not null"), passage_words, seed_words), "seeds")
    rows = found.select("id", "key", F.explode("seeds").alias("x")).select("id", "key", "x.h", "x.s", "x.q", "x.n")
    reaches = rows.groupBy("h", "s").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("rows"))
    reaches = written(reaches, "reaches")
    several = reaches.groupBy("h").agg(F.count("*").alias("reaches"), F.min("first").alias("least"), F.max("last").alias("most"))
    several = written(several.where("reaches > 1 and least < most").select("h", "reaches"), "several")
    # reaches that more than one document has, and those that differ under a seed of several documents
    met = meet(reaches, several, ["h"], "reaches", how="left")
    met = met.where("first < last or reaches is not null")
    met = written(met.select("h", "s", "first", "rows", F.col("reaches").isNotNull().alias("open")), "met")
    kept = written(meet(rows, met, ["h", "s"], "rows").select("id", "key", "h", "q", "n", "first", "open"), "kept")
    whole = kept.where("id > first").select("id", "key", F.col("q").alias("a"), (F.col("q") + F.col("n") + (passage_words - 1)).alias("b"))
    chosen = kept.where("id = first and open").groupBy("id", "key").agg(F.collect_list(F.struct("h", "q", "n")).alias("chosen"))
    windows = opened(docs.join(chosen, ["id", "key"]).select("id", "key", "text", "chosen"), passage_words)
    windows = written(windows, "windows")
    twice = windows.groupBy("h", "w").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("rows"))
    twice = written(twice.where("first < last").drop("last"), "twice")
    single = meet(windows, twice, ["h", "w"], "rows").where("id > first")
    single = single.select("id", "key", F.col("q").alias("a"), (F.col("q") + passage_words).alias("b"))
    return whole.union(single)


def remove_shared(
    docs: DataFrame, text: str = "text", id: str = "doc_id", passage_words: int = 50, seed_words: int = 16
) -> DataFrame:
    """``docs`` with ``text`` cut to the words that are kept, joined by one blank, and ``n_words`` and ``n_removed`` (long).

    A word goes if a window of ``passage_words`` consecutive words over it, as a sequence, also begins in a document with
    a smaller id; all windows are judged on the texts as they came in. Words stand between ASCII blanks and are compared
    as they are. Ids are whole numbers. Null texts have no words (text ``''``); rows with a null id lose nothing and take
    nothing from others; rows of equal id are neither smaller nor larger than one another, each is judged by its own text.
    A text shorter than a passage loses nothing. A very long text is one row; its words are hashed as one block. Columns
    n_words and n_removed are replaced, all others stay. An empty table gives no rows.
    """
    if not isinstance(docs.schema[id].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{id} must be a column of whole numbers")
    docs = docs.drop("n_words", "n_removed")
    key = F.xxhash64(F.col(text))
    plain = docs.select(F.col(id).cast("long").alias("id"), key.alias("key"), F.col(text).alias("text"))
    runs = shared_runs(plain.where("text is not null"), passage_words, seed_words)
    runs = runs.groupBy("id", "key").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    left, right, cuts = inner_names(docs, "run_id", "run_key", "runs")
    runs = runs.select(F.col("id").alias(left), F.col("key").alias(right), F.col("runs").alias(cuts))
    joined = docs.join(runs, (F.col(id) == F.col(left)) & (key == F.col(right)), "left").select(*docs.columns, cuts)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            for first, documents in blocks(batch.column(at)):
                texts, counts, gone = [], [], []
                for words, runs in zip(documents, lists.slice(first, len(documents))):
                    counts.append(len(words))
                    if runs.is_valid:
                        a, b = (runs.values.field(i).to_numpy() for i in range(2))
                        inside = np.zeros(len(words) + 1, np.int64)
                        np.add.at(inside, a, 1)
                        np.add.at(inside, b, -1)
                        stay = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
                        words = [words[i] for i in stay.tolist()]
                    gone.append(counts[-1] - len(words))
                    texts.append(b" ".join(words))
                part = batch.slice(first, len(documents))
                columns = list(part.columns[:-1])
                columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], names=schema.names)

    return joined.mapInArrow(work, schema)
