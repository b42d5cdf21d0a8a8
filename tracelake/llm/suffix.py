"""Benchmark decontamination with a generalised suffix automaton.

The words of all test items, numbered, make one automaton that knows every run of words of every item. Documents are
streamed through it: at each word the automaton tells the longest run ending there that some item has. Words in runs
that cover a whole window are hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import inner_names, written

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
# the UTF-8 bytes of the characters that are not in 00-2F, 3A-60 and 7B-7F
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))


class Automaton:
    """All runs of words of items ``(item_id, words)``; windows are ``window`` words, or a whole shorter item."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, set[str]] = {}
        shorts: dict[int, list[tuple[int, str]]] = {}
        bigrams = set()
        self.least = window
        for item, words in items:
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            bigrams.update(zip(numbers, numbers[1:]))
            state = 0
            for at, word in enumerate(numbers):
                state = self._extend(state, word)
                if at + 1 >= window:
                    ends.setdefault(state, set()).add(item)
            if 0 < len(numbers) < window:
                self.least = min(self.least, len(numbers))
                shorts.setdefault(state, []).append((len(numbers), item))
        self._settle(ends, shorts, items)
        self.size = len(self.vocabulary) + 1
        self.bigrams = np.array(sorted(a * self.size + b for a, b in bigrams), np.int64)

    def _extend(self, last: int, word: int) -> int:
        """The state of all runs that end with ``last``'s longest one and ``word``."""
        known = self.next[last].get(word)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._clone(last, word, known)
        state = self._new(self.length[last] + 1, {})
        at = last
        while at != -1 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at == -1:
            self.link[state] = 0
        else:
            target = self.next[at][word]
            longest = self.length[target] == self.length[at] + 1
            self.link[state] = target if longest else self._clone(at, word, target)
        return state

    def _new(self, length: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _clone(self, at: int, word: int, target: int) -> int:
        """Split off the runs of ``target`` that are no longer than one word after ``at``."""
        copy = self._new(self.length[at] + 1, dict(self.next[target]))
        self.link[copy], self.link[target] = self.link[target], copy
        while at != -1 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _settle(self, ends, shorts, items) -> None:
        """For each state: the state of its window-long ending, the items that have it, and short items it ends with."""
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.window_state = [-1] * len(order)
        for state in order:
            if self.length[state] >= self.window:
                up = self.link[state]
                self.window_state[state] = state if self.length[up] < self.window else self.window_state[up]
        self.items: dict[int, set[str]] = {}
        for state, names in ends.items():
            self.items.setdefault(self.window_state[state], set()).update(names)
        # a short item's own state may since have been split; its words lead to the right one
        self.shorts: dict[int, tuple[tuple[int, str], ...]] = {}
        own: dict[int, list[tuple[int, str]]] = {}
        if shorts:
            for item, words in items:
                if 0 < len(words) < self.window:
                    state = 0
                    for w in words:
                        state = self.next[state][self.vocabulary[w]]
                    own.setdefault(state, []).append((len(words), item))
            for state in order[1:]:
                mine = (*own.get(state, ()), *self.shorts.get(self.link[state], ()))
                if mine:
                    self.shorts[state] = tuple(sorted(set(mine)))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans of words (first, end exclusive; joined and in order) and the items that occur."""
        if len(words) < self.least or not self.vocabulary:
            return [], set()
        numbers = np.fromiter(map(self.vocabulary.get, words, [0] * len(words)), np.int64, len(words))
        known = numbers > 0
        # a run of an item is a chain of its word pairs: between chains no match is longer than one word
        chained = np.zeros(len(words), bool)
        pairs = np.flatnonzero(known[:-1] & known[1:])
        if len(pairs) and len(self.bigrams):
            keys = numbers[pairs] * self.size + numbers[pairs + 1]
            at = np.minimum(np.searchsorted(self.bigrams, keys), len(self.bigrams) - 1)
            chained[pairs[self.bigrams[at] == keys]] = True
        breaks = np.flatnonzero(~chained) + 1
        starts = np.concatenate(([0], breaks[:-1]))
        long = (breaks - starts >= self.least) & known[starts]
        spans: list[tuple[int, int]] = []
        found: set[int | tuple[int, str]] = set()
        for a, b in zip(starts[long].tolist(), breaks[long].tolist()):
            self._walk(numbers[a:b].tolist(), a, spans, found)
        names: set[str] = set()
        for x in found:
            names.update(self.items.get(x, ()) if isinstance(x, int) else (x[1],))
        return _joined(spans), names

    def _walk(self, numbers: list[int], offset: int, spans: list, found: set) -> None:
        state = matched = 0
        for at, word in enumerate(numbers, offset + 1):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            target = self.next[state].get(word)
            if target is None:
                continue
            state, matched = target, matched + 1
            if matched >= self.window:
                spans.append((at - matched, at))
                found.add(self.window_state[state])
            for size, item in self.shorts.get(state, ()):
                if size <= matched:
                    spans.append((at - size, at))
                    found.add((size, item))


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def pieces(items: DataFrame, id: str, text: str, window: int, most: int) -> DataFrame:
    """``(item, words, size)``: items cut into pieces of at most ``most`` words that overlap so far that every window
    lies within one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = [w.decode("utf-8", "surrogatepass") for w in words_of(text_)]
                for a in range(0, max(1, len(words) - window + 1), most - window + 1):
                    if words:
                        part = words[a : a + most]
                        rows.append((item or "", " ".join(part), len(part)))
            columns = list(zip(*rows)) if rows else [(), (), ()]
            types = (pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["item", "words", "size"]
            )

    chosen = items.select(F.col(id).cast("string").alias("id"), F.col(text).alias("text"))
    return chosen.mapInArrow(work, "item string, words string, size long").distinct()


def scan(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    automaton_words: int = 100_000,
) -> DataFrame:
    """``docs`` with n_words, n_hit (long), items (ids, sorted as strings) and spans (start and end character of each
    hit passage, from its first to its last word).

    Texts are lower-cased in A-Z and cut into words; null texts have none, and items without words never occur. Items
    are known by id: rows that repeat an id are one item; a null id counts as the empty string. Columns of ``docs``
    with those four names are replaced.

    An automaton holds at most about ``automaton_words`` words and is broadcast; more items make more automata, and the
    documents pass them one after the other, written to the shared folder in between, so that neither the driver nor a
    task holds more than one.
    """
    docs = docs.drop("n_words", "n_hit", "items", "spans")
    spark = docs.sparkSession
    found = written(pieces(items, item_id, item_text, window, max(2 * window, automaton_words // 4)), "items")
    total = found.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-total // automaton_words))
    hits, names = inner_names(docs, "hits", "names")
    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField(hits, T.ArrayType(T.LongType())),
        T.StructField(names, T.ArrayType(T.StringType())),
    ]
    out = docs
    for part in range(parts):
        rows = found.where(F.pmod(F.xxhash64("words"), F.lit(parts)) == part).select("item", "words").collect()
        automaton = Automaton([(r[0], r[1].encode("utf-8", "surrogatepass").split(b" ")) for r in sorted(map(tuple, rows))], window)
        shared = spark.sparkContext.broadcast(automaton)
        schema = T.StructType([*docs.schema.fields, *fields])
        out = out.mapInArrow(_pass(shared, docs.columns.index(text), schema.names, part > 0), schema)
        if part + 1 < parts:
            out = written(out, "scanned")
    schema = T.StructType(
        [
            *docs.schema.fields,
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        ]
    )
    return out.mapInArrow(_finish(docs.columns.index(text), len(docs.columns)), schema)


def _pass(shared, text_at: int, columns: list[str], again: bool):
    width = len(columns) - 3

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                counts, hits, names = [], [], []
                for row in range(batch.num_rows):
                    words = words_of(batch.column(text_at)[row].as_py())
                    spans, items = automaton.scan(words)
                    if again:
                        flat = batch.column(width + 1)[row].as_py()
                        spans = _joined([*spans, *zip(flat[::2], flat[1::2])])
                        items.update(batch.column(width + 2)[row].as_py())
                    counts.append(len(words))
                    hits.append([x for span in spans for x in span])
                    names.append(sorted(items))
                arrays = [pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *arrays], names=columns)

    return work


def _finish(text_at: int, width: int):
    """Word spans to character spans."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            counts, spans = [], []
            for row, flat in enumerate(batch.column(width + 1).to_pylist()):
                counts.append(sum(flat[1::2]) - sum(flat[::2]))
                spans.append(_characters(batch.column(text_at)[row].as_py(), flat) if flat else [])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: width + 1], pa.array(counts, pa.int64()), batch.column(width + 2), pa.array(spans, kind)],
                names=[*batch.schema.names[:width], "n_words", "n_hit", "items", "spans"],
            )

    return work


def _characters(text: str, flat: list[int]) -> list[dict[str, int]]:
    raw = text.encode("utf-8", "surrogatepass").translate(LOWER)
    places = [m.span() for m in WORD.finditer(raw)]
    out, done, characters = [], 0, 0

    def position(byte: int) -> int:
        nonlocal done, characters
        characters += sum((b & 0xC0) != 0x80 for b in raw[done:byte])
        done = byte
        return characters

    for a, b in zip(flat[::2], flat[1::2]):
        out.append({"start": position(places[a][0]), "end": position(places[b - 1][1])})
    return out


def remove(scanned: DataFrame, text: str = "text", coverage: float = 0.8) -> DataFrame:
    """The scanned documents without their hit passages; documents with more than ``coverage`` of their words hit go.

    What stands before and after a passage is joined by one space. Documents without hits stay byte for byte.
    """
    kept = scanned.where(F.col("n_hit") <= F.lit(coverage) * F.col("n_words"))
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    ends = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.length(text).cast("long")))
    cut = F.transform(
        F.arrays_zip(starts.alias("a"), ends.alias("b")),
        lambda s: F.substring(F.col(text), (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int")),
    )
    joined = F.array_join(F.filter(F.transform(cut, lambda x: F.trim(x)), lambda x: x != ""), " ")
    return kept.withColumn(text, F.when(F.col("n_hit") > 0, joined).otherwise(F.col(text)))
