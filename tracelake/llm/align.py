"""Alignment of two tokenizers: where tokens of both end together, and which token ids meet there.

Both tokenizers read the same bytes. The ends of their tokens, summed up, become two dictionaries from an end to the
index behind it; the keys that both have, sorted, slice the two lists of ids into groups. In every slice the tokens that
end at its end are linked. How often two ids are linked in the whole corpus then tells which partner of an id is usual.

A space between two characters that are no white space begins a new token for both tokenizers, so texts are cut there,
and what was found for a cut is kept for the next text that holds it.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tracelake.llm.common import inner_names, meet, written

SPACE = "▁"
#: letters below it have stood in all versions of Unicode as they are
FIRST_ODD = "\u0250"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


class ByteTokens:
    """A byte-level tokenizer file: ids of texts, bytes of ids. Strings of special tokens in a text are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        letters = byte_letters()
        self.bytes = {
            number: bytes(map(letters.__getitem__, token)) for token, number in told["model"]["vocab"].items() if set(token) <= letters.keys()
        }
        split = told.get("pre_tokenizer") or {}
        #: its pattern begins a token at a space between others
        self.cuts = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.cuts = self.cuts and not told.get("normalizer")

        self.fast = self._by_ranks(told["model"]) if self.cuts else None

    def _by_ranks(self, model: dict):
        """The same merges as ranks, for texts in whose letters all Unicode tables agree; None if ids are no ranks."""
        import public_tokenizers
        import tiktoken

        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        first = len(self.bytes) - len(merges)
        if first != 256 or any(model["vocab"][x + y] != first + i for i, (x, y) in enumerate(merges)):
            return None
        ranks = {token: number for number, token in self.bytes.items()}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> list[list[int]]:
        plain = [self.fast is not None and (text.isascii() or max(text) < FIRST_ODD) for text in texts]
        rest = [text for text, known in zip(texts, plain) if not known]
        odd = (found.ids for found in self.library.encode_batch_fast(rest, add_special_tokens=False)) if rest else iter(())
        return [self.fast(text) if known else next(odd) for text, known in zip(texts, plain)]


class PieceTokens:
    """A sentence-piece model: ids of texts, bytes of ids; pieces write a space as U+2581, single bytes as <0xHH>."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        byte = re.compile(r"<0x([0-9A-F]{2})>\Z")
        self.bytes = {
            i: bytes([int(found[1], 16)]) if (found := byte.match(piece)) else piece.replace(SPACE, " ").encode()
            for i, piece in enumerate(pieces)
        }
        #: no piece goes on behind a space that stands after something else
        self.cuts = not any(SPACE in piece.lstrip(SPACE) for piece in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


def aligned(
    a: list[int], b: list[int], a_sizes: list[int], b_sizes: list[int]
) -> Iterator[tuple[int, int, int, list[int]]]:
    """Groups of two lists of ids over the same bytes: their end, the index behind them in either list, and the pairs of
    ids (first times 2**32 plus second) that end together there."""
    a_ends = dict(zip(itertools.accumulate(a_sizes), itertools.count(1)))
    b_ends = dict(zip(itertools.accumulate(b_sizes), itertools.count(1)))
    at = to = 0
    for end in sorted(a_ends.keys() & b_ends.keys()):
        i, j = a_ends[end], b_ends[end]
        if a_sizes[i - 1] and b_sizes[j - 1]:
            pairs = [a[i - 1] << 32 | b[j - 1]]
        else:
            # tokens without bytes end where the one before them does
            left = [*itertools.takewhile(lambda k: not a_sizes[k], range(i - 1, at, -1))]
            right = [*itertools.takewhile(lambda k: not b_sizes[k], range(j - 1, to, -1))]
            left, right = (range(i - 1 - len(left), i), range(j - 1 - len(right), j))
            pairs = [a[x] << 32 | b[y] for x in left for y in right]
        yield end, i, j, pairs
        at, to = i, j


class Aligner:
    """What both tokenizers make of texts. ``most`` cuts are kept at a time, twice as many at the most."""

    def __init__(self, byte_path: str, piece_path: str, most: int = 250_000):
        self.a, self.b, self.most = ByteTokens(byte_path), PieceTokens(piece_path), most
        self.cuts = self.a.cuts and self.b.cuts
        self.a_sizes, self.b_sizes = ({i: len(data) for i, data in side.bytes.items()} for side in (self.a, self.b))
        self.odd = re.compile(r"\s |\A | \s| \Z").search
        self.space = re.compile(r"(?<=\S) (?=\S)")
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def split(self, text: str) -> list[str]:
        if not self.cuts:
            return [text]
        return self.space.split(text) if self.odd(text) else text.split(" ")

    def found(self, texts: list[str]) -> list[tuple | None]:
        """For every text: tokens of both, groups as text, number of groups, links as int64; None if bytes are lost.

        The texts stand one behind the other and are aligned as one; each ends at an end that both tokenizers have.
        """
        if not texts:
            return []
        spaced = [" " + text for text in texts]
        a, b = self.a.encode(spaced), self.b.encode(texts)
        raw = [text.encode() for text in spaced]
        lost = self._lost(raw, a, b)
        if lost:
            kept = iter(self.found([text for i, text in enumerate(texts) if i not in lost]))
            return [None if i in lost else next(kept) for i in range(len(texts))]
        flat_a, flat_b = list(itertools.chain.from_iterable(a)), list(itertools.chain.from_iterable(b))
        told_a, told_b = list(map(str, flat_a)), list(map(str, flat_b))
        groups, links, ends, link_ends, done = [], [], [], [], 0
        at = to = 0
        sizes_a, sizes_b = [self.a_sizes[i] for i in flat_a], [self.b_sizes[i] for i in flat_b]
        for end, i, j, pairs in aligned(flat_a, flat_b, sizes_a, sizes_b):
            groups.append(",".join(told_a[at:i]) + "|" + ",".join(told_b[to:j]))
            links += pairs
            ends.append(end)
            link_ends.append(len(links))
            at, to = i, j
        links, out = np.array(links, np.int64), []
        stops = np.searchsorted(ends, np.cumsum([len(data) for data in raw]), "right").tolist()
        for x, y, stop in zip(a, b, stops):
            first, last = (link_ends[done - 1] if done else 0), link_ends[stop - 1]
            out.append((len(x), len(y), ";".join(groups[done:stop]), stop - done, links[first:last].tobytes()))
            done = stop
        return out

    def _lost(self, raw: list[bytes], a: list[list[int]], b: list[list[int]]) -> set[int]:
        """Which texts one of the tokenizers does not give back byte by byte."""
        lost = set()
        for side, found in ((self.a, a), (self.b, b)):
            made = [b"".join([side.bytes.get(i, b"") for i in ids]) for ids in found]
            if made != raw:
                lost.update(i for i, (x, y) in enumerate(zip(made, raw)) if x != y)
        return lost

    def learn(self, cuts: set[str]) -> dict[str, tuple | None]:
        """What is known of cuts: found before, or now."""
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = [cut for cut in cuts if cut not in known]
        for cut in new:
            if cut in older:
                known[cut] = older[cut]
        new = [cut for cut in new if cut not in known]
        extra = dict(zip(new, self.found(new)))
        for cut, value in extra.items():
            if len(cut) <= 64:
                known[cut] = value
        return extra

    def texts(self, texts: list[str | None]) -> Iterator[tuple[int, int, str, int, np.ndarray]]:
        """Tokens of both, groups as text, number of groups and links of every text."""
        nothing = (0, 0, "", 0, np.zeros(0, np.int64))
        split = [self.split(text) if text else [] for text in texts]
        extra = self.learn(set(itertools.chain.from_iterable(split)))
        known = self.known
        for text, cuts in zip(texts, split):
            parts = [known[cut] if cut in known else extra[cut] for cut in cuts]
            if None in parts:
                # bytes are lost in a cut: the whole text decides
                parts = self.found([text]) if len(parts) > 1 else parts
            if not parts or None in parts:
                yield nothing
                continue
            a, b, groups, n, links = zip(*parts)
            yield sum(a), sum(b), ";".join(groups), sum(n), np.frombuffer(b"".join(links), np.int64)


_MADE: dict[tuple[str, str], Aligner] = {}


def groups(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text") -> DataFrame:
    """``docs`` without texts, with ``n_a, n_b, n_groups, n_links`` (long), ``groups_sha256`` and ``links``.

    ``text`` is read by the piece model, a space and the text by the byte-level tokenizer. ``links`` holds structs of two
    ids ``a``, ``b`` and how often (``n``) the text links them. Texts that are null, empty or not rendered byte by byte by
    both have no tokens: zeros, no links, groups_sha256 ``''``. Texts are aligned whole, however long. Columns of these
    names are replaced, others stay; repeated rows get equal results. Both paths must be readable on every executor.
    """
    made = ["n_a", "n_b", "n_groups", "n_links"]
    docs = docs.drop(*made, "groups_sha256", "links")
    at = docs.columns.index(text)
    kept = [f for f in docs.schema.fields if f.name != text]
    link = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("n", T.IntegerType())]))
    schema = T.StructType(
        [*kept, *[T.StructField(name, T.LongType()) for name in made], T.StructField("groups_sha256", T.StringType()), T.StructField("links", link)]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (byte_path, piece_path)
        if key not in _MADE:
            _MADE.clear()
            _MADE[key] = Aligner(*key)
        aligner = _MADE[key]
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                numbers, digests, pairs, times = [], [], [], []
                for a, b, told, n, links in aligner.texts(batch.column(at).to_pylist()):
                    ids, counts = np.unique(links, return_counts=True)
                    numbers.append((a, b, n, len(links)))
                    digests.append(hashlib.sha256(told.encode()).hexdigest() if told else "")
                    pairs.append(ids)
                    times.append(counts)
                ids = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
                counts = np.concatenate(times) if times else ids
                fields = [(ids >> 32).astype(np.int32), (ids & 0xFFFFFFFF).astype(np.int32), counts.astype(np.int32)]
                structs = pa.StructArray.from_arrays([pa.array(x) for x in fields], names=["a", "b", "n"])
                offsets = np.cumsum([0, *map(len, pairs)], dtype=np.int32)
                columns = [c for j, c in enumerate(batch.columns) if j != at]
                columns += [pa.array(x, pa.int64()) for x in zip(*numbers)]
                columns += [pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), structs)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(work, schema)


def usual_links(found: DataFrame) -> DataFrame:
    """``found`` of :func:`groups` without ``links``, with ``n_best`` and ``count_sum`` (long).

    The count of a pair of ids is how many links in all of ``found`` join them. ``n_best``: links of the row whose count is
    the highest of their second id, ties included; ``count_sum``: counts added up over the links of the row.

    Pairs are counted before the shuffle. Those that hold a ten-thousandth of all rows of links or more, at most ten
    thousand, go back to the rows by broadcast, the rest by a join.
    """
    found = found.drop("n_best", "count_sum")
    row, same = inner_names(found, "row", "same_row")
    # numbered while it is written: the numbers are then as fixed as the rows
    found = written(found.withColumn(row, F.monotonically_increasing_id()), "groups")
    links = found.select(F.col(row).alias("row"), F.explode("links").alias("x")).select("row", "x.a", "x.b", "x.n")
    counts = links.groupBy("a", "b").agg(F.sum("n").alias("count"), F.count("*").alias("rows"))
    # an id has at most as many partners as the other vocabulary has tokens
    best = F.col("count") == F.max("count").over(Window.partitionBy("b"))
    counts = written(counts.withColumn("best", best), "counts")
    sums = meet(links, counts, ["a", "b"], "rows").groupBy(F.col("row").alias(same)).agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).cast("long").alias("n_best"),
        F.sum(F.col("n") * F.col("count")).cast("long").alias("count_sum"),
    )
    joined = found.drop("links").join(sums, F.col(row) == F.col(same), "left").drop(row, same)
    return joined.fillna(0, ["n_best", "count_sum"])
