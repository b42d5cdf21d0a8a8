"""Byte-level BPE as a lazily determinised transducer, and decoding as a UTF-8 state machine over tokens.

Two neighbouring tokens are compatible if the merges, run on the bytes of the two alone, give back exactly the two. A
sequence of tokens is the result of the merges if and only if all its neighbours are compatible: the first merge to
cross a border between two of them would also cross it in the pair alone. So the merges are a non-deterministic
transducer that reads bytes: it is inside some token that began after some other, and may end a token where the next
one is compatible. ``Encoder`` runs all its live threads at once, as one state of the determinised machine, builds
states and transitions when they are first met, and emits a token as soon as all live threads agree on it, which is at
most one longest token after its end.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import itertools
import re
import threading
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Encoder:
    """Token ids of byte strings. ``most_states`` bounds the memory of the machine: it starts anew when it is full."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = 200_000):
        self.ranks, self.most_states = ranks, most_states
        self.tokens = {v: k for k, v in ranks.items()}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no token for the single byte {missing[0]}")
        self.prefixes: set[bytes] = set()
        for token in ranks:
            self.prefixes.update(token[:i] for i in range(1, len(token)))
        self.pairs: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        # a state: its threads (tokens not yet emitted, the token before what is pending, the bytes pending)
        self.states: list[tuple] = [(((), -1, b""),)]
        self.numbers = {self.states[0]: 0}
        # by state times 256 plus byte: the next state (times 256) and the tokens emitted
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The merges themselves: always the pair of lowest rank, of equal ones the leftmost. For short strings."""
        none, find = 1 << 60, self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [find(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            rank = min(ranks)
            if rank == none:
                break
            at = ranks.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = find(parts[at - 1] + parts[at], none)
            if at < len(ranks):
                ranks[at] = find(parts[at] + parts[at + 1], none)
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``; with left -1, whether it may begin."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            before = self.tokens[left] if left >= 0 else b""
            expected = [left, right] if left >= 0 else [right]
            known = self.pairs[key] = self.merged(before + self.tokens[right]) == expected
        return known

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        threads = []
        step = bytes([byte])
        for out, last, pending in self.states[state]:
            grown = pending + step
            if grown in self.prefixes:
                threads.append((out, last, grown))
            token = self.ranks.get(grown)
            if token is not None and self.compatible(last, token):
                threads.append(((*out, token), token, b""))
        # what all threads have in common is decided
        outs = [t[0] for t in threads]
        least, most = min(outs), max(outs)
        same = 0
        while same < len(least) and least[same] == most[same]:
            same += 1
        if same:
            threads = [(out[same:], last, pending) for out, last, pending in threads]
        target = tuple(sorted(threads))
        first = least
        number = self.numbers.get(target)
        if number is None:
            number = self.numbers[target] = len(self.states)
            self.states.append(target)
        move = self.moves[state << 8 | byte] = (number << 8, first[:same])
        return move

    def encode(self, data: bytes) -> list[int]:
        """Ids of one piece; a piece that is a token is that token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(self.states) > self.most_states:
            self._reset()
        out: list[int] = []
        state, find = 0, self.moves.get
        for byte in data:
            move = find(state | byte)
            if move is None:
                if len(self.states) > 2 * self.most_states:
                    state, find = self._restart(state >> 8) << 8, self.moves.get
                move = self._move(state >> 8, byte)
            state, emitted = move
            if emitted:
                out += emitted
        for rest, _, pending in self.states[state >> 8]:
            if not pending:
                out += rest
                break
        return out

    def _restart(self, state: int) -> int:
        """Forget the machine but for one state, in the middle of a very long piece."""
        threads = self.states[state]
        self._reset()
        if threads in self.numbers:
            return self.numbers[threads]
        self.numbers[threads] = len(self.states)
        self.states.append(threads)
        return self.numbers[threads]


class Decoder:
    """Text of a stream of token ids: a state machine over the bytes of UTF-8 that may stop inside a character.

    A state holds the bytes of a character that has begun. Moves are built when first met, one for each state and
    token. Bytes that are no UTF-8 come out as U+FFFD; ``raw`` gives the bytes as they are.
    """

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, number in ranks.items():
            self.bytes[number] = token
        self.moves: dict[tuple[bytes, int], tuple[bytes, str]] = {}
        # tokens that leave no character open when none was
        self.closed: list[str | None] = []
        for token in self.bytes:
            state, text = self.feed(b"", token)
            self.closed.append(None if state else text)

    @staticmethod
    def feed(pending: bytes, data: bytes, final: bool = False) -> tuple[bytes, str]:
        """The bytes still open after ``data``, and the text that is complete."""
        out: list[str] = []
        held = bytearray(pending)
        for byte in data:
            if held:
                low, high = _second(held[0]) if len(held) == 1 else (0x80, 0xBF)
                if low <= byte <= high:
                    held.append(byte)
                    if len(held) == _length(held[0]):
                        out.append(_character(held))
                        held.clear()
                    continue
                out.append("�")
                held.clear()
            if byte < 0x80:
                out.append(chr(byte))
            elif _length(byte):
                held.append(byte)
            else:
                out.append("�")
        if final and held:
            out.append("�")
            held.clear()
        return bytes(held), "".join(out)

    def raw(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def text(self, ids) -> str:
        try:
            # all tokens are closed: every one of them is one move back to the start
            return "".join([self.closed[i] for i in ids])
        except TypeError:
            return "".join(self.stream(ids))

    def stream(self, ids) -> Iterator[str]:
        """Text as far as it is complete after each id, the rest at the end."""
        state, moves = b"", self.moves
        for number in ids:
            move = moves.get((state, number))
            if move is None:
                if len(moves) > 500_000:
                    moves.clear()
                move = moves[(state, number)] = self.feed(state, self.bytes[number])
            state, text = move
            if text:
                yield text
        if state:
            yield "�"


def _length(lead: int) -> int:
    """Bytes of the character that a byte begins; 0 for one that begins none."""
    if 0xC2 <= lead <= 0xDF:
        return 2
    if 0xE0 <= lead <= 0xEF:
        return 3
    return 4 if 0xF0 <= lead <= 0xF4 else 0


def _second(lead: int) -> tuple[int, int]:
    """Which second bytes may follow a first one (no overlong forms, surrogates or numbers above U+10FFFF)."""
    return {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))


def _character(held: bytearray) -> str:
    number = held[0] & (0xFF >> (len(held) + 1))
    for byte in held[1:]:
        number = number << 6 | byte & 0x3F
    return chr(number)


class Recent(dict):
    """A dictionary that keeps what was used lately: at ``most`` entries they become the older half, and older go."""

    def __init__(self, most: int, make):
        super().__init__()
        self.most, self.make, self.older = most, make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Tokenizer:
    """Texts to ids and back.

    Where a single space stands between characters that are no white space, no match of the pattern can go on; such a
    space begins the next match. So texts are cut there, and what was found for a cut and for a piece is kept for a
    while. ``joins`` says whether the pattern is known to behave so; with another pattern whole texts are split.
    """

    def __init__(
        self, ranks: dict[bytes, int], pattern: str, most: int = 400_000, states: int = 500_000, joins: bool = True
    ):
        self.split = regex.compile(pattern).findall
        self.odd = re.compile(r"\s |\A | \s| \Z").search
        self.joins = joins
        self.encoder, self.decoder = Encoder(ranks, states), Decoder(ranks)
        self.cuts = Recent(most, lambda rest: self._cut(" " + rest))
        # the same word stands before many marks
        self.pieces = Recent(most // 2, lambda piece: tuple(self.encoder.encode(piece.encode("utf-8", "replace"))))

    def _cut(self, text: str) -> tuple[tuple[int, ...], str]:
        ids = tuple(itertools.chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))
        return ids, ",".join(map(str, ids))

    def parts(self, text: str | None) -> list[tuple[tuple[int, ...], str]]:
        """Ids, and the same in decimal joined by commas, of consecutive parts of a text."""
        if not text:
            return []
        if not self.joins or self.odd(text):
            return [self._cut(text)]
        first, *rest = text.split(" ")
        return [self._cut(first), *map(self.cuts.__getitem__, rest)]

    def encode(self, text: str | None) -> list[int]:
        return list(itertools.chain.from_iterable(ids for ids, _ in self.parts(text)))


_MADE: dict[tuple[str, str, int, int], Tokenizer] = {}


def _tokenizer(path: str, pattern: str, most: int = 400_000, states: int = 500_000) -> Tokenizer:
    """The latest one of a worker process, which goes on with what it has built in earlier tasks."""
    key = (path, pattern, most, states)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Tokenizer(read_ranks(path), pattern, most, states)
    return _MADE[key]


#: seconds after which a worker that encodes nothing more gives its memory back
IDLE_SECONDS = 4.0
_RELEASE: list[threading.Timer] = []


@contextlib.contextmanager
def lent(path: str, pattern: str, most: int, states: int) -> Iterator[Tokenizer]:
    """The tokenizer of a worker process for one task: the tasks that follow go on with it, and once there are none for
    ``IDLE_SECONDS`` it goes, as the worker stays to serve other stages."""
    while _RELEASE:
        _RELEASE.pop().cancel()
    tokenizer = _tokenizer(path, pattern, most, states)
    try:
        yield tokenizer
    finally:
        timer = threading.Timer(IDLE_SECONDS, _MADE.clear)
        timer.daemon = True
        timer.start()
        _RELEASE.append(timer)


def digests(docs: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: every text is encoded whole, and its ids are decoded again.

    The decoder's text goes into ``decoded_sha256`` as UTF-8. Null texts count as empty: no ids, digests of nothing.
    Texts are encoded whole, however long; repeated rows get equal results, an empty table gives no rows. A worker keeps
    what it has built for the tasks that follow, up to some 900 MB.
    ``path`` must be readable on every executor.
    """
    kind = docs.schema[id].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path, pattern)
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                counts, ids_digest, decoded = [], [], []
                for value in batch.column(1):
                    parts = tokenizer.parts(value.as_py())
                    ids = list(itertools.chain.from_iterable(ids for ids, _ in parts))
                    counts.append(len(ids))
                    ids_digest.append(hashlib.sha256(",".join([x for _, x in parts if x]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(tokenizer.decoder.text(ids).encode()).hexdigest())
                columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digest), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(work, schema)


def encode(
    docs: DataFrame, path: str, pattern: str, text: str = "text", most: int = 150_000, states: int = 200_000
) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``round_trip``: whether the ids decode to the text again.

    Columns of those names are replaced. Null texts have no ids and count as empty. Texts are encoded whole, however
    long; repeated rows get equal ids, an empty table gives no rows. A worker keeps the ids of up to twice ``most`` words
    and a machine of up to about ``states`` states, some 400 MB, for the tasks that follow, and gives them back when there
    are none.
    """
    docs = docs.drop("ids", "round_trip")
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *fields])
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lent(path, pattern, most, states) as tokenizer:
            for whole in batches:
                for i in range(0, whole.num_rows, 512):
                    batch = whole.slice(i, 512)
                    ids, same = [], []
                    for value in batch.column(at):
                        found = tokenizer.encode(value.as_py())
                        ids.append(np.array(found, np.int32))
                        same.append(tokenizer.decoder.text(found) == (value.as_py() or ""))
                    arrays = [*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())]
                    yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.mapInArrow(work, schema)


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded`` (string). Null ids give an empty text."""
    rows = rows.drop("decoded")
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])
    at = rows.columns.index(ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _tokenizer(path, pattern).decoder
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                texts = [decoder.text(v.as_py() or ()) for v in batch.column(at)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(work, schema)
