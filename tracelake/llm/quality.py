"""Text quality from supervised subword embeddings.

A text's features are its words, the character n-grams inside them, and the word pairs of a repeated word, all hashed.
Every feature has a learned vector; a text is the average of its vectors, and a softmax layer gives the classes.
Vectors and layer are trained with stochastic gradient descent on a bounded sample of labelled rows. As the layer is
linear, a trained model is one number for each feature, and texts are scored by sums over their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 17
GRAMS = (1, 2, 3, 4)
REPEATED = 0


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of some words, and the index of the word that each belongs to."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    raw = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = ends[owner] - np.arange(len(raw))  # bytes up to the end of the word
    buckets, owners = [], []
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(raw), np.uint32)
        for n in range(1, max(GRAMS) + 1):
            rolled = rolled[: len(raw) - n + 1] * np.uint32(0x01000193) + raw[n - 1 :] + np.uint32(1)
            if n in GRAMS:
                fit = left[: len(rolled)] >= n
                buckets.append(_slot(rolled[fit] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)))
                owners.append(owner[: len(rolled)][fit])
        # whole words: the sum over all bytes, each weighed by a power for its place
        places = np.arange(len(raw)) - (ends - sizes)[owner]
        powers = np.power(np.uint32(0x85EBCA6B), places.astype(np.uint32) % np.uint32(64), dtype=np.uint32) + places.astype(np.uint32)
        whole = np.add.reduceat(raw * powers, ends - sizes, dtype=np.uint32)
    buckets.append(_slot(whole ^ np.uint32(0x7F4A7C15)))
    owners.append(np.arange(len(words)))
    return np.concatenate(buckets), np.concatenate(owners)


def _slot(hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (hashes ^ (hashes >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)
        return ((x ^ (x >> np.uint32(15))) % np.uint32(BUCKETS - 1)).astype(np.int64) + 1


def split(text: str | None) -> list[bytes]:
    """Words between white space, as they are."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def bag(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of a whole text and how often each occurs."""
    different: dict[bytes, int] = {}
    numbers = np.fromiter((different.setdefault(w, len(different)) for w in words), np.int64, len(words))
    times = np.bincount(numbers, minlength=len(different))
    buckets, owner = features(list(different))
    found, at = np.unique(buckets, return_inverse=True)
    counts = np.bincount(at, weights=times[owner], minlength=len(found)) if len(found) else np.empty(0)
    again = int(np.sum(numbers[1:] == numbers[:-1]))
    if again:
        found, counts = np.concatenate(([REPEATED], found)), np.concatenate(([4.0 * again], counts))
    return found.astype(np.int32), counts.astype(np.float32)


@dataclass
class Model:
    """What each feature adds to the log-odds of class 1, and the constant."""

    weights: np.ndarray
    offset: float

    def score_all(self, texts: list[str | None], known: dict[bytes, complex]) -> list[float]:
        """Scores of some texts. ``known`` keeps, for words seen, the sum of their weights and the number of features."""
        split_texts = [split(t) for t in texts]
        if len(known) > 250_000:
            known.clear()
        fresh: list[bytes] = list(set().union(*split_texts).difference(known))
        for i in range(0, len(fresh), 20_000):
            part = fresh[i : i + 20_000]
            buckets, owner = features(part)
            sums = np.bincount(owner, weights=self.weights[buckets], minlength=len(part))
            known.update(zip(part, (sums + 1j * np.bincount(owner, minlength=len(part))).tolist()))
        out = []
        repeat = 4 * complex(self.weights[REPEATED], 1)
        for words in split_texts:
            total = sum(map(known.__getitem__, words), 0j)
            again = sum(map(bytes.__eq__, words, words[1:]))
            total += again * repeat
            logit = self.offset + (total.real / total.imag if total.imag else 0.0)
            out.append(float(1 / (1 + np.exp(-np.clip(logit, -40, 40)))))
        return out


def train(bags: list[tuple[int, np.ndarray, np.ndarray]], size: int = 12, epochs: int = 12, rate: float = 0.3) -> Model:
    """Stochastic gradient descent, one text a step, over ``(label, features, counts)``, always in the same order."""
    if not bags:
        return Model(np.zeros(BUCKETS), 0.0)
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-1 / size, 1 / size, (BUCKETS, size)).astype(np.float32)
    layer, bias = np.zeros((size, 2), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            label, found, counts = bags[i]
            pace = rate * (1 - done / steps)
            done += 1
            if not len(found):
                bias -= pace * 0.1 * (_softmax(bias) - np.eye(2, dtype=np.float32)[label])
                continue
            share = counts / counts.sum()
            hidden = share @ vectors[found]
            error = _softmax(hidden @ layer + bias) - np.eye(2, dtype=np.float32)[label]
            back = layer @ error
            layer -= pace * np.outer(hidden, error)
            bias -= pace * 0.1 * error
            # steps of single features are scaled to the texts' number of features, as each has a small share
            vectors[found] -= (pace * np.minimum(1.0, share * 200))[:, None] * back
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit(docs: DataFrame, training: DataFrame, id: str = "doc_id", text: str = "text") -> Model:
    """Train on the whole texts of ``training (id, label)``, which must be a bounded sample: it is broadcast, and the
    features of its texts, at most ``BUCKETS`` each, come to the driver. Null texts count as empty. Of rows that repeat a
    training id one is used, that with the smallest text. Without any row every score is 0.5."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [bag(split(v.as_py())) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([b[0].tobytes() for b in bags], pa.binary()), pa.array([b[1].tobytes() for b in bags], pa.binary())],
                names=["id", "label", "found", "counts"],
            )

    chosen = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(training), "id")
    chosen = chosen.groupBy("id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    kind = docs.schema[id].dataType.simpleString()
    rows = chosen.select("id", "label", "text").mapInArrow(work, f"id {kind}, label int, found binary, counts binary").collect()
    rows = sorted(rows, key=lambda r: (str(r[0]), bytes(r[2])))
    return train([(r[1], np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in rows])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of class 1, in place of a column of that name. A text without words has
    the score of the constant; equal texts have equal scores, an empty table gives no rows."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, complex] = {}
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                scores = shared.value.score_all(batch.column(at).to_pylist(), known)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=schema.names)

    return docs.mapInArrow(work, schema)
