"""Toxic passages as maximum-scoring segments of token log-odds.

Counts of words and word beginnings in toxic and clean training documents, with a Dirichlet prior from the counts of
all documents, give each of them a log-odds; a token counts with the highest of its own. What is not clearly toxic costs
a little. A linear scan finds all maximal segments of a text. For
clean text the best segment of n tokens follows an extreme-value law: ``P(S >= x) = 1 - exp(-K n exp(-lambda x))``;
lambda follows from the scores of clean tokens, K from the best segments of clean documents. Segments that are
significant under that law are the toxic passages, and their joint evidence gives the document's score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.suffix import _characters, words_of

BUCKETS = 1 << 18
BEGINNINGS = (4, 5)
#: token scores are clipped to this range; their law is read from counts in steps
LOW, HIGH, STEP = -1.0, 8.0, 0.1


def places(word: bytes) -> tuple[int, ...]:
    """Buckets of a word and its beginnings, always as many (a short word repeats its own)."""
    whole = zlib.crc32(word) & (BUCKETS - 1)
    return (whole, *(zlib.crc32(b"^" + word[:n]) & (BUCKETS - 1) if len(word) > n else whole for n in BEGINNINGS))


@dataclass
class Model:
    """Token scores by hash bucket, the law of chance segments, and the calibration of a document's evidence."""

    scores: np.ndarray
    rate: float
    scale: float
    slope: float = 1.0
    offset: float = 0.0
    expect: float = 0.01

    def values(self, words: list[bytes], known: dict[bytes, float]) -> np.ndarray:
        """The score of every token. ``known`` keeps those of words seen."""
        values = list(map(known.get, words))
        if None in values:
            for i, value in enumerate(values):
                if value is None:
                    values[i] = known[words[i]] = float(self.scores[list(places(words[i]))].max())
        if len(known) > 300_000:
            known.clear()
        return np.array(values)

    def segments(self, words: list[bytes], known: dict[bytes, float]) -> list[tuple[int, int, float]]:
        """All maximal segments (first word, word after the last, score), from left to right."""
        scores = self.values(words, known)
        return maximal_segments(scores) if len(scores) and scores.max() > 0 else []

    def judge(self, words: list[bytes], known: dict[bytes, float]) -> tuple[float, list[tuple[int, int, float, float]]]:
        """The evidence of a document, and its significant segments with the number of such expected by chance."""
        found = self.segments(words, known)
        room = np.log(self.scale * max(1, len(words)))
        passages = []
        for a, b, s in found:
            expected = float(np.exp(min(50.0, room - self.rate * s)))
            if expected <= self.expect:
                passages.append((a, b, s, expected))
        best = max((s for _, _, s in found), default=0.0)
        # together, significant segments are as one; without any, the best one counts
        total = max(best, sum(p[2] for p in passages))
        return float(np.clip(self.rate * total - room, -20, 40)), passages

    def score(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * evidence + self.offset, -40, 40))))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments in linear time: positive tokens come one by one, and each joins those before it
    that it lifts. Every kept segment points to the nearest one before it with a lower sum in front."""
    ends = np.cumsum(scores)
    positive = np.flatnonzero(scores > 0)
    kept: list[list] = []  # first, after last, sum before, sum after, index of the nearest with a lower sum before
    for at, after in zip(positive.tolist(), ends[positive].tolist()):
        first, before = at, after - float(scores[at])
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= before:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= after:
                kept.append([first, at + 1, before, after, j])
                break
            first, before = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, y - x) for a, b, x, y, _ in kept]


def held_out(id, parts: int, part: int):
    """Rows whose crc32 of the id as text has the remainder ``part``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id).cast("string"), F.lit(""))), F.lit(parts)) == part


def training_rows(labels: DataFrame, label: str, id: str, parts: int, part: int, most: int) -> DataFrame:
    """At most ``most`` labelled ids outside the held-out part, those with the smallest hash; (id, label), ids once.

    Labels are 0 and 1; rows with any other are left out. An id with both counts as 1.
    """
    rows = labels.where(F.col(id).isNotNull() & F.col(label).isin(0, 1) & ~held_out(id, parts, part))
    rows = rows.groupBy(F.col(id).alias("id")).agg(F.max(label).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("id"), "id").limit(most)


def fit(docs: DataFrame, training: DataFrame, id: str, text: str, strength: float = 10.0, drift: float = 0.1, sure: float = 25.0) -> Model:
    """Learn from the texts of ``training (id, label)``, which must be small enough to broadcast.

    Token counts of all documents make the prior, ``strength`` documents strong; the training documents that hold a
    token are counted against it. Counts are combined by bucket, so the driver gets at most as many rows as there are
    buckets. The evidence of the training documents, two numbers for each, gives the law and calibration. Rows that
    repeat a training id count as often as they stand there. Without any training row every score is next to 0.
    """
    total, clean, toxic = _counts(docs, training, id, text)
    n_clean, n_toxic = _sizes(training)
    prior = total / max(1.0, total.sum()) * strength + 0.5
    odds = np.log((toxic + prior) / (n_toxic + strength)) - np.log((clean + prior) / (n_clean + strength))
    # twice the log-likelihood ratio against equal shares: what chance and a few odd documents explain does not count
    share = n_toxic / max(1, n_toxic + n_clean)
    both = toxic + clean
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (
            np.where(toxic > 0, toxic * np.log(toxic / (both * share)), 0)
            + np.where(clean > 0, clean * np.log(clean / (both * (1 - share))), 0)
        )
    scores = np.where((ratio >= sure) & (odds > 1), odds, 0.0) - drift
    model = Model(np.clip(scores, LOW, HIGH), 1.0, 1.0)
    seen = _evidence(docs, training, id, text, model)
    if not len(seen):
        # nothing was learned, so nothing is toxic, however long it is
        model.slope, model.offset = 0.0, -40.0
        return model
    usual = seen["label"].to_numpy() == 0
    if usual.any():
        steps = np.sum([np.frombuffer(x, np.int64) for x in seen["steps"][usual]], axis=0)
        # a pseudo count keeps a score that no clean token has from being impossible
        model.rate = _rate(LOW + STEP * np.arange(len(steps)), (steps + 0.5) / (steps + 0.5).sum())
        length, best = np.maximum(1, seen["length"].to_numpy()[usual]), seen["best"].to_numpy()[usual]
        model.scale = float(usual.sum() / np.sum(length * np.exp(-model.rate * best)))
    seen = _evidence(docs, training, id, text, model)
    model.slope, model.offset = _calibrate(seen["evidence"].to_numpy(), seen["label"].to_numpy())
    return model


def _rate(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive lambda with ``sum(weights * exp(lambda * scores)) = 1``."""
    if scores.max() <= 0:
        return 1.0
    low, high = 0.0, 1.0
    grown = lambda x: float(np.sum(weights * np.exp(np.minimum(x * scores, 700)))) - 1
    while grown(high) < 0 and high < 64:
        high *= 2
    low = 1e-3
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if grown(middle) < 0 else (low, middle)
    return high


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps, held in by a small ridge."""
    design = np.stack([x, np.ones_like(x)], axis=1)
    w = np.array([0.1, -1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (p - y) + 1e-2 * w
        curve = design.T @ (design * (p * (1 - p) + 1e-9)[:, None]) + 1e-2 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w = w - np.clip(step, -1, 1)
    return float(max(w[0], 1e-6)), float(w[1])


def _sizes(training: DataFrame) -> tuple[int, int]:
    """How many training rows are clean, and toxic."""
    row = training.agg(F.count(F.when(F.col("label") == 0, 1)), F.count(F.when(F.col("label") == 1, 1))).first()
    return row[0], row[1]


def one_of_each(docs: DataFrame, training: DataFrame, id: str, text: str) -> DataFrame:
    """Training rows without those whose text another one has; a text with both labels counts as toxic."""
    chosen = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("hash")).join(F.broadcast(training), "id")
    return chosen.groupBy("hash").agg(F.min("id").alias("id"), F.max("label").alias("label")).select("id", "label").distinct()


def _labelled(docs: DataFrame, training: DataFrame, id: str, text: str, how: str) -> DataFrame:
    chosen = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return chosen.join(F.broadcast(training), "id", how).select("text", "label")


def _counts(docs: DataFrame, training: DataFrame, id: str, text: str) -> np.ndarray:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, BUCKETS), np.int64)
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                batch = whole.slice(i, 2048)
                numbers: dict[bytes, int] = {}
                found: list[int] = []
                labelled: list[tuple[int, np.ndarray]] = []
                for value, label in zip(batch.column(0), batch.column(1).to_pylist()):
                    own = [numbers.setdefault(w, len(numbers)) for w in words_of(value.as_py())]
                    found += own
                    if label is not None and own:
                        labelled.append((1 + label, np.unique(own)))
                if not numbers:
                    continue
                where = np.array([places(w) for w in numbers])
                times = np.bincount(np.array(found, np.int64), minlength=len(numbers))
                for column in where.T:
                    sums[0] += np.bincount(column, weights=times, minlength=BUCKETS).astype(np.int64)
                for row, own in labelled:
                    sums[row][np.unique(where[own])] += 1
        used = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), *(pa.array(s[used]) for s in sums)], names=["bucket", "total", "clean", "toxic"]
        )

    rows = _labelled(docs, training, id, text, "left").mapInArrow(work, "bucket int, total long, clean long, toxic long")
    table = rows.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("total", "clean", "toxic")]).toPandas()
    out = np.zeros((3, BUCKETS))
    for row, name in enumerate(("total", "clean", "toxic")):
        out[row, table["bucket"].to_numpy()] = table[name].to_numpy()
    return out


def _evidence(docs: DataFrame, training: DataFrame, id: str, text: str, model: Model):
    """For every training document: label, words, best segment, evidence, and how many tokens have which score."""
    bins = round((HIGH - LOW) / STEP) + 1
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float] = {}
        for batch in batches:
            rows = []
            for value in batch.column(0):
                words = words_of(value.as_py())
                values = shared.value.values(words, known)
                steps = np.bincount(np.round((values - LOW) / STEP).astype(np.int64), minlength=bins)
                best = max((s for _, _, s in shared.value.segments(words, known)), default=0.0)
                rows.append((len(words), best, shared.value.judge(words, known)[0], steps.astype(np.int64).tobytes()))
            columns = list(zip(*rows)) if rows else [(), (), (), ()]
            kinds = (pa.float64(), pa.float64(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).cast(pa.float64()), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["label", "length", "best", "evidence", "steps"],
            )

    rows = _labelled(docs, training, id, text, "inner")
    return rows.mapInArrow(work, "label double, length double, best double, evidence double, steps binary").toPandas()


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``passages``: start and end character, segment score, and how many such are
    expected by chance in a clean text of that length. Null and empty texts have the lowest evidence and no passages.
    Columns of those names are replaced. Nothing but the text is looked at, so repeated rows and equal texts get equal
    scores; an empty table gives no rows.
    """
    docs = docs.drop("score", "passages")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    item = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("segment", T.DoubleType()), T.StructField("expected", T.DoubleType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("passages", T.ArrayType(item))])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("segment", pa.float64()), ("expected", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                scores, passages = [], []
                for value in batch.column(at):
                    words = words_of(value.as_py())
                    evidence, found = model.judge(words, known)
                    scores.append(model.score(evidence))
                    spans = _characters(value.as_py(), [x for a, b, _, _ in found for x in (a, b)]) if found else []
                    passages.append([s | {"segment": f[2], "expected": f[3]} for s, f in zip(spans, found)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array(passages, kind)], names=schema.names)

    return docs.mapInArrow(work, schema)
