"""The pipeline, stage by stage, against plain versions of the stages on the smallest tables."""

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from corpus_plain import small  # noqa: F401 - fixture
from tracelake.llm import bpe, queries, simhash, suffix, toxicity

# plain versions shared with the tests of the operators
from test_corpus_search import brute_hits  # isort: skip
from test_corpus_text import plain_removal  # isort: skip


def shingles(text):
    words = simhash.WORD.findall((text or "").encode().translate(simhash.UPPER_TO_LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_pipeline(spark, small):
    docs = queries.table(spark, small, "documents")
    columns = docs.columns
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, small).cache()
        held[name] = (before.collect(), docs.collect())
        if name != "bpe":
            assert docs.columns == columns
    # documents with the learned words go, the rest stays as it is
    before, after = held["toxicity"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    labels = {r.doc_id: r.toxic for r in queries.table(spark, small, "labels").collect()}
    assert all(labels.get(i, 1) for i in gone)
    assert {r.doc_id: tuple(r) for r in after} == {r.doc_id: tuple(r) for r in before if r.doc_id not in gone}
    before, after = held["line_dedup"]
    assert sorted((r.doc_id, r.text) for r in after) == sorted(x[:2] for x in plain_removal([(r.doc_id, r.text) for r in before]))
    before, after = held["near_dedup"]
    sets = {r.doc_id: shingles(r.text) for r in before}
    left = sorted(r.doc_id for r in after)
    for i in left:
        assert not any(i != j and len(sets[i] & sets[j]) >= 0.85 * len(sets[i] | sets[j]) for j in left)
    for i in set(sets) - set(left):
        assert any(i != j and len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j]) for j in sets)
    before, after = held["decontamination"]
    items = [(str(r.item_id), suffix.words_of(r.text)) for r in queries.table(spark, small, "benchmark").collect()]
    texts = {r.doc_id: r.text for r in after}
    for r in before:
        words = suffix.words_of(r.text)
        hit, _ = brute_hits(words, items, 10)
        if len(hit) > 0.8 * len(words):
            assert r.doc_id not in texts
        else:
            assert suffix.words_of(texts[r.doc_id]) == [w for i, w in enumerate(words) if i not in hit]
    before, after = held["bpe"]
    path = public_tokenizers.path(queries.RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = {r.doc_id: r.text for r in before}
    assert all(r.ids == library.encode_ordinary(texts[r.doc_id] or "") and r.round_trip for r in after)
    assert len(after) == len(before)


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "ids", "n_tokens", "round_trip"] and out.where(~F.col("round_trip")).count() == 0


def test_training_is_bounded(spark, small):
    rows = toxicity.training_rows(queries.table(spark, small, "labels"), "toxic", "doc_id", 4, 2, 7)
    assert rows.count() == 7
