"""Alignment of tokenizers, passages shared with earlier documents and the filter audit, against plain versions."""

import collections
import hashlib
import itertools
import random

import numpy as np
import pytest
from corpus_plain import against_sql, frame, small  # noqa: F401 - fixtures
from pyspark.sql import functions as F

import public_tokenizers
from tracelake.llm import align, audit, common, queries, repeats

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_alignment(docs):
    """Whole texts through both libraries, every pair of tokens compared by its end."""
    a_side, b_side = align.ByteTokens(PATHS[0]), align.PieceTokens(PATHS[1])
    rows, counts = [], collections.Counter()
    for number, text in docs:
        groups, links, a, b = [], [], [], []
        if text:
            (a,), (b,) = a_side.encode([" " + text]), b_side.encode([text])
            ends = []
            for ids, side in ((a, a_side), (b, b_side)):
                parts = [side.bytes[i] for i in ids]
                ends.append(list(itertools.accumulate(map(len, parts))))
                if b"".join(parts) != (" " + text).encode():
                    a = []
            if not a:
                b = []
            else:
                seen = [0, 0]
                for end in [e for e in ends[0] if e in set(ends[1])]:
                    cut = [ends[0].index(end) + 1, ends[1].index(end) + 1]
                    groups.append(f"{','.join(map(str, a[seen[0]:cut[0]]))}|{','.join(map(str, b[seen[1]:cut[1]]))}")
                    seen = cut
                links = [(x, y) for x, e in zip(a, ends[0]) for y, f in zip(b, ends[1]) if e == f] if len(a) < 3000 else [
                    (a[ends[0].index(e)], b[ends[1].index(e)]) for e in ends[0] if e in set(ends[1])
                ]
        counts.update(links)
        rows.append((number, len(a), len(b), groups, links))
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return sorted(
        (
            number,
            a,
            b,
            len(groups),
            len(links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
            sum(counts[x] == most[x[1]] for x in links),
            sum(counts[x] for x in links),
        )
        for number, a, b, groups, links in rows
    )


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
ODD = [
    None,
    "",
    " ",
    "plain words here",
    "  two  blanks  ",
    "a▁b lost",
    "fine here a▁b lost",
    "tab\there\nline\r\n end ",
    "<|endoftext|> <s> </s> <unk> <0x41>",
    "日本語のテキスト と 한국어 🙂🙂",
    "é ﬁ   　x \x1c y \x85 z",
    "don't can't I'll 12345 67 8",
    "plain words here",
    "word " * 700,
    "x" * 5000,
]


def test_alignment_of_odd_texts(spark, frame):
    docs = frame(ODD)
    got = align.usual_links(align.groups(docs, *PATHS))
    assert sorted(map(tuple, got.select(ALIGNED).collect())) == plain_alignment(list(enumerate(ODD)))
    assert [c for c in docs.columns if c != "text"] == [c for c in got.columns if c not in ALIGNED[1:]]
    none = align.usual_links(align.groups(docs.limit(0), *PATHS))
    assert none.count() == 0


def test_alignment_of_repeated_rows(spark, frame):
    docs = frame(["a few words", "a few words", None], ids=[4, 4, None])
    got = align.usual_links(align.groups(docs, *PATHS)).select(ALIGNED).collect()
    rows = [tuple(r) for r in got if r.doc_id == 4]
    assert len(got) == 3 and rows[0] == rows[1] and rows[0][-1] == 2 * rows[0][4]


def test_alignment_query(spark, small):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, small, "documents").collect()]
    assert sorted(map(tuple, queries.op11(spark, small).select(ALIGNED).collect())) == plain_alignment(docs)


def test_cuts_change_nothing():
    """Cut at spaces or whole, with a memory of few cuts: the same groups."""
    cut, whole = align.Aligner(*PATHS, most=3), align.Aligner(*PATHS)
    whole.cuts = False
    texts = [t for t in ODD if t] + ["this and that", "that and this, this", "and that"]
    for some in (texts[:5], texts[5:], texts):
        for x, y in zip(cut.texts(some), whole.texts(some)):
            assert x[:4] == y[:4] and (x[4] == y[4]).all()
    assert len(cut.older) + len(cut.known) < 60


def test_tokens_without_bytes():
    found = [(end, i, j, {divmod(x, 1 << 32) for x in pairs}) for end, i, j, pairs in align.aligned([1, 2, 3, 4], [5, 6, 7], [2, 0, 1, 1], [2, 1, 1])]
    assert found == [(2, 2, 1, {(1, 5), (2, 5)}), (3, 3, 2, {(3, 6)}), (4, 4, 3, {(4, 7)})]


def test_fast_ids_are_those_of_the_library(spark, small):
    side = align.ByteTokens(PATHS[0])
    texts = [" " + t for t in ODD if t] + [r.text for r in queries.table(spark, small, "documents").collect() if r.text]
    assert side.fast and side.encode(texts) == [x.ids for x in side.library.encode_batch(texts, add_special_tokens=False)]


def plain_repeats(docs, size=50):
    windows = collections.defaultdict(lambda: float("inf"))
    split = [(i, [w.decode() for w in (t or "").encode().split()]) for i, t in docs]
    for i, words in split:
        if i is not None:
            for q in range(len(words) - size + 1):
                windows[tuple(words[q : q + size])] = min(windows[tuple(words[q : q + size])], i)
    out = []
    for i, words in split:
        gone = set()
        for q in range(len(words) - size + 1) if i is not None else ():
            if windows[tuple(words[q : q + size])] < i:
                gone.update(range(q, q + size))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def cut(spark, docs):
    got = repeats.remove_shared(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()
    return sorted(map(tuple, got), key=str)


def test_repeats_query(spark, small):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, small, "documents").collect()]
    assert sorted(map(tuple, queries.op12(spark, small).collect()), key=str) == plain_repeats(docs)


def made_texts(seed):
    """Passages of many lengths between own words: exact and near copies, pieces in smaller ids, one word throughout."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefgh", k=3))
    passage = [word() for _ in range(130)]
    texts = []
    for k in range(60):
        a = draw.randrange(0, 80)
        piece = passage[a : a + draw.choice([40, 45, 49, 50, 51, 60, 130])]
        if draw.random() < 0.3:
            piece = list(piece)
            piece[draw.randrange(len(piece))] = "edited"
        texts.append([word() for _ in range(draw.randrange(0, 40))] + piece + [word() for _ in range(draw.randrange(0, 40))])
    texts += [["same"] * n for n in (30, 49, 50, 51, 300)] + [passage * 2, passage, passage[:49]]
    texts += [list(texts[3]), [w if i % 70 else "new" for i, w in enumerate(passage * 3)], []]
    draw.shuffle(texts)
    return [draw.choice(["", " "]) + draw.choice([" ", "\n", " \t"]).join(words) for words in texts] + [None]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_of_made_texts(spark, frame, seed):
    texts = made_texts(seed)
    assert cut(spark, frame(texts)) == plain_repeats(list(enumerate(texts)))


def test_pieces_in_many_smaller_ids(spark, frame):
    """A passage is found although its seeds lead to hundreds of documents that hold less of it."""
    draw = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    own = lambda: [f"w{draw.random()}" for _ in range(20)]
    pieces = [own() + passage[k % 15 : k % 15 + 45] + own() for k in range(300)]
    texts = [" ".join(x) for x in pieces + [own() + passage + own() for _ in range(20)]]
    got = cut(spark, frame(texts))
    assert got == plain_repeats(list(enumerate(texts)))
    assert sum(r[2] == 60 for r in got) == 19


def test_repeats_of_odd_rows(spark, frame):
    passage = " ".join(f"p{i}" for i in range(55))
    texts = [passage, passage, passage, passage + " x", None, "", passage, "x " + passage]
    ids = [7, 7, None, 7, 9, 10, -3, 8]
    assert cut(spark, frame(texts, ids)) == plain_repeats(list(zip(ids, texts)))
    docs = frame(texts, ids, extra="text as t, 1 as runs, 2 as run_id, 3 as n_words, 4 as key, 5 as h")
    assert repeats.remove_shared(docs).columns == ["doc_id", "text", "t", "runs", "run_id", "key", "h", "n_words", "n_removed"]
    assert repeats.remove_shared(docs.limit(0)).count() == 0
    with pytest.raises(TypeError):
        repeats.remove_shared(docs.selectExpr("cast(doc_id as string) doc_id", "text"))


def test_long_texts(spark, frame):
    """One text of a million words and a copy of its end."""
    words = [f"w{i % 99_991}x{i % 13}" for i in range(1_000_000)]
    texts = [" ".join(words), "own " + " ".join(words[-5_000:]) + " own"]
    got = cut(spark, frame(texts, extra=""))
    assert [r[:3] for r in got] == [(0, 1_000_000, 0), (1, 5_002, 5_000)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000])
def test_popcounts(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert audit.popcounts(words).tolist() == [sum(int(w) >> i & 1 for w in words) for i in range(32)]


def test_meet_spreads_and_loses_nothing(spark):
    rows = spark.createDataFrame([(k, i) for k in range(50) for i in range(k)] + [(None, 1)], "k int, i int")
    table = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n")).where("k % 2 = 1")
    for share in (1, 30, 10_000):
        inner = common.meet(rows, table, ["k"], "n", share=share)
        assert inner.count() == sum(range(1, 50, 2)) and set(inner.columns) == {"k", "i", "n"}
        assert common.meet(rows, table, ["k"], "n", "left", share).count() == rows.count()


def plain_audit(docs, labels):
    def fails(text):
        words = [w.decode() for w in text.encode().split()]
        yield len(words) < 50
        yield 100 * len(set(words)) < 65 * len(words)
        yield 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text)
        yield any(c in "#$%&*|" for c in text)

    docs = [(i, part or "", text or "") for i, part, text in docs]
    first = {}
    for i, _, text in docs:
        if i is not None:
            first[text] = min(first.get(text, i), i)
    rows = [
        (part, {x for x, f in zip("ABCD", fails(text)) if f} | ({"E"} if i is not None and first[text] < i else set()), labels.get(i, (0, 0)))
        for i, part, text in docs
    ]
    out = []
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        found, shapley = [], collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                removed = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                failing = sum(x in r[1] for r in own)
                shapley[x] += len(removed)
                alone = sum(r[1] == {x} for r in own)
                lost = [sum(r[2][k] == 1 for r in removed) for k in range(2)]
                found.append((part, "".join(order), step, len(left), len(removed), failing - len(removed), alone, *lost, x))
        out += [(*f[:-1], shapley[f[-1]]) for f in found]
    return sorted(out)


AUDITED = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def audit_of(docs, labels):
    rows = audit.mark_repeats(common.written(audit.text_failures(docs), "failures"))
    rows = rows.join(labels, "doc_id", "left")
    counts = audit.survivors(rows, F.col("source"), {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})
    found = audit.order_effects(counts, {"good_lost": "good", "toxic_lost": "toxic"})
    return sorted(map(tuple, found.select(AUDITED).collect()))


def test_audit_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    texts = [long, long, long, None, "", "SHOUT # x", "a b", "a b", "é" * 50 + " A", " ".join(["w"] * 80), long + " $", "  \x0b ", long]
    ids = [5, 5, 3, 1, 2, 4, None, 9, 8, 7, 6, 10, None]
    parts = ["p", None, "", "q", "p", "q", "p", "p", None, "r", "r", "s", "p"]
    marks = {5: (1, 0), 3: (0, 1), 1: (1, 1), 4: (None, 1), 9: (1, None), 99: (1, 1)}
    docs = spark.createDataFrame(list(zip(ids, parts, texts)), "doc_id long, source string, text string")
    docs = docs.selectExpr("*", "1 as n", "2 as first_id", "3 as first_digest", "4 as fails", "5 as part", "6 as label")
    labels = spark.createDataFrame([(k, *v) for k, v in marks.items()], "doc_id long, quality int, toxic int")
    assert audit_of(docs, labels) == plain_audit(list(zip(ids, parts, texts)), marks)
    assert audit_of(docs.limit(0), labels) == []


def test_audit_query(spark, small, against_sql):
    got = queries.op13(spark, small)
    docs = [(r.doc_id, r.source, r.text) for r in queries.table(spark, small, "documents").collect()]
    labels = {r.doc_id: (r.quality, r.toxic) for r in queries.table(spark, small, "labels").collect()}
    assert sorted(map(tuple, got.select(AUDITED).collect())) == plain_audit(docs, labels)
    against_sql(small, got, queries.ORACLES["op13_filters"])
