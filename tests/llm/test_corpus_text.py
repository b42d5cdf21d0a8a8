"""Tokens, personal data, models, shards and passages against public libraries, brute force or held-out rows."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from corpus_plain import frame, small  # noqa: F401 - fixtures
from tracelake.llm import bpe, lines, pii, quality, queries, shards, toxicity

PATH = public_tokenizers.path(queries.RANKS)
ODD_TEXTS = [None, "", " ", "\n\n  a", "don't  stop", "a" * 4000, " " * 3000, "é漢字🎉 ß́x", "x \ty", "​�", "1234 56,7", "\x00\x7f"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_bpe_query(spark, small, library):
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, small, "documents").collect()}
    for row in queries.op2(spark, small).collect():
        ids = library.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_bpe_random_texts(library):
    rng = random.Random(3)
    tokenizer = bpe.Tokenizer(bpe.read_ranks(PATH), public_tokenizers.PATTERN, most=50)
    tokenizer.encoder.most_states = 300  # the machine starts anew now and then
    whole = bpe.Tokenizer(bpe.read_ranks(PATH), public_tokenizers.PATTERN, joins=False)
    letters = "aeiou thsnr 0123 \n\t.,!'é漢字🎉ßñЖ́\xa0\x85\x1c"
    for k in range(1500):
        text = "".join(rng.choice(letters if k % 2 else letters[:12]) for _ in range(rng.randint(0, 60)))
        ids = library.encode_ordinary(text)
        assert tokenizer.encode(text) == whole.encode(text) == ids
        assert tokenizer.decoder.text(ids) == text


def test_utf8_machine():
    rng = random.Random(4)
    for _ in range(1500):
        data = bytes(rng.choice([0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x41, 0xC3, 0xA9, 0xED, 0xA0, 0xF4, 0x90, 0xC0]) for _ in range(9))
        cut = rng.randrange(10)
        state, first = bpe.Decoder.feed(b"", data[:cut])
        state, rest = bpe.Decoder.feed(state, data[cut:], True)
        assert (state, first + rest) == (b"", data.decode("utf-8", "replace"))


def test_bpe_edges(frame, library):
    docs = frame(ODD_TEXTS + ["same", "same"], extra="text as decoded, 1 as ids")
    back = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    for row in back.collect():
        assert row.decoded == (row.text or "") and row.ids == library.encode_ordinary(row.text or "")
    assert bpe.digests(frame([]), PATH, public_tokenizers.PATTERN).count() == 0


def plain_identifiers(text):
    found = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        double = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        if 14 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in double) % 10 == 0:
            found.append((*m.span(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_plain_identifiers():
    rng = random.Random(1)
    for _ in range(8000):
        letters = rng.choice(["a.@-", "1.25 -", "+1 23().-", "a1@.+ -0"])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert pii.plain(text) == plain_identifiers(text)


def test_pii_query(spark, small):
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, small, "documents").collect()}
    for row in queries.op4(spark, small).collect():
        spans = plain_identifiers(texts[row.doc_id])
        form = pii.written_out(spans)
        assert row.base_sha256 == hashlib.sha256(form.encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[2] == k for s in spans) for k in pii.KINDS]
        assert set(form.split(",")) <= set(row.spans.split(","))


@pytest.mark.parametrize(
    "text, hidden",
    [
        ("mail john.doe [at] example [dot] com now", "john.doe [at] example [dot] com"),
        ("or jane at mail dot example dot org please", "jane at mail dot example dot org"),
        ("to info(at)example(dot)com, thanks", "info(at)example(dot)com"),
        ("my аdmin@exаmple.com box", "аdmin@exаmple.com"),
        ("call +1 five five five two three four seven eight nine zero today", "+1 five five five two three four seven eight nine zero"),
        ("card ４１１１ 1111 1111 1111 ok", "４１１１ 1111 1111 1111"),
        ("host 192 dot 168 dot 0 dot 1 is", "192 dot 168 dot 0 dot 1"),
        ("a john​@example.com b", "john​@example.com"),
    ],
)
def test_disguises(text, hidden):
    base, found = pii.identifiers(text)
    assert hidden in [text[a:b] for a, b, _ in found]
    assert set(base) <= set(found)


@pytest.mark.parametrize(
    "text, hidden",
    [
        ("call plus 49 171 1234567 now", "plus 49 171 1234567"),
        ("call +1 555 dash 123 dash 4567 now", "+1 555 dash 123 dash 4567"),
        ("call +1 555 hyphen 123 minus 4567 now", "+1 555 hyphen 123 minus 4567"),
        ("call +49 30 12345 six", "+49 30 12345 six"),
        ("+1 five.five.five.two.three.four.seven.eight.nine.zero", "+1 five.five.five.two.three.four.seven.eight.nine.zero"),
        ("mail jane at host.uk ok", "jane at host.uk"),
        ("mail jane at mail.example.info ok", "jane at mail.example.info"),
        ("mail jane at host.xn--p1ai ok", "jane at host.xn--p1ai"),
    ],
)
def test_disguises_without_other_hints(text, hidden):
    assert hidden in [text[a:b] for a, b, _ in pii.identifiers(text)[1]]


def test_every_step_is_hinted():
    rng = random.Random(18)
    words = [*pii.DIGITS, *pii.AT_WORDS, *pii.DOT_WORDS, *pii.DASH_WORDS, *pii.PLUS_WORDS, "@", ".", "[", "]", "(", ")", "5", "host", "com", "UK"]
    for _ in range(20_000):
        text = "".join(rng.choice(words) + rng.choice(["", " ", " ", "  ", "-", ".", ", ", "\n", "\t"]) for _ in range(rng.randint(1, 6)))
        text = rng.choice([text, text.upper()])
        changed = pii._disguises(text, list(range(len(text))), list(range(1, len(text) + 1)))[0] != text
        assert pii.hinted(text) == (pii.STEP.search(text) is not None) and (pii.hinted(text) or not changed)


@pytest.mark.parametrize("text", ["look at this dot", "the one at home", "one two three", "heat at the end.", "é è à", "(at) [dot]"])
def test_clean_text_stays_clean(text):
    assert pii.identifiers(text) == ([], [])


def test_pii_edges(frame):
    texts = [None, "", "a@b.c", "x" * 100_000 + "@", "1" * 100_000, "1." * 50_000, "+1" + " " * 50_000, "a@b.c", "\U0001f600 a@b.c"]
    got = pii.detect(frame(texts, extra="text as base, 1 as found")).orderBy("doc_id").collect()
    assert [len(r.base) for r in got] == [0, 0, 1, 0, 0, 12_500, 0, 1, 1]
    assert (got[8].base[0].start, got[8].base[0].end) == (2, 7)
    masked = {r.doc_id: r.text for r in pii.masked(frame(texts)).collect()}
    assert masked[8] == "\U0001f600 <email>" and masked[0] is None and masked[1] == ""
    assert pii.digests(frame([])).count() == 0


def segments_by_definition(scores):
    """Maximal segments by splitting at the best segment, again and again."""
    if not len(scores) or max(scores) <= 0:
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    best = max(((sums[b] - sums[a], -(b - a), -a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)))
    a, b = -best[2], best[3]
    return segments_by_definition(scores[:a]) + [(a, b)] + [(x + b, y + b) for x, y in segments_by_definition(scores[b:])]


def test_maximal_segments():
    rng = random.Random(8)
    for _ in range(400):
        # sums of powers of two differ, so no ties leave a choice
        scores = [rng.choice([-1, 1]) * 2.0**-i for i in rng.sample(range(20), rng.randint(0, 12))]
        got = [(a, b) for a, b, _ in toxicity.maximal_segments(np.array(scores))]
        assert got == segments_by_definition(scores)


def held_out_scores(spark, sf_dir, name, label):
    rows = queries.QUERIES[name](spark, sf_dir).where("held_out").join(queries.table(spark, sf_dir, "labels"), "doc_id")
    return [(r[0], r[1], r[2]) for r in rows.select("score", "predicted", label).collect()]


def test_toxicity_held_out(spark):
    rows = held_out_scores(spark, "/root/testdata/sf0.1", "op3_toxicity", "toxic")
    toxic, clean = [s for s, _, y in rows if y == 1], [s for s, _, y in rows if y == 0]
    assert np.mean([(t > c) + (t == c) / 2 for t in toxic for c in clean]) > 0.95
    assert np.mean([p == y for _, p, y in rows]) > 0.96


def test_quality_held_out(spark):
    rows = held_out_scores(spark, "/root/testdata/sf0.01", "op7_quality", "quality")
    assert np.mean([p == y for _, p, y in rows]) > 0.95


def test_models_on_odd_texts(spark, frame):
    docs = frame([None, "", "fine words here", "vile vile awful", "fine words", "vile awful scum"] * 4, extra="1 as score, 2 as passages")
    labels = spark.createDataFrame([(i, int(i % 6 in (3, 5))) for i in range(24)] + [(None, 1), (3, None)], "doc_id long, bad int")
    training = toxicity.training_rows(labels, "bad", "doc_id", 4, 9, 100)
    model = toxicity.fit(docs, training, "doc_id", "text", sure=3.0)
    got = toxicity.score(docs, model).orderBy("doc_id").collect()
    assert got[3].score > got[2].score and got[0].score == got[1].score
    assert all(0 <= r.score <= 1 for r in got) and toxicity.score(docs.limit(0), model).count() == 0
    graded = quality.score(docs, quality.fit(docs, training)).orderBy("doc_id").collect()
    assert graded[3].score > graded[2].score and graded[0].score == graded[1].score
    nothing = toxicity.training_rows(labels.limit(0), "bad", "doc_id", 4, 9, 100)
    for scored in (toxicity.score(docs, toxicity.fit(docs, nothing, "doc_id", "text")), quality.score(docs, quality.fit(docs, nothing))):
        assert len({r.score for r in scored.collect()}) == 1
    odd = labels.selectExpr("doc_id", "bad + 2 as bad").union(labels)
    kept = toxicity.training_rows(odd, "bad", "doc_id", 4, 9, 100)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, training.collect()))
    twice = quality.fit(docs.union(docs), training)
    assert (twice.weights == quality.fit(docs, training).weights).all()


def test_scores_by_plain_loops(spark, frame):
    """Given models, scores are the formulas of the docstrings, computed word by word."""
    texts = ["vile awful day", "", "fine fine fine words here", "scum vile vile awful scum and more of it", None, "short"]
    docs, rng = frame(texts, extra=""), np.random.default_rng(3)
    weights = rng.normal(size=quality.BUCKETS)
    got = {r.doc_id: r.score for r in quality.score(docs, quality.Model(weights, 0.25)).collect()}
    for i, text in enumerate(texts):
        words = [w.encode() for w in (text or "").split()]
        held = [weights[b] for w in words for b in quality.features([w])[0]]
        held += [weights[quality.REPEATED]] * sum(4 for x, y in zip(words, words[1:]) if x == y)
        logit = 0.25 + (sum(held) / len(held) if held else 0)
        assert abs(got[i] - 1 / (1 + np.exp(-logit))) < 1e-9
    odds = np.round(rng.normal(-0.2, 1, toxicity.BUCKETS), 1)
    model = toxicity.Model(odds, 0.7, 0.4, 0.9, -1.5)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for i, text in enumerate(texts):
        words = toxicity.words_of(text)
        values = [max(odds[k] for k in toxicity.places(w)) for w in words]
        room = np.log(0.4 * max(1, len(words)))
        sums = [sum(values[a:b]) for a, b in segments_by_definition(values)]
        passages = [s for s in sums if np.exp(room - 0.7 * s) <= model.expect]
        evidence = 0.7 * max(max(sums, default=0.0), sum(passages)) - room
        assert abs(got[i].score - 1 / (1 + np.exp(-(0.9 * evidence - 1.5)))) < 1e-9
        assert sorted(round(p.segment, 6) for p in got[i].passages) == sorted(round(s, 6) for s in passages)


def test_held_out_by_crc(spark):
    rows = spark.createDataFrame([(i,) for i in (0, 7, 12345, None)], "id long")
    got = {r.id: r.h for r in rows.select("id", toxicity.held_out("id", 4, 2).alias("h")).collect()}
    assert got == {i: zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2 for i in got}


def shard_law(rows, count):
    totals = [sum(r["size"] for r in rows if r.shard == s) for s in range(count)]
    for s in range(count):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    return totals


def test_shards_query(spark, small):
    texts = {r.doc_id: r.text for r in queries.table(spark, small, "documents").collect()}
    rows = queries.op9(spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    totals = shard_law(rows, 8)
    assert max(totals) - min(totals) <= 2 * max(r["size"] for r in rows) + 0.1 * sum(totals) / 8
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    assert sum(len({r.shard for r in rows if texts[r.doc_id] == t}) > 1 for t in set(texts.values())) <= 7


def test_shards_edges(spark, frame, tmp_path):
    texts = ["same"] * 400 + [None, "", "x" * 500, "é"] + ["same"] * 300
    docs = frame(texts, ids=[i % 50 for i in range(len(texts))]).withColumn("size", shards.text_size(F.col("text")))
    docs = docs.withColumn("g0", F.lit(1)).withColumn("end", F.lit(2))
    for count in (1, 3, 8):
        placed = shards.assign(docs, "size", ["text", "doc_id"], ["text"], count)
        rows = placed.collect()
        assert len(rows) == len(texts) and set(docs.columns) - {"shard"} < set(placed.columns)
        totals = shard_law(rows, count)
        assert max(totals) - min(totals) <= 2 * 501
    shards.write(placed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(texts)
    assert shards.assign(docs.limit(0), "size", ["text"], ["text"]).count() == 0
    assert len(shards.assign(docs.limit(2), "size", ["text"], [], 8).collect()) == 2
    with pytest.raises(ValueError):
        shards.assign(docs, "size", ["text"], [], 0)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spark_hash(*values):
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed) if v is not None else seed
    return signed(seed)


def plain_chunks(words, size=50):
    """Chunks (hash, first window, last window) of a row of words with their blanks, those that own windows."""
    hashes = [spark_hash(w) for w in words]
    ends = lambda i: hashes[i] % lines.LINE_WORDS == 0 or "\n" in words[i] or words[i][-2:] in lines.CLOSING
    starts = [0, *(i + 1 for i in range(len(words) - 1) if ends(i)), len(words)]
    starts = [x for a, b in zip(starts, starts[1:]) for x in range(a, b, lines.LONGEST_LINE)] + [len(words)]
    line = [spark_hash(*hashes[x:y]) for x, y in zip(starts, starts[1:])]
    rolling = [spark_hash(x, y) for x, y in zip(line, line[1:])]
    low = [j for j in range(1, len(rolling)) if rolling[j] <= min(rolling[j - 1 : j + 2])]
    chunks, last = [], len(words) - size
    for j, k in zip(low, low[1:]):
        ends = starts[j - 1] - 1, (starts[k + 3] if k + 3 < len(starts) else len(words)) - size
        x, y = (max(min(f(ends), last), 0) for f in (min, max))
        chunks.append((spark_hash(*hashes[starts[j] : starts[k]]), x, y))
    out = []
    for i, (h, x, y) in enumerate(chunks):
        x = max([x, *(c[2] + 1 for c in chunks[max(0, i - lines.NEAR) : i] if c[0] <= h)])
        y = min([y, *(c[1] - 1 for c in chunks[i + 1 : i + 1 + lines.NEAR] if c[0] < h)])
        if x <= y:
            out.append((h, x, y))
    return out


def plain_removal(docs, size=50, share=0.8):
    """(id, text) rows to (id, text, removed) by loops over all chunks and windows."""
    texts = {hashlib.md5(t.encode()).digest(): t for _, t in docs if t and len(t) >= size}
    words = {r: re.split(lines.WORD_ENDS, t, flags=re.ASCII) for r, t in texts.items()}
    words = {r: w for r, w in words.items() if len(w) >= size}
    covers, windows, found = {}, {}, {}
    told = lambda r, a, b: (*words[r][a : b - 1], words[r][b - 1].rstrip(lines.BLANKS))
    for r, own in words.items():
        for h, x, y in plain_chunks(own, size):
            covers.setdefault((h, told(r, x, y + size)), []).append((r, x, y))
            for q in range(x, y + 1):
                windows.setdefault((h, told(r, q, q + size)), set()).add((r, q))
    for (h, _), places in covers.items():
        first, start, _ = min(places)
        for r, x, y in places:
            if (r, x) == (first, start) or (r == first and x < start + size):
                for q in range(x, y + 1):
                    keeper, at = min(windows[h, told(r, q, q + size)])
                    if keeper != r or q >= at + size:
                        found.setdefault((r, keeper), set()).update(range(q, q + size))
            else:
                found.setdefault((r, first), set()).update(range(x, y + size))

    def shingles(text):
        own = [w for w in re.split("[ \t-\r]+", text.translate({c: c + 32 for c in range(65, 91)})) if w]
        return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))}

    gone = {}
    for (r, keeper), places in found.items():
        x, y = shingles(texts[r]), shingles(texts[keeper])
        if r == keeper or len(x & y) < share * len(x | y):
            gone.setdefault(r, set()).update(places)
    out = []
    for id, text in docs:
        r = hashlib.md5(text.encode()).digest() if text else None
        new = "".join(w for i, w in enumerate(words[r]) if i not in gone[r]) if r in gone else text
        out.append((id, new, len(text or "") - len(new or "")))
    return out


def test_lines_query(spark, small):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, small, "documents").collect()]
    got = sorted(map(tuple, queries.op10(spark, small).collect()))
    assert got == sorted(plain_removal(docs))
    assert any(r[2] for r in got)


def passage(rng, sentences):
    return " ".join(" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(9)).capitalize() + "." for _ in range(sentences))


def test_lines_find_passages(frame):
    rng = random.Random(11)
    shared = passage(rng, 10)
    # in long documents, and in ones that are little more than the passage
    texts = [f"{passage(rng, 20 if i % 2 else 3)} some words {shared} {passage(rng, 20 if i % 2 else 3)}" for i in range(30)]
    clean = [passage(rng, 30) for _ in range(30)]
    copies = [passage(rng, 30)] * 5
    got = {r.doc_id: r for r in lines.remove_repeated(frame(texts + clean + copies)).collect()}
    assert sum(shared in got[i].text for i in range(30)) == 1
    assert sum(got[i].removed_chars > 200 for i in range(30)) == 29
    assert all(got[30 + i].text == t for i, t in enumerate(clean + copies))


def test_lines_edges(spark, frame):
    rng = random.Random(12)
    long = "\n".join(passage(rng, 1) for _ in range(3000))
    texts = [None, "", "short", long, long, "\n\n\n", "  ", long + " x"]
    docs = frame(texts + ["short"], ids=[None, 1, 2, 3, 3, 4, 5, 6, 2])
    got = lines.remove_repeated(docs)
    assert got.columns == [*docs.columns[:1], *[c for c in docs.columns[2:]], "text", "removed_chars"] or set(got.columns) == {*docs.columns, "removed_chars"}
    rows = got.collect()
    assert sorted(str(r.text) for r in rows) == sorted(str(t) for t in texts + ["short"])
    cut = lines.remove_repeated(docs, copy_share=1.1).where("doc_id in (3, 6)").collect()
    assert sorted(len(r.text) < 1000 for r in cut) in ([False, False, True], [False, True, True])
    assert lines.remove_repeated(frame([])).count() == 0


def test_lines_cut_copies_and_frames(frame):
    rng = random.Random(13)
    shared, body, tail = passage(rng, 8), passage(rng, 60), passage(rng, 1)
    # near copies that hold a passage of other documents, and pages with one header and footer round other bodies
    copies = [f"{body} some words {shared} {passage(rng, 1)} {tail}" for _ in range(3)]
    others = [f"{passage(rng, 20)} some words {shared} {passage(rng, 20)}" for _ in range(12)]
    head, foot = passage(rng, 14), passage(rng, 14)
    pages = [f"{head} {passage(rng, 12)} {foot}" for _ in range(6)]
    got = {r.doc_id: r for r in lines.remove_repeated(frame(copies + others + pages)).collect()}
    assert sum(shared in got[i].text for i in range(15)) <= 1
    assert all(body[200:-200] in got[i].text for i in range(3))
    assert sum(got[i].removed_chars > len(head + foot) / 2 for i in range(15, 21)) == 5


@pytest.mark.parametrize("border", ["word", "sentence", "short line", "no stops"])
def test_lines_find_short_passages_whole(frame, border):
    rng = random.Random(14)
    words = lambda n: ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]
    own = words(51)
    if border != "no stops":
        own = [w + "." if i % 9 == 4 else w for i, w in enumerate(own)]
    shared = (" ".join(own) + ".") if border == "sentence" else "\n".join(" ".join(own[i : i + 3]) for i in range(0, 51, 3)) if border == "short line" else " ".join(own)
    join = {"sentence": " ", "short line": "\n"}.get(border, " ")
    texts = []
    for _ in range(12):
        before, after = passage(rng, 8), passage(rng, 8)
        before, after = (before, after) if border in ("sentence", "short line") else (before + " tail " + " ".join(words(3)), " ".join(words(2)) + " on " + after)
        texts.append((before, after))
    got = {r.doc_id: r for r in lines.remove_repeated(frame([f"{a}{join}{shared}{join}{b}" for a, b in texts])).collect()}
    assert sum(shared in got[i].text for i in range(12)) == 1
    # all the others have lost exactly the passage
    assert sum(got[i].text in (f"{a}{join}{b}", f"{a} {b}") for i, (a, b) in enumerate(texts)) == 11


def test_lines_leave_fewer_words(frame):
    rng = random.Random(15)
    shared = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(49))
    texts = [f"{passage(rng, 8)} {rng.random()} {shared} {rng.random()} {passage(rng, 8)}" for _ in range(4)]
    assert all(r.text == texts[r.doc_id] and r.removed_chars == 0 for r in lines.remove_repeated(frame(texts)).collect())


def test_lines_repeat_within_a_document(frame):
    rng = random.Random(16)
    part = passage(rng, 7)
    texts = [" ".join([part, passage(rng, 3)] * 5), "ab " * 5000, passage(rng, 20)]
    got = {r.doc_id: r for r in lines.remove_repeated(frame(texts)).collect()}
    assert got[0].text.count(part) == 1 and 0 < len(got[1].text) < 200 and got[2].text == texts[2]


def test_chunks(frame):
    """Windows are owned as a plain loop finds them, each once, and by the same chunks behind another beginning."""
    rng = random.Random(17)
    text = passage(rng, 200)
    texts = [text, "another start\n " + text, " ".join(rng.choices("the of and in to is for on by it".split(), k=5000)), "one two", "x"]
    rows = frame(texts, extra="").select("doc_id", lines.chunks_of(F.col("text"), 50).alias("c")).orderBy("doc_id").collect()
    for text, row in zip(texts[:3], rows):
        words = re.split(lines.WORD_ENDS, text, flags=re.ASCII)
        assert [(c.h, c.q, c.q + c.n - 1) for c in row.c] == plain_chunks(words)
    owned = [q for c in rows[0].c for q in range(c.q, c.q + c.n)]
    assert len(owned) == len(set(owned)) > 0.98 * 1751 and len(rows[0].c) < 1800 / 12
    first, other = ({(c.h, c.s) for c in row.c} for row in rows[:2])
    assert len(first - other) <= 2


def test_lines_keep_one_whole_passage(frame):
    """Hundreds of documents hold parts of a passage that are too short, twenty hold it whole: it stays in one."""
    rng = random.Random(18)
    words = lambda n: ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]
    shared = words(60)
    texts = [" ".join(words(30) + shared[k % 15 : k % 15 + 45] + words(30)) for k in range(400)]
    texts += [" ".join(words(30) + shared + words(30)) for _ in range(20)]
    got = {r.doc_id: r for r in lines.remove_repeated(frame(texts)).collect()}
    assert sum(" ".join(shared) in got[i].text for i in range(400, 420)) == 1
    assert all(got[i].text == texts[i] for i in range(400))


def test_lines_without_blanks(frame):
    """Every character of such a script is a word."""
    rng = random.Random(19)
    text = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    shared = text(60)
    texts = [text(40) + shared + text(40), text(40) + shared + text(40), shared, text(70), "\u3042" * 40]
    got = sorted(map(tuple, lines.remove_repeated(frame(texts, extra="")).select("doc_id", "text", "removed_chars").collect()))
    assert got == sorted(plain_removal(list(enumerate(texts)))) and sum(shared in r[1] for r in got) == 1


def test_lines_shuffled_passages(frame):
    """Two long texts of the same passages in other orders: every passage is found at its own place."""
    rng = random.Random(20)
    parts = [passage(rng, 8) for _ in range(600)]
    other = rng.sample(parts, len(parts))
    got = lines.remove_repeated(frame([" ".join(parts), " ".join(other)], extra=""), copy_share=1.1).collect()
    sizes = sorted(len(r.text) for r in got)
    assert sizes[0] < 0.02 * sizes[1] and sizes[1] == len(" ".join(parts))


def test_lines_compute_values_once(spark):
    """Lists without their last value, and shares of common shingles, name what they are made of once."""
    made = F.transform(F.col("x"), lambda v: F.xxhash64(v))
    assert str(lines._whole(made)).count("xxhash64") == 1
    assert str(lines._copies(0.8, 5)).count("array_intersect") == 1


def test_lines_leave_out_what_stands_once(spark, frame):
    """Only keys of several places go on to be compared; copies of one text are one place."""
    rows = spark.createDataFrame([(b"a", 1, 0), (b"a", 1, 0), (b"a", 2, 0), (b"b", 2, 5), (b"c", 3, 1), (b"c", 3, 9)], "rid binary, h long, q int")
    assert {r.h for r in lines._at_two_places(rows, "h").collect()} == {2, 3}


def test_encoder_serves_the_tasks_that_follow(monkeypatch):
    """Tasks of one worker share a tokenizer; once it is idle its memory is given back."""
    monkeypatch.setattr(bpe, "IDLE_SECONDS", 0.2)
    monkeypatch.setattr(bpe, "_MADE", {})
    key = (public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN, 1000, 1000)
    with bpe.lent(*key) as first:
        ids = first.encode("one two")
    with bpe.lent(*key) as second:
        assert second is first and second.encode("one two") == ids
    time.sleep(1)
    assert not bpe._MADE
