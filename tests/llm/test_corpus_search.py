"""Near duplicates, decontamination, top-k and URL rules against brute force or SQL."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpus_plain import against_sql, frame, small  # noqa: F401 - fixtures
from tracelake.llm import common, queries, simhash, suffix, topk, urls


def plain_fingerprint(text):
    words = [w for w in simhash.WORD.findall((text or "").encode().translate(simhash.UPPER_TO_LOWER))]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, ids):
    label = list(range(len(fps)))
    for _ in fps:
        new = [min(label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(fps))]
        if new == label:
            break
        label = new
    return [min(ids[j] for j in range(len(fps)) if label[j] == label[i]) for i in range(len(fps))]


def test_simhash_query(spark, small):
    rows = queries.table(spark, small, "documents").select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    components = plain_components(fps, [r.doc_id for r in rows])
    expected = sorted((r.doc_id, f"{f:016x}", c) for r, f, c in zip(rows, fps, components))
    assert sorted(map(tuple, queries.op1(spark, small).collect())) == expected


def test_simhash_edges(spark, frame):
    texts = [None, "", "  \t\n", "One two", "oNe TWO", "a b c d", "a b c d", "é É x", "\U0001f600 z", "w " * 30000]
    docs = frame(texts, [5, 4, 3, 2, 9, 1, 1, 7, None, 8])
    got = simhash.with_components(simhash.members(docs)).collect()
    by = {(r.id, r.fp.hex()): r.component for r in got}
    assert len(got) == 10
    assert by[(5, "0" * 16)] == by[(4, "0" * 16)] == by[(3, "0" * 16)] == 3
    same = {r.component for r in got if r.id in (2, 9)}
    assert same == {2}
    assert simhash.with_components(simhash.members(frame([]))).count() == 0


@pytest.mark.parametrize("radius, fixed", [(3, 1), (3, 2), (3, 3), (5, 2)])
def test_masks_meet(radius, fixed):
    masks = simhash.block_masks(64, radius, fixed)
    rng = random.Random(1)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), radius):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def test_trees_cut_and_whole(spark):
    """A shard cut into many trees gives the components of one tree."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    flips = [(np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for _ in range(8)]
    codes = sorted({int(x) for f in flips for x in base ^ f} | set(map(int, base)))
    nodes = spark.createDataFrame([(c.to_bytes(8, "big"), 0, 0) for c in codes], "fp binary, tab int, key long")
    roots = []
    for cell in (7, 64, 100_000):
        edges = simhash.links(nodes, 3, cell)
        roots.append(sorted((bytes(r.node), bytes(r.root)) for r in common.components(edges).collect()))
    assert roots[0] == roots[1] == roots[2]
    assert len({r for _, r in roots[0]}) == 30 and len(roots[0]) == len(codes)


def test_components_of_chains(spark):
    rng = random.Random(4)
    names = rng.sample(range(10_000), 120)
    pairs = [(a, b) for part in (names[:90], names[90:]) for a, b in zip(part, part[1:])] + [(names[0], n) for n in names[1:60]]
    got = dict(map(tuple, common.components(spark.createDataFrame(pairs + pairs[:5], "a long, b long")).collect()))
    assert got == {n: min(names[:90]) for n in names[:90]} | {n: min(names[90:]) for n in names[90:]}


def test_similar_finds_near_copies(spark, frame):
    rng = random.Random(5)
    words = ["w%d" % i for i in range(3000)]
    texts, group = [], []
    for g in range(25):
        base = [rng.choice(words) for _ in range(300)]
        for copy in range(3):
            changed = list(base)
            for i in rng.sample(range(300), copy * 2):
                changed[i] = "x%d" % rng.randrange(10**6)
            texts.append(" ".join(changed))
            group.append(g)
    found = simhash.similar(frame(texts))
    roots = {r.id: bytes(r.root) for r in found.collect()}
    assert len(set(roots.values())) == 25
    assert all((roots[i] == roots[j]) == (group[i] == group[j]) for i in range(75) for j in range(75))
    kept = simhash.keep_one(frame(texts), found)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 75, 3))
    assert kept.columns == frame(texts).columns


def brute_hits(words, items, window):
    hit, names = set(), set()
    for item, own in items:
        parts = [own] if len(own) < window else [own[k : k + window] for k in range(len(own) - window + 1)]
        for part in parts:
            for k in range(len(words) - len(part) + 1):
                if part and words[k : k + len(part)] == part:
                    names.add(item)
                    hit.update(range(k, k + len(part)))
    return hit, names


def test_automaton_against_brute_force():
    rng = random.Random(6)
    for _ in range(600):
        window = rng.choice([2, 3, 4])
        letters = [b"a", b"b", b"c"][: rng.choice([2, 3])]
        items = [(str(i), [rng.choice(letters) for _ in range(rng.randint(0, 9))]) for i in range(rng.randint(0, 4))]
        words = [rng.choice([*letters, b"z"]) for _ in range(rng.randint(0, 25))]
        spans, names = suffix.Automaton(items, window).scan(words)
        assert ({i for a, b in spans for i in range(a, b)}, names) == brute_hits(words, items, window)


def test_decontamination_query(spark, small):
    docs = queries.table(spark, small, "documents").collect()
    items = [(str(r.item_id), suffix.words_of(r.text)) for r in queries.table(spark, small, "benchmark").collect()]
    got = {r.doc_id: r for r in queries.op8(spark, small).collect()}
    for doc in docs:
        words = suffix.words_of(doc.text)
        hit, names = brute_hits(words, items, 10)
        row = got[doc.doc_id]
        assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (len(words), len(hit), len(names), bool(hit))


def test_decontamination_edges(spark, frame):
    items = spark.createDataFrame(
        [(1, "one two three four"), (2, ""), (3, None), (1, "One, TWO! three-four"), (None, "lone"), (4, "x " * 30), (5, "é Ü ñ")],
        "item_id long, text string",
    )
    docs = frame([None, "", "say ONE two  three, four now", "a lone wolf", "x " * 12, "nothing", "é Ü ñ"])
    for size in (100_000, 8):
        got = [suffix.scan(docs, items, window=5, automaton_words=size).where(F.col("doc_id") == i).first() for i in range(7)]
        assert [(r.n_words, r.n_hit, r["items"]) for r in got] == [
            (0, 0, []), (0, 0, []), (6, 4, ["1"]), (3, 1, [""]), (12, 12, ["4"]), (1, 0, []), (3, 3, ["5"]),
        ]
        assert docs.collect()[2].text[got[2].spans[0].start : got[2].spans[0].end] == "ONE two  three, four"
    kept = {r.doc_id: r.text for r in suffix.remove(suffix.scan(docs, items, window=5)).collect()}
    assert kept == {0: None, 1: "", 2: "say now", 3: "a wolf", 5: "nothing"}
    assert suffix.scan(frame([]), items).count() == 0
    assert suffix.scan(docs, items.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_topk_query(spark, small, against_sql):
    against_sql(small, queries.op6(spark, small), queries.ORACLES["op6_topk"])


@pytest.mark.parametrize("block", [4, 1000])
def test_topk_edges(spark, block):
    rows = [(0, [1.0, 0.0]), (50, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 1.0])]
    rows += [(5, [None, 1.0]), (6, [float("inf"), 0.0]), (7, [0.0, -1.0]), (8, [1.0]), (7, [0.0, -1.0]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as q", "2 as code")
    got = topk.search(frame, F.col("vec_id") % 50 == 0, 3, block=block).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [
        (0, 1, 1, 65536), (0, 2, 2, 65536), (0, 3, 50, 32768), (50, 1, 0, 32768), (50, 2, 1, 32768), (50, 3, 2, 32768),
    ]
    assert topk.search(frame.limit(0), F.col("vec_id") % 50 == 0, 3).count() == 0


def test_cover_trees_against_all_pairs():
    rng = np.random.default_rng(2)
    for n, m, size in ((700, 300, 3), (900, 60, 16), (5, 3, 2), (1, 1, 4)):
        points = np.floor(rng.normal(0, 30, (n, size)))
        points[: n // 3] = points[0]
        asked = np.floor(rng.normal(0, 30, (m, size)))
        ids, names = rng.permutation(2 * n)[:n], rng.permutation(2 * n + m)[:m]
        best, who = topk.dual_search(topk.CoverTree(asked, 8, 4), topk.CoverTree(points, 8, 4), names, ids, 4)
        for i in range(m):
            order = sorted((-float(asked[i] @ points[j]), int(ids[j])) for j in range(n) if ids[j] != names[i])[:4]
            assert [(-s, w) for s, w in zip(best[i], who[i]) if s > -np.inf] == order


def test_url_query(spark, small, against_sql):
    against_sql(small, queries.op5(spark, small), queries.ORACLES["op5_urls"])


def test_url_edges(spark):
    rows = ["http://A.Example.ORG/en/12?x#y", "x://example.org/es/", "nourl", None, "", "://org", "https://org/", "h://com/fr/x://y", "h://b.com:80/de/"]
    rows += ["h://a.com/fr/1", "h://a.com/de/2", "h://notexample.org/en/1", "h://example.org/en/1", "h://example.org/en/1"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string")
    pages = pages.selectExpr("*", "1 as best", "'q' as host", "2 as digest", "3 as a", "'r' as rule")
    got = urls.judge(pages, urls.rule_table(spark, queries.URL_RULES)).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [
        ("a.example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "/es/", "example.org/es/", "block"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("org", "", None, "allow"), ("org", "/", "org/", "allow"),
        ("com", "/fr/x://y", "com/fr/", "allow"), ("b.com:80", "/de/", None, "allow"), ("a.com", "/fr/1", "com/fr/", "allow"),
        ("a.com", "/de/2", "com/de/", "block"), ("notexample.org", "/en/1", "org/", "allow"),
        ("example.org", "/en/1", "example.org/en/1", "block"), ("example.org", "/en/1", "example.org/en/1", "block"),
    ]
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in urls.judge(pages, none, default="block").collect()} == {"block"}
    odd = spark.createDataFrame([(None, "/", "block"), ("org", None, "block"), ("ORG", "", "allow")], "host string, path string, verdict string")
    assert urls.judge(pages, odd).where("page_id = 5").first().verdict == "block"
    assert urls.judge(pages.limit(0), none).count() == 0


def pairs_of_overlap(overlap, count, size, seed):
    """Pairs of texts whose sets of five-word shingles overlap by ``overlap`` or a little more, with edits anywhere."""
    rng = random.Random(seed)
    made = []
    while len(made) < count:
        words = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(size)]
        other, sets = list(words), shingle_set(words)
        places = rng.sample(range(5, size - 5), size - 10)
        best = None
        for at in places:
            other[at] = "x" + "".join(rng.choices("klmnop", k=6))
            own = shingle_set(other)
            share = len(sets & own) / len(sets | own)
            if share < overlap:
                break
            best = (" ".join(words), " ".join(other), share)
        if best and best[2] < overlap + 0.012:
            made.append(best)
    return made


def shingle_set(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


@pytest.mark.parametrize("overlap, linked", [(0.78, False), (0.80, True), (0.82, True)])
def test_near_duplicates_at_the_limit(frame, overlap, linked):
    """Every pair at the limit is linked, none below it is."""
    pairs = pairs_of_overlap(overlap, 200, 400, int(100 * overlap))
    texts = [t for a, b, _ in pairs for t in (a, b)]
    roots = {r.id: r.root for r in simhash.similar(frame(texts, extra="")).collect()}
    found = sum(roots[2 * i] == roots[2 * i + 1] for i in range(200))
    assert found >= 199 if linked else found == 0
    assert len(set(roots.values())) == 400 - found


def test_near_duplicates_by_brute_force(spark, frame):
    """Groups, chains, copies and odd texts: the components of all pairs whose sets overlap enough."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    texts = [None, "", "  ", "one", "One", "one two three four five", "ONE two three four five six", "a a a a a a", "a a a a a a a a a"]
    for size in (40, 120, 700):
        for _ in range(6):
            base = [word() for _ in range(size)]
            texts.append(" ".join(base))
            for _ in range(5):
                # a walk: each step is near the one before, not always the first
                base = [w if rng.random() > 0.02 else word() for w in base]
                texts.append(rng.choice([" ", "\n"]).join(base))
    texts += [texts[20]] * 4 + [(texts[30] + " ") * 3]
    got = {r.id: r.root for r in simhash.similar(frame(texts)).collect()}

    def shingles(text):
        words = (text or "").encode().translate(simhash.UPPER_TO_LOWER).split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    alike = lambda f: {(i, j) for i in range(len(texts)) for j in range(i) if f(i) == f(j)}
    assert alike(got.get) == alike(label.__getitem__)


def test_confirmed_labels_ask_little():
    """Pairs of one group are not all asked; pairs that do not hold join nothing."""
    asked = []

    def holds(i, j):
        asked.append((i, j))
        return i // 50 == j // 50

    a, b = np.triu_indices(100, 1)
    label = simhash.confirmed_labels(100, [(a, b)], holds)
    assert label.tolist() == [0] * 50 + [50] * 50
    assert len(asked) < 2500 + 400
