"""Removal of repeated passages, found by content-defined chunks of lines, in DataFrame expressions only.

A line ends at a line break, behind a word with a closing mark, and behind every word whose hash says so, so prose of any
layout has short lines. A rolling hash runs over the hashes of two lines; where it is least among its neighbours, a chunk
begins. Such borders depend on the nearest lines only. Of the chunks that a window of passage length holds together with
those lines, the one with the least hash owns the window, so equal windows are owned by equal chunks, wherever they
stand. Chunks meet globally, each with the hash of all that its windows cover. Texts that agree on the whole of it repeat
each other there; where one chunk covers different words, its windows are laid open and looked up one by one, so the text
that keeps a passage always holds the whole of it. Windows that match go together to runs, runs are compared with what is
kept byte by byte, and then they go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import inner_names, meet, shingles_of, written

BLANKS = " \t\n\x0b\f\r"
# scripts that set no blanks: every character is a word
UNSPACED = "[฀-໿က-႟ក-៿぀-ヿ㐀-鿿]"
BLANK_ENDS = r"(?<=\s)(?=\S)"
WORD_ENDS = rf"{BLANK_ENDS}|(?<={UNSPACED})(?=\S)"
#: ends of words that end a line, as does a line break
CLOSING = [mark + " " for mark in ".!?,;:"]
#: one in so many words ends a line whatever it is
LINE_WORDS = 3
#: words of a line in which nothing ends it
LONGEST_LINE = 32
#: words of a line that are hashed one by one
FEW = 5
#: chunks to either side that a chunk is compared with; where more share a window, more than one may own it
NEAR = 8


def words_of(text: Column) -> Column:
    """The words of a text with all blanks behind them: joined they are the text."""
    spaced = (F.octet_length(text) == F.length(text)) | ~F.rlike(text, F.lit(UNSPACED))
    return F.when(spaced, F.split(text, BLANK_ENDS)).otherwise(F.split(text, WORD_ENDS))


def bare(word: Column) -> Column:
    return F.rtrim(word, F.lit(BLANKS))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _whole(pairs: Column) -> Column:
    """All values but the last."""
    # a let: the values are not computed once more for their number
    return let(pairs, lambda p: F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))))


def _next(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """``join`` of every value and the one behind it, null behind the last."""
    return F.zip_with(values, F.slice(values, 2, F.size(values)), join)


def chunks_of(text: Column, size: int) -> Column:
    """Chunks that own windows of ``size`` words, as structs: hash ``h`` of the chunk, first window ``q``, how many there
    are ``n``, and hash ``s`` of the bytes they cover."""

    def of(words: Column, hashes: Column) -> Column:
        def start(word: Column, i: Column) -> Column:
            """Number of the word behind one that ends a line."""
            chosen = F.pmod(F.get(hashes, i), F.lit(LINE_WORDS)) == 0
            ends = chosen | F.substring(word, -2, 2).isin(CLOSING) | F.contains(word, F.lit("\n"))
            return F.when(ends, i + 1)

        count = F.size(words)
        starts = F.filter(F.transform(words, start), lambda i: i < count)
        starts = F.concat(F.array(F.lit(0)), starts, F.array(count))
        short = lambda a, b: F.sequence(a, F.greatest(F.coalesce(b, a) - 1, a), F.lit(LONGEST_LINE))
        longest = lambda s: F.array_max(_next(s, lambda a, b: b - a))
        all_short = lambda s: F.concat(_whole(F.flatten(_next(s, short))), F.array(count))
        cut_short = let(starts, lambda s: F.when(longest(s) > LONGEST_LINE, all_short(s)).otherwise(s))
        return let(cut_short, lambda s: let(borders(hashes, s), lambda c: let(chunked(words, hashes, s, c), lambda x: owning(words, hashes, x))))

    def span(values: Column, a: Column, b: Column) -> Column:
        return F.xxhash64(F.slice(values, a + 1, F.greatest(b - a, F.lit(0))))

    def line(hashes: Column, a: Column, b: Column) -> Column:
        """The hash of a line. Most are of few words: nulls add nothing, so their words are named without a slice."""
        few = [F.get(hashes, a)] + [F.when(b > a + i, F.get(hashes, a + i)) for i in range(1, FEW)]
        return F.when(b - a <= FEW, F.xxhash64(*few)).otherwise(span(hashes, a, b))

    def borders(hashes: Column, starts: Column) -> Column:
        """Numbers of the lines at which chunks begin."""
        lines = _whole(_next(starts, lambda a, b: F.when(b.isNotNull(), line(hashes, a, b))))
        rolling = let(lines, lambda x: _whole(_next(x, lambda p, q: F.xxhash64(p, q))))

        def least(r: Column) -> Column:
            low = lambda x, j: (x <= F.get(r, j - 1)) & F.coalesce(x <= F.get(r, j + 1), F.lit(True))
            return F.filter(F.transform(r, lambda x, j: F.when(low(x, j), j)), lambda j: j.isNotNull())

        return let(rolling, least)

    def chunked(words: Column, hashes: Column, starts: Column, borders: Column) -> Column:
        """Chunks with the first and the last window that holds them and the lines that their borders depend on."""
        last = F.size(words) - size
        inside = lambda q: F.greatest(F.least(q, last), F.lit(0))

        def chunk(j: Column, k: Column) -> Column:
            a, b = F.get(starts, j), F.get(starts, k)
            before, behind = F.get(starts, j - 1) - 1, F.coalesce(F.get(starts, k + 3), F.size(words)) - size
            return F.struct(
                F.when(k.isNotNull(), span(hashes, a, b)).alias("h"),
                inside(F.least(before, behind)).alias("low"),
                inside(F.greatest(before, behind)).alias("high"),
            )

        return _whole(_next(borders, chunk))

    def owning(words: Column, hashes: Column, chunks: Column) -> Column:
        def own(x: Column, k: Column) -> Column:
            # first and last windows grow along the text: of the chunks with smaller hashes the nearest one counts
            at = lambda d: F.get(chunks, k + d)
            left = F.coalesce(*(F.when(at(-d)["h"] <= x["h"], at(-d)["high"] + 1) for d in range(1, NEAR + 1)), x["low"])
            right = F.coalesce(*(F.when(at(d)["h"] < x["h"], at(d)["low"] - 1) for d in range(1, NEAR + 1)), x["high"])
            return F.struct(x["h"].alias("h"), F.greatest(x["low"], left).alias("q"), F.least(x["high"], right).alias("last"))

        def told(x: Column) -> Column:
            end = x["last"] + (size - 1)
            cover = F.xxhash64(F.slice(hashes, x["q"] + 1, end - x["q"]), bare(F.get(words, end)))
            return F.struct(x["h"], cover.alias("s"), x["q"], (x["last"] - x["q"] + 1).alias("n"))

        return F.transform(F.filter(F.transform(chunks, own), lambda x: x["q"] <= x["last"]), told)

    # blanks belong to their words; a chunk is followed by two lines, so its last word stands as it does elsewhere
    return let(words_of(text), lambda words: let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: of(words, h)))


def windows_of(rows: DataFrame, size: int) -> DataFrame:
    """The windows of some chunks, ``rows (rid, text, chunks)``: hash ``h`` of the chunk, first word ``q``, and hash ``x``
    of the bytes. Words are cut once a text; windows are rows, not elements, so their hashes are compiled."""
    rows = rows.select("rid", words_of(F.col("text")).alias("words"), "chunks")
    rows = rows.select("rid", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"), "chunks")
    rows = rows.select("rid", "words", "hashes", F.explode("chunks").alias("c"))
    rows = rows.select("rid", "words", "hashes", "c.h", F.explode(F.expr("sequence(c.q, c.q + c.n - 1)")).alias("q"))
    # blanks behind the last word do not count
    inner, end = F.slice("hashes", F.col("q") + 1, F.lit(size - 1)), bare(F.get("words", F.col("q") + (size - 1)))
    return rows.select("rid", "h", F.xxhash64(inner, end).alias("x"), "q")


def runs_of(found: Column, size: int) -> Column:
    """Pieces ``(shift, a, b)`` as runs ``(a, b, shift)``: windows that follow one another at one shift go together."""

    def of(s: Column) -> Column:
        before = lambda i, name: F.get(s, i - 1)[name]
        here = lambda i, name: F.get(s, i)[name]
        opens = lambda i: (i == 0) | (before(i, "shift") != here(i, "shift")) | (here(i, "a") > before(i, "b") - size + 1)
        firsts = F.concat(F.filter(F.sequence(F.lit(0), F.size(s) - 1), opens), F.array(F.size(s)))
        run = lambda i, j: F.struct(here(i, "a").alias("a"), F.get(s, j - 1)["b"].alias("b"), here(i, "shift").alias("shift"))
        return let(firsts, lambda f: _whole(_next(f, run)))

    return let(F.array_sort(found), of)


def remove_repeated(
    docs: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    passage_words: int = 50,
    copy_share: float = 0.8,
    shingle_words: int = 5,
) -> DataFrame:
    """``docs`` without the repeats of passages; column ``removed_chars`` (long) tells how much went.

    A passage is a run of ``passage_words`` words or more that two different texts share byte by byte, or that a text
    repeats behind itself. It stays in the text with the smallest digest (in one text: where it stands first) and goes
    from all others. A passage is seen if it holds a chunk, about 10 words, with a line before and two behind it.

    Rows of equal texts are copies of one document and get equal results: a copy is not cut because of the other. So is
    a text whose set of ``shingle_words``-word shingles overlaps with another's by ``copy_share`` or more: what it shares
    with that one is left for an operator that finds near duplicates, passages that stay in other texts go from it as
    well. Use a share above 1 to cut near copies, too.

    Null, empty and shorter texts stay as they are; an empty table gives no rows. A very long text is one row; its
    chunks and windows are ordinary rows. A column named removed_chars is replaced, all others stay; ``id`` is not used
    but to be named like in other operators.

    Only hashes travel until it is known which texts share a chunk. What many rows share is met by broadcast.
    """
    docs = docs.drop("removed_chars")
    rid, drops = inner_names(docs, "rid", "drops")
    marked = docs.withColumn(rid, F.unhex(F.md5(F.col(text))))
    size = passage_words
    own = marked.select(F.col(rid).alias("rid"), F.col(text).alias("text")).where(F.length("text") >= size)
    chunks = own.select("rid", F.explode(chunks_of(F.col("text"), size)).alias("c")).select("rid", "c.h", "c.s", "c.q", "c.n")
    chunks = written(chunks, "chunks")
    # in monotonous texts a chunk may own so many windows that they repeat one another
    many = written(chunks.where(F.col("n") > size).select("rid", F.struct("h", "q", "n").alias("c")), "many")
    place, fields = F.struct("rid", "q"), ["h", "s", "first", "rows"]
    chunks = written(_at_two_places(chunks, "h"), "shared")
    covers = chunks.groupBy("h", "s").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("rows"))
    covers = written(covers, "covers")
    several = covers.groupBy("h").agg(F.count("*").alias("covers"), F.min("first").alias("least"), F.max("last").alias("most"))
    several = written(several.where("covers > 1 and least != most").select("h", "covers"), "several")
    # what stands at more than one place, and chunks of which different words stand around
    met = meet(covers, several, ["h"], "covers", how="left").where("first != last or covers is not null")
    met = written(met.select(*fields, F.col("covers").isNotNull().alias("open")), "met")
    kept = written(meet(chunks, met, ["h", "s"], "rows").select("rid", "h", "q", "n", "first", "open"), "kept")
    # a place that overlaps the kept one in the same text is looked at by windows
    beside = F.expr(f"rid = first.rid and q > first.q and q < first.q + {size}")
    is_first = F.struct("rid", "q") == F.col("first")
    piece = lambda a, b, keeper: F.struct((F.col("q") - F.col(f"{keeper}.q")).alias("shift"), a.alias("a"), b.alias("b"))
    whole = kept.where(~is_first & ~beside).select(
        "rid", F.col("first.rid").alias("from"), piece(F.col("q"), F.col("q") + F.col("n") + (size - 1), "first").alias("piece")
    )
    # and so is the kept one, which covers the same
    opens = kept.where((is_first & F.col("open")) | beside).select("rid", F.struct("h", "q", "n").alias("c"))
    opens = opens.union(kept.where(beside).select("rid", F.struct("h", F.col("first.q").alias("q"), "n").alias("c")))
    chosen = opens.union(many).groupBy("rid").agg(F.collect_set("c").alias("chunks"))
    # one row for all copies of a text
    used = kept.where("open or first.rid != rid or q > first.q").select("rid").union(kept.select("first.rid"))
    used = written(used.union(many.select("rid")).distinct(), "used")
    texts = own.join(used, "rid", "left_semi").groupBy("rid").agg(F.first("text").alias("text"))
    texts = written(texts, "texts")
    opened = written(windows_of(texts.join(chosen, "rid"), size), "windows")
    opened = written(_at_two_places(opened, "x"), "repeats")
    twice = opened.groupBy("h", "x").agg(F.min(place).alias("keeper"), F.max(place).alias("most"), F.count("*").alias("n"))
    twice = written(twice.where("keeper != most").drop("most"), "keepers")
    found = meet(opened, twice, ["h", "x"], "n").where(f"rid != keeper.rid or q >= keeper.q + {size}")
    single = found.select("rid", F.col("keeper.rid").alias("from"), piece(F.col("q"), F.col("q") + size, "keeper").alias("piece"))
    pairs = whole.union(single).groupBy("rid", "from").agg(F.collect_set("piece").alias("pieces"))
    pairs = written(pairs.select("rid", "from", runs_of(F.col("pieces"), size).alias("runs")), "pairs")
    both = pairs.join(texts.withColumnRenamed("text", "own"), "rid")
    both = both.join(texts.select(F.col("rid").alias("from"), F.col("text").alias("other")), "from")
    inner = lambda words, a, b: F.slice(words, a + 1, b - a - 1)
    end = lambda words, b: bare(F.get(words, b - 1))
    alike = lambda x, y, a, b, shift: (end(x, b) == end(y, b - shift)) & (inner(x, a, b) == inner(y, a - shift, b - shift))
    same = lambda x, y, run: alike(x, y, run["a"], run["b"], run["shift"])
    cuts = let(words_of(F.col("own")), lambda x: let(words_of(F.col("other")), lambda y: F.filter("runs", lambda run: same(x, y, run))))
    # no condition on the cuts: they would be computed for it and once more
    lists = both.where((F.col("rid") == F.col("from")) | ~_copies(copy_share, shingle_words)).select("rid", cuts.alias("cuts"))
    lists = lists.groupBy("rid").agg(F.array_sort(F.flatten(F.collect_list("cuts"))).alias("picks"))
    # in order, equal runs are neighbours
    single = let(F.col("picks"), lambda p: F.filter(p, lambda run, i: (i == 0) | (run != F.get(p, i - 1))))
    lists = written(lists.select("rid", single.alias("picks")), "lists")
    joined = _with_lists(marked, rid, lists, drops)
    some = F.col(drops).isNotNull()
    name = inner_names(joined, "_cut")[0]
    # of runs in the order of their starts, each adds what goes on behind all before it: the words between are kept
    kept = F.transform(
        F.array(F.struct(words_of(F.col(text)).alias("w"), F.col(drops).alias("p"))),
        lambda x: F.aggregate(
            x["p"],
            F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
            lambda acc, p: F.struct(
                F.greatest(acc["at"], p["b"]).alias("at"),
                F.concat(acc["out"], F.array(F.array_join(F.slice(x["w"], acc["at"] + 1, F.greatest(p["a"] - acc["at"], F.lit(0))), ""))).alias("out"),
            ),
            lambda acc: F.concat(F.array_join(acc["out"], ""), F.array_join(F.slice(x["w"], acc["at"] + 1, F.size(x["w"])), "")),
        ),
    )
    out = joined.withColumn(name, F.when(some, F.element_at(kept, 1)).otherwise(F.col(text)))
    out = out.withColumn("removed_chars", (F.coalesce(F.length(text) - F.length(name), F.lit(0))).cast("long"))
    return out.withColumn(text, F.col(name)).drop(name, rid, drops)


def _at_two_places(rows: DataFrame, key: str) -> DataFrame:
    """Those of ``rows (rid, q, ...)`` whose ``key`` stands at two places or more, told by 64-bit hashes of the places."""
    spot = F.xxhash64("rid", "q")
    several = rows.groupBy(key).agg(F.min(spot).alias("least"), F.max(spot).alias("most"), F.count("*").alias("rows"))
    several = written(several.where("least != most").select(key, "rows"), "several")
    return meet(rows, several, [key], "rows").select(*rows.columns)


def _copies(share: float, words: int) -> Column:
    """Whether the sets of shingles of ``own`` and ``other`` overlap by ``share``; sets are only made of texts that could."""

    def overlap(x: Column, y: Column) -> Column:
        enough = lambda both: both >= F.lit(share) * (F.size(x) + F.size(y) - both)
        return let(F.size(F.array_intersect(x, y)), enough)

    sets = lambda name: F.array_distinct(shingles_of(F.col(name), words))
    # characters per word differ little between texts that share most of them
    near = F.least(F.length("own"), F.length("other")) >= F.lit(share * share / 2) * F.greatest(F.length("own"), F.length("other"))
    return F.when(near, let(sets("own"), lambda x: let(sets("other"), lambda y: overlap(x, y)))).otherwise(F.lit(False))


def _with_lists(marked: DataFrame, rid: str, lists: DataFrame, drops: str) -> DataFrame:
    key = inner_names(marked, "key")[0]
    lists = lists.select(F.col("rid").alias(key), F.col("picks").alias(drops))
    return marked.join(lists, F.col(rid) == F.col(key), "left").drop(key)
