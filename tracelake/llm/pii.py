"""Personal data in texts, also where it is disguised.

Plain identifiers are found in the text as it is. Then a transducer rewrites the text piece by piece: look-alike letters
and digits of other alphabets, digits spelled as words, and at and dot disguises become plain characters, and every
character put out remembers the source characters that it came from. Identifiers found in the rewritten text are mapped
back to spans of the source; those that meet no plain one of their kind are added.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a digit that follows another begins nothing: the match would have begun there
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Around every at sign: the longest run of name characters before it (not before the end of the last match) and
    the domain after it. Linear, as every character is looked at from one at sign on either side."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end(), "email"
            done = match.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def numbers(text: str) -> Iterator[Span]:
    if not DIGIT.search(text):
        return
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                yield *m.span(), "ip"
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield *m.span(), "card"
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(DIGIT.findall(m[0])) <= 15:
                yield *m.span(), "phone"


def plain(text: str) -> list[Span]:
    """Identifiers in a text as it is, by start and then kind."""
    found = [*emails(text), *numbers(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# ---- disguises: fixed values ----------------------------------------------------------------------------------------

DIGIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
OTHER_DIGITS = {"oh": "0", "null": "0"}
AT_WORDS, DOT_WORDS = ("at", "arobase", "arroba"), ("dot", "punkt", "punto", "point")
DASH_WORDS, PLUS_WORDS = ("dash", "hyphen", "minus"), ("plus",)
CYRILLIC = dict(zip("авеіјкмнорѕстухАВЕІЈКМНОРЅСТУХ", "abeijkmhopsctyxABEIJKMHOPSCTYX"))
GREEK = dict(zip("αεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeiknoptuxABEZHIKMNOPTYX"))
SIGNS = {"․": ".", "。": ".", "．": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "﹫": "@", "＠": "@"}
INVISIBLE = "​‌‍⁠﻿­"


def _look_alikes() -> dict[str, str]:
    """Single characters of other alphabets to the ASCII ones they look like."""
    out = {**CYRILLIC, **GREEK, **SIGNS, **{c: "" for c in INVISIBLE}, " ": " "}
    # full-width, mathematical, circled and other compatibility forms, and digits of other scripts, by their properties
    for block in (range(0x0660, 0x066A), range(0x06F0, 0x06FA), range(0x0966, 0x0970), range(0x2070, 0x209C), range(0x2460, 0x24EA), range(0xFF01, 0xFF5F), range(0x1D400, 0x1D800)):
        for number in block:
            plain_form = unicodedata.normalize("NFKC", chr(number))
            if not plain_form.isascii() and unicodedata.decimal(chr(number), None) is not None:
                plain_form = str(unicodedata.decimal(chr(number)))
            if len(plain_form) == 1 and plain_form.isascii():
                out.setdefault(chr(number), plain_form)
    return out


LOOK_ALIKES = _look_alikes()
# ranges that hold all of them: a class of single characters would be searched one by one
ODD = re.compile("[\xa0\xad\u0370-\u052f\u0660-\u096f\u2000-\u24ff\u3002\ufe6b\ufeff\uff01-\uff5e\U0001d400-\U0001d7ff]")

_words = lambda *groups: "|".join(w for g in groups for w in g)
_any_digit = _words(DIGIT_WORDS, OTHER_DIGITS)
# one step of the transducer: a disguise, with the blanks around it that it swallows
STEP = re.compile(
    rf"(?P<at>\s{{0,3}}(?:[\[({{<]\s{{0,3}}(?:{_words(AT_WORDS)}|@)\s{{0,3}}[\])}}>])\s{{0,3}})"
    rf"|(?P<dot>\s{{0,3}}(?:[\[({{<]\s{{0,3}}(?:{_words(DOT_WORDS)}|\.)\s{{0,3}}[\])}}>])\s{{0,3}})"
    rf"|(?P<wide_at>(?<=\S)\s{{1,3}}(?:{_words(AT_WORDS)})\s{{1,3}}(?=[A-Za-z0-9-]+(?:\s{{0,3}}[\[({{<]\s{{0,3}}|\s{{1,3}})(?:{_words(DOT_WORDS)})\b|[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?:[A-Za-z]{{2,63}}|xn--[A-Za-z0-9-]{{1,59}})\b))"
    rf"|(?P<wide_dot>(?<=[A-Za-z0-9])\s{{1,3}}(?:{_words(DOT_WORDS)})\s{{1,3}}(?=[A-Za-z0-9]))"
    rf"|(?P<spaced_at>(?<=[A-Za-z0-9])[ \t]{{1,3}}@[ \t]{{1,3}}(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])[ \t]{{1,3}}@(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])@[ \t]{{1,3}}(?=[A-Za-z0-9]))"
    rf"|(?P<digit>\b(?:{_any_digit})\b)"
    rf"|(?P<dash>(?<=[\s-])(?:{_words(DASH_WORDS)})(?=[\s-]))"
    rf"|(?P<plus>\b(?:{_words(PLUS_WORDS)})\s{{1,3}}(?=(?:{_any_digit}|[0-9])))",
    re.IGNORECASE,
)
DIGITS = {w: str(i) for i, w in enumerate(DIGIT_WORDS)} | OTHER_DIGITS
SIGN_OF = {"at": "@", "wide_at": "@", "spaced_at": "@", "dot": ".", "wide_dot": ".", "dash": "-", "plus": "+"}


# every alternative of a step holds one of these; most texts have none and are spared the longer search
MARKS = re.compile(rf"[@\[({{<]|\b(?:{_words(AT_WORDS, DOT_WORDS, DASH_WORDS, PLUS_WORDS)}|{_any_digit})\b", re.IGNORECASE)


def hinted(text: str) -> bool:
    """Whether a step of the transducer applies."""
    return MARKS.search(text) is not None and STEP.search(text) is not None


def _letters(text: str, starts: list[int], ends: list[int]) -> tuple[str, list[int], list[int]]:
    """Replace look-alikes. ``starts`` and ``ends`` give the source span of every character."""
    out, a, b, done = [], [], [], 0
    for m in ODD.finditer(text):
        at = m.start()
        out.append(text[done:at])
        a += starts[done:at]
        b += ends[done:at]
        new = LOOK_ALIKES.get(m[0], m[0])
        out.append(new)
        if new:
            a.append(starts[at])
            b.append(ends[at])
        done = m.end()
    out.append(text[done:])
    return "".join(out), a + starts[done:], b + ends[done:]


def _disguises(text: str, starts: list[int], ends: list[int]) -> tuple[str, list[int], list[int]]:
    """Replace at, dot, dash and digit words. A digit word next to another digit swallows one blank between them."""
    out, a, b, done = [], [], [], 0
    after_digit = -1
    for m in STEP.finditer(text):
        kind = m.lastgroup
        new = DIGITS[m[0].lower()] if kind == "digit" else SIGN_OF[kind]
        gap = text[done : m.start()]
        if kind == "digit" and after_digit == done and gap in (" ", "  ", ", ", "\n"):
            gap = ""
        if gap:
            out.append(gap)
            a += starts[done : m.start()]
            b += ends[done : m.start()]
        # blanks around a sign belong to no identifier's span unless it goes on over them
        out.append(new)
        a.append(starts[m.start()])
        b.append(ends[m.end() - 1])
        done = m.end()
        after_digit = done if kind == "digit" else -1
    out.append(text[done:])
    return "".join(out), a + starts[done:], b + ends[done:]


def normalised(text: str) -> tuple[str, list[int], list[int]] | None:
    """The rewritten text with the source start and end of each of its characters; None if nothing would change."""
    odd, hint = not text.isascii() and ODD.search(text) is not None, hinted(text)
    if not odd and not hint:
        return None
    found = (text, list(range(len(text))), list(range(1, len(text) + 1)))
    if odd:
        found = _letters(*found)
    if hint or hinted(found[0]):
        found = _disguises(*found)
    return found


def identifiers(text: str | None) -> tuple[list[Span], list[Span]]:
    """Plain identifiers, and all: the plain ones and those found behind disguises, by start and then kind."""
    if not text:
        return [], []
    base = plain(text)
    found = normalised(text)
    if found is None:
        return base, base
    changed, starts, ends = found
    added = []
    taken: dict[str, list[tuple[int, int]]] = {k: [(a, b) for a, b, kind in base if kind == k] for k in KINDS}
    for a, b, kind in plain(changed):
        a, b = starts[a], ends[b - 1]
        if not any(x < b and a < y for x, y in taken[kind]):
            added.append((a, b, kind))
        elif (a, b) not in taken[kind] and all(a <= x and y <= b for x, y in taken[kind] if x < b and a < y):
            # a disguised part beside a plain one: the whole is added, the plain span stays
            added.append((a, b, kind))
    return base, sorted({*base, *added}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written_out(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``found``: arrays of (start, end, kind) in characters of the source, end exclusive.
    Null texts have none. Columns of those names are replaced."""
    docs = docs.drop("base", "found")
    at = docs.columns.index(text)
    item = "array<struct<start:bigint,end:bigint,kind:string>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    names = [*docs.columns, "base", "found"]
    schema = docs.withColumns({n: F.lit(None).cast(item) for n in names[-2:]}).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                pairs = [identifiers(v.as_py()) for v in batch.column(at)]
                arrays = [pa.array([rows(p[k]) for p in pairs], kind) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=names)

    return docs.mapInArrow(work, schema)


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every identifier found replaced by its kind in angle brackets; overlapping ones by the first."""
    found = detect(docs, text)
    spans = F.filter("found", lambda s: F.lit(True))
    step = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(acc["out"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("<"), s["kind"], F.lit(">")).alias("out"),
            )
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), F.length(text))),
    )
    return found.withColumn(text, step).drop("base", "found")


def digests(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)``: counts of plain identifiers, the digest of
    their written form, and the written form of all."""
    kind = docs.schema[id].dataType.simpleString()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                pairs = [identifiers(v.as_py()) for v in batch.column(1)]
                counts = [pa.array([sum(s[2] == k for s in p[0]) for p in pairs], pa.int64()) for k in KINDS]
                base = pa.array([hashlib.sha256(written_out(p[0]).encode()).hexdigest() for p in pairs], pa.string())
                spans = pa.array([written_out(p[1]) for p in pairs], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), *counts, base, spans], names=names)

    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(work, schema)
