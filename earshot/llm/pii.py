"""Personal data, also where it is disguised, with spans of the original text.

Plain identifiers are found by four patterns. Then two transducers rewrite a text and
keep, for each character they write, the span it was read from: the first drops
invisible characters and writes look-alike letters and digits as ASCII, the second
writes spelled digits as digits and ``(at)`` and ``dot`` as signs. The same patterns
run on the rewritten text, and what they find is mapped back and added.

Cases: a null text counts as empty and has no spans; a disguise inside a plain span
adds nothing; a repeated row gets its own result; extra columns pass through, and
those named like a result give way to it. Texts are worked on whole, and the time is in
proportion to their length.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, insort
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from earshot.llm import arrow

KINDS = ("email", "ip", "card", "phone")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits does.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

# Letters that look like Latin ones, the words for digits, for dots and for "at".
_ALIKE = dict(zip(
    "абвеіјкмнорсѕтухԁԛԝһАВЕІЈКМНОРСЅТУХαβγεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "abbeijkmhopcstyxdqwhABEIJKMHOPCSTYXabyeiknoptuxABEZHIKMNOPTYX",
))
_INVISIBLE = "­​‌‍⁠﻿"
_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6",
    "siete": "7", "ocho": "8", "nueve": "9",
}

_WORD = "(?:" + "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True)) + ")"
_OPEN, _SHUT = r"[(\[{<]", r"[)\]}>]"
_DOT_WORD = r"(?:dot|punkt|point|punto)"
_AT_WORD = r"(?:at|ät|arroba|arobase)"
_BRACKETED = rf"\s{{0,9}}{_OPEN}\s{{0,9}}(?:{_DOT_WORD}|\.)\s{{0,9}}{_SHUT}\s{{0,9}}"
_DOT = rf"{_BRACKETED}|(?<=[\w)])\s{{1,9}}{_DOT_WORD}\s{{1,9}}(?=\w)|(?<=[A-Za-z0-9])[。｡](?=[a-z0-9])"
#: A bare "at" (or its like) is only a sign before a domain that is spelled out: to any ending after a
#: bracketed dot or a "dot" that isn't a noun, and to one of these after "point", "punkt"
#: and "punto" ("at this point in").
_TOP = "(?:com|org|net|edu|gov|info|io|co|eu|uk|us|de|at|ch|fr|be|ca|es|mx|it|nl|pl|ru|example|test)"
_NOUN = (
    r"(?:the|an?|this|that|these|those|each|every|any|some|one|no|its|his|her|their|my|our|your|which|what)\s{1,9}dot\b"
)
_LABEL = "[A-Za-z0-9-]{1,63}"
_DOMAIN_AHEAD = (
    rf"(?=(?:{_LABEL}(?:{_DOT})){{1,4}}{_TOP}\b"
    rf"|(?!{_NOUN})(?:{_LABEL}(?:{_DOT})){{0,3}}{_LABEL}(?:{_BRACKETED}|\s{{1,9}}dot\s{{1,9}})[a-z]{{2,63}}\b)"
)
_DISGUISES = {
    "digits": rf"(?P<digits>(?<!\w){_WORD}(?:[\s,-]{{1,3}}{_WORD})*(?!\w))",
    "plus": rf"(?P<plus>(?<!\w)plus\s{{1,9}}(?=[0-9]|{_WORD}\b))",
    "signs": rf"(?P<at>\s{{0,9}}{_OPEN}\s{{0,9}}(?:{_AT_WORD}|@)\s{{0,9}}{_SHUT}\s{{0,9}}|\s{{1,9}}{_AT_WORD}\s{{1,9}}{_DOMAIN_AHEAD})"
    rf"|(?P<dot>{_DOT})",
}
_EACH_WORD = re.compile(_WORD, re.IGNORECASE)
_SIGN = re.compile(rf"{_OPEN}\s{{0,9}}(?:{_AT_WORD}|@|\.|{_DOT_WORD})\s{{0,9}}{_SHUT}|[A-Za-z0-9][。｡][a-z0-9]", re.IGNORECASE)
#: Runs of the letters that the words of the disguises are made of.
_RUN = re.compile("[" + "".join(sorted(set("".join(_DIGIT_WORDS) + "abcdefghijklmnopqrstuvwxyz"))) + "]+")
_DOT_WORDS = frozenset(("dot", "punkt", "point", "punto"))
#: Letters that ignoring case equates with ASCII ones, though lower() doesn't.
_CASELESS = {0x130: "i", 0x131: "i", 0x17F: "s"}

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for at, char in enumerate(reversed(digits)):
        value = int(char) * (1 + at % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost matches by their ``@``: no run of letters is read twice."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and _LOCAL.match(text, first - 1):
            first -= 1
        domain = _DOMAIN.match(text, at + 1) if first < at else None
        if domain:
            done = domain.end()
            out.append(("email", first, done))
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))
    return out


def plain(text: str) -> list[Span]:
    """Undisguised identifiers, by kind as in ``KINDS``, then start."""
    out = _emails(text)
    for m in _IP.finditer(text) if "." in text else ():
        if all(int((p.lstrip("0") or "0")[:4]) <= 255 for p in m.groups()):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0]) if m.end() - m.start() >= 13 else ""
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def _ascii(char: str) -> str:
    """What the first transducer writes for a character."""
    if char in _INVISIBLE:
        return ""
    if char in _ALIKE:
        return _ALIKE[char]
    flat = unicodedata.normalize("NFKC", char)
    if len(flat) == 1 and "!" <= flat <= "~":
        return flat
    digit = unicodedata.decimal(char, None)
    return char if digit is None else str(digit)


_WRITES: dict[str, str] = {}


def _written(char: str) -> str:
    if char not in _WRITES:
        _WRITES[char] = char if char.isascii() else _ascii(char)
    return _WRITES[char]


def _digit(word: str) -> str:
    low = word.lower()
    # Ignoring case also equates a few letters that lower() leaves apart.
    return _DIGIT_WORDS.get(low) or next(d for w, d in _DIGIT_WORDS.items() if re.fullmatch(w, word, re.I))


class Rewritten:
    """A text and the source span of each of its characters."""

    def __init__(self, text: str, starts=None, ends=None):
        self.text = text
        self.starts = range(len(text)) if starts is None else starts
        self.ends = range(1, len(text) + 1) if ends is None else ends

    def source(self, first: int, last: int) -> tuple[int, int]:
        return self.starts[first], self.ends[last - 1]


def _letters(source: Rewritten) -> Rewritten:
    if all(_written(c) == c for c in set(source.text)):
        return source
    kept = [(w, s, e) for c, s, e in zip(source.text, source.starts, source.ends) if (w := _written(c))]
    return Rewritten("".join(k[0] for k in kept), [k[1] for k in kept], [k[2] for k in kept])


def _signs(source: Rewritten) -> Rewritten:
    text = source.text
    kinds = _kinds(text)
    if not kinds:
        return source
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []

    def put(char: str, first: int, last: int) -> None:
        a, b = source.source(first, last)
        out.append(char)
        starts.append(a)
        ends.append(b)

    done = 0
    for m in _pattern(kinds).finditer(text):
        out.append(text[done:m.start()])
        starts.extend(source.starts[done:m.start()])
        ends.extend(source.ends[done:m.start()])
        if m.lastgroup == "digits":
            for word in _EACH_WORD.finditer(text, *m.span()):
                put(_digit(word[0]), *word.span())
        else:
            put({"plus": "+", "at": "@", "dot": "."}[m.lastgroup], *m.span())
        done = m.end()
    out.append(text[done:])
    starts.extend(source.starts[done:])
    ends.extend(source.ends[done:])
    return Rewritten("".join(out), starts, ends)


def _kinds(text: str) -> tuple[str, ...]:
    """The parts of ``_DISGUISES`` that may match somewhere in a text.

    A part that is left out can't: it needs one of its words, whole, or a bracketed sign.
    """
    words = set(_RUN.findall((text if text.isascii() else text.translate(_CASELESS)).lower()))
    return tuple(kind for kind, may in (
        ("digits", not words.isdisjoint(_DIGIT_WORDS)),
        ("plus", "plus" in words),
        ("signs", not words.isdisjoint(_DOT_WORDS) or _SIGN.search(text)),
    ) if may)


@cache
def _pattern(kinds: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(_DISGUISES[kind] for kind in kinds), re.IGNORECASE)


def disguised(text: str, base: list[Span]) -> list[Span]:
    """Identifiers that only show once the text is rewritten."""
    second = _signs(_letters(Rewritten(text)))
    if second.text == text:
        return []
    taken: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    for kind, a, b in base:
        insort(taken[kind], (a, b))
    out = []
    for kind, first_char, last_char in plain(second.text):
        a, b = second.source(first_char, last_char)
        spans = taken[kind]
        at = bisect_left(spans, (a + 1, -1)) - 1
        inside = at >= 0 and spans[at][0] <= a and b <= spans[at][1]
        if not inside and text[a:b] != second.text[first_char:last_char]:
            out.append((kind, a, b))
    return out


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
]))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` (plain spans) and ``spans`` (all), in code points, end exclusive."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    as_rows = lambda spans: [dict(zip(("kind", "start", "end"), s)) for s in spans]

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            base, every = [], []
            for value in arrow.strings(batch.column(text)):
                found = plain(value)
                base.append(as_rows(ordered(found)))
                every.append(as_rows(ordered(found + disguised(value, found))))
            return [pa.array(base, kind), pa.array(every, kind)]

        return work

    return arrow.map_columns(docs, [T.StructField("base", SPANS), T.StructField("spans", SPANS)], make)
