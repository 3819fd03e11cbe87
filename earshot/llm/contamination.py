"""Benchmark decontamination with one Aho-Corasick automaton.

The automaton holds every window of ``WINDOW`` consecutive words of the items
(questions and answers), normalised; an item of fewer words is one window. Its letters
are numbers: one for each of the words that the items use most, two for any other, as
nodes with many children are slow to leave. Each text is normalised in the same way and
scanned once, whole, stretch by stretch. A word inside an occurrence is hit, and runs of
hit words are given as spans of the original text.

Normal form: A-Z in lower case; words are runs of digits, a-z and characters beyond
ASCII.

Cases: a null or empty text has no words and no hits; a null or empty item has no
window; items that share a window all count; a repeated row gets its own result; with
no items nothing is hit; items without an id are called by the empty string; extra
columns pass through, and those named like a result give way to it.
"""

from __future__ import annotations

import math
import string
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.llm import arrow

WINDOW = 13
#: Items are broadcast and scanned in blocks of about so many bytes of text. An automaton
#: takes about 120 bytes for each of these, at worst.
BLOCK_BYTES = 4 << 20

_KEPT = {*string.digits.encode(), *string.ascii_lowercase.encode(), *range(128, 256)}
_FOLD = bytes(
    c if c in _KEPT else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)
_WORDS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

#: Texts are turned into numbers in stretches of about so many bytes.
STRETCH = 1 << 18


#: So many words have a letter of their own; second letters begin at LOW.
COMMON = 512
LOW = 1 << 20


class _Letters(dict):
    """Letters of the words of the items, common words first; 0 for any other word."""

    def __init__(self, words: list[bytes]):
        side = max(256, math.isqrt(len(words)) + 1)
        high, low = COMMON + 1, LOW
        super().__init__(
            (word, (at + 1,) if at < COMMON else (high + (at - COMMON) // side, low + (at - COMMON) % side))
            for at, word in enumerate(words)
        )

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        return (0,)

    def of(self, words: list[bytes]) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.__getitem__, words)))


class Windows:
    """The automaton of (id, text) items, and the length and owners of each window."""

    def __init__(self, items: list[tuple[str, bytes]]):
        uses = Counter(chain.from_iterable(text.translate(_FOLD).split() for _, text in items))
        self.letters = _Letters(sorted(uses, key=lambda w: (-uses[w], w)))
        self.lengths = bytearray()
        #: The one item, or the list of items, that has the window.
        self.owners: list[str | list[str]] = []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for name, text in items:
            words = text.translate(_FOLD).split()
            for at in range(max(1, len(words) - WINDOW + 1)) if words else ():
                self._add(name, words[at:at + WINDOW])
        self.automaton.make_automaton()

    def _add(self, name: str, window: list[bytes]) -> None:
        letters = self.letters.of(window)
        known = self.automaton.get(letters, -1)
        if known < 0:
            self.automaton.add_word(letters, len(self.owners))
            self.owners.append(name)
            self.lengths.append(len(window))
        elif isinstance(self.owners[known], list):
            self.owners[known].append(name)
        elif self.owners[known] != name:
            self.owners[known] = [self.owners[known], name]

    def names(self, windows: set[int]) -> set[str]:
        out: set[str] = set()
        for number in windows:
            owner = self.owners[number]
            out.update(owner if isinstance(owner, list) else (owner,))
        return out


#: The last automaton a worker built, by the name of its block.
_BUILT: dict[str, Windows] = {}


def _windows(name: str, items: Broadcast) -> Windows:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Windows(items.value)
    return _BUILT[name]


def _stretches(flat: bytes) -> Iterator[list[bytes]]:
    """Words of a text in lower case and spaces, some thousand at a time."""
    at = 0
    while at < len(flat):
        end = flat.find(b" ", at + STRETCH)
        end = len(flat) if end < 0 else end
        words = flat[at:end].split()
        if words:
            yield words
        at = end


def scan(windows: Windows, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Words of a text, its runs of hit words (first, last), and the items found."""
    n_words, n_letters, runs, found = 0, 0, [], set()
    matches = None
    for words in _stretches(text.translate(_FOLD)):
        before = n_words
        n_words += len(words)
        if not windows.owners:
            continue
        letters = windows.letters.of(words)
        if matches is None:
            matches = windows.automaton.iter(letters)
        else:
            matches.set(letters)
        hits = list(matches)
        if hits:
            codes = np.array(letters)
            word_at = before - 1 + np.cumsum((codes <= COMMON) | (codes >= LOW))
            lasts = word_at[np.array([at for at, _ in hits]) - n_letters].tolist()
            for last, (_, number) in zip(lasts, hits):
                found.add(number)
                first = last - windows.lengths[number] + 1
                while runs and first <= runs[-1][1] + 1:
                    first = min(first, runs.pop()[0])
                runs.append((first, last))
        n_letters += len(letters)
    return n_words, runs, windows.names(found)


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Inclusive runs without overlap, those that touch joined."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def offsets(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point spans, end exclusive, of runs of words in the original text."""
    if not runs:
        return []
    inside = np.frombuffer(b" " + text.translate(_FOLD) + b" ", np.uint8) != 32
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    ends = np.flatnonzero(inside[:-1] & ~inside[1:])
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(points[starts[a]]), int(points[ends[b]])) for a, b in runs]


def contamination(
    docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``docs`` with ``n_words, n_hit, hit_items, hit_spans``.

    The items are a stated, configured set. They are measured first and broadcast in
    blocks of bounded size; each block is one more scan.
    """
    named = items.select(
        F.coalesce(items[item].cast("string"), F.lit("")).alias("id"),
        F.coalesce(items[item_text].cast("binary"), F.lit(b"")).alias("text"),
    )
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    context = docs.sparkSession.sparkContext
    found = docs
    for block in range(blocks):
        part = named.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        held = context.broadcast([(r.id, bytes(r.text)) for r in part.collect()])
        found = _scan_block(found, held, text, first=block == 0, last=block == blocks - 1)
    return found


def _scan_block(df: DataFrame, held: Broadcast, text: str, first: bool, last: bool) -> DataFrame:
    done = [
        T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
        T.StructField("hit_items", T.ArrayType(T.StringType())), T.StructField("hit_spans", SPANS),
    ]
    open_ = [T.StructField("_runs", _WORDS), T.StructField("_names", T.ArrayType(T.StringType()))]

    name = uuid.uuid4().hex

    def make():
        windows = _windows(name, held)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = arrow.raw(batch.column(text))
            results = [scan(windows, x) for x in texts]
            if not first:
                before = zip(batch.column("_runs").to_pylist(), batch.column("_names").to_pylist())
                results = [
                    (n, merge(runs + [(r["first"], r["last"]) for r in old]), names | set(had))
                    for (n, runs, names), (old, had) in zip(results, before)
                ]
            names = pa.array([sorted(x[2]) for x in results], pa.list_(pa.string()))
            if not last:
                kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
                runs = [[{"first": a, "last": b} for a, b in x[1]] for x in results]
                return [pa.array(runs, kind), names]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            spans = [
                [{"start": a, "end": b} for a, b in offsets(t, runs)]
                for t, (_, runs, _) in zip(texts, results)
            ]
            return [
                pa.array([x[0] for x in results], pa.int64()),
                pa.array([sum(b - a + 1 for a, b in x[1]) for x in results], pa.int64()),
                names, pa.array(spans, kind),
            ]

        return work

    if last:
        return arrow.map_columns(df, done, make).drop("_runs", "_names")
    return arrow.map_columns(df, open_, make)


def is_contaminated():
    """At least one word in twenty hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
