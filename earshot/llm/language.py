"""Language ID with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram of letters binds (multiplies)
the vectors of its letters, the one k places from the end rotated by k; a text bundles
(adds) its n-grams; a language bundles the texts labelled with it. A text gets the
language whose prototype has the highest cosine with it, which is its score.

Letters are lower-cased; anything else is a boundary, which also stands at both ends
of a text, and n-grams reach over no boundary.

Cases: a text that is null, empty or without a letter is ``und`` with score 0; any other
is ``und`` with a null score when nothing was learned; rows without a text or a label teach nothing;
equal cosines go to the label first in order; repeated rows count each time; extra
columns pass through, and those named like a result give way to it. A text of any
length is worked on whole, in pieces cut at spaces; a stretch without one takes about 60
bytes a character while it is worked on.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.llm import arrow

DIMENSIONS = 1024
GRAM = 3
UNDECIDED = "und"
ROWS = 128
#: N-grams bound at a time, and characters looked at in one go.
GRAMS, SEGMENT = 4096, 1 << 19
_EDGE = 32

_TABLES: list[np.ndarray] = []
_LETTERS: dict[int, np.ndarray] = {}


def _folded() -> np.ndarray:
    """For each code point its lower case if it is a letter, else the boundary."""
    if not _TABLES:
        table = np.full(sys.maxunicode + 1, _EDGE, np.int32)
        for point in range(sys.maxunicode + 1):
            char = chr(point)
            if unicodedata.category(char)[0] == "L":
                low = char.lower()
                table[point] = ord(low) if len(low) == 1 else point
        _TABLES.append(table)
    return _TABLES[0]


def letter_vector(point: int) -> np.ndarray:
    """The random vector of a letter: a function of its code point alone."""
    if point not in _LETTERS:
        raw = np.random.PCG64(point).random_raw(DIMENSIONS // 64)
        bits = np.unpackbits(np.asarray(raw, np.uint64).view(np.uint8))
        _LETTERS[point] = (2 * bits.astype(np.int8) - 1).astype(np.int8)
    return _LETTERS[point]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each n-gram: the number of its text, and its code."""
    flat = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = _folded()[flat].astype(np.int64)
    owner = np.repeat(np.arange(len(texts) + 1), [len(t) + 1 for t in texts] + [1])
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != _EDGE) | (points[:-1] != _EDGE)
    points, owner = points[keep], owner[keep]
    if len(points) < GRAM:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.zeros(len(points) - GRAM + 1, np.int64)
    inside = np.ones(len(codes), bool)
    for k in range(GRAM):
        part = points[k:len(points) - GRAM + 1 + k]
        codes = codes << 21 | part
        if 0 < k < GRAM - 1:
            inside &= part != _EDGE
    return owner[1:1 + len(codes)][inside], codes[inside]


def vectors(codes: np.ndarray) -> np.ndarray:
    """The bound vector of each n-gram."""
    out = np.ones((len(codes), DIMENSIONS), np.int8)
    for k in range(GRAM):
        points = codes >> 21 * k & (1 << 21) - 1
        known, where = np.unique(points, return_inverse=True)
        out *= np.stack([np.roll(letter_vector(int(p)), k) for p in known])[where]
    return out


def bundle(texts: list[str], group: np.ndarray | None = None, groups: int = 0) -> np.ndarray:
    """The vector of each text, or of each group of texts, ``GRAMS`` n-grams at a time."""
    rows = groups or len(texts)
    total = np.zeros((rows, DIMENSIONS))
    group = np.arange(len(texts)) if group is None else group
    for some, owner in _segments(texts, group):
        of, codes = grams(some)
        where, distinct = pd.factorize(codes)
        order = np.argsort(where, kind="stable")
        where, of = where[order], owner[of[order]]
        at = np.searchsorted(where, np.arange(0, len(distinct) + GRAMS, GRAMS))
        for low, (a, b) in zip(range(0, len(distinct), GRAMS), zip(at[:-1], at[1:])):
            width = min(GRAMS, len(distinct) - low)
            counts = np.bincount(of[a:b] * width + where[a:b] - low, minlength=rows * width).reshape(rows, width)
            bound = vectors(np.asarray(distinct[low:low + width])).astype(np.float32)
            total += counts.astype(np.float32) @ bound
    return total


def _segments(texts: list[str], group: np.ndarray) -> Iterator[tuple[list[str], np.ndarray]]:
    """Lists of about ``SEGMENT`` characters; a longer text is cut at spaces, which n-grams don't cross."""
    some, owner, size = [], [], 0
    for text, of in zip(texts, group.tolist()):
        at = 0
        while True:
            end = text.find(" ", at + SEGMENT)
            end = len(text) if end < 0 else end
            some.append(text[at:end])
            owner.append(of)
            size += end - at
            if size >= SEGMENT:
                yield some, np.array(owner)
                some, owner, size = [], [], 0
            at = end
            if at >= len(text):
                break
    if some:
        yield some, np.array(owner)


def learn(docs: DataFrame, text: str = "text", label: str = "lang") -> dict[str, np.ndarray]:
    """The prototype of each label: a sum over all its rows, added up in Spark.

    What reaches the driver is ``DIMENSIONS`` numbers for each label.
    """
    labelled = docs.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(
        F.col(label).cast("string").alias("label"), F.col(text).alias("text")
    )

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in _small(whole):
                names, where = np.unique(batch.column("label").to_pylist(), return_inverse=True)
                sums = bundle(arrow.strings(batch.column("text")), where, len(names))
                for name, vector in zip(names.tolist(), sums):
                    totals[name] = totals.get(name, 0) + vector
        for name, vector in totals.items():
            yield pa.RecordBatch.from_pydict({
                "label": [name] * DIMENSIONS, "at": np.arange(DIMENSIONS, dtype=np.int32),
                "value": vector.astype(np.int64),
            })

    parts = labelled.mapInArrow(bundled, "label string, at int, value long")
    sums = parts.groupBy("label", "at").agg(F.sum("value").alias("value"))
    profiles = sums.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("v")
    )
    return {r.label: np.array(r.v, np.float64) for r in profiles.collect()}


def _small(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in arrow.cut(batch):
        for at in range(0, part.num_rows, ROWS):
            yield part.slice(at, ROWS)


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    names = sorted(prototypes)
    units = np.stack([prototypes[n] / max(1.0, np.linalg.norm(prototypes[n])) for n in names]) if names else None

    def decide(texts: list[str]) -> list[tuple[str, float | None]]:
        found = bundle(texts)
        lengths = np.linalg.norm(found, axis=1)
        has_letter = lengths > 0
        if units is None:
            return [(UNDECIDED, None if ok else 0.0) for ok in has_letter]
        cosines = found @ units.T / np.maximum(lengths, 1e-9)[:, None]
        best = cosines.argmax(axis=1)
        return [
            (names[b], min(1.0, max(0.0, float(c[b])))) if ok else (UNDECIDED, 0.0)
            for b, c, ok in zip(best, cosines, has_letter)
        ]

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = arrow.strings(batch.column(text))
            out = [x for at in range(0, len(texts), ROWS) for x in decide(texts[at:at + ROWS])]
            return [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())]

        return work

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return arrow.map_columns(docs, fields, make)


def held_out(key: Column) -> Column:
    """True for about a fifth of the keys, by a checksum of the key as text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0
