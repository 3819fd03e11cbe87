"""Encodings of words, remembered within a bound of bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: About what a word and its encoding take besides their contents.
_ENTRY = 200
#: Longer words are encoded each time, so that one of them can't take the whole bound.
LONG = 256
#: What a word takes in an ``IdTable`` besides its characters and ids.
_ROW = 24
#: Words whose ids are put in place at a time.
SEGMENT = 1 << 18


class Memo:
    """Bytes for each word. Two generations of about ``bound`` bytes each are kept: when
    the young one is full it becomes the old one, and words still in use move on."""

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], bound: int):
        self.encode = encode
        self.bound = bound
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0
        self.passing: list[str] = []

    def of(self, words: set[str]) -> dict[str, bytes]:
        """A table with (at least) these words, good until the next call."""
        for word in self.passing:
            del self.known[word]
        new = words.difference(self.known)
        self.passing = [w for w in new if len(w) > LONG]
        size = _ENTRY * len(new) + 2 * sum(map(len, new))
        if self.passing:
            size -= sum(_ENTRY + 2 * len(w) for w in self.passing)
        if new and self.size and self.size + size > self.bound:
            kept = words.difference(self.passing)
            self.old, self.known, new = self.known, {}, words
            size = _ENTRY * len(kept) + 2 * sum(map(len, kept))
            self.size = 0
        if new:
            self.size += size
            self.known |= {w: self.old[w] for w in new if w in self.old}
            listed = list(new.difference(self.old))
            self.known.update(zip(listed, self.encode(listed)))
        return self.known

    def join_all(self, texts: list[list[str]]) -> list[bytes]:
        """The bytes of each list of words, end to end."""
        known = self.of(set(chain.from_iterable(texts)))
        return [b"".join(map(known.__getitem__, x)) for x in texts]


class IdTable:
    """32-bit ids for each word, in arrays of about ``bound`` bytes: beyond it, the words
    used last stay, as many as half of it holds. Arrow cuts texts at white space and
    numbers their words, so each is looked up once for all texts given together."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], bound: int):
        self.encode = encode
        self.bound = bound
        self.words = pa.array([], pa.large_string())
        self.ids = np.empty(0, "<u4")
        self.begins = np.zeros(1, np.int64)
        self.used = np.empty(0, np.int64)
        self.now = 0

    def _forget(self) -> None:
        sizes = _ROW + pc.binary_length(self.words).to_numpy() + 4 * np.diff(self.begins)
        if sizes.sum() <= self.bound:
            return
        order = np.argsort(-self.used, kind="stable")
        kept = np.sort(order[np.cumsum(sizes[order]) <= self.bound // 2])
        counts = np.diff(self.begins)[kept]
        self.ids = self._gathered(kept, counts)
        self.begins = np.concatenate([[0], np.cumsum(counts)])
        self.words, self.used = self.words.take(pa.array(kept)), self.used[kept]

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where these different words are in the table."""
        self._forget()
        self.now += 1
        found = pc.index_in(words, value_set=self.words)
        new = words.filter(found.is_null())
        found = found.fill_null(-1).to_numpy().astype(np.int64)
        found[found < 0] = np.arange(len(self.words), len(self.words) + len(new))
        if len(new):
            encoded = self.encode(new.to_pylist())
            counts = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(encoded), "<u4")])
            self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(counts)])
            self.words = pa.concat_arrays([self.words, new])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        self.used[found] = self.now
        return found

    def _gathered(self, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The ids of the words at these places, end to end."""
        ends = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(ends[-1], "<u4")
        for at in range(0, len(places), SEGMENT):
            some, before = slice(at, at + SEGMENT), ends[:-1][at:at + SEGMENT]
            low, high = ends[at], ends[min(at + SEGMENT, len(places))]
            out[low:high] = self.ids[np.arange(low, high) + np.repeat(self.begins[places[some]] - before, counts[some])]
        return out

    def join_all(self, texts: list[str]) -> list[bytes]:
        """The ids of the words of each text, end to end."""
        lists = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        words = lists.flatten().dictionary_encode()
        places = self._places(words.dictionary)[words.indices.to_numpy()]
        counts = np.diff(self.begins)[places]
        raw = memoryview(self._gathered(places, counts)).cast("B")
        cuts = (4 * np.concatenate([[0], np.cumsum(counts)])[lists.offsets.to_numpy()]).tolist()
        return [bytes(raw[a:b]) for a, b in zip(cuts, cuts[1:])]
