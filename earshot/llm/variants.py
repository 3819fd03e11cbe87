"""Spelling variant grouping with a trie of letter frequencies.

Words are the runs of letters of all texts, counted in Spark. Letters fall into
``GROUPS`` groups, and a word is the vector of its letters in each group. One letter
replaced takes one from a group and gives one to a group; one inserted gives one. So two
near words differ by a surplus and a deficit of at most one each.

A trie has the words by length and by one group's count after another. A search goes
down depth first, all searched words of a batch at once, and spends its surplus and
deficit; what is left at a leaf is verified letter by letter. The trie is cut below the
counts of the first ``PREFIX`` groups: every word stands in one subtrie, and is looked up
in the few subtries within its budget. Each pair is met once: the longer word looks for
the shorter; of equal lengths, the one with the larger prefix for the other; of equal
prefixes, the later word for the earlier. Subtries of more than ``PART`` letters are dealt
into parts, each of which is searched, so no task holds more than a part and one batch.

Cases: a null or empty text has no words; a document without an id counts with the empty
string for its id; repeated rows count each time; of near words with equal counts the
first in code-point order is the form; extra columns aren't read; an empty table gives
an empty result. Words may be of any length.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm import arrow
from earshot.llm.shingles import mixed
from earshot.session import broadcast_if_small, pin

GROUPS, PREFIX = 12, 4
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: One run in so many loses a letter (see ``typed``).
TYPO = 199
#: Letters in one part of a subtrie.
PART = 1 << 20
#: Ranges of so many words are compared without going deeper.
LEAF = 16
#: Letters compared at a time.
_STEP = 1 << 22

RUNS = "[A-Za-zÀ-ÿ]+"


def _lowered(word: Column) -> Column:
    """A-Z in lower case; other letters only occur in words with more bytes than letters."""
    plain = F.octet_length(word) == F.length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def typed(key: Column, word: Column) -> Column:
    """The word, or in one case in ``TYPO``, decided by a checksum of key and word, without one letter."""
    name = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), word)
    mark = F.crc32(name.cast("binary"))
    at = F.pmod(mark, F.length(word)).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(mark % TYPO == 0, cut).otherwise(word)


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: words of at least ``MIN_LENGTH`` letters found ``MIN_COUNT`` times or more."""
    runs = docs.select(
        docs[key].alias("key"), F.explode(F.regexp_extract_all(docs[text], F.lit(RUNS), F.lit(0))).alias("run")
    ).where(F.length("run") >= MIN_LENGTH)
    words = runs.select("key", _lowered(F.col("run")).alias("run")).select(typed(F.col("key"), F.col("run")).alias("word"))
    counts = words.where(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= MIN_COUNT)


class Words:
    """Words as rows of bytes (all letters are Latin-1), with lengths and group counts."""

    def __init__(self, words: list[str]):
        raw = [w.encode("latin-1") for w in words]
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.length = np.fromiter(map(len, raw), np.int64, len(raw))
        self.start = np.cumsum(self.length) - self.length
        owner = np.repeat(np.arange(len(raw)), self.length)
        self.counts = np.bincount(
            owner * GROUPS + self.flat % GROUPS, minlength=len(raw) * GROUPS
        ).reshape(-1, GROUPS)

    def letters(self, rows: np.ndarray, length: int) -> np.ndarray:
        """The letters of words of one length."""
        return self.flat[self.start[rows][:, None] + np.arange(length)]


def key_of(length: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """The number of the subtrie of each (length, counts of the first groups)."""
    key = mixed(length.astype(np.uint64))
    for k in range(PREFIX):
        key = mixed(key * np.uint64(31) + prefix[:, k].astype(np.uint64))
    return key.view(np.int64)


def probes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The subtries each word is looked up in: (row, key), each once."""
    prefix, length = words.counts[:, :PREFIX], words.length
    rows = np.arange(len(length))
    found = [(rows, key_of(length, prefix)), (rows, key_of(length - 1, prefix))]
    for i in range(PREFIX):
        some = rows[prefix[:, i] > 0]
        less = prefix[some].copy()
        less[:, i] -= 1
        found += [(some, key_of(length[some], less)), (some, key_of(length[some] - 1, less))]
        for j in range(i + 1, PREFIX):
            other = less.copy()
            other[:, j] += 1
            found.append((some, key_of(length[some], other)))
    row, key = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[fresh], key[fresh]


class Trie:
    """Words of one length, in order of their counts: a node is a range of them."""

    def __init__(self, words: Words, rows: np.ndarray, length: int):
        order = np.lexsort(words.counts[rows].T[::-1])
        self.rows, self.length = rows[order], length
        self.counts = words.counts[self.rows]
        self.letters = words.letters(self.rows, length)

    def search(self, counts: np.ndarray, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in ``counts``, rows of the trie's words) one edit apart; the words
        searched for are as long as the trie's, or longer by one."""
        longer = letters.shape[1] - self.length
        budget = 1 - longer  # deficit; the surplus may be one in both cases
        n = len(counts)
        todo = [(0, len(self.rows), 0, np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64))]
        while todo:
            low, high, level, alive, surplus, deficit = todo.pop()
            if high - low <= LEAF or level == GROUPS:
                yield from self._verify(low, high, level, counts, letters, alive, surplus, deficit, budget)
                continue
            here = self.counts[low:high, level]
            cuts = np.flatnonzero(here[1:] != here[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), high - low]):
                over = counts[alive, level] - here[a]
                more, less = surplus + np.maximum(over, 0), deficit + np.maximum(-over, 0)
                ok = (more <= 1) & (less <= budget)
                if ok.any():
                    todo.append((low + a, low + b, level + 1, alive[ok], more[ok], less[ok]))

    def _verify(self, low, high, level, counts, letters, alive, surplus, deficit, budget):
        step = max(1, _STEP // max(1, (high - low) * max(self.length, GROUPS)))
        width = max(1, _STEP // max(1, self.length))
        for at in range(0, len(alive), step):
            part = slice(at, at + step)
            over = counts[alive[part]][:, None, level:] - self.counts[None, low:high, level:]
            more = np.maximum(over, 0).sum(axis=2) + surplus[part][:, None]
            less = np.maximum(-over, 0).sum(axis=2) + deficit[part][:, None]
            i, j = np.nonzero((more <= 1) & (less <= budget))
            i, j = alive[part][i], low + j
            for k in range(0, len(i), width):
                a, b = i[k:k + width], j[k:k + width]
                near = one_edit(letters[a], self.letters[b])
                if near.any():
                    yield a[near], self.rows[b[near]]


def one_edit(words: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether the words of each row differ by one letter replaced, or put into the first."""
    length = others.shape[1]
    if words.shape[1] == length:
        return (words != others).sum(axis=1) == 1
    ahead = np.cumprod(words[:, :length] == others, axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    behind = np.cumprod((words[:, 1:] == others)[:, ::-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    return ahead + behind >= length


class Subtrie:
    """The words of one part, as a trie for each length (one, but for equal hashes)."""

    def __init__(self, words: list[str]):
        self.words = np.array(words, object)
        made = Words(words)
        self.prefix = made.counts[:, :PREFIX]
        self.tries = {
            int(n): Trie(made, np.flatnonzero(made.length == n), int(n)) for n in np.unique(made.length)
        }

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``words``, place in the subtrie) that these words have to find."""
        asked = Words(words)
        names = np.array(words, object)
        found = []
        for length in np.unique(asked.length):
            rows = np.flatnonzero(asked.length == length)
            letters = asked.letters(rows, int(length))
            for size in (int(length), int(length) - 1):
                if size not in self.tries:
                    continue
                for a, b in self.tries[size].search(asked.counts[rows], letters):
                    a = rows[a]
                    if size == length:
                        order = asked.counts[a, :PREFIX] - self.prefix[b]
                        lead = order[np.arange(len(a)), (order != 0).argmax(axis=1)]
                        mine = (lead > 0) | ((lead == 0) & (names[a] > self.words[b]))
                        a, b = a[mine], b[mine]
                    found.append((a, b))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: every two near words of ``word, n``, in both directions."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrow.cut(whole):
                made = Words(batch.column("word").to_pylist())
                row, key = probes(made)
                home = key_of(made.length, made.counts[:, :PREFIX])
                rows = np.concatenate([np.arange(batch.num_rows), row])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([home, key])),
                     pa.array((np.arange(len(rows)) >= batch.num_rows).astype(np.int32)),
                     batch.column("word").take(pa.array(rows)), batch.column("n").take(pa.array(rows))],
                    ["key", "side", "word", "n"],
                )

    rows = words.mapInArrow(keyed, "key long, side int, word string, n long")
    homes = rows.where("side = 0")
    parts = broadcast_if_small(homes.groupBy("key").agg(
        F.ceil(F.sum(F.length("word")) / PART).cast("int").alias("parts")
    ))
    place = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    every = F.when(F.col("side") == 0, F.array(place)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = rows.join(parts, "key").withColumn("part", F.explode(every)).select(
        F.xxhash64("key", "part").alias("meet"), "side", "word", "n"
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, trie = None, None
        for held, asked in arrow.meetings(batches, "meet", "side"):
            if held is not known:
                known, trie = held, Subtrie(held.column("word").to_pylist())
            a, b = trie.near(asked.column("word").to_pylist())
            if len(a):
                a, b = pa.array(a), pa.array(b)
                ours = [asked.column(c).take(a) for c in ("word", "n")]
                theirs = [held.column(c).combine_chunks().take(b) for c in ("word", "n")]
                for x, y in ((ours, theirs), (theirs, ours)):
                    yield pa.RecordBatch.from_arrays([*x, *y], ["word", "n", "near", "near_n"])

    found = dealt.repartition("meet").sortWithinPartitions("meet", "side")
    return found.mapInArrow(meet, "word string, n long, near string, near_n long")


def roots(forms: DataFrame, largest: int) -> DataFrame:
    """``word, root``: the last of the chain of forms from each word that has one.

    A form is ``RATIO`` times as frequent as its word, which bounds the links of a chain
    and so the rounds; each round doubles the way that a word has gone.
    """
    links = math.floor(math.log(max(largest, MIN_COUNT) / MIN_COUNT, RATIO) + 1e-9)
    found = pin(forms.select("word", F.col("form").alias("root")))
    for _ in range(max(0, links - 1).bit_length()):
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = pin(found.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return found


def group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of the vocabulary."""
    words = pin(vocabulary(docs, key, text))
    pairs = near_words(words)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word")))
    summed = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    largest = -F.col("best.less")
    formed = largest >= RATIO * F.col("n")
    known = pin(words.join(summed, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(formed, F.col("best.word")).alias("form"), F.when(formed, largest).alias("form_n"),
    ))
    most = known.agg(F.max("n")).first()[0] or 0
    ends = roots(known.where("form is not null"), most)
    return known.join(ends, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )
