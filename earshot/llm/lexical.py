"""Ranked lexical search for many queries that share terms.

Queries (items) are sums over sets of terms. Terms that the same items hold are one
shared set; each item is then a list of such sets, in order of how many items hold them,
and sets that stand side by side in several items are joined, again and again. What
comes out is a graph in which items share partial sums: a leaf is a shared set of terms,
an inner node two nodes added, an item a few nodes added.

Spark reads the texts once and keeps, for each document, its length and the terms that
any item asks for. Document frequencies and lengths are counted over all documents.
Then batches of documents are scored: the leaves' accumulators are filled from the terms'
contributions, each inner node is added up once for all the items that use it, and the
items are read off the graph. A task keeps the best documents of each item; the best of
the best are ranked in two steps, so no task gets those of all tasks.

Scores are integers: ``w * ((10^9 tf) div (1000 tf + 20 m))`` with the weight ``w``
from the number of documents with the term, and ``m`` from the document's length.

Cases: a null or empty text has no terms and is not counted; a document without an id
counts in the statistics but can't be named, so it isn't ranked; documents that share an
id are ranked each for itself; equal scores go by id; a null or empty item finds
nothing, items without an id are left out, rows that share an item's id are one item;
extra columns aren't read; with no documents or items the result is empty. Texts are
read whole, in pieces of ``PIECE`` bytes cut between terms.
"""

from __future__ import annotations

import math
import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from earshot.llm import arrow
from earshot.session import pin

TOP = 50
#: Items are broadcast and scored in blocks of about so many bytes of text.
BLOCK_BYTES = 4 << 20
PIECE = 1 << 20
#: Documents scored at a time.
ROWS = 512
#: Parts in which the best of all tasks are ranked first.
SALTS = 32

_KEPT = {*string.digits.encode(), *string.ascii_lowercase.encode(), *range(128, 256)}
_FOLD = bytes(c if c in _KEPT else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def count_terms(text: bytes) -> Counter[bytes]:
    """The terms of a text and how often each occurs."""
    if len(text) <= PIECE:
        return Counter(text.translate(_FOLD).split())
    counts: Counter[bytes] = Counter()
    flat = text.translate(_FOLD)
    at = 0
    while at < len(flat):
        end = flat.find(b" ", at + PIECE)
        end = len(flat) if end < 0 else end
        counts.update(flat[at:end].split())
        at = end
    return counts


class Plan:
    """How the items' sums are made.

    ``leaf`` has the leaf of each term, ``pairs`` the two nodes that each inner node adds,
    ``parts`` the nodes of each item. Leaves are numbered first, inner nodes after them.
    """

    def __init__(self, items: dict[int, set[bytes]]):
        self.items = sorted(items)
        holders: dict[bytes, list[int]] = defaultdict(list)
        for number, name in enumerate(self.items):
            for term in items[name]:
                holders[term].append(number)
        self.terms = sorted(holders)
        sets: dict[tuple[int, ...], int] = {}
        self.leaf = [sets.setdefault(tuple(holders[t]), len(sets)) for t in self.terms]
        self.leaves = len(sets)
        lists: list[list[int]] = [[] for _ in self.items]
        for held, leaf in sorted(sets.items(), key=lambda x: (-len(x[0]), x[1])):
            for number in held:
                lists[number].append(leaf)
        self.pairs: list[tuple[int, int]] = []
        self.parts = self._joined(lists)

    def _joined(self, lists: list[list[int]]) -> list[list[int]]:
        """Neighbours that several items have become a node, until there are none.

        A round takes the most frequent pairs of which none begins where another ends.
        """
        while True:
            seen = Counter(p for x in lists for p in zip(x, x[1:]))
            made: dict[tuple[int, int], int] = {}
            left, right = set(), set()
            for (a, b), count in sorted(seen.items(), key=lambda x: (-x[1], x[0])):
                if count > 1 and a not in right and b not in left:
                    left.add(a)
                    right.add(b)
                    made[a, b] = self.leaves + len(self.pairs) + len(made)
            if not made:
                return lists
            lists = [_replaced(x, made) for x in lists]
            self.pairs += made

    def scores(self, term: np.ndarray, doc: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
        """Items x documents: the sums of ``value`` (of ``term`` in ``doc``) over each item's terms."""
        nodes = np.zeros((self.leaves + len(self.pairs), docs), np.int64)
        place = np.asarray(self.leaf, np.int64)[term] * docs + doc
        order = np.argsort(place, kind="stable")
        place = place[order]
        if len(place):
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            nodes.reshape(-1)[place[first]] = np.add.reduceat(value[order], first)
        for node, (a, b) in enumerate(self.pairs, self.leaves):
            np.add(nodes[a], nodes[b], out=nodes[node])
        return np.stack([nodes[p].sum(axis=0) for p in self.parts])


def _replaced(nodes: list[int], made: dict[tuple[int, int], int]) -> list[int]:
    out: list[int] = []
    for x in nodes:
        if out and (out[-1], x) in made:
            out[-1] = made[out[-1], x]
        else:
            out.append(x)
    return out


def postings(docs: DataFrame, terms: list[bytes], key: str, text: str) -> DataFrame:
    """``doc_id, n, terms, tfs``: each document's length and the wanted terms in it."""
    held = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = held.value
        wanted = number.keys()
        for whole in batches:
            for batch in arrow.cut(whole):
                lengths, found, tfs = [], [], []
                for raw in arrow.raw(batch.column("text")):
                    counts = count_terms(raw)
                    some = counts.keys() & wanted
                    lengths.append(counts.total())
                    found.append([number[t] for t in some])
                    tfs.append([counts[t] for t in some])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(lengths, pa.int64()),
                     pa.array(found, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                    ["doc_id", "n", "terms", "tfs"],
                )

    given = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    return given.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


class Best:
    """The ``top`` best (score, smaller id) rows of each item, gathered batch by batch."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.least = np.ones(items, np.int64)
        self.rows = [np.empty(0, np.int64) for _ in range(3)]

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        item, at = np.nonzero(scores >= self.least[:, None])
        rows = [item, ids[at], scores[item, at]]
        self.rows = [np.concatenate([a, b]) for a, b in zip(self.rows, rows)]
        if len(self.rows[0]) > 4 * self.top * len(self.least):
            self.prune()

    def prune(self) -> None:
        item, ids, score = self.rows
        order = np.lexsort((ids, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[rank < self.top]
        self.rows = [x[order] for x in self.rows]
        item, _, score = self.rows
        last = rank[rank < self.top] == self.top - 1
        self.least[item[last]] = score[last]


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the best documents of each item.

    The items are measured, and collected and scored in blocks of bounded size; each
    block is one more reading of the documents.
    """
    named = items.select(items[item].cast("long").alias("item_id"), items[item_text].cast("binary").alias("text"))
    named = named.where("item_id is not null and text is not null")
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    found = []
    for block in range(blocks):
        asked: dict[int, set[bytes]] = defaultdict(set)
        for row in named.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect():
            if terms := count_terms(bytes(row.text)).keys():
                asked[row.item_id] |= terms
        if asked:
            found.append(_search_block(docs, Plan(asked), top, key, text))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)


def _search_block(docs: DataFrame, plan: Plan, top: int, key: str, text: str) -> DataFrame:
    held = pin(postings(docs, plan.terms, key, text))
    n, words = held.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = np.zeros(len(plan.terms), np.int64)
    for row in held.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():
        frequency[row.t] = row.df
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(df) + 1))) for df in frequency], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((plan, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weight = shared.value
        best = Best(len(plan.items), top)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                term, tf = (batch.column(c).flatten().to_numpy() for c in ("terms", "tfs"))
                counts = np.diff(batch.column("terms").offsets.to_numpy())
                doc = np.repeat(np.arange(batch.num_rows), counts)
                m = 50 + 50 * batch.column("n").to_numpy() * n // words
                value = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
                best.take(plan.scores(term, doc, value, batch.num_rows), batch.column("doc_id").to_numpy())
        best.prune()
        rows, ids, score = best.rows
        yield pa.RecordBatch.from_pydict({
            "item_id": np.asarray(plan.items, np.int64)[rows], "doc_id": ids, "score": score,
        })

    rows = held.where("n > 0 and doc_id is not null").mapInArrow(run, "item_id long, doc_id long, score long")
    order = (F.col("score").desc(), F.col("doc_id"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order)))
    some = some.where(F.col("rank") <= top).select("item_id", "doc_id", "score")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
