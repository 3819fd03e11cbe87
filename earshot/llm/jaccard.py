"""N-gram Jaccard join by count vectors in R-trees.

The shingles of a text are hashed into groups, and the numbers in the groups are a
point. The smaller of two coordinates, summed, bounds the shingles two texts share, so
a tree of points with the largest coordinates at each node rules out whole subtrees;
the pairs it leaves are verified on the whole texts.

One tree over a corpus would prune nothing: with as many groups as the bound needs to
be sharp, points lie about as far from one another as from any box. The corpus is
therefore first dealt into many small trees, without losing a link:

* Sets of sizes up to ``n`` that link differ in at most ``2 n (1 - s) / (1 + s)``
  shingles. Cut into more ranges of hashes than that, at least one range holds the same
  shingles in both. Sizes fall into levels, each with a number of ranges of its own; a
  text joins its level and, if partners may be there, the next.
* What a text holds in a range is one key. Texts with a key in common meet in a tree.
  A range that is empty is no key; the rare text that has too many of them also gets
  the keys of a prefix filter, which need no such condition.
* Texts with the same keys meet many times; equal lists of texts are kept once.
* In each list, every text is first paired with the first. The links among these join
  most copies into components, and only texts of different components go through the
  trees: no list of copies is ever paired with itself.
* A list that fits in a leaf is one; its pairs are bounded once however many lists they
  share. Longer lists with the same first text become one, so that each of their pairs
  is bounded about once. Lists longer than ``BLOCK`` are dealt into blocks, and each pair of blocks is a tree
  join of its own.

Equal sets are one member of the join, the one with the smallest id.

Cases: a null or empty text, or one without words, has no shingles and no links; equal
texts link; rows without an id take no part and are components of their own, with a
null id; rows that share an id are one document, linked by whatever either is linked
to; extra columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm import arrow
from earshot.llm.shingles import mixed, shingle_sets, similar
from earshot.session import broadcast_if_small, ensure_checkpoint_dir, pin

PERCENT = 80
BLOCK = 4096
#: Longest list that is compared as a whole; longer ones are written in parts.
LIST = 50_000
#: Leaves of a tree hold so many points, nodes so many children.
LEAF, FAN = 32, 8
#: Copies of one set are dealt into so many parts.
SALTS = 16
_SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


# Sets: size, digest, keys and points of texts.


def _digests(sets: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """128 bits for each set: sums over its shingles."""
    out = []
    for salt in _SALT[:2]:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(sets ^ salt), dtype=np.uint64)])
        out.append((sums[at[1:]] - sums[at[:-1]]).view(np.int64))
    return out


def differing(size: int | np.ndarray, other: int | np.ndarray, percent: int) -> int | np.ndarray:
    """The most shingles that linked sets of these sizes differ in."""
    return (size + other) * (100 - percent) // (100 + percent)


def ranges_of(level: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Ranges of a level: enough that, with some of them empty, one is still the same."""
    most = (2 << level) - 1
    return differing(most, most, percent) * 106 // 100 + 2


def keys(sets: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all texts, and the number of the text of each."""
    sizes = np.diff(at)
    level = np.zeros(len(sizes), np.int64)
    level[sizes > 0] = np.log2(sizes[sizes > 0] + 0.5).astype(np.int64)
    top = (2 << level) - 1
    largest = sizes * 100 // percent
    owner = np.repeat(np.arange(len(sizes)), sizes)
    found, owners = [], []
    lost = np.zeros(len(sizes), bool)
    for up, wanted in ((0, sizes > 0), (1, (sizes > 0) & (largest > top))):
        mine = wanted[owner]
        shingles, text = sets[mine], owner[mine]
        if not len(shingles):
            continue
        ranges = ranges_of(level + up, percent).astype(np.uint64)
        place = ((shingles >> np.uint64(32)) * ranges[text]) >> np.uint64(32)
        first = np.ones(len(shingles), bool)
        first[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
        begin = np.flatnonzero(first)
        sums = np.add.reduceat(mixed(shingles ^ _SALT[2]), begin)
        text = text[begin]
        where = (level[text] + up).astype(np.uint64) << np.uint64(40) | place[begin]
        found.append(mixed(sums + mixed(where)))
        owners.append(text)
        most = np.minimum(largest, top) if up == 0 else largest
        full = np.bincount(text, minlength=len(sizes))
        lost |= wanted & (full < differing(sizes, most, percent) + 1)
    for i in np.flatnonzero(lost):
        length = sizes[i] - -(-sizes[i] * percent // 100) + 1
        found.append(mixed(sets[at[i]:at[i] + length] ^ _SALT[0]))
        owners.append(np.full(length, i))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found).view(np.int64), np.concatenate(owners)


def point(shingles: np.ndarray) -> bytes:
    """Numbers of shingles in a power of two of groups, at least as many as shingles, packed."""
    groups = 1 << max(4, int(len(shingles)).bit_length())
    counts = np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    if counts.max(initial=0) > 255:
        raise ValueError("a group of more than 255 shingles")
    return zlib.compress(counts.astype(np.uint8).tobytes(), 1)


def coordinates(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """The point in fewer groups."""
    return np.minimum(counts.reshape(-1, groups).sum(axis=0), 65535).astype(np.uint16)


def may_link(a: bytes, b: bytes, total: int, percent: int) -> bool:
    """Whether the smaller coordinates, summed, leave two points the overlap of a link."""
    x, y = coordinates(a), coordinates(b)
    groups = min(len(x), len(y))
    bound = int(np.minimum(folded(x, groups), folded(y, groups)).sum(dtype=np.int64))
    return bound * (100 + percent) >= percent * total


# Passes over the texts.


def _members(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrow.cut(whole):
                sets, at = shingle_sets(arrow.raw(batch.column("text")))
                a, b = _digests(sets, at)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n": np.diff(at), "a": a, "b": b})

    return docs.mapInArrow(run, "doc_id long, n long, a long, b long")


def _keyed(docs: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrow.cut(whole):
                found, owner = keys(*shingle_sets(arrow.raw(batch.column("text"))), percent)
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_pydict({"key": found, "doc_id": ids[owner]})

    return docs.mapInArrow(run, "key long, doc_id long")


def _points(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrow.cut(whole):
                sets, at = shingle_sets(arrow.raw(batch.column("text")))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id"), "n": np.diff(at),
                    "point": pa.array([point(sets[x:y]) for x, y in zip(at[:-1], at[1:])], pa.binary()),
                })

    return docs.mapInArrow(run, "doc_id long, n long, point binary")


# Lists of texts that share a key.


def _lists(rows: DataFrame) -> DataFrame:
    """``list, docs``: the texts of each key that has several, equal lists once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = _Lists()
        for batch in batches:
            yield from lists.take(batch.column("key").to_numpy(), batch.column("doc_id").to_numpy())
        yield from lists.finish()

    found = (
        rows.repartition("key").sortWithinPartitions("key", "doc_id")
        .mapInArrow(run, "list long, part int, docs array<long>")
    )
    return found.groupBy("list", "part").agg(F.first("docs").alias("docs")).select("list", "docs")


class _Lists:
    """Gathers (key, doc) rows sorted by key into lists. Only the last key's rows are held,
    at most ``LIST`` and a batch: a longer list is written in parts, under its key's name."""

    def __init__(self):
        self.key, self.open, self.part = None, np.empty(0, np.int64), 0

    def take(self, key: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        if len(self.open):
            key = np.concatenate([np.full(len(self.open), self.key), key])
            docs = np.concatenate([self.open, docs])
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (docs[1:] != docs[:-1])
        key, docs = key[fresh], docs[fresh]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        yield from self._write(key, docs, begin[:-1], begin[1:])
        if key[-1] != self.key:
            self.key, self.part = key[-1], 0
        self.open = docs[begin[-1]:]
        if len(self.open) > LIST:
            yield _as_lists([self.key], [self.part], [self.open])
            self.part, self.open = self.part + 1, self.open[:0]

    def finish(self) -> Iterator[pa.RecordBatch]:
        if len(self.open):
            n = len(self.open)
            yield from self._write(np.full(n, self.key), self.open, np.array([0]), np.array([n]))

    def _write(self, key, docs, begin, end) -> Iterator[pa.RecordBatch]:
        if self.part and len(begin) and key[begin[0]] == self.key:
            yield _as_lists([self.key], [self.part], [docs[begin[0]:end[0]]])
            begin, end = begin[1:], end[1:]
        some = end - begin > 1
        begin, end = begin[some], end[some]
        if len(begin):
            marks = mixed(docs.view(np.uint64) ^ _SALT[0])
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(marks, dtype=np.uint64)])
            names = mixed(sums[end] - sums[begin] + (end - begin).astype(np.uint64)).view(np.int64)
            yield _as_lists(names, np.zeros(len(begin)), [docs[a:b] for a, b in zip(begin, end)])


def _as_lists(names, parts, docs) -> pa.RecordBatch:
    ends = np.cumsum([0] + [len(d) for d in docs], dtype=np.int32)
    return pa.RecordBatch.from_pydict({
        "list": pa.array(np.asarray(names, np.int64)), "part": pa.array(np.asarray(parts, np.int32)),
        "docs": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(docs))),
    })


# Trees of points.


class Tree:
    """Points packed into leaves by size and widest coordinate, leaves into nodes.

    ``levels[0]`` are the leaves. A node has the largest coordinates of its points, their
    least and largest size, and their component if they have but one (else -1).
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray, ids: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        slab = LEAF * FAN
        for at in range(0, len(order), slab):
            part = order[at:at + slab]
            widest = np.ptp(points[part], axis=0).argmax()
            order[at:at + slab] = part[np.argsort(points[part, widest], kind="stable")]
        self.points, self.sizes, self.labels, self.ids = points[order], sizes[order], labels[order], ids[order]
        self.levels = []
        level = [self.points, self.sizes, self.sizes, self.labels]
        width = LEAF
        while not self.levels or len(self.levels[-1][1]) > 1:
            at = np.arange(0, len(level[1]), width)
            labels = np.minimum.reduceat(level[3], at)
            labels = np.where(labels == np.maximum.reduceat(level[3], at), labels, -1)
            level = [
                np.maximum.reduceat(level[0], at, axis=0), np.minimum.reduceat(level[1], at),
                np.maximum.reduceat(level[2], at), labels,
            ]
            self.levels.append(level)
            width = FAN

    def children(self, level: int, node: int) -> range:
        return range(node * FAN, min((node + 1) * FAN, len(self.levels[level - 1][1])))


def tree_pairs(left: Tree, right: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of the points whose bound lets them link and whose components differ."""
    alone = left is right
    todo = [(len(left.levels) - 1, 0, len(right.levels) - 1, 0)]
    while todo:
        up, a, down, b = todo.pop()
        corner_a, least_a, most_a, label_a = (x[a] for x in left.levels[up])
        corner_b, least_b, most_b, label_b = (x[b] for x in right.levels[down])
        if most_a * 100 < least_b * percent or most_b * 100 < least_a * percent or label_a == label_b != -1:
            continue
        bound = int(np.minimum(corner_a, corner_b).sum(dtype=np.int64))
        if bound * (100 + percent) < percent * (least_a + least_b):
            continue
        if up == down == 0:
            yield from _leaf_pairs(left, a, right, b, percent, alone and a == b)
        elif up >= down:
            todo += [(up - 1, c, down, b) for c in left.children(up, a)] if not (alone and up == down and a == b) else [
                (up - 1, c, up - 1, d) for c in left.children(up, a) for d in left.children(up, a) if c <= d
            ]
        else:
            todo += [(up, a, down - 1, d) for d in right.children(down, b)]


def _leaf_pairs(left: Tree, a: int, right: Tree, b: int, percent: int, same: bool):
    x, y = slice(a * LEAF, (a + 1) * LEAF), slice(b * LEAF, (b + 1) * LEAF)
    shared = np.minimum(left.points[x][:, None, :], right.points[y][None, :, :]).sum(axis=2, dtype=np.int64)
    total = left.sizes[x][:, None] + right.sizes[y][None, :]
    near = (shared * (100 + percent) >= percent * total) & (left.labels[x][:, None] != right.labels[y][None, :])
    if same:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    if len(i):
        yield left.ids[x][i], right.ids[y][j]


def _meet(rows: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The tree join of one pair of blocks (or of one block with itself)."""
    raw = [coordinates(p) for p in rows.column("point").to_pylist()]
    groups = min(map(len, raw))
    points = np.stack([folded(p, groups) for p in raw])
    sizes, labels, ids, block = (rows.column(c).to_numpy() for c in ("n", "label", "doc", "block"))
    sides = [
        Tree(points[block == k], sizes[block == k], labels[block == k], ids[block == k]) for k in np.unique(block)
    ]
    yield from tree_pairs(sides[0], sides[-1], percent)


def _tree_candidates(rows: DataFrame, percent: int) -> DataFrame:
    """``a, b`` from rows (list, doc, label, n, point), list by list."""
    counts = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    dealt = (
        rows.join(counts, "list").withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.xxhash64("list", F.least("block", "other"), F.greatest("block", "other")).alias("meet"),
            "doc", "label", "n", "point", "block",
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "meet"):
            for a, b in _meet(table, percent):
                yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return dealt.repartition("meet").sortWithinPartitions("meet").mapInArrow(run, "a long, b long")


def _leaf_candidates(rows: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """``a, b`` from rows (list, doc, label, n) of lists that fit in one leaf.

    A pair usually shares many lists, so pairs are made distinct before they get their
    points and are bounded.
    """
    items = rows.groupBy("list").agg(F.array_sort(F.collect_list(F.struct("doc", "n", "label"))).alias("items"))

    def partners(x, i):
        close = lambda y: (y["label"] != x["label"]) & (
            F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * percent
        )
        later = F.filter(F.slice("items", i + 2, LEAF), close)
        return F.transform(later, lambda y: F.struct(x["doc"].alias("a"), y["doc"].alias("b")))

    pairs = items.select(F.inline(F.flatten(F.transform("items", partners)))).distinct()
    of = lambda c: points.select(
        F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("point").alias(f"point_{c}")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("point_a").to_pylist(), batch.column("point_b").to_pylist()
            total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            ok = pa.array([may_link(p, q, t, percent) for p, q, t in zip(x, y, total.tolist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(ok)

    return pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(run, "a long, b long")


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal ``key`` from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        values = batch.column(key).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if held and values[a] != current:
                yield pa.Table.from_batches(held)
                held = []
            current = values[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


# The join.


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(broadcast_if_small(ids, max_rows=1_000_000), "doc_id", "left_semi")


def _verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose texts link."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    some = _only(docs, ids)
    both = (
        pairs.join(some.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(some.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrow.cut(whole):
                texts = arrow.raw(batch.column("text_a")) + arrow.raw(batch.column("text_b"))
                known = list(dict.fromkeys(texts))
                where = {t: i for i, t in enumerate(known)}
                sets, at = shingle_sets(known)
                of = lambda t: sets[at[where[t]]:at[where[t] + 1]]
                n = batch.num_rows
                ok = pa.array([similar(of(x), of(y), percent) for x, y in zip(texts[:n], texts[n:])], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(ok)

    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """``doc, label``: the smallest id reachable over ``links`` (a, b).

    Every round, a document takes the smallest label of its neighbours and then its
    label's label; so paths halve in length. With a number of ``rounds`` the labels may
    not be final, but equal labels always mean that documents are connected.
    """
    edges = pin(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = edges.groupBy(F.col("a").alias("doc")).agg(F.min("b").alias("label"))
    labels = pin(labels.select("doc", F.least("doc", "label").alias("label")))
    done = 0
    while rounds is None or done < rounds:
        near = (
            edges.join(labels.select(F.col("doc").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("doc")).agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "doc").select("doc", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        root = labels.select(F.col("doc").alias("label"), F.col("label").alias("root"))
        new = pin(lower.join(root, "label", "left").select(
            "doc", "old", F.least("label", F.coalesce("root", "label")).alias("label")
        ))
        labels, done = new.select("doc", "label"), done + 1
        if new.where("label < old").isEmpty():
            break
    return labels


def join(docs: DataFrame, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    ensure_checkpoint_dir(docs.sparkSession)
    given = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    members = pin(_members(given))
    named = given.where("doc_id is not null")
    whole = members.where("n > 0 and doc_id is not null").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    sets = whole.groupBy("a", "b", "n").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    # Only sets with copies are joined back, each under every salt: copies may be many.
    copied = sets.where("copies > 1").select(
        "a", "b", "n", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    firsts = pin(
        whole.join(copied, ["a", "b", "n", "salt"], "left").select("doc_id", F.coalesce("first", "doc_id").alias("first"), "n")
    )

    # A copy has the keys of the first of its set, so only that one gives keys.
    copies = firsts.groupBy("doc_id").agg(F.bool_and(F.col("first") != F.col("doc_id")).alias("copy")).where("copy")
    copies = broadcast_if_small(copies.select("doc_id"), max_rows=1_000_000)
    lists = _lists(_keyed(named.join(copies, "doc_id", "left_anti"), percent))
    inside = (
        lists.select("list", F.explode("docs").alias("doc_id")).join(firsts, "doc_id")
        .select("list", F.col("first").alias("doc"), "n").distinct()
    )
    heads = inside.groupBy("list").agg(F.min(F.struct("doc", "n")).alias("head"), F.max("doc").alias("last"))
    inside = pin(
        inside.join(heads.where("head.doc < last"), "list").select("list", "doc", "n", "head")
    )
    first = F.col("head.doc")
    close = F.least("n", "head.n") * 100 >= F.greatest("n", "head.n") * percent
    starred = pin(
        inside.where((F.col("doc") != first) & close).select(first.alias("a"), F.col("doc").alias("b")).distinct()
    )
    links = pin(_verified(starred, named, percent))
    rough = components(links, rounds=2)

    labelled = inside.join(rough, "doc", "left").select(
        "list", "doc", "n", first.alias("head"), F.coalesce("label", "doc").alias("label")
    )
    sizes = labelled.groupBy("list").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size")
    ).where("low < high")
    split = pin(labelled.join(sizes.select("list", "size"), "list"))
    points = pin(_points(_only(named, split.select(F.col("doc").alias("doc_id")).distinct())))
    # Long lists with one head overlap: together they are one list, which has all their pairs.
    trees = (
        split.where(F.col("size") > LEAF).select(F.col("head").alias("list"), "doc", "label").distinct()
        .join(points.withColumnRenamed("doc_id", "doc"), "doc")
    )
    found = _leaf_candidates(split.where(F.col("size") <= LEAF), points, percent).unionByName(
        _tree_candidates(trees, percent)
    )
    others = pin(found.distinct().join(starred, ["a", "b"], "left_anti"))
    more = _verified(others, named, percent)
    lowest = firsts.groupBy("doc_id").agg(F.min("first").alias("a"))
    twins = firsts.join(lowest, "doc_id").where("a != first").select("a", F.col("first").alias("b"))

    final = components(links.unionByName(more).unionByName(twins))
    placed = (
        firsts.join(final, firsts["first"] == final["doc"], "left")
        .select(F.col("doc_id").alias("of"), F.coalesce("label", "first").alias("component"))
        .groupBy("of").agg(F.min("component").alias("component"))
    )
    return members.join(placed, members["doc_id"] == placed["of"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )
