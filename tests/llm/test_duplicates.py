"""Similarity join, line windows and fingerprints against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from earshot.llm import fingerprints, jaccard, lines
from earshot.llm.shingles import shingle_sets, similar

SCHEMA = "doc_id long, text string, lang string, n long, label string, point string, `first` int, key int"


def table(spark, rows):
    """Documents with columns that clash with the operators' own names."""
    return spark.createDataFrame([(i, t, "en", 1, "x", "y", 2, 3) for i, t in rows], SCHEMA)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    texts = [None, "", "  \t\n", "one", "One", "two words", "two words", "a b c d e", "A\tb c  d e"]
    for size in (6, 9, 20, 45, 130, 400):
        base = words(rng, size)
        texts += [" ".join(edited(rng, base, rng.randrange(0, 1 + size // 30))) for _ in range(12)]
        texts += [" ".join(base + words(rng, extra)) for extra in range(0, size // 4 + 2, 1 + size // 20)]
    hub = words(rng, 150)  # copies near the hub but not near one another
    texts += [" ".join(hub)] + [" ".join(edited(rng, hub, 3)) for _ in range(25)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(7 * i, texts[k]) for i, k in enumerate(order)]


def brute_components(rows, percent=80):
    def shingles(text):
        fold = (text or "").translate({c: c + 32 for c in range(65, 91)})
        found = [w for w in re.split("[\x20\x09-\x0d]+", fold) if w]
        return {tuple(found[i:i + 5]) for i in range(max(1, len(found) - 4))} if found else set()

    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            union, common = len(sets[i] | sets[j]), len(sets[i] & sets[j])
            if union and 100 * common >= percent * union:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("block, leaf", [(4096, 32), (5, 2)])
def test_join_finds_the_components_of_all_pairs(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    rows = corpus()
    found = jaccard.join(table(spark, rows))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute_components(rows)


def test_join_with_repeated_ids_null_ids_and_no_rows(spark):
    a, b, c = "a b c d e f", "p q r s t u", "x y z x y z x"
    rows = [(1, a), (2, a), (2, b), (3, b), (3, b), (None, a), (4, c)]
    found = jaccard.join(table(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in found) == [
        (-1, -1), (1, 1), (2, 1), (2, 1), (3, 1), (3, 1), (4, 4),
    ]
    assert jaccard.join(table(spark, [])).count() == 0


def test_every_linked_pair_has_a_key_in_common():
    rng = random.Random(3)
    for _ in range(300):
        size = rng.choice([1, 2, 4, 5, 7, 8, 15, 16, 31, 32, 40, 63, 100, 250])
        base = np.array([rng.getrandbits(64) for _ in range(size)], np.uint64)
        most = jaccard.differing(size, size, 80) // 2
        other = base.copy()
        for k in range(rng.randrange(most + 1)):
            other[k] = rng.getrandbits(64)
        grown = np.concatenate([base, np.array([rng.getrandbits(64) for _ in range(size // 4)], np.uint64)])
        for x, y in ((base, other), (base, grown)):
            x, y = np.unique(x), np.unique(y)
            assert similar(x, y, 80)
            keys, owner = jaccard.keys(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), 80)
            assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


def test_tree_rules_out_no_pair_that_links():
    rng = random.Random(5)
    bases = [words(rng, n) for n in (40, 60, 200)]
    texts = [" ".join(edited(rng, rng.choice(bases), rng.randrange(6))).encode() for _ in range(300)]
    sets, at = shingle_sets(texts)
    packed = [jaccard.point(sets[a:b]) for a, b in zip(at[:-1], at[1:])]
    points = [jaccard.coordinates(p) for p in packed]
    groups = min(map(len, points))
    folded = np.stack([jaccard.folded(p, groups) for p in points])
    ids = np.arange(len(texts))
    tree = jaccard.Tree(folded, np.diff(at), ids.copy(), ids)
    near = {(min(x, y), max(x, y)) for a, b in jaccard.tree_pairs(tree, tree, 80) for x, y in zip(a.tolist(), b.tolist())}
    links = {
        (i, j) for i in ids.tolist() for j in range(i + 1, len(texts))
        if similar(sets[at[i]:at[i + 1]], sets[at[j]:at[j + 1]], 80)
    }
    assert links and links <= near and len(near) < len(texts) ** 2 / 3
    sizes = np.diff(at).tolist()
    assert all(jaccard.may_link(packed[i], packed[j], sizes[i] + sizes[j], 80) for i, j in links)


def test_lists_of_a_hot_key_are_written_in_parts(monkeypatch):
    monkeypatch.setattr(jaccard, "LIST", 10)
    lists = jaccard._Lists()
    key = np.array([1] + [2] * 55 + [3, 4, 4], np.int64)
    docs = np.arange(len(key), dtype=np.int64)
    out = []
    for at in range(0, len(key), 7):
        out += lists.take(key[at:at + 7], docs[at:at + 7])
    out += lists.finish()
    rows = [r for b in out for r in b.to_pylist()]
    hot = [r for r in rows if r["list"] == 2]
    assert sorted(d for r in hot for d in r["docs"]) == list(range(1, 56))
    assert len({r["part"] for r in hot}) == len(hot) > 3
    assert [r["docs"] for r in rows if r["list"] != 2] == [[57, 58]]


def test_components_of_a_long_chain(spark):
    chain = spark.range(60).select((F.col("id") * 3).alias("a"), (F.col("id") * 3 + 3).alias("b"))
    assert jaccard.components(chain).where("label != 0").count() == 0


def brute_windows(rows, size=3):
    seen, out = {}, []
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        parts = (text or "").split("\n")
        gone = set()
        for at in range(len(parts) - size + 1):
            window = tuple(parts[at:at + size])
            if text is None or not any(re.search(r"\S", x) for x in window):
                continue
            if seen.setdefault(window, (i, at)) != (i, at):
                gone |= set(range(at, at + size))
        out.append((i, None if text is None else "\n".join(p for k, p in enumerate(parts) if k not in gone)))
    return out


def test_line_windows(spark):
    rng = random.Random(2)
    some = [f"line {k}" for k in range(12)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(some) for _ in range(rng.randrange(1, 14)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a"), (103, "x\nx\nx\nx\nx"), (104, "\n\n\n\n"), (105, "\n" * 9)]
    found = lines.drop_repeated_windows(table(spark, rows))
    assert found.columns == ["doc_id", "text", "lang", "n", "label", "point", "first", "key", "n_lines", "n_removed"]
    assert sorted((r.doc_id, r.text) for r in found.collect()) == brute_windows(rows)
    twice = table(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc"), (2, "a\nb\nc\nd")])
    assert sorted((r.doc_id or 0, r.text) for r in lines.drop_repeated_windows(twice).collect()) == [
        (0, "a\nb\nc"), (1, "a\nb\nc"), (1, "a\nb\nc"), (2, "d"),
    ]
    assert lines.drop_repeated_windows(table(spark, [])).count() == 0


def brute_fingerprint(text):
    def number(value, seed=42):
        return xxhash.xxh64(value.encode(), seed=seed).intdigest()

    one = xxhash.xxh64((1).to_bytes(4, "little"), seed=42).intdigest()
    parts = [p for x in (text or "").split("\n") if (p := x.strip(" "))]
    sentences = [s for p in parts for s in re.split(r"(?<=[.!?])\s+", p) if s]
    wide = [len(parts), len(sentences)]
    return parts, sentences, wide, number, one


def test_fingerprints_add_up(spark):
    rng = random.Random(4)
    texts = ["\n".join(" ".join(words(rng, 5)) + "." for _ in range(n)) for n in (0, 1, 2, 5, 30, 400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(50, texts[3] + "\n\n" + texts[4]), (51, None)]
    rows += [(52, "\n".join(reversed(texts[4].split("\n")))), (53, "a\na"), (54, "a")]
    prints = fingerprints.with_fingerprint(table(spark, rows), "text", "label")
    found = {r.doc_id: r.label for r in prints.collect()}
    assert found[52] == found[4] != found[3] and found[51] == found[0] and found[53] != found[54]
    for i in (3, 4, 53):
        parts, sentences, wide, number, _ = brute_fingerprint(dict(rows)[i])
        assert [int(found[i][k:k + 8], 16) for k in (0, 8)] == wide
        assert int(found[i][16:24], 16) == sum(number(p) & 0xFFFFFFFF for p in parts) % (1 << 32)
        lanes = [0] * fingerprints.LANES
        for s in sentences:
            lanes[number(s) % fingerprints.LANES] += number(s) >> 32 & 0xFFFF
        at = fingerprints.HEAD * 8
        assert [int(found[i][at + 4 * k:at + 4 * k + 4], 16) for k in range(fingerprints.LANES)] == [
            x % (1 << 16) for x in lanes
        ]
    pair = spark.createDataFrame([(found[3], found[4], found[50])], "a string, b string, both string")
    row = pair.select(
        fingerprints.combine(F.col("a"), F.col("b")).alias("sum"),
        fingerprints.combine(F.col("both"), F.col("b"), -1).alias("rest"),
        fingerprints.likeness(F.col("a"), F.col("both")).alias("part"),
        fingerprints.likeness(F.col("a"), F.col("b")).alias("none"),
        fingerprints.likeness(F.col("a"), F.col("a")).alias("same"),
    ).first()
    assert row["sum"] == found[50] and row.rest == found[3]
    assert row.same == 1 and row.none < 0.15 < row.part < 0.5  # 5 of 35 sentences: 10 / 40


@pytest.mark.parametrize("n", [100, 3000, 5000, 12_000, 40_000])
def test_likeness_of_long_texts(spark, n):
    text = lambda first: "\n".join(f"sentence {k}." for k in range(first, first + n))
    rows = [(0, text(0)), (1, text(n)), (2, text(n // 2)), (3, text(n) + "\n" + text(2 * n))]
    prints = fingerprints.with_fingerprint(table(spark, rows), "text", "label")
    found = {r.doc_id: r.label for r in prints.collect()}
    pairs = spark.createDataFrame([(found[0], found[1]), (found[0], found[2])], "a string, b string")
    none, half = (r[0] for r in pairs.select(fingerprints.likeness(F.col("a"), F.col("b"))).collect())
    assert none < 0.2 and 0.3 < half < 0.7, (none, half)
    rest = spark.createDataFrame([(found[3], found[1])], "a string, b string").select(
        fingerprints.combine(F.col("a"), F.col("b"), -1).alias("x")
    ).first().x
    after = fingerprints.with_fingerprint(table(spark, [(4, text(2 * n))]), "text", "label").first().label
    assert rest == after


@pytest.mark.parametrize("per_piece", [20_000, 4])
def test_next_document_in_every_cut(spark, monkeypatch, per_piece):
    monkeypatch.setattr(fingerprints, "ROWS_PER_PIECE", per_piece)
    rows = [(i * i, f"text é{i} " * (i % 4)) for i in range(23)] + [(None, "no id")]
    found = {r.doc_id: r for r in fingerprints.edit_report(table(spark, rows)).collect()}
    order = sorted((r for r in rows if r[0] is not None), reverse=True) + [rows[-1]]
    import hashlib
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        want = text[:len(text) - half] + after[:half]
        assert found[i].n_chars == len(text)
        assert found[i].edited_sha256 == hashlib.sha256(want.encode()).hexdigest(), i
    assert fingerprints.edit_report(table(spark, [])).count() == 0
    only = fingerprints.edit_report(table(spark, [(9, "abcd")])).first()
    assert only.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and only.near_next == 1
