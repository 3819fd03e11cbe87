"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from earshot.llm import variants

SCHEMA = "doc_id long, text string, word string, n long, key int, side int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], SCHEMA)


def brute(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = max(a, b, key=len), min(a, b, key=len)
        return len(a) == len(b) + 1 and any(a[:k] + a[k + 1:] == b for k in range(len(a)))

    out = {}
    for w, n in counts.items():
        others = [(-m, o) for o, m in counts.items() if near(w, o)]
        less, form = min(others, default=(0, None))
        out[w] = [n, len(others), form, -less] if others and -less >= 5 * n else [n, len(others), None, None]
    for w in out:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w].append(root)
    return {w: tuple(x) for w, x in out.items()}


def corpus(seed, texts=60):
    rng = random.Random(seed)
    letters = "abcdeñÑé"
    bases = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 10))) for _ in range(25)]

    def edit(w):
        k = rng.randrange(len(w) + 1)
        return rng.choice([w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k + 1:]])

    pool = [(b, 400) for b in bases]
    pool += [(edit(b), rng.choice([6, 20, 60])) for b in bases for _ in range(6)]
    pool += [(edit(edit(b)), rng.choice([6, 12])) for b in bases for _ in range(5)]
    words, weights = zip(*pool)
    return [(i, " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, weights, k=200))) for i in range(texts)]


@pytest.mark.parametrize("part, leaf", [(1 << 20, 16), (40, 1)])
def test_groups_equal_those_of_all_pairs(spark, monkeypatch, part, leaf):
    monkeypatch.setattr(variants, "PART", part)
    monkeypatch.setattr(variants, "LEAF", leaf)
    long = "z" * 70_000
    rows = corpus(1) + [(100, None), (101, ""), (102, "12 _ ×"), (None, "nullid " * 9), (7, "twice one. " * 3), (7, "twice one. " * 3)]
    rows += [(200, f"{long} {long[:-1]}y {long}y aa " * 5), (201, f"{long} " * 30)]
    want = brute([r for r in rows if r[0] not in (200, 201)])
    found = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in variants.group(table(spark, rows)).collect()}
    far = {w: found.pop(w) for w in list(found) if len(w) > 60_000}
    assert found == want and any(r[2] for r in want.values())
    assert any(want[r[2]][2] for r in want.values() if r[2])  # chains
    assert far[long][:2] == (35, 2) and far[long + "y"][2] == far[long[:-1] + "y"][2] == long


def test_no_rows(spark):
    assert variants.group(table(spark, [])).count() == 0


def test_each_pair_is_met_once():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcdl") for _ in range(rng.randrange(6, 9))) for _ in range(300)})
    made = variants.Words(words)
    home = variants.key_of(made.length, made.counts[:, :variants.PREFIX])
    row, key = variants.probes(made)
    met = Counter()
    for k in set(home.tolist()):
        inside = [words[i] for i in (home == k).nonzero()[0]]
        asked = [words[i] for i in row[key == k]]
        a, b = variants.Subtrie(inside).near(asked)
        met.update(tuple(sorted((asked[x], inside[y]))) for x, y in zip(a, b))
    assert met and set(met.values()) == {1}
