"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import pytest

from earshot.llm import lexical

DOCS = "doc_id long, text string, item_id long, score string, n int"
ITEMS = "item_id long, text string, doc_id int"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERM, (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, top):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, words = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, c in counted:
            m = 50 + 50 * c.total() * n // words
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in wanted if c[t]
            )
            if s > 0 and i is not None:
                scored.append((-s, i))
        out += [(item, k, i, -s) for k, (s, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def run(spark, docs, items, top):
    found = lexical.search(
        spark.createDataFrame([(i, t, 5, "x", 1) for i, t in docs], DOCS),
        spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS), top,
    )
    assert dict(found.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    return sorted(tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect())


def case(seed):
    rng = random.Random(seed)
    some = [f"w{k}" for k in range(60)] + ["é", "ÉÀ", "x1", "日本"]
    weights = [1 / (k + 1) for k in range(len(some))]
    text = lambda n: ", ".join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(some, weights, k=n))
    docs = [(i, text(rng.randrange(0, 40))) for i in range(150)]
    docs += [(500 + i, docs[3][1]) for i in range(40)]  # copies: ties
    docs += [(7, docs[9][1]), (7, docs[9][1]), (None, docs[9][1]), (800, None), (801, ""), (802, "_-! "), (803, text(3000))]
    items = [(i, text(rng.randrange(1, 25))) for i in range(30)] + [(3, "w1 w2 more"), (40, None), (41, ""), (None, "w1"), (42, "absent")]
    return docs, items


@pytest.mark.parametrize("top, rows, block", [(50, 512, 4 << 20), (4, 7, 4 << 20), (9, 512, 400)])
def test_ranks_equal_those_of_all_scores(spark, monkeypatch, top, rows, block):
    monkeypatch.setattr(lexical, "ROWS", rows)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    docs, items = case(top)
    assert run(spark, docs, items, top) == brute(docs, items, top)


def test_no_documents_no_items(spark):
    docs, items = case(1)
    assert run(spark, [], items, 5) == [] and run(spark, docs, [], 5) == []
    assert run(spark, [(1, None), (2, "")], items, 5) == []


def test_graph_shares_sums_and_covers_each_item_once():
    rng = random.Random(3)
    items = {i: {f"t{rng.randrange(40)}".encode() for _ in range(15)} for i in range(50)}
    items |= {60: items[0] | {b"own"}, 61: set(items[0])}
    plan = lexical.Plan(items)
    under = [{k} for k in range(plan.leaves)]
    for a, b in plan.pairs:
        assert not under[a] & under[b]
        under.append(under[a] | under[b])
    by_leaf = [{t for t, x in zip(plan.terms, plan.leaf) if x == k} for k in range(plan.leaves)]
    for name, parts in zip(plan.items, plan.parts):
        assert sum(len(by_leaf[x]) for p in parts for x in under[p]) == len(items[name])
        assert {t for p in parts for x in under[p] for t in by_leaf[x]} == items[name]
    inner = range(plan.leaves, plan.leaves + len(plan.pairs))
    for node in inner:
        own = {t for x in under[node] for t in by_leaf[x]}
        assert sum(own <= held for held in items.values()) > 1
    adds = sum(map(len, plan.parts)) + len(plan.pairs)
    assert adds < sum(map(len, items.values()))


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = b"one two. Three " * 500 + b"x" * 300
    whole = lexical.count_terms(text)
    monkeypatch.setattr(lexical, "PIECE", 50)
    assert lexical.count_terms(text) == whole and whole[b"three"] == 500 and whole[b"x" * 300] == 1
