"""Nearest neighbours against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, rep long, score int, list string, ids int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], SCHEMA)


def product(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += float(x) * float(y)
    return total


def brute(rows, top, width):
    usable = {}
    for i, v in rows:
        if i is None or v is None or len(v) != width or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        v = np.array(v, np.float32).tolist()
        usable[i] = min(usable.get(i, v), v)
    out = []
    for q in usable:
        if q % 20 == 0:
            near = sorted((-product(usable[q], v), i) for i, v in usable.items() if i != q)[:top]
            out += [(q, k, i, -s) for k, (s, i) in enumerate(near, 1)]
    return sorted(out)


def case(seed, n=400, width=12):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, width))
    rows = [(int(i), (centres[i % 6] + 0.4 * rng.standard_normal(width) * (1 + i % 3)).tolist()) for i in rng.permutation(n)]
    same = rows[5][1]
    rows += [(1000 + 3 * i, same) for i in range(120)]  # a very common vector, some of it asking
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None), (2020, [0.0] * width), (2040, [1.0] * (width - 1) + [None]), (2060, [1.0] * (width - 1) + [nan])]
    rows += [(2080, [inf] + [1.0] * (width - 1)), (2100, [1.0] * (width + 2)), (2120, []), (None, same), (40, same), (40, same)]
    return rows


@pytest.mark.parametrize("top, part, chunk, lists", [(20, 8192, 4096, 64), (3, 20, 5, 30)])
def test_all_lists_and_no_doubt_give_the_exact_neighbours(spark, monkeypatch, top, part, chunk, lists):
    monkeypatch.setattr(neighbours, "PART", part)
    monkeypatch.setattr(neighbours, "CHUNK", chunk)
    monkeypatch.setattr(neighbours, "LIST", lists)
    monkeypatch.setattr(neighbours, "ROWS", 16)
    monkeypatch.setattr(neighbours, "COLUMNS", 4)
    monkeypatch.setattr(neighbours, "EPSILON", 1e6)
    rows = case(top)
    found = neighbours.search(table(spark, rows), F.col("vec_id") % 20 == 0, top, recall=None)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, top, 12)


def test_recall_on_the_given_vectors(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    want = brute(rows, 20, 64)
    got = {(r.query_id, r.vec_id): r.score for r in neighbours.search(vectors, F.col("vec_id") % 20 == 0).collect()}
    hit = [(q, i, s) for q, _, i, s in want if (q, i) in got]
    assert len(got) == len(want) and len(hit) >= 0.95 * len(want)
    assert all(got[q, i] == s for q, i, s in hit)


def test_few_rows_and_none(spark):
    asks = F.col("vec_id") % 20 == 0
    assert neighbours.search(table(spark, []), asks).count() == 0
    assert neighbours.search(table(spark, [(0, [1.0, 2.0])]), asks).count() == 0
    found = neighbours.search(table(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-1.0, 0.5])]), asks).collect()
    assert [tuple(r) for r in sorted(found)] == [(0, 1, 1, 5.0), (0, 2, 2, 0.0)]
    assert neighbours.search(table(spark, [(1, [1.0]), (2, [2.0])]), asks).count() == 0


def test_a_scan_gives_up_most_vectors_and_keeps_the_near():
    rng = np.random.default_rng(2)
    rows = rng.standard_normal((4000, 64))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    index = neighbours.fit(rows, 1.0, 4, 20, 0.97)
    part = neighbours.Part(index, rows, np.arange(4000), np.arange(4001))
    query = rows[7] + 0.1 * rng.standard_normal(64)
    rotated = index.asked(query[None])[0]
    near = np.sort(rows @ query)[::-1]
    limit = 2 - 2 / np.linalg.norm(query) * near[9]
    alive = part._alive(rotated, limit * (1 + 1e-9), 0, 4000)
    assert 7 in alive and 8 <= len(alive) <= 10
    scores, ids = part.scan(query, rotated, -np.inf, 10)
    assert ids[0] == 7 and np.allclose(scores, near[:10])


@pytest.mark.parametrize("few", [1, 16, 1 << 30])
def test_queries_are_scanned_together_as_each_would_be(monkeypatch, few):
    monkeypatch.setattr(neighbours, "FEW", few)
    monkeypatch.setattr(neighbours, "PAIRS", 50)
    monkeypatch.setattr(neighbours, "TOGETHER", 30)
    monkeypatch.setattr(neighbours, "ROWS", 500)
    monkeypatch.setattr(neighbours, "EPSILON", 1e6)
    rng = np.random.default_rng(3)
    rows = rng.integers(-3, 4, (1200, 24)).astype(float)  # many equal scores
    begin = np.concatenate([[0], np.cumsum(1 + rng.integers(0, 3, 1200))])
    ids = rng.permutation(begin[-1])
    index = neighbours.fit(rows, np.sqrt((rows**2).sum(axis=1).max()), 4, 20, 0.97)
    queries = rows[:100] * rng.integers(1, 5, (100, 1))
    scores = np.repeat(queries @ rows.T, np.diff(begin), axis=1)
    bounds = np.where(np.arange(100) % 3 == 0, -np.inf, np.sort(scores, axis=1)[:, -10])
    bounds[1::9] = scores.max() + 1  # nothing is that near
    want = []
    for q in range(100):
        near = sorted((-s, i) for s, i in zip(scores[q], ids) if s >= bounds[q])[:10]
        want += [(q, -s, i) for s, i in near]
    part = neighbours.Part(index, rows, ids, begin)
    tiles, pairs = [], part._pairs
    monkeypatch.setattr(part, "_pairs", lambda *x: tiles.append(len(x[1])) or pairs(*x))
    found = part.scan_all(queries, index.asked(queries), bounds, 10)
    assert list(zip(*(x.tolist() for x in found))) == want
    assert tiles == [30] * 9 + [10] * 3
    assert [len(x) for x in part.scan_all(queries[:0], index.asked(queries[:0]), bounds[:0], 10)] == [0, 0, 0]
