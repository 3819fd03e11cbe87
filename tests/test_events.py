import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.functions import refractory
from earshot.operators import events

SCHEMA = "stream_id long, frame_idx long, score double"


@pytest.fixture(scope="module")
def streams():
    rng = random.Random(1)
    data = {}
    for s, density in enumerate([0.02, 0.1, 0.5, 1.0, 0.3, 0.005]):
        frames = [i for i in range(rng.randint(80, 400)) if rng.random() < density or i % 97 < 25]
        data[s] = [(i, 0.9 if density == 1.0 else round(rng.random(), 2)) for i in frames]
    return data


@pytest.fixture(scope="module")
def scores(spark, streams):
    rows = [(s, i, x) for s, frames in streams.items() for i, x in frames]
    return spark.createDataFrame(rows, SCHEMA).cache()


def counts(scores, thresholds, grouping, chunk, fanout):
    chunks = events.chunk_hits(scores, ["stream_id"], None, chunk)
    limits = F.array(*[F.lit(t) for t in thresholds])
    rows = events.refractory_counts(
        chunks, ["stream_id"], limits, F.lit(grouping), False, chunk, fanout
    )
    return {(r.stream_id, r.threshold): (r.events, r.frames) for r in rows.collect()}


@pytest.mark.parametrize("grouping,chunk,fanout", [(1, 8, 4), (3, 16, 2), (7, 8, 3), (50, 64, 2), (3, 4096, 4096)])
def test_counts_do_not_depend_on_chunks(scores, streams, grouping, chunk, fanout):
    got = counts(scores, [0.0, 0.5, 0.9], grouping, chunk, fanout)
    for s, frames in streams.items():
        for t in [0.0, 0.5, 0.9]:
            marks = [i for i, x in frames if x >= t]
            want = (len(brute.events(marks, grouping)), len(marks))
            assert got.get((s, t), (0, 0)) == want


@pytest.mark.parametrize("grouping,chunk,fanout", [(3, 8, 3), (7, 4096, 4096)])
def test_event_rows(scores, streams, grouping, chunk, fanout):
    rows = events.refractory_events(scores, ["stream_id"], 0.3, grouping, chunk, fanout).collect()
    got = {}
    for r in rows:
        got.setdefault(r.stream_id, []).append(r.frame_idx)
    for s, frames in streams.items():
        assert sorted(got.get(s, [])) == brute.events([i for i, x in frames if x >= 0.3], grouping)


@pytest.mark.parametrize("chunk,fanout", [(8, 3), (4096, 4096)])
def test_runs(scores, streams, chunk, fanout):
    got = {}
    for r in events.score_runs(scores, ["stream_id"], 0.3, chunk, fanout).collect():
        got.setdefault(r.stream_id, []).append((r.lo, r.hi, r.peak, r.peak_idx))
    for s, frames in streams.items():
        assert sorted(got.get(s, [])) == brute.runs(frames, 0.3)


def test_peak_hold_crosses_chunks(spark):
    rows = [(0, i, 1.0 if i in (0, 2290) else 0.001) for i in range(2400)]
    held = events.peak_hold(spark.createDataFrame(rows, SCHEMA), ["stream_id"], 2300)
    level, want = 0.0, {}
    for _, i, x in rows:
        level = max(0.7 * level, x)
        want[i] = level
    for r in held.collect():
        assert r.held == pytest.approx(want[r.frame_idx], rel=1e-9)


@pytest.mark.parametrize("marks,expected", [([0], 1), (range(20), 1), ([*range(20), *range(80, 86)], 2)])
def test_worked_examples(spark, marks, expected):
    rows = spark.createDataFrame([(0, i, 1.0) for i in marks], SCHEMA)
    assert counts(rows, [0.5], 50, 4096, 4096)[(0, 0.5)] == (expected, len(list(marks)))


def test_more_hits_never_mean_fewer_events():
    """What makes the threshold search exact."""
    rng = random.Random(3)
    for _ in range(3000):
        marks = {i for i in range(30) if rng.random() < 0.4}
        extra = marks | {rng.randrange(30)}
        g = rng.randint(1, 6)
        assert len(brute.events(extra, g)) >= len(brute.events(marks, g))


def test_the_floor_reaches_the_scan(spark, scores, tmp_path):
    scores.write.parquet(str(tmp_path / "scores"))
    chunks = events.chunk_hits(spark.read.parquet(str(tmp_path / "scores")), ["stream_id"], 0.5)
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(score,0.5)" in plan
    assert plan.count("Exchange") == 1


def test_steps_of_scores_add_up_to_every_count():
    rng = random.Random(7)
    for _ in range(300):
        gap, digits = rng.randrange(0, 6), rng.choice([1, 4])
        hits = sorted(rng.sample(range(60), rng.randrange(1, 40)))
        scores = [round(rng.random(), digits) for _ in hits]
        added = refractory.step_events(np.array(hits), np.array(scores), gap)
        assert (added >= 0).all()
        for t in {*scores, -1.0}:
            above = [h for h, s in zip(hits, scores) if s > t]
            assert sum(a for a, s in zip(added, scores) if s > t) == len(brute.events(above, gap))


@pytest.mark.parametrize("chunk", [8, 64])
def test_event_steps_over_chunks(spark, chunk):
    rng = random.Random(chunk)
    rows = [(k, 4, i, round(rng.random(), 2)) for k in range(3) for i in sorted(rng.sample(range(300), [20, 120, 290][k]))]
    scores = spark.createDataFrame(rows, "stream_id long, grouping int, frame_idx long, score double")
    chunks = events.chunk_hits(scores, ["stream_id", "grouping"], None, chunk)
    steps = events.event_steps(chunks, ["stream_id"], chunk).collect()
    for k in range(3):
        for t in (-1.0, 0.2, 0.5, 0.77, 0.9):
            want = len(brute.events([i for s, _, i, x in rows if s == k and x > t], 4))
            assert sum(r.events for r in steps if r.stream_id == k and r.score > t) == want
