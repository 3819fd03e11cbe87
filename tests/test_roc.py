import random

import brute
import pytest

from earshot.operators import roc

FA = "set_name string, candidate string, stream_id long, frame_idx long, score double"
POS = "candidate string, clip_id long, score double"
SETS = "set_name string, hours double, grouping int"


def make(seed, ties):
    rng = random.Random(seed)
    digits = 1 if ties else 6
    return {
        ("s", c): {k: [(i, round(rng.random(), digits)) for i in range(60)] for k in range(3)}
        for c in ("a", "b")
    }


@pytest.mark.parametrize("seed,ties,hours", [(1, False, 12.0), (2, True, 20.0), (3, False, 0.3)])
def test_search_finds_what_a_full_sweep_finds(spark, seed, ties, hours):
    data = make(seed, ties)
    fa = spark.createDataFrame(
        [(s, c, k, i, x) for (s, c), streams in data.items() for k, fs in streams.items() for i, x in fs], FA)
    pos = spark.createDataFrame([(c, i, i / 40) for c in ("a", "b") for i in range(40)], POS)
    sets = spark.createDataFrame([("s", hours, 3)], SETS)
    rows = roc.exact_profile(fa, pos, sets).collect()
    assert len(rows) == 8
    for r in rows:
        want = brute.exact_threshold(data[("s", r.candidate)], r.budget * hours, 3)
        assert r.threshold == want
        assert r.recall == pytest.approx(sum(i / 40 > want for i in range(40)) / 40)


def test_everything_fits_a_large_budget(spark):
    fa = spark.createDataFrame([("s", "a", 0, i, i / 10) for i in range(10)], FA)
    pos = spark.createDataFrame([("a", 0, 0.0)], POS)
    sets = spark.createDataFrame([("s", 1000.0, 3)], SETS)
    assert {r.threshold for r in roc.exact_profile(fa, pos, sets).collect()} == {-1.0}


def test_empty_set_gives_null(spark):
    fa = spark.createDataFrame([], FA)
    pos = spark.createDataFrame([("a", 0, 0.5)], POS)
    sets = spark.createDataFrame([("s", 1.0, 3)], SETS)
    rows = roc.exact_profile(fa, pos, sets).collect()
    assert len(rows) == 4 and all(r.threshold is None and r.recall is None for r in rows)


def test_unreachable_budget_and_operating_point(spark):
    fa = spark.createDataFrame([("s", "a", 0, i * 10, 1.0) for i in range(50)], FA)
    pos = spark.createDataFrame([("a", i, 1.0) for i in range(4)], POS)
    sets = spark.createDataFrame([("s", 1.0, 3)], SETS)
    curve = roc.curve(fa, pos, sets)
    assert curve.count() == 11 and curve.where("events <> 50").isEmpty()
    assert all(r.recall is None for r in roc.recall_profile(curve, ["set_name", "candidate"]).collect())
    point = roc.operating_point(curve, ["set_name", "candidate"], 0.2).first()
    assert point.candidate == "a" and point.threshold is None


def test_strict_and_non_strict_readings_differ(spark):
    fa = spark.createDataFrame([("s", "a", 0, 0, 0.5)], FA)
    pos = spark.createDataFrame([("a", 0, 0.5)], POS)
    sets = spark.createDataFrame([("s", 1.0, 3)], SETS)
    at_half = roc.at_threshold(roc.curve(fa, pos, sets)).first()
    assert at_half.recall == 1.0 and at_half.events == 1
    thresholds = spark.createDataFrame([("s", "a", 0.2, 0.5)], "set_name string, candidate string, budget double, threshold double")
    assert roc.recall_above(pos, thresholds, []).first().recall == 0.0
