import pytest
from pyspark.sql import functions as F

from earshot.operators import audio, batches, quality, selection, windows


def test_input_violations(spark):
    expected = spark.createDataFrame(
        [("a", [3], 16, 96, None), ("a_noise", [3], 16, 96, "a"), ("b", [2, 3], 16, 96, None), ("c", [2], None, 96, None),
         ("d", [3], 16, 96, None), ("orphan", [3], 16, 96, "gone")],
        "input string, dims array<int>, frames long, width long, same_as string")

    def broken(**shapes):
        rows = list(shapes.items())
        found = quality.input_violations(expected, spark.createDataFrame(rows, "input string, shape array<long>"))
        return sorted((r.input, r.rule) for r in found.collect())

    good = {"a": [9, 16, 96], "a_noise": [9, 16, 96], "b": [70, 96], "c": [5, 96], "d": [1, 16, 96], "orphan": [1, 16, 96]}
    assert broken(**good) == []
    assert broken(**{**good, "b": [7, 16, 96]}) == []
    assert broken(**{**good, "a_noise": [8, 16, 96], "b": [7, 17, 96], "c": [5, 1, 96], "d": [1, 16, 95]}) == [
        ("a_noise", "same shape"), ("b", "frames"), ("c", "dimensions"), ("d", "width")]
    assert broken(**{k: v for k, v in good.items() if k != "c"}) == [("c", "missing")]
    assert len(broken(**{"x": [1]})) == 6


def test_sets_shorter_than_a_window(spark):
    frames = spark.createDataFrame([(s, i) for s, n in ((1, 16), (2, 15), (3, 40)) for i in range(n)], "s int, i int")
    with pytest.raises(ValueError, match="2 : 15 frames are shorter"):
        windows.checked(frames, ["s"], 16)
    assert windows.checked(frames.where("s <> 2"), ["s"], 16).count() == 56
    sized = frames.groupBy("s").agg(F.count("*").alias("frames"))
    found = {r.s: (r.windows, r.error is None) for r in windows.window_counts(sized, 16).collect()}
    assert found == {1: (1, True), 2: (None, False), 3: (25, True)}


def test_what_is_published(spark):
    pair = "set_name string, candidate string, recall double"
    exact = spark.createDataFrame([("u", "x", 0.5), ("u", "y", 0.7), ("u", "baseline", 0.9), ("own", "x", 0.9), ("own", "y", 0.1)], pair)
    cond = spark.createDataFrame(
        [("u", "x", "env", 0.8), ("u", "y", "env", 0.2), ("u", "x", "music", 0.9), ("u", "x", "quiet", None), ("u", "y", "quiet", None)],
        "set_name string, candidate string, condition string, recall double")
    rates = exact.select("set_name", "candidate", F.lit(1.0).alias("lowest_rate"))

    def choose(select_on, condition):
        rows = selection.choose_published(exact, cond, exact, rates, select_on, condition, "u").collect()
        return [tuple(r) for r in rows]

    assert choose("u", "mixed") == [("u", "mixed", "y", "exact")]
    assert choose("u", "env") == [("u", "env", "x", "exact")]
    assert choose("u", "music") == [("u", "mixed", "y", "exact")]  # not all were measured on it
    assert choose("u", "quiet") == [("u", "quiet", "y", "grid")]  # measured, but within no budget
    assert choose("none", "mixed") == [("u", "mixed", "y", "exact")]
    assert choose("own", "env") == [("own", "mixed", "x", "exact")]


def test_shape_audit_finds_a_short_window(spark):
    rows = spark.createDataFrame(
        [("a", [[1.0, 2.0]] * 3), ("b", [[1.0, 2.0]] * 3), ("b", [[1.0]] * 3)], "k string, x array<array<double>>")
    audit = {r.k: r for r in quality.shape_audit(rows, ["k"], "x", 3, 2).collect()}
    assert audit["a"].fits and not audit["b"].fits and audit["b"].min_width == 1


def test_scores_that_are_not_scores(spark):
    rows = spark.createDataFrame(
        [("a", 0.0), ("a", 1.0), ("b", float("nan")), ("b", 1.5), ("b", None)], "k string, score double")
    got = {r.k: (r.bad, r.sane) for r in quality.score_sanity(rows, ["k"]).collect()}
    assert got == {"a": (0, True), "b": (3, False)}


def test_threshold_precedence(spark):
    requests = spark.createDataFrame(
        [(0, "m", 0.5, 0.9), (1, "m", 0.5, None), (2, "m", 0.2, None), (3, "none", 0.5, None)],
        "n long, model string, budget double, given double")
    profiles = spark.createDataFrame([("m", 0.5, 0.7), ("m", 0.2, None)], "model string, budget double, threshold double")
    got = {r.n: (r.used, r.reason) for r in quality.resolve_thresholds(requests, profiles).collect()}
    assert got == {
        0: (0.9, "given"), 1: (0.7, "measured"),
        2: (0.5, "default: budget not reachable"), 3: (0.5, "default: no metrics"),
    }


def test_row_count_must_equal_the_plan(spark):
    assert audio.require_rows(spark.range(3), 3).first().n_rows == 3
    with pytest.raises(Exception, match="expected 4 rows"):
        audio.require_rows(spark.range(3), 4).collect()


def test_holdout_larger_than_the_bank_is_an_error(spark):
    bank = spark.range(100).withColumnRenamed("id", "idx")
    sides = batches.tail_holdout(bank, 100, 0.01, 16).groupBy("side").count().collect()
    assert {r.side: r["count"] for r in sides} == {"train": 72, "evaluate": 28}
    with pytest.raises(ValueError):
        batches.tail_holdout(bank, 100, 10.0, 16)


def test_batch_cursor_wraps(spark):
    plan = batches.batch_plan(spark, 3, {"negative": 5, "positive": 2}, {"negative": 4, "positive": 1})
    draws = [r.idx for r in plan.where(F.col("class") == "negative").orderBy("step", "slot").collect()]
    assert draws == [i % 5 for i in range(12)]
    assert {(r["class"], r.label) for r in plan.collect()} == {("negative", 0), ("positive", 1)}
