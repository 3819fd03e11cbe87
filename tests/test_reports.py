import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.functions import scalars
from earshot.operators import report, selection, stress


@pytest.mark.parametrize("n,share", [(1, 0.9), (2, 0.9), (37, 0.1), (200, 0.9)])
def test_percentile_interpolates_like_numpy(spark, n, share):
    rng = random.Random(n)
    values = [round(rng.random(), 1) for _ in range(n)]
    df = spark.createDataFrame(list(enumerate(values)), "ckpt long, v double")
    got = selection.exact_percentile(df, "v", "ckpt", share, rows_per_task=20).first().v
    assert got == pytest.approx(float(np.percentile(values, share * 100)))


def test_gate_falls_back_to_the_best_tenth(spark):
    rows = [(i, 0.5, 0.1 * (i % 5), 1.0 + i) for i in range(25)]
    df = spark.createDataFrame(rows, "ckpt long, val_accuracy double, val_recall double, val_fp_per_hr double")
    kept = selection.recall_gated(df, 0.2).orderBy("place").collect()
    assert [r.ckpt for r in kept] == [1, 0] and all(r.fallback for r in kept)


def test_poisson_interval(spark):
    row = spark.range(1).select(
        scalars.poisson_low(F.lit(5)).alias("a"), scalars.poisson_high(F.lit(5)).alias("b"),
        scalars.poisson_low(F.lit(0)).alias("c"), scalars.poisson_high(F.lit(0)).alias("d")).first()
    assert (round(row.a, 3), round(row.b, 3), row.c, row.d) == (1.611, 11.668, 0.0, 3.69)


def test_fixed_point_shows_the_exact_value(spark):
    values = [0.0625, 0.0005, 0.5125, 0.1875, 0.5, 12.3456, -0.0004, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.s for r in df.select(scalars.fixed_point("v").alias("s")).collect()] == [
        "-" if v is None else f"{v:.3f}" for v in values]


def test_ranking_leaves_out_runs_without_a_reading(spark):
    rows = [(0, 0.5), (1, None), (2, 0.7), (3, 0.5)]
    df = spark.createDataFrame(rows, "n long, recall double")
    assert [(r.n, r.place) for r in report.ranking(df, "n").orderBy("place").collect()] == [(2, 1), (0, 2), (3, 3)]


def test_stress_grid_has_every_cell_and_a_clean_row(spark):
    grid = stress.stress_grid(spark.range(2))
    assert grid.count() == 2 * 21 and grid.where("snr is null").count() == 2


def test_weakest_clip_is_judged_without_strictness(spark):
    scored = spark.createDataFrame([("a", "env", 5, 1, 0.5), ("a", "env", 5, 2, 0.8)],
                                   "candidate string, role string, snr int, clip_id long, score double")
    limits = spark.createDataFrame([("a", 0.2, 0.6), ("a", 0.5, 0.5)], "candidate string, budget double, threshold double")
    assert stress.cleared_budgets(scored, limits).first().clears == "0.5"
    shares = {r.budget: r.clear_frac for r in stress.summary(scored, limits).collect()}
    assert shares == {0.2: 0.5, 0.5: 0.5}
