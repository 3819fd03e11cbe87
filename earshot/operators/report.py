"""The cross-run leaderboard. Input rows follow ``sources.metrics.METRICS_SCHEMA``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.constants import (
    COMPARE_AT, CONDITIONS, FA_BUDGETS, RECALL_NOISE, RECALL_REAL, STRESS_CELLS,
)
from earshot.functions import scalars
from earshot.operators.positions import row_positions


def run_name(name: Column, repo: Column) -> Column:
    """The run's own name, else the last part of its repository."""
    own = F.when(name != "", name)
    return F.coalesce(own, F.element_at(F.split(repo, "/"), -1))


def keep_run(name: Column, skip: list[str]) -> Column:
    return ~F.exists(F.array(*[F.lit(s) for s in skip]), lambda s: name.contains(s)) if skip else F.lit(True)


def named_runs(metrics: DataFrame, skip: list[str] = ("rehearsal",)) -> DataFrame:
    name = run_name(F.col("run_name"), F.col("repo"))
    return metrics.withColumn("name", name).where(keep_run(F.col("name"), list(skip)))


def grid_recall(curve: Column, budget: float) -> Column:
    """Best recall on the stored curve within the budget; NULL when out of reach."""
    fits = F.filter(curve, lambda r: r["false_accepts_per_hour"] <= budget)
    return F.array_max(F.transform(fits, lambda r: r["recall"]))


def profile(run: str = "recall_at_fa", curve: str = "curve") -> Column:
    """Budget -> recall: the stored map, or one read off the curve where it is missing."""
    from_curve = F.create_map(*[
        part for b in FA_BUDGETS for part in (F.lit(str(b)), grid_recall(F.col(curve), b))
    ])
    return F.when(F.col(run).isNull() | (F.size(run) == 0), from_curve).otherwise(F.col(run))


def is_exact() -> Column:
    """Whether a profile comes from the exact curve rather than the grid.

    Newer runs say so. Otherwise a recall that is on no curve row gives it away.
    """
    known = F.transform("curve", lambda r: r["recall"])
    read = F.filter(F.map_values("profile"), lambda v: v.isNotNull())
    return (
        (F.coalesce("metrics_version", F.lit(0)) >= 2)
        | F.col("recall_at_fa_exact").isNotNull()
        | (F.size(F.array_except(read, known)) > 0)
    )


def compare_row(curve: str = "curve", threshold: float = COMPARE_AT) -> Column:
    return F.get(F.filter(curve, lambda r: r["threshold"] == threshold), F.lit(0))


def with_profiles(runs: DataFrame) -> DataFrame:
    """Add ``profile``, ``exact`` and ``half``, the row at the reporting threshold."""
    return runs.withColumn("profile", profile()).withColumns({
        "exact": is_exact(), "half": compare_row(),
    })


def leaderboard(runs: DataFrame) -> DataFrame:
    """The printed table: one text row per run, ``run`` cut to its width, ``name`` in full."""
    low = scalars.poisson_low(F.col("half.events")) / F.col("val_set_hrs")
    high = scalars.poisson_high(F.col("half.events")) / F.col("val_set_hrs")
    budgets = [
        scalars.fixed_point(F.element_at("profile", F.lit(str(b)))).alias(f"recall_at_{b}".replace(".", "_"))
        for b in FA_BUDGETS
    ]
    label = F.concat(F.substring("name", 1, 18), F.when(F.col("exact"), "").otherwise(" ~"))
    return runs.select(
        "name", label.alias("run"), F.coalesce("selected", F.lit("-")).alias("selected"), *budgets,
        scalars.fixed_point("half.recall").alias("recall_at_half"),
        scalars.fixed_point("half.false_accepts_per_hour", 2).alias("rate_at_half"),
        F.concat_ws("-", scalars.fixed_point(low, 2), scalars.fixed_point(high, 2)).alias("interval"),
        F.coalesce(F.col("selection.merged").cast("string"), F.lit("-")).alias("merged"),
    )


def condition_report(runs: DataFrame, budget: float) -> DataFrame:
    """Recall by condition and stress-grid clear share at one budget, ``-`` for missing.

    ``line`` is ``run``, or ``baseline`` for the baseline that a run was compared with;
    a baseline has no stress cells.
    """
    key = F.lit(str(budget))

    def condition(source, name):
        by_budget = F.element_at(source, F.lit(name))
        return scalars.fixed_point(F.element_at(by_budget, key)["recall"]).alias(name)

    def stress(cell):
        rows = F.element_at("stress", F.col("selected"))["rows"]
        share = F.element_at(F.element_at(rows, F.lit(cell))["clear_frac"], key)
        return scalars.fixed_point(share).alias(cell.replace("@", "_"))

    own = runs.select(
        "name", F.lit("run").alias("line"),
        *[condition(F.col("recall_at_fa_by_condition"), c) for c in CONDITIONS], *[stress(c) for c in STRESS_CELLS],
    )
    if "baseline" not in runs.columns:
        return own
    theirs = runs.where("baseline is not null").select(
        "name", F.lit("baseline").alias("line"),
        *[condition(F.col("baseline.recall_at_fa_by_condition"), c) for c in CONDITIONS],
        *[F.lit(None).cast("string").alias(c.replace("@", "_")) for c in STRESS_CELLS],
    )
    return own.unionByName(theirs)


def at_budget(runs: DataFrame, budget: float, condition: str | None = None) -> DataFrame:
    """Add ``recall`` at a budget, on the mixed set or on one condition.

    On a condition the run's profile is that one value, so mean recall and budget wins
    follow the ranking.
    """
    key = F.lit(str(budget))
    if condition is None:
        return runs.withColumn("recall", F.element_at("profile", key))
    by_budget = F.element_at("recall_at_fa_by_condition", F.lit(condition))
    recall = F.element_at(by_budget, key)["recall"]
    return runs.withColumn("recall", recall).withColumn(
        "profile", F.when(F.col("recall").isNotNull(), F.create_map(key, F.col("recall")))
        .otherwise(F.create_map().cast("map<string,double>")),
    )


def ranking(runs: DataFrame, order: str, **scan) -> DataFrame:
    """Add ``place``, from 1: recall descending, ties in run order, NULLs left out."""
    reached = runs.where(F.col("recall").isNotNull()).withColumn("_key", -F.col("recall"))
    placed = row_positions(reached, [], ["_key", order], "place", **scan)
    return placed.withColumn("place", F.col("place") + 1).drop("_key")


def mean_recall(runs: DataFrame, order: str, **scan) -> DataFrame:
    """Mean recall over the budgets a run reaches, ordered by the sum, not the mean."""
    values = F.filter(F.map_values("profile"), lambda v: v.isNotNull())
    total = F.round(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v), 9)
    used = F.size(values)
    rows = runs.select(
        "name", order, F.round(F.coalesce(F.try_divide(total, used), F.lit(0.0)), 6).alias("mean_recall"),
        used.alias("budgets"), (-total).alias("_key"),
    )
    return row_positions(rows, [], ["_key", order], "place", **scan).drop("_key")


def leader_and_runner_up(runs: DataFrame, order: str) -> DataFrame:
    """One row: the two best runs at the budget side by side; empty below two runs."""
    top = runs.where(F.col("recall").isNotNull()).orderBy(F.desc("recall"), order).limit(2)
    kept = F.struct("name", "recall", "profile")
    key = F.struct(-F.col("recall"), F.col(order))
    return top.agg(
        F.min_by(kept, key).alias("leader"), F.max_by(kept, key).alias("second"),
        F.count(F.lit(1)).alias("_n"),
    ).where("_n = 2").drop("_n")


def margin_verdict(pair: DataFrame) -> DataFrame:
    """Whether the lead is noise, real, or neither."""
    delta = F.col("leader.recall") - F.col("second.recall")
    verdict = (
        F.when(delta < RECALL_NOISE, "noise").when(delta > RECALL_REAL, "real")
        .otherwise("inconclusive on its own")
    )
    return pair.select(
        F.col("leader.name").alias("leader"), F.col("second.name").alias("second"),
        F.round(delta, 6).alias("delta"), verdict.alias("verdict"),
    )


def budget_wins(pair: DataFrame) -> DataFrame:
    """At how many budgets the leader is ahead, of those both runs reach."""
    a = lambda b: F.element_at("leader.profile", F.lit(str(b)))
    c = lambda b: F.element_at("second.profile", F.lit(str(b)))
    both = [(a(b).isNotNull() & c(b).isNotNull()) for b in FA_BUDGETS]
    ahead = [F.coalesce(a(b) > c(b), F.lit(False)) for b in FA_BUDGETS]
    count = lambda flags: sum((f.cast("int") for f in flags), F.lit(0))
    return pair.select(count(ahead).alias("wins"), count(both).alias("seen"))
