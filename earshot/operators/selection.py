"""Choosing checkpoints and candidates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.operators.positions import row_positions


def exact_percentile(df: DataFrame, column: str, unique: str, share: float, **scan) -> DataFrame:
    """One row ``column``: the percentile with linear interpolation between ranks.

    The ranks come from a distributed row number, so no task holds all values.
    """
    values = df.select(column, unique).where(F.col(column).isNotNull())
    ranked = row_positions(values, [], [column, unique], "_rank", **scan)
    at = share * (values.count() - 1)
    near = ranked.where(F.col("_rank").isin(math.floor(at), math.ceil(at)))
    low, high = F.min(column), F.max(column)
    return near.agg((low + (high - low) * (at - math.floor(at))).alias(column))


def percentile_gates(checkpoints: DataFrame, **scan) -> dict[str, Column]:
    """The 90th, 90th and 10th percentiles, by gate name, as scalar subqueries."""
    wanted = {"val_accuracy": 0.9, "val_recall": 0.9, "val_fp_per_hr": 0.1}
    filled = checkpoints.na.fill(0.0, ["val_fp_per_hr"])
    return {
        column.replace("val_", "gate_"): exact_percentile(
            filled, column, "ckpt", share, **scan).scalar()
        for column, share in wanted.items()
    }


def pass_percentile_gates(checkpoints: DataFrame, **scan) -> DataFrame:
    """Checkpoints that clear all three percentile gates, with the gates."""
    return checkpoints.withColumns(percentile_gates(checkpoints, **scan)).where(
        (F.col("val_accuracy") >= F.col("gate_accuracy"))
        & (F.col("val_recall") >= F.col("gate_recall"))
        & (F.coalesce("val_fp_per_hr", F.lit(0.0)) <= F.col("gate_fp_per_hr"))
    )


def recall_gated(checkpoints: DataFrame, target: float, top_k: int = 10) -> DataFrame:
    """The ``top_k`` checkpoints by recall among those within the false-accept target.

    When none is within it, the best tenth by false accepts (at least one) stands
    in, marked ``fallback``. Ties keep the original order; ``place`` 0 is the best.
    """
    rate = F.coalesce("val_fp_per_hr", F.lit(0.0))
    passing = checkpoints.where(rate <= target)
    fallback = passing.isEmpty()
    if fallback:
        size = max(1, checkpoints.count() // 10)
        keyed = checkpoints.withColumn("_rate", rate)
        passing = row_positions(keyed, [], ["_rate", "ckpt"], "_rank").where(
            F.col("_rank") < size
        ).drop("_rate", "_rank")
    best = passing.orderBy(F.desc("val_recall"), "ckpt").limit(top_k)
    ranked = best.withColumn("_order", -F.col("val_recall"))
    return row_positions(ranked, [], ["_order", "ckpt"], "place").drop("_order").withColumn(
        "fallback", F.lit(fallback)
    )


def choose_candidate(
    exact: DataFrame, grid: DataFrame, rates: DataFrame, baseline: str = "baseline"
) -> DataFrame:
    """Per set, the candidate to publish and the rule that chose it.

    ``exact`` and ``grid`` are (set_name, candidate, recall) at the selection
    budget, ``rates`` is (set_name, candidate, lowest_rate). Exact recall decides
    where any candidate has one, then grid recall, then the lowest rate. Ties go
    to the first name. The baseline is a reference and never chosen.
    """
    keys = ["set_name", "candidate"]
    rows = (
        rates.join(exact.withColumnRenamed("recall", "exact"), keys, "left")
        .join(grid.withColumnRenamed("recall", "grid"), keys, "left")
        .where(F.col("candidate") != baseline)
    )

    def best(value, sign):
        return F.min(F.when(value.isNotNull(), F.struct((sign * value).alias("k"), "candidate")))

    tiers = rows.groupBy("set_name").agg(
        best(F.col("exact"), -1).alias("exact"),
        best(F.col("grid"), -1).alias("grid"),
        best(F.col("lowest_rate"), 1).alias("rate"),
    )
    rule = (
        F.when(F.col("exact").isNotNull(), "exact").when(F.col("grid").isNotNull(), "grid")
        .otherwise("lowest rate")
    )
    return tiers.select(
        "set_name", F.coalesce("exact", "grid", "rate")["candidate"].alias("candidate"),
        rule.alias("rule"),
    )


def choose_published(
    exact: DataFrame, conditions: DataFrame, grid: DataFrame, rates: DataFrame,
    select_on: str, select_condition: str = "mixed", fallback: str = "upstream", baseline: str = "baseline",
) -> DataFrame:
    """One row (set_name, condition, candidate, rule): what a run publishes.

    The set is ``select_on`` if anything was measured on it, else ``fallback``. Exact recall
    on ``select_condition`` decides, if every candidate was measured on that condition there,
    otherwise that on the mixed positives; then as in :func:`choose_candidate`. ``exact`` is
    (set_name, candidate, recall), ``conditions`` has ``condition`` besides, and a NULL recall
    still counts as measured. The baseline is never chosen.
    """
    known = exact.select("set_name").distinct().where(F.col("set_name") == select_on)
    primary = F.when(known.agg(F.count(F.lit(1)).alias("n")).scalar() > 0, select_on).otherwise(fallback)
    on = lambda df: df.where((F.col("set_name") == primary) & (F.col("candidate") != baseline))
    wanted = on(conditions).where(F.col("condition") == select_condition).select("set_name", "candidate", "recall")
    trained = on(exact)
    absent = trained.join(wanted, ["set_name", "candidate"], "left_anti").agg(F.count(F.lit(1)).alias("n")).scalar()
    use = (F.lit(select_condition) != "mixed") & (absent == 0)
    ranking = trained.select("set_name", "candidate", "recall").where(~use).unionByName(wanted.where(use))
    chosen = choose_candidate(ranking, on(grid), on(rates), baseline)
    return chosen.select(
        "set_name", F.when(use, select_condition).otherwise("mixed").alias("condition"), "candidate", "rule"
    )
