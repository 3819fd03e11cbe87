"""Stress grids: positives under interference at fixed signal-to-noise ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.constants import BACKGROUND_ROLES, STRESS_SNRS
from earshot.operators.positions import row_positions
from earshot.session import broadcast_if_small


def stress_grid(positives: DataFrame, roles=BACKGROUND_ROLES, snrs=STRESS_SNRS) -> DataFrame:
    """Every positive in every (role, snr) cell, and once clean (snr NULL)."""
    cells = F.array(
        F.struct(F.lit("clean").alias("role"), F.lit(None).cast("int").alias("snr")),
        *[F.struct(F.lit(r).alias("role"), F.lit(s).alias("snr")) for r in roles for s in snrs],
    )
    return positives.select("*", F.inline(cells))


def cell_key():
    return F.when(F.col("snr").isNull(), F.col("role")).otherwise(
        F.concat_ws("@", "role", F.col("snr").cast("string"))
    )


def split_cell(cell):
    """(role, snr) of a ``role@snr`` key; snr is NULL for ``clean``."""
    parts = F.split(cell, "@")
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1)).cast("int")


def exact_median(scored: DataFrame, keys: list[str], unique: str) -> DataFrame:
    """Rows (keys, median) by row number, from the one or two middle rows."""
    ranked = row_positions(scored, keys, ["score", unique], "_rank")
    sizes = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    middle = F.col("_rank").isin(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2))
    return ranked.join(sizes, keys).where(middle).groupBy(*keys).agg(
        F.avg("score").alias("median")
    )


def summary(scored: DataFrame, thresholds: DataFrame, unique: str = "clip_id") -> DataFrame:
    """Per cell and budget: lowest and median score, share strictly above the threshold.

    ``scored`` has (candidate, role, snr, clip_id, score), ``thresholds`` has
    (candidate, budget, threshold), any number of budgets. The budgets ride along as
    one array, so clips are not multiplied by them.
    """
    cell = ["candidate", "role", "snr"]
    counts = _cleared(
        scored, thresholds, cell, lambda score, limit: score > limit, F.min("score").alias("min")
    )
    shares = counts.groupBy(*cell, "budget", "threshold").agg(
        F.min("min").alias("min"),
        (F.sum(F.when(F.col("level") >= F.col("needed"), F.col("n")).otherwise(0)) / F.sum("n")).alias("share"),
    )
    medians = exact_median(
        scored.withColumn("snr", F.coalesce("snr", F.lit(-1))), cell, unique
    )
    return (
        shares.withColumn("_snr", F.coalesce("snr", F.lit(-1)))
        .join(medians.withColumnRenamed("snr", "_snr"), ["candidate", "role", "_snr"])
        .select(
            *cell, "budget", F.round("min", 4).alias("min"), F.round("median", 4).alias("median"),
            F.when(F.col("threshold").isNotNull(), F.round("share", 3)).alias("clear_frac"),
        )
    )


def _cleared(scored, thresholds, keys, clears, *more) -> DataFrame:
    """Per key, level and budget: ``n`` rows that clear ``level`` thresholds of the
    candidate, and the level ``needed`` to clear the budget's.

    A row that clears a threshold clears all lower ones, so the number it clears tells
    which. Rows are counted by level before the budgets multiply them, whatever their
    number.
    """
    packed = broadcast_if_small(_packed(thresholds))
    limits = F.filter(F.transform("profile", lambda p: p["threshold"]), lambda t: t.isNotNull())
    level = F.size(F.filter(limits, lambda t: F.coalesce(clears(F.col("score"), t), F.lit(False))))
    counts = (
        scored.join(packed, "candidate").withColumn("level", level)
        .groupBy(*keys, "level").agg(F.count("score").alias("n"), *more)
    )
    needed = F.transform("profile", lambda p: F.struct(
        p["budget"].alias("budget"), p["threshold"].alias("threshold"),
        F.size(F.filter("profile", lambda q: q["threshold"] <= p["threshold"])).alias("needed"),
    ))
    return counts.join(packed, "candidate").select(*counts.columns, F.inline(needed))


def _packed(thresholds: DataFrame) -> DataFrame:
    """One row per candidate with its budgets and thresholds in budget order."""
    return thresholds.groupBy("candidate").agg(
        F.array_sort(F.collect_list(F.struct("budget", "threshold"))).alias("profile")
    )


def cleared_budgets(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Per cell, the budgets whose threshold even the weakest clip reaches (>=)."""
    cell = ["candidate", "role", "snr"]
    weakest = scored.groupBy(*cell).agg(F.min("score").alias("weakest"))
    passing = F.filter("profile", lambda p: F.col("weakest") >= p["threshold"])
    names = F.array_join(F.transform(passing, lambda p: p["budget"].cast("string")), ", ")
    return weakest.join(broadcast_if_small(_packed(thresholds)), "candidate").select(
        *cell, "weakest", F.when(names == "", F.lit("-")).otherwise(names).alias("clears")
    )


def interference_only(frames: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Per pool and budget: the peak score and frames at or above the threshold."""
    keys = ["candidate", "pool"]
    counts = _cleared(
        frames, thresholds, keys, lambda score, limit: score >= limit, F.max("score").alias("peak")
    )
    return counts.groupBy(*keys, "budget", "threshold").agg(
        F.round(F.max("peak"), 4).alias("peak"),
        F.coalesce(F.sum(F.when(F.col("level") >= F.col("needed"), F.col("n"))), F.lit(0)).alias("all"),
    ).select(
        *keys, "peak", "budget", F.when(F.col("threshold").isNull(), 0).otherwise(F.col("all")).alias("frames")
    )


def clip_scores(frames: DataFrame, keys: list[str]) -> DataFrame:
    """A clip's score is its highest frame."""
    return frames.groupBy(*keys).agg(F.max("score").alias("score"))
