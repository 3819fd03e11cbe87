"""Curves, budgets and exact operating points over false-accept sets.

Inputs, by column:

- false accepts: ``set_name, candidate, stream_id, frame_idx, score``
- positives: ``candidate, clip_id, score``
- sets: ``set_name, hours, grouping``, one row each

Scores are doubles. The curve reads ``score >= threshold``; the exact profile and
everything that uses its thresholds reads ``score > threshold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.constants import COMPARE_AT, FA_BUDGETS, THRESHOLDS
from earshot.functions import scalars
from earshot.operators import events
from earshot.session import broadcast_if_small, for_each, pin

#: Bins of scores for each factor of two.
BINS = 16
#: Pairs and budgets that are sent to every task; beyond that they are joined by a shuffle.
MAX_PAIRS = 10_000
#: Slices of scores in which the sums over scores are made.
SLICES = 256


def grid(thresholds: list[float] = THRESHOLDS) -> Column:
    return F.array(*[F.lit(float(t)) for t in thresholds])


def recall_at_thresholds(positives: DataFrame, keys: list[str], thresholds=THRESHOLDS) -> DataFrame:
    """Rows (keys, threshold, recall): share of positives at or above each threshold."""
    rows = F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"),
                 F.avg((F.col("score") >= t).cast("double")).alias("recall"))
        for t in thresholds
    ])
    return positives.groupBy(*keys).agg(rows.alias("rows")).select(*keys, F.inline("rows"))


def curve(
    false_accepts: DataFrame, positives: DataFrame, sets: DataFrame, thresholds=THRESHOLDS
) -> DataFrame:
    """One row per (set, candidate, threshold) with recall and both counters.

    Each frame crosses the network once: the thresholds are applied to chunks of
    hits, and only counts travel after that.
    """
    keys = ["set_name", "candidate", "stream_id"]
    sets = broadcast_if_small(sets)
    chunks = events.chunk_hits(false_accepts, keys, min(thresholds)).join(
        sets.select("set_name", "grouping"), "set_name"
    )
    counts = (
        events.refractory_counts(chunks, keys, grid(thresholds), F.col("grouping"))
        .groupBy("set_name", "candidate", "threshold")
        .agg(F.sum("events").alias("events"), F.sum("frames").alias("frames"))
    )
    recalls = recall_at_thresholds(positives, ["candidate"], thresholds)
    rate = lambda n: F.round(F.col(n) / F.col("hours"), 4)
    return (
        for_each(recalls, sets.select("set_name", "hours"))
        .join(counts, ["set_name", "candidate", "threshold"], "left")
        .na.fill(0, ["events", "frames"])
        .select(
            "set_name", "candidate", "threshold", "recall",
            rate("events").alias("false_accepts_per_hour"),
            rate("frames").alias("frames_above_per_hour"),
            "events", "frames", "hours",
        )
    )


def at_threshold(curve_rows: DataFrame, threshold: float = COMPARE_AT) -> DataFrame:
    """The reporting row. The grid holds literals, so equality is exact."""
    return curve_rows.where(F.col("threshold") == threshold)


def recall_profile(
    curve_rows: DataFrame, keys: list[str], budgets=FA_BUDGETS, rounded: bool = True
) -> DataFrame:
    """Rows (keys, budget, recall): best recall whose rate fits; NULL when none does.

    ``rounded`` compares the reported four-decimal rate, otherwise the count.
    """
    rate = (
        F.col("false_accepts_per_hour") if rounded else F.col("events") / F.col("hours")
    )
    rows = F.array(*[
        F.struct(F.lit(float(b)).alias("budget"),
                 F.max(F.when(rate <= b, F.col("recall"))).alias("recall"))
        for b in budgets
    ])
    return curve_rows.groupBy(*keys).agg(rows.alias("rows")).select(*keys, F.inline("rows"))


def operating_point(curve_rows: DataFrame, keys: list[str], target: float) -> DataFrame:
    """The whole curve row at the lowest threshold that meets ``target``; keys only if none."""
    rest = [c for c in curve_rows.columns if c not in keys]
    meets = F.col("false_accepts_per_hour") <= target
    point = F.min_by(F.when(meets, F.struct(*rest)), F.when(meets, F.col("threshold")))
    return (
        curve_rows.groupBy(*keys).agg(point.alias("point"))
        .select(*keys, *[F.col(f"point.{c}").alias(c) for c in rest])
    )


# --- exact thresholds --------------------------------------------------------


def exact_thresholds(
    false_accepts: DataFrame, sets: DataFrame, candidates: DataFrame, budgets=FA_BUDGETS
) -> DataFrame:
    """Rows (set, candidate, budget, threshold): the lowest that fits the budget.

    Thresholds are the distinct false-accept scores and -1. A threshold fits when
    the events among frames *above* it do not exceed budget * hours. Adding hits
    never lowers the event count (greedy selection with a fixed gap is a maximum
    packing), so the fit is monotone and can be searched.

    A histogram of scores, one scan with counts added up before they are shuffled, gives
    a floor: more than ``allowed * (grouping + 1)`` frames never fit. Only frames above
    it are shuffled, once, into chunks. One pass over them gives the events that every
    score adds to those above it; added up from the highest score down, the first score
    to exceed the budget is the threshold. The number of jobs is the same for any input.
    """
    pair = ["set_name", "candidate"]
    limits = sets.select(
        "set_name", "grouping",
        F.explode(F.array(*[F.lit(float(b)) for b in budgets])).alias("budget"),
        (F.col("budget") * F.col("hours")).alias("allowed"),
    )
    bracket = pin(_first_bracket(false_accepts, limits, pair))
    # All tables of one row for a pair, or for its budgets, are as small as this one.
    hint = F.broadcast if bracket.count() <= MAX_PAIRS else (lambda df: df)
    floors = bracket.groupBy(*pair).agg(F.min("lo").alias("floor"), F.first("grouping").alias("grouping"))
    chunks = events.chunk_hits(
        false_accepts.join(hint(floors), pair).where("score > floor"), [*pair, "stream_id", "grouping"]
    )
    steps = pin(
        events.event_steps(chunks, [*pair, "stream_id"])
        .groupBy(*pair, "score").agg(F.sum("events").alias("events"))
    )
    found = bracket.join(_crossings(steps, bracket, pair, hint), [*pair, "budget"], "left").select(
        *pair, "budget", F.coalesce("threshold", F.lit(-1.0)).alias("threshold")
    )
    return (
        for_each(candidates.select("candidate").distinct(), limits.select("set_name", "budget"))
        .join(hint(found), [*pair, "budget"], "left")
        .select(*pair, "budget", "threshold")
    )


def _crossings(steps: DataFrame, bracket: DataFrame, pair: list[str], hint) -> DataFrame:
    """Rows (pair, budget, threshold): the highest score with which the sum exceeds ``allowed``.

    Scores fall into ``SLICES`` slices by rough ranks. The sums of slices tell in which
    one each budget is exceeded, and only that slice's scores are added up one by one.
    """
    ranks = [i / SLICES for i in range(1, SLICES)]
    cuts = steps.groupBy(*pair).agg(F.percentile_approx("score", ranks, 10_000).alias("cuts"))
    of = F.size(F.filter("cuts", lambda c: c >= F.col("score")))
    sliced = steps.join(hint(cuts), pair).select(*pair, "score", "events", of.alias("slice"))
    before = Window.partitionBy(*pair).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sliced.groupBy(*pair, "slice").agg(F.sum("events").alias("events"))
    sums = sums.withColumn("before", F.coalesce(F.sum("events").over(before), F.lit(0)))
    inside = (
        sums.join(hint(bracket.select(*pair, "budget", "allowed")), pair)
        .where("before <= allowed and before + events > allowed")
        .select(*pair, "budget", "allowed", "slice", "before")
    )
    down = Window.partitionBy(*pair, "budget").orderBy(F.desc("score"))
    return (
        sliced.join(hint(inside), [*pair, "slice"])
        .withColumn("total", F.col("before") + F.sum("events").over(down))
        .where("total > allowed")
        .groupBy(*pair, "budget").agg(F.max("score").alias("threshold"))
    )


def exact_profile(
    false_accepts: DataFrame, positives: DataFrame, sets: DataFrame, budgets=FA_BUDGETS
) -> DataFrame:
    """Rows (set, candidate, budget, threshold, recall), recall being strict ``>``."""
    thresholds = pin(exact_thresholds(false_accepts, sets, positives, budgets))
    recall = recall_above(positives, thresholds, [])
    return thresholds.join(
        recall, ["set_name", "candidate", "budget"], "left"
    ).select("set_name", "candidate", "budget", "threshold", "recall")


def recall_above(positives: DataFrame, thresholds: DataFrame, by: list[str]) -> DataFrame:
    """Rows (set, candidate, budget, by, recall) at given thresholds, strict ``>``.

    A NULL threshold gives a NULL recall. ``by`` names extra positive columns,
    such as the condition.
    """
    return (
        positives.join(broadcast_if_small(thresholds), "candidate")
        .groupBy("set_name", "candidate", "budget", *by)
        .agg(F.avg((F.col("score") > F.col("threshold")).cast("double")).alias("recall"))
    )


def _first_bracket(false_accepts, limits, pair) -> DataFrame:
    """Rows (pair, budget, grouping, allowed, lo): every score up to ``lo`` doesn't fit.

    ``lo`` is -2 when nothing is known. Scores are counted in bins of equal ratio, from
    0 up and from 1 down, so the bins are narrow where few frames are.
    """
    score = F.col("score")
    fine = lambda x: F.floor(F.log2(F.greatest(x, F.lit(1e-12))) * BINS).cast("int")
    place = F.when(score <= 0.5, fine(score)).otherwise(-fine(1 - score))
    bins = false_accepts.groupBy(*pair, place.alias("bin")).agg(
        F.count(F.lit(1)).alias("frames"), F.max("score").alias("high")
    )
    order = Window.partitionBy(*pair).orderBy(F.desc("bin"))
    counted = bins.select(
        *pair, F.sum("frames").over(order).alias("frames"), F.lead("high").over(order).alias("below")
    )
    fails = F.col("frames") > F.floor("allowed") * (F.col("grouping") + 1)
    return (
        counted.join(limits, "set_name")
        .groupBy(*pair, "budget", "grouping", "allowed")
        .agg(F.coalesce(F.max(F.when(fails, F.col("below"))), F.lit(-2.0)).alias("lo"))
    )


# --- comparisons -------------------------------------------------------------


def invariant_violations(exact: DataFrame, grid_profile: DataFrame) -> DataFrame:
    """Rows (set, candidate, budget, violations): exact recall below the grid's.

    Every grid threshold is also open to the exact search, so a violation is a bug.
    The grid profile should compare counts, not rounded rates.
    """
    keys = ["set_name", "candidate", "budget"]
    worse = F.col("grid").isNotNull() & (
        F.col("recall").isNull() | (F.col("recall") < F.col("grid") - 1e-9)
    )
    return exact.join(grid_profile.withColumnRenamed("recall", "grid"), keys).select(
        *keys, worse.cast("long").alias("violations")
    )


def clips_above(positives: DataFrame, thresholds: DataFrame, by: list[str]) -> DataFrame:
    """Rows (set, candidate, budget, threshold, by, clips, clear), strict ``>``."""
    return (
        positives.join(broadcast_if_small(thresholds), "candidate")
        .groupBy("set_name", "candidate", "budget", "threshold", *by)
        .agg(F.count(F.lit(1)).alias("clips"),
             F.count_if(F.col("score") > F.col("threshold")).alias("clear"))
    )


def grid_counts(positives: DataFrame, keys: list[str], thresholds=THRESHOLDS) -> DataFrame:
    """Rows (keys, threshold, clips, clear): the grid joined to the scores by ``>=``."""
    rows = F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"),
                 F.count(F.lit(1)).alias("clips"),
                 F.count_if(F.col("score") >= t).alias("clear"))
        for t in thresholds
    ])
    return positives.groupBy(*keys).agg(rows.alias("rows")).select(*keys, F.inline("rows"))


def candidate_matrix(false_accepts: DataFrame, conditions: DataFrame, sets: DataFrame) -> DataFrame:
    """Every candidate on every set and condition, scored or not."""
    fa = false_accepts.groupBy("set_name", "candidate").agg(
        F.count(F.lit(1)).alias("fa_frames"), F.max("score").alias("fa_top")
    )
    clips = conditions.groupBy("candidate", "condition").agg(
        F.count(F.lit(1)).alias("clips"), F.max("score").alias("clip_top")
    )
    cells = for_each(
        for_each(clips.select("candidate").distinct(), sets.select("set_name")),
        clips.select("condition").distinct(),
    )
    return cells.join(fa, ["set_name", "candidate"], "left").join(
        clips, ["candidate", "condition"], "left"
    )


def against_baseline(rows: DataFrame, baseline: str) -> DataFrame:
    """Each candidate next to the baseline of the same set and condition."""
    keys = ["set_name", "condition"]
    reference = rows.where(F.col("candidate") == baseline).select(
        *keys, F.col("recall").alias("baseline_recall")
    )
    return rows.where(F.col("candidate") != baseline).join(reference, keys).withColumn(
        "delta", F.round(F.col("recall") - F.col("baseline_recall"), 6)
    )


def split_half_transfer(
    false_accepts: DataFrame, positives: DataFrame, sets: DataFrame, seeds: list[int],
    budgets=FA_BUDGETS,
) -> DataFrame:
    """How a threshold chosen on one half of a set does on the other half.

    Streams are dealt to halves by seed, so no event is cut in two. Rows (set_name
    as set/seed, candidate, budget, threshold, recall, events, rate), the last two
    measured on the half that was not used to choose.
    """
    drawn = F.array(*[
        F.struct(F.lit(s).alias("seed"),
                 F.pmod(scalars.seeded_bits(s, "stream_id"), F.lit(2)).alias("half"))
        for s in seeds
    ])
    dealt = false_accepts.select("*", F.inline(drawn)).withColumn(
        "set_name", F.concat_ws("/", "set_name", F.col("seed").cast("string"))
    ).drop("seed")
    sizes = dealt.groupBy("set_name", "candidate").agg(
        F.count_if(F.col("half") == 0).alias("chosen"), F.count(F.lit(1)).alias("all")
    ).groupBy("set_name").agg(F.max(F.col("chosen") / F.col("all")).alias("share"))
    halves = pin(
        sizes.withColumn("_set", F.substring_index("set_name", "/", 1))
        .join(sets.withColumnRenamed("set_name", "_set"), "_set")
        .select("set_name", "grouping", (F.col("hours") * F.col("share")).alias("hours"),
                (F.col("hours") * (1 - F.col("share"))).alias("rest_hours"))
    )
    chosen = pin(exact_profile(
        dealt.where("half = 0").drop("half"), positives,
        halves.select("set_name", "hours", "grouping"), budgets,
    ))
    pair = ["set_name", "candidate"]
    probes = chosen.groupBy(*pair).agg(
        F.array_distinct(F.collect_list("threshold")).alias("probes"),
        F.min("threshold").alias("floor"),
    )
    rest = (
        dealt.where("half = 1").join(broadcast_if_small(probes), pair)
        .where("score > floor")
    )
    chunks = events.chunk_hits(rest, [*pair, "stream_id"]).join(
        broadcast_if_small(probes.select(*pair, "probes")), pair
    ).join(broadcast_if_small(halves.select("set_name", "grouping")), "set_name")
    measured = (
        events.refractory_counts(
            chunks, [*pair, "stream_id"], F.col("probes"), F.col("grouping"), strict=True)
        .groupBy(*pair, "threshold").agg(F.sum("events").alias("events"))
    )
    return (
        chosen.join(measured, [*pair, "threshold"], "left").na.fill(0, ["events"])
        .join(broadcast_if_small(halves.select("set_name", "rest_hours")), "set_name")
        .select(*pair, "budget", "threshold", "recall", "events",
                F.round(F.col("events") / F.col("rest_hours"), 4).alias("rate"))
    )
