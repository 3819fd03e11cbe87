"""Input audits, sanity checks, parity and threshold resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.constants import COMPARE_AT, PARITY_TOLERANCE


def hard_examples(scored: DataFrame, low: float = 0.001, high: float = 0.999) -> DataFrame:
    """Examples still worth a gradient: not negatives < low, not positives > high."""
    easy = ((F.col("label") == 0) & (F.col("score") < low)) | (
        (F.col("label") == 1) & (F.col("score") > high)
    )
    return scored.where(~easy)


def shapes(arrays: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The header of each input: rows, and the least and largest frames and width (0 for a flat row)."""
    outer, inner = F.size(value), F.transform(F.col(value), lambda r: F.size(r))
    return arrays.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(outer).alias("min_frames"), F.max(outer).alias("max_frames"),
        F.min(F.array_min(inner)).alias("min_width"), F.max(F.array_max(inner)).alias("max_width"),
    )


def shape_audit(arrays: DataFrame, keys: list[str], value: str, frames: int, width: int) -> DataFrame:
    """One row per input: row count, shapes seen and whether they all fit."""
    return shapes(arrays, keys, value).withColumn(
        "fits",
        (F.col("min_frames") == frames) & (F.col("max_frames") == frames)
        & (F.col("min_width") == width) & (F.col("max_width") == width),
    )


def input_violations(expected: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows (input, rule, found, wanted): everything that is wrong with a job's inputs.

    ``expected`` has for each input ``input, dims, frames, width`` (dims: the numbers of
    dimensions it may have; frames: that many if it has three; null where anything goes)
    and ``same_as``, an input whose shape it must have, or null. ``headers`` has ``input,
    shape``, the shape as in an array file's header. Only headers are compared, all
    rules in one pass: an input is ``missing``, has the wrong number of ``dimensions``,
    ``frames`` or ``width`` (its last dimension), or differs from the input that it must
    be like (``same shape``). A wrong number of dimensions ends the rules for that input.
    """
    text = lambda c: F.concat(F.lit("("), F.array_join(c.cast("array<string>"), ", "), F.lit(")"))
    model = headers.select(F.col("input").alias("same_as"), F.col("shape").alias("_model"))
    both = expected.join(headers, "input", "left").join(model, "same_as", "left")
    shape = F.col("shape")
    there, flat = shape.isNotNull(), ~F.array_contains("dims", F.size(shape))
    fits = there & ~F.coalesce(flat, F.lit(False))
    last = F.element_at(shape, -1)

    def rule(name, broken, found, wanted):
        row = F.struct(F.lit(name).alias("rule"), found.alias("found"), wanted.alias("wanted"))
        return F.when(F.coalesce(broken, F.lit(False)), row)

    rules = F.array(
        rule("missing", ~there, F.lit(None).cast("string"), F.lit("an array")),
        rule("dimensions", there & flat, text(shape), F.array_join(F.col("dims").cast("array<string>"), " or ")),
        rule("frames", fits & (F.size(shape) == 3) & (shape[1] != F.col("frames")), text(shape), F.col("frames").cast("string")),
        rule("width", fits & (last != F.col("width")), text(shape), F.col("width").cast("string")),
        rule("same shape", fits & (shape != F.col("_model")), text(shape), text(F.col("_model"))),
    )
    return both.select("input", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("input", "r.*")


def probe_checksum(frames: DataFrame, value: str, rows: int | None = None) -> DataFrame:
    """Rows read and their sum, over the first ``rows`` by idx or over all of them."""
    read = frames if rows is None else frames.where(F.col("idx") < rows)
    total = F.aggregate(value, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    return read.agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum(total), 4).alias("checksum"))


def score_sanity(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: how many scores, and how many are missing, not finite or outside [0, 1]."""
    score = F.col("score")
    bad = score.isNull() | F.isnan(score) | ~score.between(0.0, 1.0)
    return scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad")
    ).withColumn("sane", (F.col("n") > 0) & (F.col("bad") == 0))


def score_parity(
    left: DataFrame, right: DataFrame, rows: int | None = None,
    tolerance: float = PARITY_TOLERANCE,
) -> DataFrame:
    """Largest difference between two scorers on the same ``idx``."""
    both = left.select("idx", F.col("score").alias("a")).join(
        right.select("idx", F.col("score").alias("b")), "idx"
    )
    if rows is not None:
        both = both.where(F.col("idx") < rows)
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_diff")
    ).withColumn("agrees", F.col("max_diff") < tolerance)


def resolve_thresholds(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Add ``used`` and ``reason`` to requests (model, budget, given).

    A given threshold wins; a model without any profile, or whose budget is not
    reachable, falls back to the default.
    """
    known = profiles.select("model").distinct().withColumn("_known", F.lit(True))
    joined = requests.join(known, "model", "left").join(
        profiles.select("model", "budget", "threshold"), ["model", "budget"], "left"
    )
    given, measured = F.col("given"), F.col("threshold")
    reason = (
        F.when(given.isNotNull(), "given")
        .when(F.col("_known").isNull(), "default: no metrics")
        .when(measured.isNull(), "default: budget not reachable")
        .otherwise("measured")
    )
    return joined.select(
        *requests.columns, F.coalesce(given, measured, F.lit(COMPARE_AT)).alias("used"),
        reason.alias("reason"),
    )


def set_hours(frames: Column, window: int, step_seconds: Column) -> tuple[Column, Column]:
    """Hours by frames, as inputs are announced, and by windows, as rates are computed."""
    by_frames = frames * step_seconds / 3600
    by_windows = (frames - window + 1) * step_seconds / 3600
    return by_frames, by_windows


def limited_hours(sizes: DataFrame, limits: list[int | None], window: int, step: float) -> DataFrame:
    """The hours of each frame set under each frame limit; the limit changes the rate."""
    kept = F.least(F.col("frames"), F.coalesce("frame_limit", "frames"))
    hours = (kept - window + 1) * step / 3600
    rows = F.array(*[F.lit(n).cast("long") for n in limits])
    return sizes.withColumn("frame_limit", F.explode(rows)).select(
        "*", kept.alias("kept"), F.round(F.greatest(hours, F.lit(0.0)), 6).alias("hours")
    )
