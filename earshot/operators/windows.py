"""Cutting frame sequences into windows, re-cutting and framing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.constants import FRAME_SAMPLES, WINDOW_FRAMES

CHUNK_FRAMES = 4096


def sliding_windows(
    frames: DataFrame, keys: list[str], window: int = WINDOW_FRAMES, value: str = "x",
    chunk_frames: int = CHUNK_FRAMES,
) -> DataFrame:
    """Rows (keys, idx, value): stride-1 windows of ``window`` frames as arrays.

    Each chunk of frames also receives the first window - 1 frames of the next
    one, so chunks are windowed on their own and a long stream uses many tasks.
    """
    assert window <= chunk_frames
    chunk = F.floor(F.col("frame_idx") / chunk_frames)
    lends = F.pmod("frame_idx", F.lit(chunk_frames)) < window - 1
    homes = F.when(lends & (chunk > 0), F.array(chunk - 1, chunk)).otherwise(F.array(chunk))
    ahead = Window.partitionBy(*keys, "_home").orderBy("frame_idx").rowsBetween(0, window - 1)
    last = F.max("frame_idx").over(ahead)
    return (
        frames.withColumn("_home", F.explode(homes))
        .select(
            *keys, F.col("frame_idx").alias("idx"), F.collect_list(value).over(ahead).alias(value),
            last.alias("_last"), "_home",
        )
        .where((F.size(value) == window) & (F.col("_last") == F.col("idx") + window - 1)
               & (F.floor(F.col("idx") / chunk_frames) == F.col("_home")))
        .drop("_last", "_home")
    )


def window_counts(sets: DataFrame, window: int = WINDOW_FRAMES) -> DataFrame:
    """``sets`` (with ``frames``) and how many ``windows`` each has, or the ``error`` of a short one."""
    enough = F.col("frames") >= window
    said = F.concat(F.col("frames").cast("string"), F.lit(f" frames are shorter than the {window}-frame window"))
    return sets.withColumn("windows", F.when(enough, F.col("frames") - window + 1)).withColumn(
        "error", F.when(~enough, said)
    )


def checked(frames: DataFrame, keys: list[str], window: int = WINDOW_FRAMES) -> DataFrame:
    """``frames``, failing when any set has fewer than ``window`` of them: it would yield nothing."""
    sets = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"))
    short = window_counts(sets, window).where("error is not null")
    name = F.concat_ws(" ", *[F.col(k).cast("string") for k in keys], F.lit(":"), "error")
    first = short.agg(F.min(name).alias("said")).first().said
    if first is not None:
        raise ValueError(first)
    return frames


def recut_flat(
    frames: DataFrame, total: Column, window: int = WINDOW_FRAMES, value: str = "x"
) -> DataFrame:
    """Rows (idx, value): tumbling windows that start before total - window.

    With a total divisible by the window, the last full window is left out.
    """
    return (
        frames.withColumn("idx", F.floor(F.col("frame_idx") / window))
        .where(F.col("idx") * window < total - window)
        .groupBy("idx")
        .agg(F.transform(
            F.array_sort(F.collect_list(F.struct("frame_idx", value))), lambda f: f[value]
        ).alias(value))
    )


def recut_count(rows: Column, window: int = WINDOW_FRAMES) -> Column:
    """How many windows :func:`recut_flat` yields."""
    return F.greatest(F.ceil((rows - window) / window), F.lit(0))


def batch_estimate(rows: Column, window: int = WINDOW_FRAMES) -> Column:
    """The estimate used to announce a batch; one low unless the window divides it."""
    return F.greatest(F.floor((rows - window) / window), F.lit(0))


def prewindowed(windows: DataFrame, window: int = WINDOW_FRAMES, value: str = "x") -> DataFrame:
    """Windows that already have the model's width pass; any other is an error."""
    fits = F.assert_true(
        F.size(value) == window, F.lit(f"windowed rows cannot be re-cut to {window} frames")
    )
    return windows.where(fits.isNull())


def frame_starts(length: Column, hop: int = FRAME_SAMPLES, drop_exact_last: bool = False) -> Column:
    """Array of the sample offsets at which full frames start.

    ``drop_exact_last`` stops earlier, losing a final frame that ends the clip.
    """
    count = F.floor((length - 1) / hop) if drop_exact_last else F.floor(length / hop)
    none = F.filter(F.array(F.lit(0).cast("long")), lambda _: F.lit(False))
    return F.when(
        count > 0, F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: i * hop)
    ).otherwise(none)
