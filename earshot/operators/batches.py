"""Holdouts, training batches and augmentation as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.constants import (
    AUGMENT_BATCH, AUGMENT_PROBABILITY, BACKGROUND_SNR_DB, CONDITIONS, SECONDS_PER_FRAME,
)
from earshot.functions import scalars
from earshot.session import broadcast_if_small


#: Draws of one example that are held as an array.
TURNS = 4096


def holdout_rows(hours: float, window: int) -> int:
    return int(hours * 3600 / (window * SECONDS_PER_FRAME))


def tail_holdout(bank: DataFrame, total: int, hours: float, window: int) -> DataFrame:
    """Add ``side``: the last ``hours`` of a windowed bank are for evaluation only."""
    cutoff = total - holdout_rows(hours, window)
    if cutoff <= 0:
        raise ValueError(f"a holdout of {hours} h wants more than the {total} rows there are")
    return bank.withColumn(
        "side", F.when(F.col("idx") < cutoff, F.lit("train")).otherwise(F.lit("evaluate"))
    )


def batch_plan(
    spark: SparkSession, steps: int, sizes: dict[str, int], per_class: dict[str, int]
) -> DataFrame:
    """Rows (step, class, slot, idx, label): every draw of every training step.

    Each class has a cursor that walks its rows in order and wraps at the end, so
    the draw of any slot is arithmetic and steps are planned independently.
    """
    classes = F.array(*[
        F.struct(F.lit(name).alias("class"), F.lit(n).alias("n"),
                 F.lit(sizes[name]).cast("long").alias("size"),
                 F.lit(1 if name == "positive" else 0).alias("label"))
        for name, n in per_class.items()
    ])
    return (
        spark.range(steps).select(F.col("id").alias("step"), F.inline(classes))
        .withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select("step", "class", "slot",
                F.pmod(F.col("step") * F.col("n") + F.col("slot"), "size").alias("idx"), "label")
    )


def drawn_examples(
    examples: DataFrame, steps: int, sizes: dict[str, int], per_class: dict[str, int]
) -> DataFrame:
    """Rows (step, class, slot, idx, label, other columns): the batch plan with its examples.

    ``examples`` has (class, idx). Its class makes ``steps * n`` draws, of which an example
    is drawn at idx, idx + size and so on, so each works out its own and the plan, far
    larger than the examples, is never joined. ``TURNS`` of them are held at a time.
    """
    of = lambda values: F.coalesce(*[
        F.when(F.col("class") == name, F.lit(values[name]).cast("long")) for name in per_class
    ])
    turns = F.ceil((steps * F.col("_n") - F.col("idx")) / F.col("_size"))
    first = F.col("_pack") * TURNS
    pack = F.when(F.col("_turns") > 0, F.sequence(F.lit(0).cast("long"), F.floor((F.col("_turns") - 1) / TURNS)))
    draw = F.col("idx") + F.col("_turn") * F.col("_size")
    return (
        examples.withColumns({"_n": of(per_class), "_size": of(sizes)})
        .withColumn("_turns", turns)
        .withColumn("_pack", F.explode(pack))
        .withColumn("_turn", F.explode(F.sequence(first, F.least(first + TURNS, F.col("_turns")) - 1)))
        .select(
            F.floor(draw / F.col("_n")).alias("step"), "class",
            F.pmod(draw, F.col("_n")).cast("int").alias("slot"), "idx",
            F.when(F.col("class") == "positive", 1).otherwise(0).alias("label"),
            *[c for c in examples.columns if c not in ("class", "idx")],
        )
    )


def augmentation_rounds(clips: DataFrame, total: int, rounds: int) -> DataFrame:
    """Rows (clip columns, round, pos): the whole list repeated, copies far apart."""
    return clips.withColumn(
        "round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))
    ).withColumn("pos", F.col("round") * total + F.col("clip_no"))


def condition_settings(condition: str) -> dict[str, float]:
    """Augmentation probabilities of one validation condition."""
    if condition == "clean":
        return {**AUGMENT_PROBABILITY, "background": 0.0, "rir": 0.0, "noise": 0.0}
    return {**AUGMENT_PROBABILITY, "background": 1.0}


def condition_fan_out(clips: DataFrame) -> DataFrame:
    """Every validation clip under every condition, with its probabilities and pool."""
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("condition"),
            F.lit(None if c == "clean" else c).cast("string").alias("pool_role"),
            *[F.lit(p).alias(f"p_{name}") for name, p in condition_settings(c).items()],
        )
        for c in CONDITIONS
    ])
    return clips.select("*", F.inline(rows))


def draw_backgrounds(rows: DataFrame, pool: DataFrame, files: int, seed: int) -> DataFrame:
    """Join each (round, clip_no) to its own draw from a pool numbered by ``file_no``."""
    draw = F.pmod(scalars.seeded_bits(seed, F.lit("bg"), "round", "clip_no"), F.lit(files))
    return rows.withColumn("file_no", draw).join(broadcast_if_small(pool), "file_no")


def draw_shares(drawn: DataFrame) -> DataFrame:
    """A role's share of draws; it follows from its share of files, not of hours."""
    counts = drawn.groupBy("role").agg(F.count(F.lit(1)).alias("draws"))
    total = counts.agg(F.sum("draws")).scalar()
    return counts.select("role", "draws", F.round(F.col("draws") / total, 6).alias("share"))


def augmentation_plan(
    rows: DataFrame, rirs: int, seed: int,
    probabilities: dict[str, float] = AUGMENT_PROBABILITY,
    snr: tuple[float, float] = BACKGROUND_SNR_DB,
) -> DataFrame:
    """Add one boolean per effect, ``snr_db`` and ``rir_no`` to (round, clip_no, pos).

    Effects and SNR are drawn per row; the impulse response once per batch of
    ``AUGMENT_BATCH`` rows. Draws depend on seed and key only.
    """
    unit = lambda *key: scalars.seeded_unit(seed, *key)
    batch = F.floor(F.col("pos") / AUGMENT_BATCH)
    low, high = snr
    effects = {
        f"use_{name}": (unit(F.lit(name), batch) if name == "rir" else unit(
            F.lit(name), "round", "clip_no")) < p
        for name, p in probabilities.items()
    }
    return rows.withColumn("batch", batch).withColumns({
        **effects,
        "snr_db": F.lit(low) + unit(F.lit("snr"), "round", "clip_no") * (high - low),
        "rir_no": F.pmod(scalars.seeded_bits(seed, F.lit("rir_no"), batch), F.lit(rirs)),
    })
