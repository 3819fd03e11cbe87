"""Speaker-disjoint splits, quotas, text slots and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from earshot.functions import scalars
from earshot.operators.positions import head, prefix_sum, row_positions
from earshot.session import broadcast_if_small


def speaker_pair(index: Column, n_speakers: int) -> tuple[Column, Column]:
    """The ordered speaker pair of a generated clip, cycling through all pairs."""
    cell = F.pmod(index, F.lit(n_speakers * n_speakers))
    return F.floor(cell / n_speakers), F.pmod(cell, F.lit(n_speakers))


def held_out_speakers(speakers: DataFrame, count: int, seed: int) -> DataFrame:
    """``count`` speakers drawn without replacement; ``speakers`` has ``speaker``."""
    return (
        speakers.orderBy(scalars.seeded_key(seed, "speaker"), "speaker")
        .limit(count).select("speaker")
    )


def expected_holdout(n_speakers: Column, held_out: Column) -> Column:
    return 1 - F.pow((n_speakers - held_out) / n_speakers, F.lit(2.0))


def assign_split(examples: DataFrame, held_out: DataFrame) -> DataFrame:
    """Add ``split``: val when either speaker is held out, else train."""
    side = lambda name: broadcast_if_small(
        held_out.select(F.col("speaker").alias(name), F.lit(True).alias(f"_{name}"))
    )
    is_val = F.col("_spk_a").isNotNull() | F.col("_spk_b").isNotNull()
    return (
        examples.join(side("spk_a"), "spk_a", "left").join(side("spk_b"), "spk_b", "left")
        .withColumn("split", F.when(is_val, F.lit("val")).otherwise(F.lit("train")))
        .select(*examples.columns, "split")
    )


def without_speakers(examples: DataFrame, held_out: DataFrame) -> DataFrame:
    """Examples in which neither speaker is held out."""
    for side in ("spk_a", "spk_b"):
        examples = examples.join(
            broadcast_if_small(held_out.select(F.col("speaker").alias(side))), side, "left_anti"
        )
    return examples


def smallest_total(
    speakers: DataFrame, held_out: DataFrame, n_train: int, n_val: int
) -> DataFrame:
    """One row ``total``: the fewest clips, walked in index order, that fill both quotas.

    ``speakers`` is 0..n-1. The split repeats every n * n clips, so only one period
    matters, and within it only a count per first speaker: n rows, whatever the
    quotas are.
    """
    marked = speakers.join(
        held_out.select("speaker", F.lit(True).alias("_held")), "speaker", "left"
    ).select("speaker", F.coalesce("_held", F.lit(False)).alias("held"))
    n, v = marked.agg(F.count(F.lit(1)), F.count_if("held")).first()
    kept = (n - v) * (n - v)
    split = lambda name, quota, whole, mixed, period: F.struct(
        F.lit(name).alias("split"), F.lit(quota).alias("quota"), F.lit(period).alias("period"),
        F.when(F.col("held"), whole).otherwise(mixed).alias("got"),
    )
    per_row = marked.select("speaker", "held", F.inline(F.array(
        split("train", n_train, 0, n - v, kept), split("val", n_val, n, v, n * n - kept),
    ))).where("got > 0 and quota > 0")
    filled = prefix_sum(per_row, ["split"], ["speaker"], "got", "before")
    full = F.floor((F.col("quota") - 1) / F.col("period"))
    need = F.col("quota") - full * F.col("period") - F.col("before")
    row = filled.withColumns({"full": full, "need": need}).where(
        (F.col("need") > 0) & (F.col("need") <= F.col("got"))
    )
    # A held-out first speaker fills a whole row of pairs; otherwise the second
    # speaker is the need-th of the split's own class.
    inner = row_positions(marked, ["held"], ["speaker"], "rank").select(
        F.col("speaker").alias("second"), F.col("held").alias("val"), "rank"
    )
    found = row.withColumns({
        "val": F.when(~F.col("held"), F.col("split") == "val"), "rank": F.col("need") - 1,
    }).join(inner, ["val", "rank"], "left")
    second = F.when(F.col("held"), F.col("need") - 1).otherwise(F.col("second"))
    index = F.col("full") * n * n + F.col("speaker") * n + second
    return found.agg(F.coalesce(F.max(index + 1), F.lit(0)).cast("long").alias("total"))


def cap_to_quota(examples: DataFrame, quotas: dict[str, int], order: str = "idx") -> DataFrame:
    """The first rows of each (kind, split) in index order, up to the split's quota."""
    keys = ["kind", "split"]
    quota = F.coalesce(*[F.when(F.col("split") == s, F.lit(q)) for s, q in quotas.items()])
    if isinstance(examples.schema[order].dataType, NumericType):
        # Quotas are far smaller than what they are drawn from: only that much is sorted.
        examples = head(examples, keys, order, quota)
    placed = row_positions(examples, keys, [order], "place")
    return placed.where(F.col("place") < quota)


def split_accounting(counted: DataFrame, listed: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """Counts per (kind, split) against a listing and the quotas."""
    keys = ["kind", "split"]
    have = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("counted"))
    disk = listed.groupBy(*keys).agg(F.count(F.lit(1)).alias("listed"))
    quota = F.coalesce(*[F.when(F.col("split") == s, F.lit(q).cast("long")) for s, q in quotas.items()])
    return (
        have.join(disk, keys, "full").na.fill(0, ["counted", "listed"])
        .withColumn("agrees", F.col("counted") == F.col("listed"))
        .withColumn("meets_quota", F.col("counted") >= quota)
    )


# --- text slots ----------------------------------------------------------------


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    return row_positions(df, [], order, out)


def cycle_texts(slots: DataFrame, texts: DataFrame) -> DataFrame:
    """Give slot i the text i mod the number of texts; ``texts`` has (text_no, text)."""
    size = texts.count()
    return (
        slots.withColumn("text_no", F.pmod("slot", F.lit(size)))
        .join(broadcast_if_small(texts), "text_no").drop("text_no")
    )


def injection_slots(slots: DataFrame, fraction: float, custom: DataFrame, seed: int) -> DataFrame:
    """(slot, custom_text): round(fraction * total) random slots, texts dealt in slot order."""
    total = slots.count()
    wanted = round(fraction * total)
    size = custom.count()
    keyed = slots.select("slot", scalars.seeded_key(seed, "slot").alias("_key"))
    chosen = row_positions(keyed, [], ["_key", "slot"], "_rank").where(F.col("_rank") < wanted)
    dealt = row_positions(chosen.select("slot"), [], ["slot"], "_j")
    return (
        dealt.withColumn("text_no", F.pmod("_j", F.lit(size)))
        .join(broadcast_if_small(custom), "text_no")
        .select("slot", F.col("text").alias("custom_text"))
    )


def overlay(slots: DataFrame, custom: DataFrame) -> DataFrame:
    """Replace ``text`` where a slot has a custom text."""
    return slots.join(custom, "slot", "left").select(
        "slot", F.coalesce("custom_text", "text").alias("text"),
        F.col("custom_text").isNotNull().alias("is_custom"),
    )


# --- samples ---------------------------------------------------------------------


def stress_picks(clips: DataFrame, count: int, seed: int, n_speakers: int) -> DataFrame:
    """``count`` clips without replacement (all when there are fewer), with speakers."""
    a, b = speaker_pair(F.col("idx"), n_speakers)
    picks = clips.orderBy(scalars.seeded_key(seed, "idx"), "idx").limit(count)
    return picks.select("idx", a.alias("spk_a"), b.alias("spk_b")).orderBy("idx")


def until_seconds(files: DataFrame, target_samples: int, seed: int) -> DataFrame:
    """Files in random order until ``target_samples`` is reached; has (name, n_samples)."""
    keyed = files.withColumn("_key", scalars.seeded_key(seed, "name"))
    scan = prefix_sum(keyed, [], ["_key", "name"], "n_samples", "before")
    return scan.where(F.col("before") < target_samples).drop("_key")


# --- sets ------------------------------------------------------------------------


def labelled_union(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """One validation table, label 1 for positives and 0 for negatives."""
    return positives.withColumn("label", F.lit(1)).unionByName(
        negatives.withColumn("label", F.lit(0))
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def available(declared: DataFrame, present: DataFrame) -> DataFrame:
    """Declared names that are present."""
    return declared.intersect(present)
