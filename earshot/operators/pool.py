"""Building the balanced background pool: re-cut, reserve, balance, babble."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from earshot.constants import SEGMENT_SECONDS, SILENCE_RMS, STRESS_RESERVE
from earshot.functions import scalars
from earshot.operators.positions import prefix_sum, row_positions
from earshot.session import pin


def drop_silent(clips: DataFrame, samples: str = "pcm", floor: float = SILENCE_RMS) -> DataFrame:
    """Drop clips too quiet to bring up to level; also guards the division by RMS."""
    return clips.where(scalars.rms(samples) >= floor)


def unit_rms(clips: DataFrame, samples: str = "pcm") -> DataFrame:
    return clips.withColumn(samples, scalars.scaled(samples, scalars.rms(samples)))


def segment_cap(hours: float, reserve: int = STRESS_RESERVE) -> int:
    """Segments a role may have: the hours asked for, and the reserve."""
    return int(hours * 3600 / SEGMENT_SECONDS) + reserve


def segment_floor(hours: float) -> int:
    """Segments a balanced role must have: half the hours asked for, at least one."""
    return max(int(0.5 * hours * 3600 / SEGMENT_SECONDS), 1)


def segment_overlaps(
    clips: DataFrame, order: list[str], length: str, segment: int, **scan
) -> DataFrame:
    """Which part of which clip falls in which segment of its role.

    Clips are laid end to end per role in ``order``. Each row is one overlap: the
    clip's columns, ``seg``, ``at`` (offset in the role), ``first`` (offset in the
    clip) and ``take`` (length). No join is needed: a clip knows its own segments.
    """
    placed = prefix_sum(clips.where(F.col(length) > 0), ["role"], order, length, "start", **scan)
    stop = F.col("start") + F.col(length)
    seg = F.explode(F.sequence(
        F.floor(F.col("start") / segment), F.floor((stop - 1) / segment)
    ))
    at = F.greatest(F.col("start"), F.col("seg") * segment)
    end = F.least(stop, (F.col("seg") + 1) * segment)
    return placed.withColumn("seg", seg).withColumns({
        "at": at, "first": at - F.col("start"), "take": end - at,
    })


def recut(
    clips: DataFrame, order: list[str], content: str, segment: int, shortest: int,
    cap: int | None = None, text: bool = False, **scan,
) -> DataFrame:
    """Rows (role, seg, n_samples, content): equal-length segments per role.

    A last piece shorter than ``segment`` is kept if it has ``shortest`` samples;
    ``cap`` is the number of segments a role may have. Works on arrays, or on
    strings with ``text``. A segment is put together from its own pieces only.
    """
    length = F.length(content) if text else F.size(content)
    # Offsets are worked out on lengths alone; the audio joins its own pieces after.
    sizes = clips.select("role", *order, length.cast("long").alias("_len"))
    pieces = segment_overlaps(sizes, order, "_len", segment, **scan)
    if cap is not None:
        pieces = pieces.where(F.col("seg") < cap)
    pieces = pieces.join(clips, ["role", *order])
    first, take = (F.col("first") + 1).cast("int"), F.col("take").cast("int")
    part = (
        F.substring(F.col(content), first, take) if text else F.slice(content, first, take)
    )
    parts = F.transform(
        F.array_sort(F.collect_list(F.struct("at", part.alias("part")))), lambda p: p["part"]
    )
    joined = F.array_join(parts, "") if text else F.flatten(parts)
    return (
        pieces.groupBy("role", "seg")
        .agg(F.sum("take").alias("n_samples"), joined.alias(content))
        .where(F.col("n_samples") >= shortest)
    )


def hold_back_reserve(segments: DataFrame, reserve: int = STRESS_RESERVE) -> DataFrame:
    """Add ``reserved``: the last ``reserve`` segments of each role leave the pool.

    Only (role, seg) is ranked, and a rank filter keeps ``reserve`` rows per role
    in each task before anything is shuffled. The broadcast has ``reserve`` rows
    per role.
    """
    last = Window.partitionBy("role").orderBy(F.desc("seg"))
    held = (
        segments.select("role", "seg").withColumn("_rank", F.row_number().over(last))
        .where(F.col("_rank") <= reserve).select("role", "seg", F.lit(True).alias("_held"))
    )
    return segments.join(F.broadcast(held), ["role", "seg"], "left").withColumn(
        "reserved", F.coalesce("_held", F.lit(False))
    ).drop("_held")


def role_counts(segments: DataFrame, hours: float, reserve: int = STRESS_RESERVE) -> DataFrame:
    """Per role: pool size, balanced size, and whether both are large enough."""
    floor = segment_floor(hours)
    counts = segments.groupBy("role").agg(
        F.count_if(~F.col("reserved")).alias("pool"), F.count(F.lit(1)).alias("total")
    )
    least = counts.agg(F.min("pool")).scalar()
    return counts.withColumn("balanced", least).withColumns({
        "has_reserve": F.col("total") > reserve, "above_floor": F.col("balanced") >= floor,
    })


def balance(segments: DataFrame, seed: int, **scan) -> DataFrame:
    """Cut every role's pool at random to the size of the smallest."""
    pool = segments.where(~F.col("reserved"))
    least = pool.groupBy("role").count().agg(F.min("count")).scalar()
    keyed = pool.select("role", "seg", scalars.seeded_key(seed, "role", "seg").alias("_key"))
    placed = row_positions(keyed, ["role"], ["_key", "seg"], "_place", **scan)
    chosen = placed.where(F.col("_place") < least).select("role", "seg")
    return pool.join(chosen, ["role", "seg"], "left_semi")


def pool_summary(pool: DataFrame, reserve: DataFrame) -> DataFrame:
    """Files, hours (every file counted as a full segment) and reserve per role."""
    files = pool.groupBy("role").agg(F.count(F.lit(1)).alias("files"))
    held = reserve.groupBy("role").agg(F.count(F.lit(1)).alias("stress_reserve"))
    return files.join(held, "role", "left").na.fill(0, ["stress_reserve"]).withColumn(
        "hours", F.round(F.col("files") * SEGMENT_SECONDS / 3600, 2)
    )


def babble_members(babbles: DataFrame, speech: int, segment: int, seed: int,
                   talkers: tuple[int, int] = (2, 5)) -> DataFrame:
    """Rows (babble, talker, pos, offset): 2 to 5 distinct speech segments each.

    The j-th talker is drawn among the segments not yet taken, by rank, so no
    babble ever looks at the whole pool.
    """
    low, high = talkers
    wanted = F.least(
        F.lit(low) + F.pmod(scalars.seeded_bits(seed, F.lit("k"), "babble"), F.lit(high - low + 1)),
        F.lit(speech),
    ).cast("int")

    def draw(taken: Column, talker: Column) -> Column:
        rank = F.pmod(
            scalars.seeded_bits(seed, F.lit("pick"), "babble", talker), F.lit(speech) - talker
        )
        pick = F.aggregate(
            F.array_sort(taken), rank, lambda r, t: F.when(r >= t, r + 1).otherwise(r)
        )
        return F.concat(taken, F.array(pick))

    nobody = F.filter(F.array(F.lit(0).cast("long")), lambda _: F.lit(False))
    picks = F.aggregate(F.sequence(F.lit(0), F.col("k") - 1), nobody, draw)
    return (
        babbles.select("babble", wanted.alias("k"))
        .select("babble", F.posexplode(picks).alias("talker", "pos"))
        .withColumn("offset", F.pmod(
            scalars.seeded_bits(seed, F.lit("roll"), "babble", "talker"), F.lit(segment)))
    )


def tiled(samples: Column, length: int) -> Column:
    """Repeat ``samples`` until ``length`` is filled."""
    times = F.ceil(F.lit(length) / F.size(samples)).cast("int")
    return F.slice(F.flatten(F.array_repeat(samples, times)), 1, length)


def rolled(samples: Column, offset: Column) -> Column:
    """Move samples right by ``offset``, wrapping round."""
    n = F.size(samples)
    shift = F.pmod(offset, n).cast("int")
    return F.concat(F.slice(samples, n - shift + 1, shift), F.slice(samples, F.lit(1), n - shift))


def babble(members: DataFrame, speech: DataFrame, segment: int) -> DataFrame:
    """Rows (babble, talkers, pcm): members tiled, rolled, summed and levelled.

    ``speech`` has (pos, pcm). A babble gathers its own few members, no more.
    """
    part = rolled(tiled(F.col("pcm"), segment), F.col("offset"))
    parts = members.join(speech, "pos").groupBy("babble").agg(
        F.array_sort(F.collect_list(F.struct("talker", part.alias("pcm")))).alias("parts")
    )
    silence = F.array_repeat(F.lit(0.0), segment)
    mix = F.aggregate(
        "parts", silence,
        lambda acc, p: F.zip_with(acc, p["pcm"], lambda a, b: a + b.cast("double")),
    )
    return parts.select(
        "babble", F.size("parts").alias("talkers"), mix.alias("pcm")
    ).withColumn("pcm", scalars.level_normalise("pcm"))


def reserve_audio(held: DataFrame, content: str, text: bool = False) -> DataFrame:
    """Rows (role, parts, n_samples, content): a role's reserve as one piece.

    The reserve is ``STRESS_RESERVE`` segments per role, which bounds the piece.
    """
    parts = F.transform(
        F.array_sort(F.collect_list(F.struct("seg", content))), lambda p: p[content]
    )
    joined = F.array_join(parts, "") if text else F.flatten(parts)
    return held.groupBy("role").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("n_samples").alias("n_samples"),
        joined.alias(content),
    )


def build(
    clips: DataFrame, order: list[str], segment: int, shortest: int, hours: float, seed: int,
    reserve: int = STRESS_RESERVE, **scan,
) -> tuple[DataFrame, DataFrame]:
    """The pool and the stress reserve, rows (role, seg, n_samples, pcm), from clips.

    Silent clips go, the rest are brought to unit RMS, re-cut up to the hours asked for
    and levelled; the reserve is held back, the roles are balanced, and babble is made
    of the speech that is left, apart for the pool and for the reserve, as many as the
    other roles have. Fails if a role has no more than the reserve, or a balanced role
    is below half the hours.
    """
    spark = clips.sparkSession
    cut = recut(
        unit_rms(drop_silent(clips)), order, "pcm", segment, shortest, segment_cap(hours, reserve), **scan
    )
    cut = pin(hold_back_reserve(cut.withColumn("pcm", scalars.level_normalise("pcm")), reserve))
    counts = role_counts(cut, hours, reserve).select(
        "role", "balanced",
        F.assert_true("has_reserve", F.concat("role", F.lit(": no more segments than the reserve"))).alias("_a"),
        F.assert_true("above_floor", F.lit("the balanced pool is below its floor")).alias("_b"),
    ).where("_a is null and _b is null")
    size = counts.agg(F.min("balanced")).first()[0] or 0
    out = []
    for part, wanted in ((balance(cut, seed, **scan), size), (cut.where("reserved"), reserve)):
        part = part.select("role", "seg", "n_samples", "pcm")
        speech = row_positions(part.where("role = 'speech'").select("seg", "pcm"), [], ["seg"], "pos", **scan)
        draws = babble_members(spark.range(wanted).withColumnRenamed("id", "babble"), wanted, segment, seed)
        mixed = babble(draws, speech, segment).select(
            F.lit("babble").alias("role"), F.col("babble").alias("seg"),
            F.size("pcm").cast("long").alias("n_samples"), "pcm",
        )
        out.append(part.unionByName(mixed))
    return out[0], out[1]
