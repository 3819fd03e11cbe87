"""Running totals and row numbers in a total order, safe under skew.

A plain window keeps each group in one task. That is right for small groups and
fatal for a role or stream that holds a third of the table. Above
``rows_per_task`` rows, groups that are themselves larger than that are split
along the order by sampled splitters, each piece is scanned on its own, and the
pieces are stitched by the running total of the piece sums.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from earshot.session import broadcast_if_small, pin

ROWS_PER_TASK = 2_000_000
MAX_SPLITS = 4096
MAX_STEPS = 65_536
OVERSAMPLE = 32
MAX_HOT_GROUPS = 4096


def prefix_sum(
    df: DataFrame,
    group: list[str],
    order: list[str],
    value: str | Column,
    out: str,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one in its group.

    ``order`` must be unique within the group. ``value`` should be integral, so
    that the result does not depend on how the additions are bracketed.
    """
    value = F.col(value) if isinstance(value, str) else value
    columns = df.columns
    df = df.withColumn("_v", value)
    rows = df.count()
    if rows <= rows_per_task:
        total = _running("_v", Window.partitionBy(*_keys(group)).orderBy(*order))
        return df.withColumn(out, total).drop("_v")

    if not group and isinstance(df.schema[order[0]].dataType, IntegralType):
        made = _even_pieces(df, order[0], rows, rows_per_task)
        if made:
            pieces, base = made
            inside = _running("_v", Window.partitionBy("_piece").orderBy(*order))
            return pieces.withColumn(out, inside + base).select(*columns, out)
    split = _split_hot_groups(df, group, order, rows, rows_per_task)
    pieces = split.where("_piece >= 0").groupBy(*group, "_piece").agg(F.sum("_v").alias("_sum"))
    stitched = pieces.select(
        *group,
        "_piece",
        _running("_sum", Window.partitionBy(*_keys(group)).orderBy("_piece")).alias("_base"),
    )
    inside = _running("_v", Window.partitionBy(*group, "_piece").orderBy(*order))
    # Scanned first: the join then finds the rows dealt and sorted as it needs them.
    return (
        split.withColumn("_inside", inside)
        .join(stitched, [*group, "_piece"], "left")
        .withColumn(out, F.col("_inside") + F.coalesce("_base", F.lit(0)))
        .select(*columns, out)
    )


def row_positions(
    df: DataFrame,
    group: list[str],
    order: list[str],
    out: str,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``out``: the 0-based position of each row in its group's order."""
    return prefix_sum(df, group, order, F.lit(1).cast("long"), out, rows_per_task)


def head(
    df: DataFrame, group: list[str], order: str, wanted: Column, bins: int = 4096
) -> DataFrame:
    """The rows that can be among the first ``wanted`` of their group by ``order``, a number.

    They are found by counts in ``bins`` equal steps of ``order``, added up before they are
    shuffled: all steps up to the one in which a group has its ``wanted`` rows. Rows without
    ``order`` come first. ``wanted`` depends on the group only; without it no row is kept.
    """
    low, high = df.agg(F.min(order).cast("double"), F.max(order).cast("double")).first()
    width = ((high or 0.0) - (low or 0.0)) / bins or 1.0
    # Casts, differences and quotients are rounded, but never fall where ``order`` rises.
    step = F.coalesce(F.floor((F.col(order).cast("double") - F.lit(low or 0.0)) / F.lit(width)), F.lit(-1))
    stepped = df.withColumn("_step", step)
    before = Window.partitionBy(*group).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        stepped.groupBy(*group, "_step").agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .where(F.col("_before") < wanted)
        .groupBy(*group).agg(F.max("_step").alias("_end"))
        .select(*[F.col(c).alias(f"_of_{c}") for c in group], "_end")
    )
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return (
        stepped.join(broadcast_if_small(pin(ends)), same & (F.col("_step") <= F.col("_end")))
        .select(*df.columns)
    )


def _keys(group: list[str]) -> list:
    return list(group) if group else [F.lit(0)]


def _running(column: str, window) -> Column:
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(before), F.lit(0)).cast("long")


def _even_pieces(
    df: DataFrame, first: str, rows: int, rows_per_task: int
) -> tuple[DataFrame, Column] | None:
    """``df`` dealt by ``_piece``, and what comes before a row's piece; None if it can't be cut so.

    Even steps of the first order column are counted, and neighbours put together. A row
    finds its piece by one look-up, with no search and no join. At most ``MAX_STEPS`` counts
    come back. A step with more rows than a task takes needs splitters of all columns.
    """
    wanted = max(1, rows_per_task // 4)
    steps = min(MAX_STEPS, max(4096, 16 * rows // wanted))
    low, high = df.agg(F.min(first), F.max(first)).first()
    if low is None or low == high:
        return None
    # Rounded, but never falling where the column rises; NULL comes first.
    place = F.floor((F.col(first).cast("double") - F.lit(float(low))) / F.lit((high - low) / steps))
    place = F.when(F.col(first).isNull(), 0).otherwise(F.least(place, F.lit(steps)) + 1).cast("int")
    counts = df.groupBy(place.alias("step")).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("_v"), F.lit(0)).cast("long").alias("total")
    )
    piece_of, bases, held, before, at = [0] * (steps + 2), [0], 0, 0, 0
    for step, n, total in sorted(tuple(r) for r in counts.collect()):
        if n > rows_per_task:
            return None
        if held and held + n > wanted:
            bases.append(before)
            at, held = at + 1, 0
        piece_of[step] = at
        held, before = held + n, before + total
    known = lambda values, kind: F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")
    dealt = df.withColumn("_piece", F.get(known(piece_of, "int"), place))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if len(bases) > tasks:
        dealt = dealt.repartition(len(bases), "_piece")
    return dealt, F.get(known(bases, "bigint"), F.col("_piece"))


def _split_hot_groups(
    df: DataFrame, group: list[str], order: list[str], rows: int, rows_per_task: int
) -> DataFrame:
    """Add ``_piece``: -1 for a small group, else the slice of the order it is in.

    Splitters come from a hash sample, so they are a pure function of the data
    and stay the same when a lost task is run again. At most ``MAX_HOT_GROUPS``
    groups are split, and by counting any other group then holds less than
    ``rows / MAX_HOT_GROUPS`` rows, so the broadcast is bounded either way.
    """
    splits = min(MAX_SPLITS, max(2, math.ceil(rows / rows_per_task)))
    keep_one_in = max(1, rows // (splits * OVERSAMPLE))
    types = dict(df.dtypes)
    key = F.struct(
        *[
            (F.unix_micros(F.col(c).cast("timestamp")) if types[c].startswith("timestamp")
             else F.col(c)).alias(c)
            for c in order
        ]
    )
    sample = df.where(F.pmod(F.xxhash64(*group, *order), F.lit(keep_one_in)) == 0).agg(
        F.array_sort(F.collect_list(key)).alias("keys")
    )
    every = F.greatest(F.lit(1), F.ceil(F.size("keys") / splits)).cast("int")
    chosen = sample.select(
        F.filter("keys", lambda _, i: F.pmod(i + 1, every) == 0).alias("splitters")
    )
    # At most MAX_SPLITS keys come back; as a literal they are the same in every task.
    as_json = chosen.select(F.to_json("splitters")).first()[0]
    splitters = F.from_json(F.lit(as_json), chosen.schema["splitters"].dataType)

    steps = math.ceil(math.log2(splits + 2)) + 1

    def halve(state, _):
        middle = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        left = F.struct(state["lo"].alias("lo"), middle.alias("hi"))
        right = F.struct((middle + 1).alias("lo"), state["hi"].alias("hi"))
        moved = F.when(F.get(splitters, middle) <= key, right).otherwise(left)
        return F.when(state["lo"] < state["hi"], moved).otherwise(state)

    piece = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(F.lit(0).alias("lo"), F.size(splitters).alias("hi")),
        halve,
        lambda state: state["lo"],
    )
    if not group:
        return df.withColumn("_piece", piece)
    hot = (
        df.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > rows_per_task)
        .orderBy(F.desc("_rows"), *group)
        .limit(MAX_HOT_GROUPS)
        .select(*group, F.lit(True).alias("_hot"))
    )
    return (
        df.join(F.broadcast(hot), group, "left")
        .withColumn("_piece", F.when(F.col("_hot"), piece).otherwise(F.lit(-1)))
        .drop("_hot")
    )
