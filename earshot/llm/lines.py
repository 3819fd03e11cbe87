"""Line dedup by overlapping three-line windows.

Every run of three consecutive lines is hashed; windows that occur more than once in
the table are repeats; every occurrence but the first (smallest document id, then
position) covers its three lines, and covered lines go.

Cases: a null text stays null and an empty one empty; documents of fewer lines than a
window have none and stay whole; windows of blank lines only don't count; a window
that overlaps its own earlier occurrence covers the shared lines too; rows that share
a document id count as one place, so a repeated row is no repeat of itself; rows
without a document id stay whole and take no part; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _windows(lines: Column, size: int) -> Column:
    """The windows of one document as (pos, a, b), with 128 bits of hash."""
    starts = F.when(F.size(lines) >= size, F.sequence(F.lit(1), F.size(lines) - (size - 1)))
    cut = F.transform(starts, lambda i: F.slice(lines, i, size))

    def hashed(window: Column, i: Column) -> Column:
        return F.struct(
            i.alias("pos"),
            F.xxhash64(window).alias("a"),
            F.xxhash64(F.lit(size), window).alias("b"),
            F.exists(window, lambda line: line.rlike(r"\S")).alias("some"),
        )

    return F.filter(F.transform(cut, hashed), lambda w: w["some"])


def _uncovered(lines: Column, starts: Column, size: int) -> Column:
    """The lines in the gaps between windows at ``starts`` (sorted, distinct)."""

    def gap(start: Column, i: Column) -> Column:
        after = F.when(i == 0, 0).otherwise(F.get(starts, i - 1) + size)
        return F.slice(lines, after + 1, F.greatest(start - after, F.lit(0)))

    rest = F.element_at(starts, -1) + size
    tail = F.slice(lines, rest + 1, F.greatest(F.size(lines) - rest, F.lit(0)))
    return F.concat(F.flatten(F.transform(starts, gap)), tail)


def drop_repeated_windows(
    docs: DataFrame, size: int = 3, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` without later occurrences, plus ``n_lines`` and ``n_removed`` (long)."""
    added = ("n_lines", "n_removed")
    rows = docs.select(
        docs[key].alias("_key"),
        F.split(docs[text], "\n", -1).alias("_lines"),
        F.struct(*[docs[c] for c in docs.columns if c not in added]).alias("_row"),
    )
    windows = (
        rows.where(F.col("_key").isNotNull())
        .select("_key", F.inline(_windows(F.col("_lines"), size)))
        .select("_key", "pos", "a", "b")
    )
    place = F.struct("_key", "pos")
    repeated = (
        windows.groupBy("a", "b")
        .agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
        .where(F.col("_first") != F.col("_last"))
        .select("a", "b", "_first")
    )
    covered = (
        windows.join(repeated, ["a", "b"])
        .where(place != F.col("_first"))
        .groupBy(F.col("_key").alias("_of"))
        .agg(F.array_sort(F.collect_set("pos")).alias("_starts"))
    )
    joined = rows.join(covered, F.col("_key") == F.col("_of"), "left")
    lines = F.col("_lines")
    kept = F.when(F.col("_starts").isNull(), lines).otherwise(
        _uncovered(lines, F.col("_starts"), size)
    )
    done = joined.select("_row", "_lines", kept.alias("_kept"))
    count = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    return done.select(
        *[
            F.array_join("_kept", "\n").alias(text) if c == text else F.col(f"_row.`{c}`").alias(c)
            for c in docs.columns if c not in added
        ],
        count("_lines").alias("n_lines"),
        (count("_lines") - count("_kept")).alias("n_removed"),
    )
