"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each node every child draws
``-ln(u) / weight`` with ``u`` a hash of the row's key and the child's name, and the
smallest draw wins, so a child gets its share of the node's rows. A child whose
weight does not change keeps its draw: rows move only into or out of the subtrees
whose weights change, and stay where they are inside the others.

Cases: a null key counts as the empty string; rows that repeat a key go to the same
shard and get slots of their own; null or empty text has size 1 and crc32 0; an empty
table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_PIECE = 200_000
#: Also bounds the broadcast of piece offsets: shards * MAX_PIECES rows of three numbers.
MAX_PIECES = 4096


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def balanced_tree(regions: int = 2, racks: int = 2, shards: int = 2) -> list[Leaf]:
    """Shards 0, 1, ... of equal weight, the same number in each rack and region."""
    return [
        Leaf(f"region{g}", f"rack{g * racks + k}", (g * racks + k) * shards + s)
        for g in range(regions) for k in range(racks) for s in range(shards)
    ]


def grow(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a region of its own: no old subtree changes its weight, so
    rows move only into the new shard."""
    shard = max(leaf.shard for leaf in tree) + 1
    return [*tree, Leaf(f"region+{shard}", f"rack+{shard}", shard, weight)]


def _unit(key: Column, name: str) -> Column:
    """A number in (0, 1) from 48 bits of a hash of the key and a node's name."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{name}"))), 1, 12), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 48)


def _draw(key: Column, name: str, weight: float) -> Column:
    return -F.log(_unit(key, name)) / weight


def shard_of(key: Column, tree: list[Leaf]) -> Column:
    """The shard of each key (a string column)."""

    def descend(leaves: list[Leaf], level: int) -> Column:
        if level == 3:
            return F.lit(leaves[0].shard)
        groups: dict[str, list[Leaf]] = {}
        for leaf in leaves:
            groups.setdefault(str(leaf[level]), []).append(leaf)
        if len(groups) == 1:
            return descend(leaves, level + 1)
        draws = {
            name: _draw(key, f"{level}/{name}", sum(x.weight for x in inside))
            for name, inside in groups.items()
        }
        names = list(groups)
        least = F.least(*draws.values())
        chosen = descend(groups[names[-1]], level + 1)
        for name in reversed(names[:-1]):
            chosen = F.when(draws[name] == least, descend(groups[name], level + 1)).otherwise(chosen)
        return chosen

    return descend(tree, 0)


def with_slots(df: DataFrame, shard: str, order: list[Column], rows: int, out: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without a gap.

    The order is that of a hash of the first order column, then the order columns. A
    shard is cut into pieces along the hash, each piece is numbered in a task of its
    own, and the counts of the pieces before it are added. The numbers do not depend
    on how many pieces there are.
    """
    pieces = min(MAX_PIECES, max(1, math.ceil(rows / ROWS_PER_PIECE)))
    lead = F.md5(F.concat(F.coalesce(order[0].cast("string"), F.lit("")), F.lit("|slot")))
    head = F.conv(F.substring(lead, 1, 4), 16, 10).cast("int")
    cut = df.withColumn("_lead", lead).withColumn("_piece", F.floor(head * pieces / 65536).cast("int"))
    counts = cut.groupBy(shard, "_piece").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(shard).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        shard, "_piece", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base")
    )
    inside = Window.partitionBy(shard, "_piece").orderBy("_lead", *order)
    return (
        cut.withColumn("_in", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), [shard, "_piece"])
        .withColumn(out, (F.col("_base") + F.col("_in")).cast("long"))
        .drop("_lead", "_piece", "_in", "_base")
    )


def assign(
    docs: DataFrame, tree: list[Leaf] | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, grown_shard`` of each row.

    ``size`` is the UTF-8 length of the text plus 1; ``grown_shard`` is the shard with
    one more shard in the tree.
    """
    tree = tree or balanced_tree()
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    placed = rows.select(
        "doc_id",
        (F.octet_length("text").cast("long") + 1).alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        shard_of(named, tree).alias("shard"),
        shard_of(named, grow(tree)).alias("grown_shard"),
    )
    return with_slots(placed, "shard", [F.col("doc_id"), F.col("text_crc32"), F.col("size")], docs.count())
