"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

A paragraph (a line that isn't blank, trimmed) becomes a wide vector: counts of itself
and its sentences, its hash in ``EQUAL`` lanes, and the hashes of its sentences, each
added in one lane of a fine part and, for one sentence in ``COARSE``, of a coarser one,
for one of those in ``COARSE`` of a still coarser one, and so on for ``PARTS`` parts.
A document's fingerprint is the sum of these vectors, lane by lane, modulo powers of
two. The order of paragraphs doesn't matter, equal multisets have equal fingerprints,
and paragraphs go in or out by adding or subtracting their fingerprint (``combine``).

Two fingerprints differ in a lane where a sentence of only one of them fell. The share
of equal lanes thus tells how many sentences differ, and ``likeness`` sets that
against how many there are. It uses the finest part with lanes to spare; the last part
has them for any text that a string can hold.

Cases: a null text counts as empty; a text without paragraphs has the zero
fingerprint; repeated paragraphs count as often as they occur; rows that share an id
follow one another in the order of their texts, rows without one come last; the only
row of a table is its own successor; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EQUAL = 4
LANES = 64
COARSE = 16
PARTS = 7
#: Hex digits of a count or paragraph lane (modulo 2^32) and of a sentence lane (2^16).
WIDE, NARROW = 8, 4
HEAD = 2 + EQUAL
ROWS_PER_PIECE = 20_000
#: Bounds the table of pieces that is broadcast, three numbers each.
MAX_PIECES = 4096


def _paragraphs(text: Column) -> Column:
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.trim(x))
    return F.filter(lines, lambda x: x != "")


def _sentences(of: Column) -> Column:
    parts = F.flatten(F.transform(of, lambda p: F.split(p, r"(?<=[.!?])\s+", -1)))
    return F.filter(parts, lambda x: x != "")


def _sum(hashes: Column, shift: int, digits: int) -> Column:
    modulus = F.lit(1 << 4 * digits).cast("long")
    return F.aggregate(
        hashes, F.lit(0).cast("long"), lambda a, h: F.pmod(a + _bits(h, shift, digits), modulus)
    )


def _bits(hashed: Column, shift: int, digits: int) -> Column:
    return F.pmod(F.shiftrightunsigned(hashed, shift), F.lit(1 << 4 * digits).cast("long"))


def _drawn(hashed: Column, level: int) -> Column:
    """0 for one hash in ``COARSE``: by four bits for each level that no lane reads."""
    return F.pmod(F.shiftrightunsigned(hashed, 44 + 4 * level if level < 5 else 4 * level - 12), F.lit(COARSE))


def _lanes(hashes: Column) -> Column:
    """Each hash's middle bits added in the lane its low bits name."""
    zero = F.array_repeat(F.lit(0).cast("long"), LANES)
    modulus = F.lit(1 << 4 * NARROW).cast("long")

    def add(lanes: Column, h: Column) -> Column:
        at = F.pmod(h, F.lit(LANES)).cast("int")
        new = F.pmod(F.get(lanes, at) + _bits(h, 32, NARROW), modulus)
        return F.concat(F.slice(lanes, 1, at), F.array(new), F.slice(lanes, at + 2, LANES))

    return F.aggregate(hashes, zero, add)


def _hex(lanes: Column, digits: int) -> Column:
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), digits, "0")), "")


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the fingerprint of each text as hex digits, lane after lane."""
    columns = [F.col(f"`{c}`") for c in df.columns if c != out]
    units = df.select(*columns, _paragraphs(F.col(f"`{text}`")).alias("_p"))
    units = units.select(
        *columns,
        F.size("_p").cast("long").alias("_np"),
        F.transform("_p", lambda p: F.xxhash64(p)).alias("_a"),
        F.transform("_p", lambda p: F.xxhash64(F.lit(1), p)).alias("_b"),
        F.transform(_sentences(F.col("_p")), lambda s: F.xxhash64(s)).alias("_s"),
    )
    wide = F.array(
        F.col("_np"), F.size("_s").cast("long"),
        *[_sum(F.col(of), shift, WIDE) for of in ("_a", "_b") for shift in (0, 32)],
    )
    # The hashes are gone through once; each further draw only reads one in COARSE.
    units = units.withColumn("_d", F.filter("_s", lambda h: _drawn(h, 1) == 0))
    parts, kept = [_hex(_lanes(F.col("_s")), NARROW)], F.col("_d")
    for level in range(1, PARTS):
        kept = F.filter(kept, lambda h: _drawn(h, level) == 0) if level > 1 else kept
        parts.append(F.when(F.size(kept) > 0, _hex(_lanes(kept), NARROW)).otherwise("0" * LANES * NARROW))
    return units.select(*columns, F.concat(_hex(wide, WIDE), *parts).alias(out))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of both multisets together, or (sign -1) of ``a`` without ``b``."""

    def part(first: int, lanes: int, digits: int) -> Column:
        def lane(i: Column) -> Column:
            at = i * digits + (first + 1)
            x, y = (F.conv(F.substr(v, at, F.lit(digits)), 16, 10).cast("long") for v in (a, b))
            total = F.pmod(x + sign * y, F.lit(1 << 4 * digits).cast("long"))
            return F.lpad(F.lower(F.hex(total)), digits, "0")

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(lanes - 1)), lane), "")

    return F.concat(part(0, HEAD, WIDE), part(HEAD * WIDE, PARTS * LANES, NARROW))


def likeness(a: Column, b: Column) -> Column:
    """About the share of sentences that two fingerprints have in common, 0 to 1.

    The number of different sentences that one of ``n`` lanes' worth of sums tells apart
    follows from the share of lanes left equal. Counted so, the sentences of one side
    only are set against those of both. A part that is full gives way to the next one.
    """

    def lane(v: Column, first: int, i: Column) -> Column:
        return F.substr(v, i * NARROW + (first + 1), F.lit(NARROW))

    def different(equal: Column) -> Column:
        return F.log(F.greatest(equal, F.lit(0.5 / LANES))) / math.log(1 - 1 / LANES)

    def shares(first: int) -> list[Column]:
        zeros = lambda v: F.size(F.filter(
            F.sequence(F.lit(0), F.lit(LANES - 1)), lambda i: lane(v, first, i) == "0" * NARROW
        )) / LANES
        same = F.size(F.filter(
            F.sequence(F.lit(0), F.lit(LANES - 1)), lambda i: lane(a, first, i) == lane(b, first, i)
        )) / LANES
        return [same, zeros(a), zeros(b)]

    def common(first: int) -> Column:
        same, left, right = shares(first)
        total = different(left) + different(right)
        return F.when(total > 0, F.greatest(F.lit(0.0), 1 - different(same) / total)).otherwise(0.0)

    starts = [HEAD * WIDE + k * LANES * NARROW for k in range(PARTS)]
    out = common(starts[-1])
    for first in reversed(starts[:-1]):
        out = F.when(F.least(*shares(first)) > 0.05, common(first)).otherwise(out)
    return F.when(a == b, 1.0).otherwise(out).cast("double")


def with_next(df: DataFrame, key: str, carried: list[str], ties: list[str]) -> DataFrame:
    """Add ``next_<column>`` of the row after this one by descending ``key``; after the
    last comes the first.

    The keys are cut at quantiles into pieces of bounded size. Each piece gets a copy of
    the first row of the piece after it, so every row finds its successor in its own
    piece: one shuffle, and no window over the whole table.
    """
    rows = df.count()
    pieces = min(MAX_PIECES, max(1, math.ceil(rows / ROWS_PER_PIECE)))
    cuts = []
    if pieces > 1:
        shares = [i / pieces for i in range(1, pieces)]
        cuts = sorted(set(df.stat.approxQuantile(key, shares, 0.2 / pieces)))
    steps = len(cuts).bit_length() + 1
    bounds = F.array(*[F.lit(int(c)) for c in cuts]) if cuts else F.array().cast("array<long>")

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        right = F.get(bounds, middle) <= F.col(key)
        return F.struct(
            F.when((state["lo"] < state["hi"]) & right, middle + 1).otherwise(state["lo"]).alias("lo"),
            F.when((state["lo"] < state["hi"]) & ~right, middle).otherwise(state["hi"]).alias("hi"),
        )

    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), halve, lambda s: s["lo"],
    )
    cut = df.withColumn("_piece", F.when(F.col(key).isNull(), 0).otherwise(found))
    heads = cut.groupBy("_piece").agg(F.max(key).alias("_head"))
    around = Window.orderBy(F.desc("_piece"))
    whole = Window.orderBy(F.desc("_piece")).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    heads = heads.select(
        "_piece", "_head",
        F.coalesce(F.lag("_piece").over(around), F.last("_piece").over(whole)).alias("_to"),
    )
    copies = F.when(
        F.col(key).eqNullSafe(F.col("_head")),
        F.array(
            F.struct(F.col("_piece").alias("_at"), F.lit(0).alias("_copy")),
            F.struct(F.col("_to").alias("_at"), F.lit(1).alias("_copy")),
        ),
    ).otherwise(F.array(F.struct(F.col("_piece").alias("_at"), F.lit(0).alias("_copy"))))
    dealt = cut.join(F.broadcast(heads), "_piece").select(*df.columns, F.inline(copies))
    order = Window.partitionBy("_at").orderBy("_copy", F.desc_nulls_last(key), *ties)
    return (
        dealt.select(*df.columns, "_copy", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried])
        .where("_copy = 0").drop("_copy")
    )


def edit_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form: the second half replaced by the
    start of the next document, with how alike they are."""
    rows = docs.select(docs[key].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    marked = with_fingerprint(rows, "text", "fingerprint")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    pairs = with_next(marked, "doc_id", ["text", "fingerprint"], ["text"])
    edited = pairs.withColumn("n_chars", F.length("text").cast("long")).withColumn(
        "_edited",
        F.concat(
            F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half),
            F.substr("next_text", F.lit(1), half),
        ),
    )
    edited = edited.select(
        "doc_id", "n_chars", "fingerprint", "next_fingerprint", "_edited",
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
    )
    edited = with_fingerprint(edited, "_edited", "edited_fingerprint")
    return edited.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
