"""Counting and listing detections in score streams.

The refractory rule is sequential: a hit starts an event only if it is more than
``grouping`` frames after the last event. Streams can be far larger than a task,
so they are cut into fixed chunks of frames. For a chunk, the past matters only
through how many of its first frames are still blocked, a number from 0 to
``grouping``. Each chunk is therefore reduced to a small table "blocked on entry
-> events, blocked until", and those tables compose: chunks into super-chunks,
super-chunks into the stream. Nothing larger than one chunk of hits or ``FANOUT``
chunk tables is ever held by one task, however dense or long the stream is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from earshot.constants import METER_DECAY
from earshot.functions import refractory
from earshot.session import pin

CHUNK_FRAMES = 4096
FANOUT = 4096
HITS_PER_BLOCK = 2_000_000

# Past this many frames METER_DECAY ** age times any score below 1e6 is exactly 0.
METER_HALO = 2200


def chunk_hits(
    scores: DataFrame, keys: list[str], floor: float | Column | None = None,
    chunk_frames: int = CHUNK_FRAMES,
) -> DataFrame:
    """Rows (keys, chunk, hits): the frames of a chunk that score at least ``floor``.

    ``frame_idx`` is unique within ``keys``, so ``hits`` has at most
    ``chunk_frames`` entries. The floor is applied before the shuffle.
    """
    hits = scores if floor is None else scores.where(F.col("score") >= floor)
    return (
        hits.withColumn("chunk", F.floor(F.col("frame_idx") / chunk_frames))
        .groupBy(*keys, "chunk")
        .agg(F.array_sort(F.collect_list(F.struct("frame_idx", "score"))).alias("hits"))
    )


def refractory_counts(
    chunks: DataFrame,
    keys: list[str],
    thresholds: Column,
    grouping: Column,
    strict: bool = False,
    chunk_frames: int = CHUNK_FRAMES,
    fanout: int = FANOUT,
) -> DataFrame:
    """Rows (keys, threshold, events, frames) for every threshold that has a hit.

    ``chunks`` comes from :func:`chunk_hits`; ``thresholds`` is an array column
    and ``grouping`` a number column, both evaluated on its rows. Hits pass with
    ``>=``, or ``>`` when ``strict``.
    """
    supers = _compose_level(
        _chunk_tables(chunks, keys, thresholds, grouping, strict, chunk_frames),
        [*keys, "threshold"], chunk_frames, fanout,
    )
    final = supers.groupBy(*keys, "threshold").agg(
        _children(), F.sum("frames").alias("frames")
    )
    free = F.lit(0).cast("long")
    return final.select(
        *keys, "threshold",
        _fold(F.col("children"), free)["n"].alias("events"),
        "frames",
    )


def event_steps(chunks: DataFrame, keys: list[str], chunk_frames: int = CHUNK_FRAMES) -> DataFrame:
    """Rows (keys, score, events): what the hits of a score add to the event count.

    The count above a threshold is the sum of ``events`` over all higher scores, so one
    pass gives it for every threshold. ``chunks`` comes from :func:`chunk_hits` with
    ``grouping`` among its columns. Hits further apart than ``grouping`` never block one
    another, whatever the threshold, so a chunk falls into pieces; those that may touch
    a piece of the next chunk are put together first. Hits that add nothing have no row.
    """
    columns = [*keys, "grouping"]
    made = pin(_pieces(chunks, columns, chunk_frames))
    whole = made.where("first is null").select(*keys, "score", "events")
    # Only where pieces begin and end crosses the network here, twice a chunk at most.
    edges = made.where("first is not null").select(*columns, "first", "last")
    order = Window.partitionBy(*keys).orderBy("first")
    apart = F.coalesce(F.col("first") - F.lag("last").over(order) > F.col("grouping"), F.lit(True))
    named = edges.withColumn("_new", apart.cast("int")).withColumn(
        "_segment", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).select(*keys, "first", "_segment")
    touching = (
        made.where("first is not null").join(named, [*keys, "first"])
        .groupBy(*columns, "_segment")
        .agg(F.array_sort(F.collect_list(F.struct("first", "hits"))).alias("parts"))
        .select(*columns, F.flatten(F.transform("parts", lambda p: p["hits"])).alias("hits"))
    )
    joined = _steps(touching, columns)
    return whole.unionByName(joined.select(*keys, "score", "events"))


def _pieces(chunks: DataFrame, columns: list[str], chunk_frames: int) -> DataFrame:
    """Steps of the pieces inside a chunk; the hits of those that may go on in another."""
    schema = StructType([
        *[chunks.schema[c] for c in columns], StructField("score", DoubleType()), StructField("events", LongType()),
        StructField("first", LongType()), StructField("last", LongType()), chunks.schema["hits"],
    ])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            hits = batch.column("hits")
            offsets = hits.offsets.to_numpy()
            values = pa.array(hits.values)
            frames = values.field("frame_idx").to_numpy()
            scores = values.field("score").to_numpy(zero_copy_only=False)
            rows, cells, events, edges = [], [], [], []
            gaps = batch.column("grouping").to_pylist()
            starts = batch.column("chunk").to_numpy(zero_copy_only=False) * chunk_frames
            for row, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                gap, start = gaps[row], int(starts[row])
                for a, b in refractory.pieces(frames[low:high], gap):
                    a, b = low + a, low + b
                    if frames[a] - start < gap or start + chunk_frames - frames[b - 1] <= gap:
                        edges.append((row, a, b))
                    elif b - a == 1:
                        rows.append(row)
                        cells.append(a)
                        events.append(1)
                    else:
                        added = refractory.step_events(frames[a:b], scores[a:b], gap)
                        some = np.flatnonzero(added)
                        rows += [row] * len(some)
                        cells += (a + some).tolist()
                        events += added[some].tolist()
            n, m = len(rows), len(edges)
            taken = pa.array(rows + [e[0] for e in edges], pa.int64())
            ends = np.cumsum([0] + [0] * n + [b - a for _, a, b in edges], dtype=np.int32)
            inside = np.concatenate([np.arange(a, b) for _, a, b in edges]) if m else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c).take(taken) for c in columns],
                pa.array(scores[cells].tolist() + [None] * m, pa.float64()), pa.array(events + [None] * m, pa.int64()),
                pa.array([None] * n + [int(frames[a]) for _, a, _ in edges], pa.int64()),
                pa.array([None] * n + [int(frames[b - 1]) for _, _, b in edges], pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends), values.take(pa.array(inside))),
            ], names=schema.names)

    return chunks.mapInArrow(run, schema)


def _steps(segments: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (columns, score, events) of whole segments of hits."""
    schema = StructType([
        *[segments.schema[c] for c in columns], StructField("score", DoubleType()), StructField("events", LongType()),
    ])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            hits = batch.column("hits")
            offsets, values = hits.offsets.to_numpy(), hits.values
            frames = values.field("frame_idx").to_numpy()
            scores = values.field("score").to_numpy(zero_copy_only=False)
            gaps = batch.column("grouping").to_pylist()
            for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                added = refractory.step_events(frames[a:b], scores[a:b], gaps[row])
                some = np.flatnonzero(added)
                at = pa.array(np.full(len(some), row))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(at) for c in columns], pa.array(scores[a + some]), pa.array(added[some])],
                    names=schema.names,
                )

    return segments.mapInArrow(run, schema)


def chunk_entries(
    chunks: DataFrame,
    keys: list[str],
    threshold: float,
    grouping: int,
    chunk_frames: int = CHUNK_FRAMES,
    fanout: int = FANOUT,
    before: DataFrame | None = None,
) -> DataFrame:
    """Rows (keys, chunk, until, n): the first frame that isn't blocked as a chunk begins,
    and the events before it.

    ``chunks`` comes from :func:`chunk_hits` with the same ``chunk_frames``, all streams
    being free as they begin. ``before`` (keys, n) has events counted earlier.
    """
    limits = F.array(F.lit(float(threshold)))
    tables = _chunk_tables(
        chunks, keys, limits, F.lit(grouping), False, chunk_frames
    ).drop("threshold")
    supers = _compose_level(tables, keys, chunk_frames, fanout)

    # Walk back down: the state in which each super-chunk, then each chunk, is entered.
    zero = F.lit(0).cast("long")
    whole = supers.groupBy(*keys).agg(_children()).withColumn("until", zero)
    if before is None:
        whole = whole.withColumn("n", zero)
    else:
        whole = whole.join(before.select(*keys, "n"), keys, "left").na.fill(0, ["n"])
    down = lambda df, name: df.select(
        *keys, F.explode(_entries(F.col("children"), F.col("until"), F.col("n"))).alias("e")
    ).select(*keys, F.col("e.id").alias(name), F.col("e.until").alias("until"), F.col("e.n").alias("n"))
    return down(
        tables.withColumn("super", F.floor(F.col("chunk") / fanout))
        .groupBy(*keys, "super").agg(_children("chunk"))
        .join(down(whole, "super"), [*keys, "super"]),
        "chunk",
    )


def fired(hits: str, until: Column, grouping: int) -> Column:
    """The hits of a chunk, in order, that start events when it is entered with ``until``."""
    start = F.struct(until.alias("until"), F.filter(hits, lambda h: F.lit(False)).alias("events"))

    def take(state, hit):
        fires = F.struct(
            (hit["frame_idx"] + grouping + 1).alias("until"),
            F.concat(state["events"], F.array(hit)).alias("events"),
        )
        return F.when(hit["frame_idx"] >= state["until"], fires).otherwise(state)

    return F.aggregate(hits, start, take, lambda state: state["events"])


def refractory_events(
    scores: DataFrame,
    keys: list[str],
    threshold: float,
    grouping: int,
    chunk_frames: int = CHUNK_FRAMES,
    fanout: int = FANOUT,
) -> DataFrame:
    """Rows (keys, frame_idx, score): one per event, at the frame that starts it."""
    chunks = chunk_hits(scores, keys, threshold, chunk_frames)
    chunk_entry = chunk_entries(chunks, keys, threshold, grouping, chunk_frames, fanout)
    return (
        chunks.join(chunk_entry, [*keys, "chunk"])
        .select(*keys, F.explode(fired("hits", F.col("until"), grouping)).alias("hit"))
        .select(*keys, "hit.frame_idx", "hit.score")
    )


def frames_above(scores: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    """Rows (keys, threshold, frames): frames at or above each threshold, ungrouped."""
    counts = scores.groupBy(*keys).agg(
        F.array(*[
            F.struct(F.lit(t).alias("threshold"),
                     F.count_if(F.col("score") >= t).alias("frames"))
            for t in thresholds
        ]).alias("rows")
    )
    return counts.select(*keys, F.inline("rows"))


def false_accept_rate(events: Column, hours: Column) -> Column:
    return F.round(events / hours, 4)


def score_runs(
    scores: DataFrame,
    keys: list[str],
    threshold: float,
    chunk_frames: int = CHUNK_FRAMES,
    fanout: int = FANOUT,
) -> DataFrame:
    """Maximal runs of consecutive frames at or above ``threshold``.

    Rows (keys, lo, hi, peak, peak_idx), ``peak_idx`` being the first frame that
    reaches the peak. Runs are found inside chunks; only those that touch a chunk
    edge, at most two per chunk, are looked at again to be joined up.
    """
    order = Window.partitionBy(*keys, "chunk").orderBy("frame_idx")
    runs = (
        scores.where(F.col("score") >= threshold)
        .withColumn("chunk", F.floor(F.col("frame_idx") / chunk_frames))
        .withColumn("island", F.col("frame_idx") - F.row_number().over(order))
        .groupBy(*keys, "chunk", "island")
        .agg(
            F.min("frame_idx").alias("lo"),
            F.max("frame_idx").alias("hi"),
            F.max("score").alias("peak"),
            F.min_by("frame_idx", F.struct(-F.col("score"), "frame_idx")).alias("peak_idx"),
        )
        .drop("chunk", "island")
    )
    runs = _join_runs(runs, keys, chunk_frames, chunk_frames * fanout)
    return _join_runs(runs, keys, chunk_frames * fanout, None)


def peak_hold(scores: DataFrame, keys: list[str], chunk_frames: int = CHUNK_FRAMES) -> DataFrame:
    """Add ``held``: r = max(decay * r, score), the level a meter shows.

    That is the largest score * decay ** age. A frame stops counting once the
    power underflows, so a chunk needs only a short tail of the one before it.
    """
    assert chunk_frames > METER_HALO
    chunk = F.floor(F.col("frame_idx") / chunk_frames)
    in_tail = F.pmod("frame_idx", F.lit(chunk_frames)) >= chunk_frames - METER_HALO
    homes = F.when(in_tail, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    decay = F.log(F.lit(METER_DECAY))
    age = F.pmod("frame_idx", F.lit(chunk_frames)) + F.when(
        F.col("home") > chunk, -chunk_frames
    ).otherwise(0)
    past = (
        Window.partitionBy(*keys, "home").orderBy("frame_idx")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    level = F.max(F.log("score") - F.col("_age") * decay).over(past)
    return (
        scores.withColumn("home", F.explode(homes))
        .withColumn("_age", age)
        .withColumn("held", F.coalesce(F.exp(level + F.col("_age") * decay), F.lit(0.0)))
        .where(F.col("home") == chunk)
        .drop("home", "_age")
    )


# --- chunk tables ----------------------------------------------------------


def _chunk_tables(chunks, keys, thresholds, grouping, strict, chunk_frames) -> DataFrame:
    """One row per (keys, chunk, threshold) with ``table``, ``start`` and ``frames``.

    ``table`` has one entry when no hit is among the frames that can be blocked on
    entry; otherwise it has one for each number of blocked frames. Chunks come in
    as Arrow batches, cut so that ``HITS_PER_BLOCK`` hits are worked on at a time.
    """
    sized = chunks.select(
        *keys, "chunk", grouping.cast("long").alias("g"),
        F.transform("hits", lambda h: h["frame_idx"] - F.col("chunk") * chunk_frames).alias("local"),
        F.transform("hits", lambda h: h["score"].cast("double")).alias("score"),
        thresholds.cast("array<double>").alias("_thresholds"),
    )
    entry = StructType([StructField("n", LongType()), StructField("until", LongType())])
    schema = StructType([
        *[sized.schema[k] for k in keys], StructField("threshold", DoubleType()),
        StructField("chunk", LongType()), StructField("start", LongType()),
        StructField("frames", LongType()), StructField("table", ArrayType(entry)),
    ])

    def reduce(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lengths = np.diff(batch.column("local").offsets.to_numpy())
            block = np.cumsum(lengths) // HITS_PER_BLOCK
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
            for start, stop in zip(edges, edges[1:]):
                part = batch.slice(start, stop - start)
                yield from _reduce_block(part, keys, strict, chunk_frames, np, pa)

    return sized.mapInArrow(reduce, schema)


def _reduce_block(batch, keys, strict, chunk_frames, np, pa):
    """Result batches for one block of chunks, one per position in the threshold arrays."""
    flat = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False)
    lengths = lambda name: np.diff(batch.column(name).offsets.to_numpy())
    owner = np.repeat(np.arange(batch.num_rows), lengths("local"))
    local, score = flat("local"), flat("score")
    chunk = batch.column("chunk").to_numpy(zero_copy_only=False)
    gap = batch.column("g").to_numpy(zero_copy_only=False)
    limits, sizes = flat("_thresholds"), lengths("_thresholds")
    first_limit = np.cumsum(sizes) - sizes
    for k in range(int(sizes.max()) if len(sizes) else 0):
        has = sizes > k
        limit = np.full(batch.num_rows, np.inf)
        limit[has] = limits[first_limit[has] + k]
        passing = score > limit[owner] if strict else score >= limit[owner]
        rows, seen, entries, events, until = refractory.entry_tables(
            local, owner, passing, chunk, gap, chunk_frames
        )
        if not len(rows):
            continue
        begin = chunk[rows] * chunk_frames
        table = pa.ListArray.from_arrays(
            pa.array(np.append(0, np.cumsum(entries)), pa.int32()),
            pa.StructArray.from_arrays(
                [pa.array(events, pa.int64()), pa.array(until + np.repeat(begin, entries), pa.int64())],
                names=["n", "until"]),
        )
        picked = pa.array(rows)
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(key).take(picked) for key in keys], pa.array(limit[rows]),
             pa.array(chunk[rows], pa.int64()), pa.array(begin, pa.int64()),
             pa.array(seen, pa.int64()), table],
            names=[*keys, "threshold", "chunk", "start", "frames", "table"],
        )


def _children(order: str = "super") -> Column:
    child = F.struct(F.col(order).alias("id"), F.col("start"), F.col("table"))
    return F.array_sort(F.collect_list(child)).alias("children")


def _enter(child: Column, until: Column) -> Column:
    """The row of a child's table for a state, blocked before frame ``until``."""
    blocked = F.greatest(until - child["start"], F.lit(0).cast("long"))
    return F.get(child["table"], F.least(blocked, F.size(child["table"]) - 1).cast("int"))


def _fold(children: Column, until: Column) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("n"), until.alias("until"))

    def step(state, child):
        row = _enter(child, state["until"])
        return F.struct((state["n"] + row["n"]).alias("n"), row["until"].alias("until"))

    return F.aggregate(children, start, step)


def _entries(children: Column, until: Column, n: Column) -> Column:
    """Array of (id, until, n): the state in which each child is entered, and the events before."""
    zero = F.lit(0).cast("long")
    one = F.struct(zero.alias("id"), zero.alias("until"), zero.alias("n"))
    nothing = F.filter(F.array(one), lambda _: F.lit(False))
    start = F.struct(until.cast("long").alias("until"), n.cast("long").alias("n"), nothing.alias("seen"))

    def step(state, child):
        entry = F.struct(child["id"].alias("id"), state["until"].alias("until"), state["n"].alias("n"))
        row = _enter(child, state["until"])
        return F.struct(
            row["until"].alias("until"), (state["n"] + row["n"]).alias("n"),
            F.concat(state["seen"], F.array(entry)).alias("seen"),
        )

    return F.aggregate(children, start, step, lambda state: state["seen"])


def _compose_level(tables, keys, chunk_frames, fanout) -> DataFrame:
    """Fold the chunk tables of each super-chunk into one table of the same form."""
    grouped = (
        tables.withColumn("super", F.floor(F.col("chunk") / fanout))
        .groupBy(*keys, "super")
        .agg(_children("chunk"), F.sum("frames").alias("frames"))
        .withColumn("start", F.col("super") * (chunk_frames * fanout))
    )
    first = F.col("children")[0]
    feels_past = first["start"] == F.col("start")
    entries = F.sequence(
        F.lit(0).cast("long"),
        F.when(feels_past, (F.size(first["table"]) - 1).cast("long")).otherwise(0),
    )
    table = F.transform(entries, lambda b: _fold(F.col("children"), F.col("start") + b))
    return grouped.select(*keys, "super", "start", "frames", table.alias("table"))


def _join_runs(runs: DataFrame, keys: list[str], width: int, within: int | None) -> DataFrame:
    """Join runs that continue across multiples of ``width`` frames.

    With ``within``, only runs that do not touch a multiple of ``within`` are
    joined for good; the next level sees to the rest.
    """
    edge = (F.pmod("lo", F.lit(width)) == 0) | (F.pmod(F.col("hi") + 1, F.lit(width)) == 0)
    part = [*keys, "_home"]
    home = F.floor(F.col("lo") / within) if within else F.lit(0).cast("long")
    order = Window.partitionBy(*part).orderBy("lo")
    broken = F.coalesce(F.col("lo") != F.lag("hi").over(order) + 1, F.lit(True))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    joined = (
        runs.where(edge)
        .withColumn("_home", home)
        .withColumn("_new", broken.cast("int"))
        .withColumn("_run", F.sum("_new").over(upto))
        .groupBy(*part, "_run")
        .agg(
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.max("peak").alias("peak"),
            F.min_by("peak_idx", F.struct(-F.col("peak"), "peak_idx")).alias("peak_idx"),
        )
        .drop("_home", "_run")
    )
    return runs.where(~edge).unionByName(joined)
