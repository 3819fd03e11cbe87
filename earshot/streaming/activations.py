"""Activation counting on live score streams, with the rule the batch metrics use.

A stream fires on a frame that scores at least the threshold and is no longer blocked;
it then stays blocked for ``grouping`` further frames. ``session_window`` would be wrong
here: a hit extends a session, but it does not extend a refractory period.

State has two levels. The frames of a trigger are reduced to chunk tables (see
``operators.events``), and only those tables meet the state of a stream, six numbers. So
one stream may bring nearly all frames of a trigger: they are spread over tasks by chunk.
The state table is written whole by every trigger, under the trigger's number, and read
by the next; older ones are deleted. A trigger that runs again starts from the same state
and overwrites its own rows, so nothing counts twice.

Frames at or below the last one counted are dropped and counted as ``late``. With some
``patience``, frames wait until the newest frame is so many seconds ahead of them, and
those that come in another order meanwhile are counted in their place. Frames that come
more than once in a trigger are one, with the highest score and the earliest time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.constants import METER_DECAY
from earshot.operators import events
from earshot.session import broadcast_if_small, pin

FRAME_SCHEMA = "stream_id long, frame_idx long, ts timestamp, score double"
STATE_SCHEMA = (
    "stream_id long, activations long, blocked_until long, last_frame long, frames long, recent double, late long"
)
KEYS = ["stream_id"]


def read_frames(spark: SparkSession, folder: str, schema: str = FRAME_SCHEMA, max_files: int | None = None) -> DataFrame:
    """A stream of frames from Parquet files as they land; ``max_files`` bounds a trigger."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def advance(frames: DataFrame, state: DataFrame, threshold: float, grouping: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the frames that fire (with the running count), and the state after them."""
    known = state.select("stream_id", F.col("last_frame").alias("_last"), F.col("blocked_until").alias("_until"))
    seen = frames.join(broadcast_if_small(known), "stream_id", "left")
    is_late = F.coalesce(F.col("frame_idx") <= F.col("_last"), F.lit(False))
    late = seen.where(is_late).groupBy("stream_id").agg(F.count(F.lit(1)).alias("_late"))
    fresh = pin(
        seen.where(~is_late).groupBy("stream_id", "frame_idx").agg(
            F.max("score").alias("score"), F.min("ts").alias("ts"), F.coalesce(F.max("_until"), F.lit(0)).alias("_until")
        )
    )
    # Hits that are still blocked neither fire nor block, so the rest starts free.
    chunks = pin(events.chunk_hits(fresh.where(F.col("frame_idx") >= F.col("_until")), KEYS, threshold))
    counted = state.select("stream_id", F.col("activations").alias("n"))
    entries = events.chunk_entries(chunks, KEYS, threshold, grouping, before=counted)
    numbered = F.posexplode(events.fired("hits", F.col("until"), grouping)).alias("_at", "hit")
    found = (
        chunks.join(entries, [*KEYS, "chunk"]).select("stream_id", "n", numbered)
        .select("stream_id", "hit.frame_idx", "hit.score", (F.col("n") + F.col("_at") + 1).alias("activations"))
    )
    times = fresh.where(F.col("score") >= threshold).select("stream_id", "frame_idx", "ts")
    found = pin(found.join(times, ["stream_id", "frame_idx"]))

    tallies = fresh.groupBy("stream_id").agg(F.count(F.lit(1)).alias("_frames"), F.max("frame_idx").alias("_end"))
    age = F.col("_end") - F.col("frame_idx")
    levels = (
        fresh.join(broadcast_if_small(tallies), "stream_id").where(age <= events.METER_HALO)
        .groupBy("stream_id").agg(F.max(F.col("score") * F.pow(F.lit(METER_DECAY), age)).alias("_level"))
    )
    fired = found.groupBy("stream_id").agg(F.max("activations").alias("_count"), F.max("frame_idx").alias("_fired"))
    met = tallies.join(levels, "stream_id", "left").join(fired, "stream_id", "left")
    zero = F.lit(0).cast("long")
    last = F.coalesce("_end", "last_frame", F.lit(-1).cast("long"))
    faded = F.coalesce(F.col("recent") * F.pow(F.lit(METER_DECAY), last - F.col("last_frame")), F.lit(0.0))
    after = state.join(met, "stream_id", "full").join(late, "stream_id", "full").select(
        "stream_id", F.coalesce("_count", "activations", zero).alias("activations"),
        F.coalesce(F.col("_fired") + grouping + 1, "blocked_until", zero).alias("blocked_until"),
        last.alias("last_frame"), (F.coalesce("frames", zero) + F.coalesce("_frames", zero)).alias("frames"),
        F.greatest(faded, F.coalesce("_level", F.lit(0.0))).alias("recent"),
        (F.coalesce("late", zero) + F.coalesce("_late", zero)).alias("late"),
    )
    return found.select("stream_id", "frame_idx", "ts", "score", "activations"), after


def count_to(
    stream: DataFrame, folder: str, threshold: float, grouping: int, patience: float = 0.0
):
    """Start a run over what has landed.

    Below ``folder`` are ``events/batch_id=`` (what fired), ``state/batch_id=`` (the newest
    state of every stream), ``waiting/batch_id=`` (frames held back) and the checkpoint.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        frames, waiting = batch, newest(spark, f"{folder}/waiting", batch_id)
        if patience:
            if waiting is not None:
                frames = frames.unionByName(waiting)
            frames = pin(frames)
            mark = frames.agg(F.max("ts").alias("newest")).select(F.col("newest") - F.make_dt_interval(secs=F.lit(patience)))
            ready = F.col("ts") <= mark.scalar()
            frames.where(~ready).write.mode("overwrite").parquet(f"{folder}/waiting/batch_id={batch_id}")
            frames = frames.where(ready)
        state = newest(spark, f"{folder}/state", batch_id)
        state = spark.createDataFrame([], STATE_SCHEMA) if state is None else state
        found, after = advance(frames, state, threshold, grouping)
        found.write.mode("overwrite").parquet(f"{folder}/events/batch_id={batch_id}")
        after.write.mode("overwrite").parquet(f"{folder}/state/batch_id={batch_id}")
        for table in ("state", "waiting"):
            _forget(spark, f"{folder}/{table}", batch_id - 1)

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start()
    )


def _batches(spark: SparkSession, table: str) -> dict[int, str]:
    """The folders of whole batches of a table, by number."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return {}
    found = [s.getPath() for s in files.listStatus(path)]
    whole = [p for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return {int(p.getName().split("=")[1]): p.toString() for p in whole}


def newest(spark: SparkSession, table: str, before: int | None = None) -> DataFrame | None:
    """The newest whole batch of a table (older than ``before``), if there is one."""
    batches = _batches(spark, table)
    numbers = [n for n in batches if before is None or n < before]
    return spark.read.parquet(batches[max(numbers)]) if numbers else None


def _forget(spark: SparkSession, table: str, before: int) -> None:
    for number, folder in _batches(spark, table).items():
        if number < before:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fired(spark: SparkSession, folder: str) -> DataFrame:
    """All activations so far."""
    return spark.read.parquet(f"{folder}/events").drop("batch_id")


def rates(spark: SparkSession, folder: str, step_seconds: float) -> DataFrame:
    """Running counts, time, activations per hour, meter level and late frames of each stream."""
    hours = (F.col("last_frame") + 1) * step_seconds / 3600
    return newest(spark, f"{folder}/state").select(
        "stream_id", "activations", "frames", hours.alias("hours"),
        F.when(hours > 0, F.col("activations") / hours).otherwise(0.0).alias("per_hour"), "recent", "late",
    )
