"""Live streams: frames land in blocks, each run picks up where the last one stopped."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.functions import udtf
from earshot.operators import events, positions, scoring
from earshot.plans import evaluation
from earshot.plans import fixtures as fx
from earshot.plans.registry import query, table
from earshot.sources import publish
from earshot.streaming import activations as live

HIT = evaluation.HIT
WEIGHTS = [((i * 37) % 11 - 5) / 4 for i in range(64)]
WEIGHTS_SQL = "[" + ", ".join(f"{w}::DOUBLE" for w in WEIGHTS) + "]"
LINEAR_SQL = f"""1 / (1 + exp(-(list_sum(list_transform(list_zip(embedding::DOUBLE[], {WEIGHTS_SQL}),
  lambda p: p[1] * p[2])) + 0.1)))"""


def land_in_blocks(frames, folder: str, cut: str):
    """Yield after each block of frames has landed: those before ``cut``, then the rest."""
    for block in (F.col("ts") < cut, F.col("ts") >= cut):
        frames.where(block).write.mode("append").parquet(folder)
        yield


def score_frames(spark, sf_dir):
    return fx.frames(spark, sf_dir).select(
        "stream_id", "frame_idx", F.col("ts").cast("timestamp").alias("ts"), "score"
    )


def middle(frames) -> str:
    span = frames.agg(
        F.timestamp_micros(F.floor((F.unix_micros(F.min("ts")) + F.unix_micros(F.max("ts"))) / 2))
        .cast("string")
    )
    return span.first()[0]


def run_live(spark, frames, name, threshold, schema=live.FRAME_SCHEMA, scored=lambda stream: stream):
    """Run once for each block that lands; the folder of what was counted."""
    folder = publish.shared_folder(spark, name)
    for _ in land_in_blocks(frames, f"{folder}/landing", middle(frames)):
        stream = scored(live.read_frames(spark, f"{folder}/landing", schema))
        live.count_to(stream, folder, threshold, fx.GROUPING).awaitTermination()
    return folder


@query("str1_live_activations", evaluation.FRAME_EVENTS_SQL + """
SELECT stream_id, frame_idx, score, row_number() OVER (PARTITION BY stream_id ORDER BY frame_idx) AS activations
FROM ev JOIN hits USING (stream_id, frame_idx)""")
def live_activations(spark, sf_dir):
    folder = run_live(spark, score_frames(spark, sf_dir), "activations", HIT)
    return live.fired(spark, folder).select("stream_id", "frame_idx", "score", "activations")


@query("str2_live_scoring", f"""WITH RECURSIVE
scored AS (
  SELECT label AS stream_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx,
         {LINEAR_SQL} AS score FROM embeddings),
hits AS (SELECT stream_id, frame_idx, score FROM scored WHERE score >= 0.55),
""" + evaluation.events_cte("ev", "hits", "stream_id") + """
SELECT CAST(stream_id AS BIGINT) AS stream_id, frame_idx, round(score, 6) AS score
FROM ev JOIN hits USING (stream_id, frame_idx)""")
def live_scoring(spark, sf_dir):
    frames = positions.row_positions(
        table(spark, sf_dir, "embeddings").select(
            F.col("label").cast("long").alias("stream_id"), "vec_id", F.col("embedding").alias("x")),
        ["stream_id"], ["vec_id"], "frame_idx",
    ).select("stream_id", "frame_idx", "x", F.timestamp_seconds(F.col("frame_idx")).alias("ts"))
    schema = "stream_id long, frame_idx long, x array<float>, ts timestamp"
    score = lambda stream: scoring.score_windows(stream, "x", scoring.LinearScorer(WEIGHTS, 0.1)).drop("x")
    folder = run_live(spark, frames, "scoring", 0.55, schema, score)
    return live.fired(spark, folder).select("stream_id", "frame_idx", F.round("score", 6).alias("score"))


@query("str3_live_rates", evaluation.FRAME_EVENTS_SQL + """
SELECT stream_id, coalesce(n, 0) AS activations, frames, round(frames * 600 / 3600, 6) AS hours,
       round(coalesce(n, 0) / (frames * 600 / 3600), 6) AS per_hour, CAST(0 AS BIGINT) AS late
FROM (SELECT stream_id, count(*) AS frames FROM frames GROUP BY 1)
LEFT JOIN (SELECT stream_id, count(*) AS n FROM ev GROUP BY 1) USING (stream_id)""")
def live_rates(spark, sf_dir):
    folder = run_live(spark, score_frames(spark, sf_dir), "rates", HIT)
    return live.rates(spark, folder, fx.STEP_SECONDS).select(
        "stream_id", "activations", "frames", F.round("hours", 6).alias("hours"),
        F.round("per_hour", 6).alias("per_hour"), "late",
    )


@query("udtf_refractory_events", evaluation.FRAME_EVENTS_SQL + "SELECT stream_id, frame_idx FROM ev")
def udtf_events(spark, sf_dir):
    """The table function on arrays of one chunk each, entered as the chunk before left off."""
    udtf.register(spark)
    frames, keys, width = fx.frames(spark, sf_dir), ["stream_id"], 32
    chunks = events.chunk_hits(frames, keys, HIT, width)
    entries = events.chunk_entries(chunks, keys, HIT, fx.GROUPING, width)
    chunks.join(entries, [*keys, "chunk"]).select(
        "stream_id", F.transform("hits", lambda h: h["frame_idx"]).alias("marks"), "until"
    ).createOrReplaceTempView("stream_marks")
    return spark.sql(
        "SELECT stream_id, e.frame_idx FROM stream_marks, "
        f"LATERAL refractory_events(marks, {fx.GROUPING}, until) e"
    )
