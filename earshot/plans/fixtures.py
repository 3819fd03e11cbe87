"""Detection inputs derived from the given tables, with the same steps in SQL.

``events`` is read as score streams: one stream per user, frames in time order.
Purchases stand for positives, everything else for the false-accept sets. Four
candidate scorers give different score distributions over the same frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.constants import CONDITIONS
from earshot.operators.positions import row_positions
from earshot.plans.registry import table

STEP_SECONDS = 600.0
GROUPING = 3
CANDIDATES = ["baseline", "best_single", "final", "merged"]
SETS = ["holdout", "open"]

FRAMES_SQL = """
frames AS (
  SELECT user_id AS stream_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
         event_id, event_type, ts, value,
         CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k,
         value / (value + 35.0) AS score
  FROM events)"""

CANDIDATES_SQL = FRAMES_SQL + """,
scored AS (
  SELECT stream_id, frame_idx, event_id, event_type, c.candidate,
         CASE c.candidate
           WHEN 'final' THEN value / (value + 35.0)
           WHEN 'merged' THEN (value + k) / (value + k + 70.0)
           WHEN 'best_single' THEN value / (value + k + 1.0)
           ELSE k / (k + 50.0) END AS score
  FROM frames CROSS JOIN (VALUES ('final'), ('merged'), ('best_single'), ('baseline')) c(candidate)),
fa AS (
  SELECT 'open' AS set_name, candidate, stream_id, frame_idx, score
  FROM scored WHERE event_type <> 'purchase'
  UNION ALL
  SELECT 'holdout', candidate, stream_id, frame_idx, score
  FROM scored WHERE event_type IN ('error', 'click')),
eval_sets AS (
  SELECT set_name, count(*) * 600.0 / 3600 AS hours, 3 AS grouping
  FROM fa WHERE candidate = 'final' GROUP BY set_name),
positives AS (
  SELECT candidate, event_id AS clip_id, score FROM scored WHERE event_type = 'purchase'),
conditions AS (
  SELECT candidate, event_id AS clip_id, condition, score * keep AS score
  FROM scored CROSS JOIN (VALUES ('clean', 1.0), ('env', 0.9), ('music', 0.8),
                          ('speech', 0.7), ('babble', 0.6)) d(condition, keep)
  WHERE event_type = 'purchase')"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, frame_idx, event_id, event_type, ts, value, k, score)."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream_id"), "event_id", "event_type", "ts", "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        (F.col("value") / (F.col("value") + 35.0)).alias("score"),
    )
    return row_positions(events, ["stream_id"], ["ts", "event_id"], "frame_idx")


def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(candidate, stream_id, frame_idx, event_id, event_type, score)."""
    value, k = F.col("value"), F.col("k")
    scores = {
        "final": value / (value + 35.0),
        "merged": (value + k) / (value + k + 70.0),
        "best_single": value / (value + k + 1.0),
        "baseline": k / (k + 50.0),
    }
    fan = F.array(*[
        F.struct(F.lit(name).alias("candidate"), score.alias("score"))
        for name, score in scores.items()
    ])
    return frames(spark, sf_dir).select(
        "stream_id", "frame_idx", "event_id", "event_type", F.inline(fan)
    )


def false_accepts(scores: DataFrame) -> DataFrame:
    """(set_name, candidate, stream_id, frame_idx, score) from candidate scores."""
    sets = F.when(
        F.col("event_type").isin("error", "click"), F.array(F.lit("open"), F.lit("holdout"))
    ).otherwise(F.array(F.lit("open")))
    return scores.where("event_type <> 'purchase'").select(
        F.explode(sets).alias("set_name"), "candidate", "stream_id", "frame_idx", "score"
    )


def evaluation_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(set_name, hours, grouping), one row per false-accept set."""
    kinds = table(spark, sf_dir, "events").where("event_type <> 'purchase'")
    counts = kinds.agg(
        F.count(F.lit(1)).alias("open"),
        F.count_if(F.col("event_type").isin("error", "click")).alias("holdout"),
    )
    rows = F.array(*[
        F.struct(F.lit(name).alias("set_name"),
                 (F.col(name) * STEP_SECONDS / 3600).alias("hours"),
                 F.lit(GROUPING).alias("grouping"))
        for name in SETS
    ])
    return counts.select(F.inline(rows))


def positives(scores: DataFrame) -> DataFrame:
    """(candidate, clip_id, score)."""
    return scores.where("event_type = 'purchase'").select(
        "candidate", F.col("event_id").alias("clip_id"), "score"
    )


def conditions(scores: DataFrame) -> DataFrame:
    """(candidate, clip_id, condition, score): the same clips under each condition."""
    keep = dict(zip(CONDITIONS, [1.0, 0.9, 0.8, 0.7, 0.6]))
    fan: Column = F.array(*[
        F.struct(F.lit(c).alias("condition"), (F.col("score") * keep[c]).alias("score"))
        for c in CONDITIONS
    ])
    return positives(scores).select("candidate", "clip_id", F.inline(fan))
