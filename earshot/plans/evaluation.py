"""Event counting, curves, budgets and exact operating points."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.constants import COMPARE_AT, FA_BUDGETS, THRESHOLDS
from earshot.functions import scalars
from earshot.operators import events, roc
from earshot.plans import fixtures as fx
from earshot.plans.registry import query

HIT = 0.6
GATE = 0.5
GRID_SQL = "(VALUES " + ", ".join(f"({t}::DOUBLE)" for t in THRESHOLDS) + ") g(threshold)"
BUDGET_SQL = "(VALUES " + ", ".join(f"({b}::DOUBLE)" for b in FA_BUDGETS) + ") b(budget)"


def events_cte(name: str, hits: str, keys: str, grouping: int = fx.GROUPING) -> str:
    """One row (keys, frame_idx) per event, found one event at a time."""
    from_state = ", ".join(f"e.{k.strip()}" for k in keys.split(","))
    return f"""{name} AS (
  SELECT {keys}, min(frame_idx) AS frame_idx FROM {hits} GROUP BY {keys}
  UNION ALL
  SELECT {from_state}, min(h.frame_idx) FROM {name} e JOIN {hits} h USING ({keys})
  WHERE h.frame_idx > e.frame_idx + {grouping} GROUP BY {from_state}, e.frame_idx)"""


FRAME_EVENTS_SQL = (
    "WITH RECURSIVE" + fx.FRAMES_SQL
    + f", hits AS (SELECT stream_id, frame_idx, score FROM frames WHERE score >= {HIT}), "
    + events_cte("ev", "hits", "stream_id")
)

CURVE_KEYS = "set_name, candidate, stream_id, threshold"
CURVE_SQL = (
    "WITH RECURSIVE" + fx.CANDIDATES_SQL + f""",
hits AS MATERIALIZED (
  SELECT set_name, candidate, stream_id, threshold, frame_idx
  FROM fa JOIN {GRID_SQL} ON score >= threshold),
""" + events_cte("ev", "hits", CURVE_KEYS) + f""",
ne AS (SELECT set_name, candidate, threshold, count(*) AS events FROM ev GROUP BY ALL),
nf AS (SELECT set_name, candidate, threshold, count(*) AS frames FROM hits GROUP BY ALL),
rc AS (SELECT candidate, threshold,
              avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END) AS recall
       FROM positives CROSS JOIN {GRID_SQL} GROUP BY ALL),
curve AS MATERIALIZED (
  SELECT set_name, candidate, threshold, recall,
         round(coalesce(events, 0) / hours, 4) AS false_accepts_per_hour,
         round(coalesce(frames, 0) / hours, 4) AS frames_above_per_hour,
         coalesce(events, 0) AS events, coalesce(frames, 0) AS frames,
         CAST(hours AS DOUBLE) AS hours
  FROM rc CROSS JOIN eval_sets
  LEFT JOIN ne USING (set_name, candidate, threshold)
  LEFT JOIN nf USING (set_name, candidate, threshold))
"""
)


def bisect_sql(rounds: int | None) -> str:
    """CTEs from ``ranked`` to the last ranks; without ``rounds``, until none is left between.

    The fold keeps count * 10^12 + first unblocked frame in one number.
    """
    if rounds is None:
        return f"""
bisected AS (
  SELECT set_name, candidate, budget, budget * hours AS allowed,
         CAST(-1 AS BIGINT) AS lo, max(idx) AS hi
  FROM ranked JOIN eval_sets USING (set_name) CROSS JOIN {BUDGET_SQL}
  GROUP BY set_name, candidate, budget, hours
  UNION ALL
  SELECT set_name, candidate, budget, allowed,
         CASE WHEN n <= allowed THEN lo ELSE mid END, CASE WHEN n <= allowed THEN mid ELSE hi END
  FROM (
    SELECT set_name, candidate, budget, allowed, lo, hi, mid, sum(list_reduce(
             [CAST(0 AS BIGINT)] || list_transform(
               list_filter(marks, lambda m: m.score > t.threshold), lambda m: m.frame_idx),
             lambda acc, f: CASE WHEN f >= acc % 1000000000000
               THEN (acc // 1000000000000 + 1) * 1000000000000 + f + {fx.GROUPING + 1}
               ELSE acc END) // 1000000000000) AS n
    FROM (SELECT *, (lo + hi) // 2 AS mid FROM bisected WHERE hi - lo > 1) m
    JOIN ranked t USING (set_name, candidate) JOIN streams USING (set_name, candidate)
    WHERE t.idx = mid GROUP BY ALL))"""
    steps = []
    for r in range(1, rounds + 1):
        steps.append(f"""
m{r} AS MATERIALIZED (SELECT *, (lo + hi) // 2 AS mid FROM b{r - 1}),
c{r} AS MATERIALIZED (
  SELECT set_name, candidate, budget, sum(list_reduce(
           [CAST(0 AS BIGINT)] || list_transform(
             list_filter(marks, lambda m: m.score > t.threshold), lambda m: m.frame_idx),
           lambda acc, f: CASE WHEN f >= acc % 1000000000000
             THEN (acc // 1000000000000 + 1) * 1000000000000 + f + {fx.GROUPING + 1}
             ELSE acc END) // 1000000000000) AS n
  FROM m{r} JOIN ranked t USING (set_name, candidate) JOIN streams USING (set_name, candidate)
  WHERE t.idx = mid AND hi - lo > 1 GROUP BY ALL),
b{r} AS MATERIALIZED (
  SELECT set_name, candidate, budget, allowed,
         CASE WHEN hi - lo <= 1 OR coalesce(n, 0) <= allowed THEN lo ELSE mid END AS lo,
         CASE WHEN hi - lo > 1 AND coalesce(n, 0) <= allowed THEN mid ELSE hi END AS hi
  FROM m{r} LEFT JOIN c{r} USING (set_name, candidate, budget))""")
    return f"""
b0 AS MATERIALIZED (
  SELECT set_name, candidate, budget, budget * hours AS allowed,
         CAST(-1 AS BIGINT) AS lo, max(idx) AS hi
  FROM ranked JOIN eval_sets USING (set_name) CROSS JOIN {BUDGET_SQL}
  GROUP BY set_name, candidate, budget, hours),""" + ",".join(steps)


def exact_sql(rounds: int | None = 18, inputs: str = fx.CANDIDATES_SQL) -> str:
    """Bisect the ranked thresholds of every set, candidate and budget."""
    last = "bisected" if rounds is None else f"b{rounds}"
    found = "hi - lo <= 1 AND idx = hi" if rounds is None else "idx = hi"
    return (
        "WITH RECURSIVE" + inputs + f""",
streams AS MATERIALIZED (
  SELECT set_name, candidate, stream_id,
         list({{'frame_idx': frame_idx, 'score': score}} ORDER BY frame_idx) AS marks
  FROM fa GROUP BY ALL),
ranked AS MATERIALIZED (
  SELECT set_name, candidate, threshold,
         row_number() OVER (PARTITION BY set_name, candidate ORDER BY threshold) - 1 AS idx
  FROM (SELECT DISTINCT set_name, candidate, score AS threshold FROM fa
        UNION ALL SELECT DISTINCT set_name, candidate, -1.0 FROM fa)),""" + bisect_sql(rounds) + f""",
thresholds AS MATERIALIZED (
  SELECT set_name, candidate, budget, threshold
  FROM {last} JOIN ranked USING (set_name, candidate) WHERE {found}),
exact AS MATERIALIZED (
  SELECT set_name, candidate, budget, threshold,
         avg(CASE WHEN score > threshold THEN 1.0 ELSE 0.0 END) AS recall
  FROM thresholds JOIN positives USING (candidate)
  GROUP BY set_name, candidate, budget, threshold),
cond AS MATERIALIZED (
  SELECT set_name, candidate, budget, condition,
         avg(CASE WHEN score > threshold THEN 1.0 ELSE 0.0 END) AS recall
  FROM thresholds JOIN conditions USING (candidate) GROUP BY ALL)
"""
    )


EXACT_SQL = exact_sql()
#: The same for any number of scores; 18 rounds reach no more than 2 ** 18 of them.
ANY_SIZE_SQL = exact_sql(None)


def transfer_sql(splits: int) -> str:
    """Choose thresholds on half 0 of each split, count events on half 1."""
    seeds = ", ".join(f"({i})" for i in range(splits))
    half = "CAST('0x' || substr(sha256(seed || '|' || stream_id), 1, 12) AS BIGINT) % 2"
    inputs = (
        fx.CANDIDATES_SQL.replace("fa AS (", "whole AS (").replace(
            "eval_sets AS (", "whole_sets AS (").replace("FROM fa WHERE", "FROM whole WHERE")
        + f""",
dealt AS MATERIALIZED (
  SELECT set_name || '/' || seed AS set_name, set_name AS base, candidate, stream_id, frame_idx,
         score, {half} AS half FROM whole CROSS JOIN (VALUES {seeds}) s(seed)),
eval_sets AS MATERIALIZED (
  SELECT d.set_name, hours * n AS hours, hours * (1 - n) AS rest_hours
  FROM (SELECT set_name, base, count(*) FILTER (half = 0) / count(*) AS n FROM dealt
        WHERE candidate = 'final' GROUP BY ALL) d JOIN whole_sets w ON w.set_name = d.base),
fa AS MATERIALIZED (SELECT set_name, candidate, stream_id, frame_idx, score FROM dealt WHERE half = 0)"""
    )
    return exact_sql(None, inputs) + f""",
rest AS MATERIALIZED (
  SELECT set_name, candidate, budget, stream_id, frame_idx
  FROM dealt JOIN thresholds USING (set_name, candidate) WHERE half = 1 AND score > threshold),
{events_cte("rest_ev", "rest", "set_name, candidate, budget, stream_id")}
SELECT set_name, candidate, budget, threshold, recall, coalesce(n, 0) AS events,
       round(coalesce(n, 0) / rest_hours, 4) AS rate
FROM exact LEFT JOIN (SELECT set_name, candidate, budget, count(*) AS n FROM rest_ev GROUP BY ALL)
  USING (set_name, candidate, budget) JOIN eval_sets USING (set_name)"""


PROFILE_SQL = CURVE_SQL + f""",
profile AS (
  SELECT set_name, candidate, budget,
         max(CASE WHEN false_accepts_per_hour <= budget THEN recall END) AS recall
  FROM curve CROSS JOIN {BUDGET_SQL} GROUP BY ALL)
"""


def scores_and_sets(spark, sf_dir):
    scores = fx.candidate_scores(spark, sf_dir)
    return scores, fx.false_accepts(scores), fx.evaluation_sets(spark, sf_dir)


def curve_rows(spark, sf_dir):
    scores, fa, sets = scores_and_sets(spark, sf_dir)
    return roc.curve(fa, fx.positives(scores), sets)


def exact_rows(spark, sf_dir):
    scores, fa, sets = scores_and_sets(spark, sf_dir)
    return roc.exact_profile(fa, fx.positives(scores), sets)


@query("evt1_refractory_count", FRAME_EVENTS_SQL + """
SELECT stream_id, events, frames
FROM (SELECT stream_id, count(*) AS events FROM ev GROUP BY 1)
JOIN (SELECT stream_id, count(*) AS frames FROM hits GROUP BY 1) USING (stream_id)""")
def refractory_count(spark, sf_dir):
    chunks = events.chunk_hits(fx.frames(spark, sf_dir), ["stream_id"], HIT)
    return events.refractory_counts(
        chunks, ["stream_id"], roc.grid([HIT]), F.lit(fx.GROUPING)
    ).drop("threshold")


@query("evt2_event_rows", FRAME_EVENTS_SQL + """
SELECT stream_id, frame_idx, score, round(frame_idx * 1280 / 16000, 4) AS seconds
FROM ev JOIN hits USING (stream_id, frame_idx)""")
def event_rows(spark, sf_dir):
    rows = events.refractory_events(fx.frames(spark, sf_dir), ["stream_id"], HIT, fx.GROUPING)
    return rows.withColumn("seconds", F.round(scalars.frame_seconds("frame_idx"), 4))


@query("evt3_frames_above", "WITH" + fx.FRAMES_SQL + f"""
SELECT stream_id, threshold, count(*) FILTER (score >= threshold) AS frames
FROM frames CROSS JOIN {GRID_SQL} GROUP BY ALL""")
def frames_above(spark, sf_dir):
    return events.frames_above(fx.frames(spark, sf_dir), ["stream_id"], THRESHOLDS)


@query("evt4_false_accept_rate", FRAME_EVENTS_SQL + """
SELECT stream_id, coalesce(events, 0) AS events, n * 600.0 / 3600 AS hours,
       round(coalesce(events, 0) / (n * 600.0 / 3600), 4) AS false_accepts_per_hour
FROM (SELECT stream_id, count(*) AS n FROM frames GROUP BY 1)
LEFT JOIN (SELECT stream_id, count(*) AS events FROM ev GROUP BY 1) USING (stream_id)""")
def false_accept_rate(spark, sf_dir):
    frames = fx.frames(spark, sf_dir)
    hours = frames.groupBy("stream_id").agg(
        scalars.hours(F.count(F.lit(1)), F.lit(fx.STEP_SECONDS)).alias("hours")
    )
    chunks = events.chunk_hits(frames, ["stream_id"], HIT)
    counts = events.refractory_counts(
        chunks, ["stream_id"], roc.grid([HIT]), F.lit(fx.GROUPING)
    )
    return (
        hours.join(counts, "stream_id", "left").na.fill(0, ["events"])
        .select("stream_id", "events", "hours",
                events.false_accept_rate(F.col("events"), F.col("hours"))
                .alias("false_accepts_per_hour"))
    )


@query("win6_score_runs", "WITH" + fx.FRAMES_SQL + f""",
marked AS (
  SELECT stream_id, frame_idx, score,
         frame_idx - row_number() OVER (PARTITION BY stream_id ORDER BY frame_idx) AS island
  FROM frames WHERE score >= {HIT})
SELECT stream_id, min(frame_idx) AS lo, max(frame_idx) AS hi, max(score) AS peak,
       arg_min(frame_idx, (-score, frame_idx)) AS peak_idx,
       round(min(frame_idx) * 1280 / 16000, 4) AS start_seconds,
       round((max(frame_idx) + 1) * 1280 / 16000, 4) AS end_seconds
FROM marked GROUP BY stream_id, island""")
def score_runs(spark, sf_dir):
    runs = events.score_runs(fx.frames(spark, sf_dir), ["stream_id"], HIT)
    return runs.select(
        "*",
        F.round(scalars.frame_seconds("lo"), 4).alias("start_seconds"),
        F.round(scalars.frame_seconds(F.col("hi") + 1), 4).alias("end_seconds"),
    )


@query("win9_peak_hold", "WITH" + fx.FRAMES_SQL + """
SELECT a.stream_id, a.frame_idx,
       round(max(b.score * pow(0.7, a.frame_idx - b.frame_idx)), 6) AS held
FROM frames a JOIN frames b ON a.stream_id = b.stream_id AND b.frame_idx <= a.frame_idx
GROUP BY 1, 2""")
def peak_hold(spark, sf_dir):
    held = events.peak_hold(fx.frames(spark, sf_dir), ["stream_id"])
    return held.select("stream_id", "frame_idx", F.round("held", 6).alias("held"))


@query("agg3_curve", CURVE_SQL + "SELECT * FROM curve")
def curve(spark, sf_dir):
    return curve_rows(spark, sf_dir)


@query("agg4_at_threshold", CURVE_SQL + f"SELECT * FROM curve WHERE threshold = {COMPARE_AT}")
def at_threshold(spark, sf_dir):
    return roc.at_threshold(curve_rows(spark, sf_dir))


@query("agg5_recall_at_fa", CURVE_SQL + f"""
SELECT set_name, candidate,
       max(CASE WHEN false_accepts_per_hour <= {GATE} THEN recall END) AS recall
FROM curve GROUP BY ALL""")
def recall_at_fa(spark, sf_dir):
    rows = roc.recall_profile(curve_rows(spark, sf_dir), ["set_name", "candidate"], [GATE])
    return rows.drop("budget")


@query("agg6_recall_profile", PROFILE_SQL + "SELECT * FROM profile")
def recall_profile(spark, sf_dir):
    return roc.recall_profile(curve_rows(spark, sf_dir), ["set_name", "candidate"])


@query("agg7_exact_profile", ANY_SIZE_SQL + "SELECT * FROM exact")
def exact_profile(spark, sf_dir):
    return exact_rows(spark, sf_dir)


@query("agg8_operating_point", CURVE_SQL + """,
best AS (SELECT set_name, candidate, min(threshold) AS threshold FROM curve
         WHERE false_accepts_per_hour <= 0.2 GROUP BY ALL)
SELECT k.set_name, k.candidate, c.* EXCLUDE (set_name, candidate)
FROM (SELECT DISTINCT set_name, candidate FROM curve) k
LEFT JOIN best USING (set_name, candidate)
LEFT JOIN curve c ON c.set_name = k.set_name AND c.candidate = k.candidate
                 AND c.threshold = best.threshold""")
def operating_point(spark, sf_dir):
    return roc.operating_point(curve_rows(spark, sf_dir), ["set_name", "candidate"], 0.2)


@query("agg9_exact_beats_grid", EXACT_SQL + f""",
grid_hits AS MATERIALIZED (
  SELECT set_name, candidate, stream_id, threshold, frame_idx
  FROM fa JOIN {GRID_SQL} ON score >= threshold),
""" + events_cte("grid_ev", "grid_hits", CURVE_KEYS) + f""",
grid_curve AS (
  SELECT set_name, candidate, threshold, events, recall, hours
  FROM (SELECT candidate, threshold,
               avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END) AS recall
        FROM positives CROSS JOIN {GRID_SQL} GROUP BY ALL)
  CROSS JOIN eval_sets
  LEFT JOIN (SELECT set_name, candidate, threshold, count(*) AS events
             FROM grid_ev GROUP BY ALL) USING (set_name, candidate, threshold)),
grid AS (
  SELECT set_name, candidate, budget,
         max(CASE WHEN coalesce(events, 0) / hours <= budget THEN recall END) AS grid
  FROM grid_curve CROSS JOIN {BUDGET_SQL} GROUP BY ALL)
SELECT set_name, candidate, budget,
       CAST(grid IS NOT NULL AND (recall IS NULL OR recall < grid - 1e-9) AS BIGINT) AS violations
FROM exact JOIN grid USING (set_name, candidate, budget)""")
def exact_beats_grid(spark, sf_dir):
    scores, fa, sets = scores_and_sets(spark, sf_dir)
    pos = fx.positives(scores)
    return roc.invariant_violations(
        roc.exact_profile(fa, pos, sets),
        roc.recall_profile(
            roc.curve(fa, pos, sets), ["set_name", "candidate"], rounded=False
        ),
    )


@query("agg10_condition_recall", EXACT_SQL + """
SELECT set_name, candidate, condition, budget, recall FROM cond""")
def condition_recall(spark, sf_dir):
    scores, fa, sets = scores_and_sets(spark, sf_dir)
    thresholds = roc.exact_thresholds(fa, sets, scores)
    return roc.recall_above(fx.conditions(scores), thresholds, ["condition"])


@query("agg20_standard_error", "WITH" + fx.CANDIDATES_SQL + f"""
SELECT candidate, threshold, count(*) AS n, avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END) AS recall,
       round(sqrt(avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END)
             * (1 - avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END)) / count(*)), 6) AS standard_error
FROM positives CROSS JOIN {GRID_SQL} GROUP BY ALL""")
def standard_error(spark, sf_dir):
    pos = fx.positives(fx.candidate_scores(spark, sf_dir))
    sizes = pos.groupBy("candidate").agg(F.count(F.lit(1)).alias("n"))
    return (
        roc.recall_at_thresholds(pos, ["candidate"]).join(sizes, "candidate")
        .withColumn("standard_error",
                    F.round(scalars.recall_standard_error(F.col("recall"), F.col("n")), 6))
    )


@query("jn2_condition_thresholds", ANY_SIZE_SQL + """
SELECT set_name, candidate, budget, threshold, condition, count(*) AS clips,
       count(*) FILTER (score > threshold) AS clear
FROM thresholds JOIN conditions USING (candidate) GROUP BY ALL""")
def condition_thresholds(spark, sf_dir):
    scores, fa, sets = scores_and_sets(spark, sf_dir)
    thresholds = roc.exact_thresholds(fa, sets, scores)
    return roc.clips_above(fx.conditions(scores), thresholds, ["condition"])


@query("jn3_threshold_grid", "WITH" + fx.CANDIDATES_SQL + f"""
SELECT candidate, threshold, count(*) AS clips, count(*) FILTER (score >= threshold) AS clear
FROM positives CROSS JOIN {GRID_SQL} GROUP BY ALL""")
def threshold_grid(spark, sf_dir):
    return roc.grid_counts(fx.positives(fx.candidate_scores(spark, sf_dir)), ["candidate"])


@query("jn4_candidate_matrix", "WITH" + fx.CANDIDATES_SQL + """,
cells AS (
  SELECT candidate, set_name, condition
  FROM (SELECT DISTINCT candidate FROM scored) CROSS JOIN eval_sets
  CROSS JOIN (VALUES ('clean'), ('env'), ('music'), ('speech'), ('babble')) c(condition))
SELECT candidate, set_name, condition, fa_frames, fa_top, clips, clip_top
FROM cells
LEFT JOIN (SELECT set_name, candidate, count(*) AS fa_frames, max(score) AS fa_top
           FROM fa GROUP BY ALL) USING (set_name, candidate)
LEFT JOIN (SELECT candidate, condition, count(*) AS clips, max(score) AS clip_top
           FROM conditions GROUP BY ALL) USING (candidate, condition)""")
def candidate_matrix(spark, sf_dir):
    scores, fa, sets = scores_and_sets(spark, sf_dir)
    return roc.candidate_matrix(fa, fx.conditions(scores), sets)


@query("jn5_baseline_delta", EXACT_SQL + f"""
SELECT c.set_name, c.candidate, c.condition, c.recall, b.recall AS baseline_recall,
       round(c.recall - b.recall, 6) AS delta
FROM cond c JOIN cond b ON b.set_name = c.set_name AND b.condition = c.condition
  AND b.budget = c.budget AND b.candidate = 'baseline'
WHERE c.candidate <> 'baseline' AND c.budget = {GATE}""")
def baseline_delta(spark, sf_dir):
    scores, fa, sets = scores_and_sets(spark, sf_dir)
    thresholds = roc.exact_thresholds(fa, sets, scores)
    rows = roc.recall_above(fx.conditions(scores), thresholds, ["condition"])
    return roc.against_baseline(rows.where(F.col("budget") == GATE).drop("budget"), "baseline")
