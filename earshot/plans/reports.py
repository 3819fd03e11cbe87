"""Stress summaries, checkpoint and candidate selection, and the run leaderboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.constants import CONDITIONS, FA_BUDGETS, STRESS_CELLS, THRESHOLDS
from earshot.functions import scalars
from earshot.operators import report, roc, selection, stress
from earshot.plans import evaluation
from earshot.plans import fixtures as fx
from earshot.plans.registry import query, table
from earshot.session import pin, spread
from earshot.sources import metrics, publish

BUDGET = 0.5

# --- stress ----------------------------------------------------------------------

PROFILE = [
    (c, b, t) for c, ts in {
        "final": [0.72, 0.6, 0.5, 0.41], "merged": [0.8, 0.65, 0.52, 0.45],
        "best_single": [0.7, 0.55, 0.45, 0.3], "baseline": [None, 0.6, 0.58, 0.5],
    }.items() for b, t in zip(FA_BUDGETS, ts)
]
PROFILE_SQL = "(VALUES " + ", ".join(
    f"('{c}', {b}::DOUBLE, {'NULL' if t is None else t}::DOUBLE)" for c, b, t in PROFILE
) + ") p(candidate, budget, threshold)"
ROLE_KEEP = {"clean": 1.0, "speech": 0.8, "babble": 0.7, "music": 0.85, "env": 0.9}
STRESS_SQL = "WITH" + fx.CANDIDATES_SQL + """,
cells AS (
  SELECT 'clean' AS role, NULL::INTEGER AS snr UNION ALL
  SELECT role, snr FROM (VALUES ('speech'), ('babble'), ('music'), ('env')) r(role)
  CROSS JOIN (VALUES (20), (15), (10), (5), (0)) s(snr)),
stressed AS (
  SELECT candidate, clip_id, role, snr,
         score * CASE role WHEN 'clean' THEN 1.0::DOUBLE WHEN 'speech' THEN 0.8 WHEN 'babble' THEN 0.7
                 WHEN 'music' THEN 0.85 ELSE 0.9 END * (coalesce(snr, 20) + 20) / 40 AS score
  FROM positives CROSS JOIN cells)
"""


#: More budgets than a run reports: every number of them has to come out.
STRESS_BUDGETS = [0.1, *FA_BUDGETS, 4.0]
STRESS_PROFILE = [
    (c, b, None if t is None else round(t + lift, 2))
    for c, _, t in [row for row in PROFILE if row[1] == 0.5]
    for b, lift in zip(STRESS_BUDGETS, (0.2, 0.15, 0.0, -0.1, -0.1, -0.3))
] + [("unmatched", 0.2, 0.5)]
STRESS_PROFILE[0] = (*STRESS_PROFILE[0][:2], None)
STRESS_PROFILE_SQL = "(VALUES " + ", ".join(
    f"('{c}', {b}::DOUBLE, {'NULL' if t is None else t}::DOUBLE)" for c, b, t in STRESS_PROFILE
) + ") p(candidate, budget, threshold)"


def stress_thresholds(spark):
    return spark.createDataFrame(STRESS_PROFILE, "candidate string, budget double, threshold double")


def thresholds(spark):
    return spark.createDataFrame(PROFILE, "candidate string, budget double, threshold double")


def stressed(spark, sf_dir):
    rows = stress.stress_grid(fx.positives(fx.candidate_scores(spark, sf_dir)))
    keep = F.coalesce(*[F.when(F.col("role") == r, F.lit(k)) for r, k in ROLE_KEEP.items()])
    return rows.withColumn(
        "score", F.col("score") * keep * (F.coalesce("snr", F.lit(20)) + 20) / 40
    )


@query("jn6_stress_grid", STRESS_SQL + "SELECT * FROM stressed")
def stress_grid(spark, sf_dir):
    return stressed(spark, sf_dir)


@query("agg11_stress_summary", STRESS_SQL + f"""
SELECT candidate, role, snr, budget, round(min(score), 4) AS min, round(median(score), 4) AS median,
       round(avg(CASE WHEN threshold IS NOT NULL THEN CASE WHEN score > threshold THEN 1.0 ELSE 0.0 END END), 3) AS clear_frac
FROM stressed JOIN {STRESS_PROFILE_SQL} USING (candidate) GROUP BY ALL""")
def stress_summary(spark, sf_dir):
    return stress.summary(stressed(spark, sf_dir), stress_thresholds(spark))


@query("agg12_cleared_budgets", STRESS_SQL + f"""
SELECT candidate, role, snr, weakest,
       coalesce(string_agg(budget::VARCHAR, ', ' ORDER BY budget) FILTER (weakest >= threshold), '-') AS clears
FROM (SELECT candidate, role, snr, min(score) AS weakest FROM
      (SELECT candidate, role, snr, clip_id, score * 0.2 + 0.45 AS score FROM stressed) GROUP BY ALL)
JOIN {PROFILE_SQL} USING (candidate) GROUP BY ALL""")
def cleared_budgets(spark, sf_dir):
    rows = stressed(spark, sf_dir).withColumn("score", F.col("score") * 0.2 + 0.45)
    return stress.cleared_budgets(rows, thresholds(spark))


@query("agg13_interference_only", "WITH" + fx.CANDIDATES_SQL + f"""
SELECT candidate, event_type AS pool, budget, round(max(score), 4) AS peak,
       count(*) FILTER (score >= threshold) AS frames
FROM scored JOIN {STRESS_PROFILE_SQL} USING (candidate) WHERE event_type <> 'purchase' GROUP BY ALL""")
def interference_only(spark, sf_dir):
    frames = fx.candidate_scores(spark, sf_dir).where("event_type <> 'purchase'")
    return stress.interference_only(
        frames.withColumnRenamed("event_type", "pool"), stress_thresholds(spark)
    )


@query("scl7_cell_keys", STRESS_SQL + """
SELECT candidate, coalesce(role || '@' || snr, role) AS cell, role, snr, count(*) AS clips
FROM stressed GROUP BY ALL""")
def cell_keys(spark, sf_dir):
    keyed = stressed(spark, sf_dir).groupBy("candidate", stress.cell_key().alias("cell")).agg(
        F.count(F.lit(1)).alias("clips")
    )
    role, snr = stress.split_cell(F.col("cell"))
    return keyed.withColumns({"role": role, "snr": snr})


@query("ml3_clip_scores", "WITH" + fx.CANDIDATES_SQL + """
SELECT candidate, stream_id, max(score) AS score FROM scored GROUP BY ALL""")
def clip_scores(spark, sf_dir):
    return stress.clip_scores(fx.candidate_scores(spark, sf_dir), ["candidate", "stream_id"])


# --- checkpoints and candidates -----------------------------------------------------

CKPT_SQL = """ckpts AS (
  SELECT o_orderkey AS ckpt, (o_custkey % 101) / 101.0 AS val_accuracy,
         o_totalprice / 600000 AS val_recall,
         CASE WHEN o_orderkey % 9 <> 0 THEN (o_custkey % 37) / 10.0 END AS val_fp_per_hr FROM orders)"""


def checkpoints(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ckpt"),
        ((F.col("o_custkey") % 101) / 101.0).alias("val_accuracy"),
        (F.col("o_totalprice") / 600000).alias("val_recall"),
        F.when(F.col("o_orderkey") % 9 != 0, (F.col("o_custkey") % 37) / 10.0).alias("val_fp_per_hr"),
    )


@query("agg19_percentile_gates", f"""WITH {CKPT_SQL},
g AS (SELECT quantile_cont(val_accuracy, 0.9) AS a, quantile_cont(val_recall, 0.9) AS r,
             quantile_cont(coalesce(val_fp_per_hr, 0), 0.1) AS f FROM ckpts)
SELECT ckpt, round(a, 9) AS gate_accuracy, round(r, 9) AS gate_recall, round(f, 9) AS gate_fp_per_hr
FROM ckpts CROSS JOIN g WHERE val_accuracy >= a AND val_recall >= r AND coalesce(val_fp_per_hr, 0) <= f""")
def percentile_gates(spark, sf_dir):
    rows = selection.pass_percentile_gates(checkpoints(spark, sf_dir))
    gates = ["gate_accuracy", "gate_recall", "gate_fp_per_hr"]
    return rows.select("ckpt", *[F.round(g, 9).alias(g) for g in gates])


@query("smp16_recall_gated", f"""WITH {CKPT_SQL}
SELECT ckpt, val_recall, row_number() OVER (ORDER BY val_recall DESC, ckpt) - 1 AS place, false AS fallback
FROM ckpts WHERE coalesce(val_fp_per_hr, 0) <= 0.2 ORDER BY val_recall DESC, ckpt LIMIT 10""")
def recall_gated(spark, sf_dir):
    rows = selection.recall_gated(checkpoints(spark, sf_dir), 0.2)
    return rows.select("ckpt", "val_recall", "place", "fallback")


@query("smp16_gate_fallback", f"""WITH {CKPT_SQL},
c AS (SELECT ckpt, val_recall, coalesce(val_fp_per_hr, 0) + 1 AS rate FROM ckpts),
p AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY rate, ckpt) AS r FROM c)
      WHERE r <= greatest(1, (SELECT count(*) FROM c) // 10))
SELECT ckpt, val_recall, row_number() OVER (ORDER BY val_recall DESC, ckpt) - 1 AS place, true AS fallback
FROM p ORDER BY val_recall DESC, ckpt LIMIT 10""")
def gate_fallback(spark, sf_dir):
    shifted = checkpoints(spark, sf_dir).withColumn(
        "val_fp_per_hr", F.coalesce("val_fp_per_hr", F.lit(0.0)) + 1
    )
    rows = selection.recall_gated(shifted, 0.2)
    return rows.select("ckpt", "val_recall", "place", "fallback")


@query("smp17_choose_candidate", evaluation.CURVE_SQL + """,
grid AS (SELECT set_name, candidate,
                max(CASE WHEN false_accepts_per_hour <= 0.5 THEN recall END) AS grid,
                max(CASE WHEN false_accepts_per_hour <= 0.05 THEN recall END) AS tight,
                min(false_accepts_per_hour) AS lowest_rate
         FROM curve WHERE candidate <> 'baseline' GROUP BY ALL),
ranked AS (SELECT *, CASE WHEN set_name = 'open' THEN tight END AS exact FROM grid)
SELECT set_name,
       coalesce(arg_min(candidate, (-exact, candidate)) FILTER (exact IS NOT NULL),
                arg_min(candidate, (-grid, candidate)) FILTER (grid IS NOT NULL),
                arg_min(candidate, (lowest_rate, candidate))) AS candidate,
       CASE WHEN count(exact) > 0 THEN 'exact' WHEN count(grid) > 0 THEN 'grid' ELSE 'lowest rate' END AS rule
FROM ranked GROUP BY set_name""")
def choose_candidate(spark, sf_dir):
    rows = evaluation.curve_rows(spark, sf_dir)
    pair = ["set_name", "candidate"]
    grid = roc.recall_profile(rows, pair, [0.5]).drop("budget")
    tight = roc.recall_profile(rows, pair, [0.05]).drop("budget").where("set_name = 'open'")
    rates = rows.groupBy(*pair).agg(F.min("false_accepts_per_hour").alias("lowest_rate"))
    return selection.choose_candidate(tight, grid, rates)


#: (name, set asked for, condition asked for): a condition that all have, one that a
#: candidate lacks, and a set on which nothing was measured.
PUBLISHED = [("a", "open", "music"), ("b", "open", "babble"), ("c", "attic", "mixed")]
FALLBACK = "holdout"


@query("smp17_publish", evaluation.EXACT_SQL + f""",
asked AS (FROM (VALUES {", ".join(map(str, PUBLISHED))}) a(name, select_on, select_condition)),
trained AS (SELECT set_name, candidate, recall FROM exact WHERE budget = {evaluation.GATE} AND candidate <> 'baseline'),
heard AS (SELECT set_name, candidate, condition, recall FROM cond
          WHERE budget = {evaluation.GATE} AND candidate <> 'baseline' AND NOT (condition = 'babble' AND candidate = 'final')),
primaries AS (
  SELECT name, select_condition, CASE WHEN select_on IN (SELECT set_name FROM exact) THEN select_on ELSE '{FALLBACK}' END AS set_name
  FROM asked),
usable AS (
  SELECT p.name, p.set_name, p.select_condition,
         p.select_condition <> 'mixed' AND count(h.candidate) = count(*) AS ok
  FROM primaries p JOIN trained t ON t.set_name = p.set_name
  LEFT JOIN heard h ON h.set_name = p.set_name AND h.candidate = t.candidate AND h.condition = p.select_condition
  GROUP BY p.name, p.set_name, p.select_condition),
ranking AS (
  SELECT u.name, u.set_name, u.ok, u.select_condition, t.candidate, CASE WHEN u.ok THEN h.recall ELSE t.recall END AS recall
  FROM usable u JOIN trained t ON t.set_name = u.set_name
  LEFT JOIN heard h ON h.set_name = u.set_name AND h.candidate = t.candidate AND h.condition = u.select_condition)
SELECT name, set_name, CASE WHEN ok THEN select_condition ELSE 'mixed' END AS condition,
       arg_min(candidate, (-recall, candidate)) FILTER (recall IS NOT NULL) AS candidate, 'exact' AS rule
FROM ranking GROUP BY name, set_name, ok, select_condition""")
def publish_choice(spark, sf_dir):
    """What is published, by exact recall at the gate."""
    scores, fa, sets = evaluation.scores_and_sets(spark, sf_dir)
    thresholds = pin(roc.exact_thresholds(fa, sets, scores, [evaluation.GATE]))
    exact = pin(roc.recall_above(fx.positives(scores), thresholds, []))
    heard = pin(roc.recall_above(fx.conditions(scores), thresholds, ["condition"]).where(
        "not (condition = 'babble' and candidate = 'final')"
    ))
    grid = exact.select("set_name", "candidate", "recall")
    rates = exact.select("set_name", "candidate", F.lit(0.0).alias("lowest_rate"))
    rows = None
    for name, select_on, condition in PUBLISHED:
        one = selection.choose_published(exact, heard, grid, rates, select_on, condition, FALLBACK)
        one = one.select(F.lit(name).alias("name"), "*")
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("ml2_candidate_scores", "WITH" + fx.CANDIDATES_SQL + """
SELECT f.set_name, f.candidate, count(*) AS frames, round(avg(f.score), 9) AS mean_score,
       f.candidate <> 'baseline' AS selectable
FROM fa f GROUP BY ALL""")
def candidate_scores(spark, sf_dir):
    fa = fx.false_accepts(fx.candidate_scores(spark, sf_dir))
    return fa.groupBy("set_name", "candidate").agg(
        F.count(F.lit(1)).alias("frames"), F.round(F.avg("score"), 9).alias("mean_score")
    ).withColumn("selectable", F.col("candidate") != "baseline")


# --- runs ------------------------------------------------------------------------------

RUNS_SQL = "WITH" + fx.FRAMES_SQL + f""",
curve AS (
  SELECT stream_id, threshold,
         coalesce(avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END) FILTER (event_type = 'purchase'), 0) AS recall,
         round(count(*) FILTER (event_type <> 'purchase' AND score >= threshold) / (count(*) * 600.0 / 3600), 4) AS rate,
         count(*) FILTER (event_type <> 'purchase' AND score >= threshold) AS events,
         count(*) * 600.0 / 3600 AS hours
  FROM frames CROSS JOIN {evaluation.GRID_SQL} GROUP BY ALL),
grid AS (
  SELECT stream_id, budget, max(CASE WHEN rate <= budget THEN recall END) AS grid,
         min(CASE WHEN rate <= budget THEN threshold END) AS threshold
  FROM curve CROSS JOIN {evaluation.BUDGET_SQL} GROUP BY ALL),
profile AS (
  SELECT stream_id, budget, threshold, CASE WHEN stream_id % 4 = 1 AND budget = 1.0 THEN grid + 0.0005 ELSE grid END AS recall
  FROM grid),
cond AS (
  SELECT stream_id, condition,
         avg(CASE WHEN score * keep > threshold THEN 1.0 WHEN threshold IS NOT NULL THEN 0.0 END) AS recall
  FROM frames JOIN profile USING (stream_id)
  CROSS JOIN (VALUES ('clean', 1.0), ('env', 0.9), ('music', 0.8), ('speech', 0.7), ('babble', 0.6),
              ('babble@15', 0.75), ('babble@10', 0.65), ('music@10', 0.85)) d(condition, keep)
  WHERE event_type = 'purchase' AND budget = {BUDGET} GROUP BY ALL),
runs AS (
  SELECT * FROM (
    SELECT DISTINCT stream_id,
           CASE WHEN stream_id % 10 < 2 THEN 'exp-' || stream_id ELSE 'run-' || stream_id END AS name FROM frames)
  WHERE NOT contains(name, '13'))
"""


def run_metrics(spark, sf_dir):
    """Metrics rows, one per stream, in the stored form."""
    frames = fx.frames(spark, sf_dir)
    wins = F.col("event_type") == "purchase"
    hours = F.count(F.lit(1)) * fx.STEP_SECONDS / 3600
    hit = lambda t: F.count_if(~wins & (F.col("score") >= t))
    rows = F.array(*[
        F.struct(
            F.lit(t).alias("threshold"),
            F.coalesce(F.avg(F.when(wins, (F.col("score") >= t).cast("double"))), F.lit(0.0)).alias("recall"),
            F.round(hit(t) / hours, 4).alias("false_accepts_per_hour"),
            hit(t).alias("events"), hit(t).alias("frames"),
        ) for t in THRESHOLDS
    ])
    base = frames.groupBy("stream_id").agg(rows.alias("curve"), hours.alias("val_set_hrs"))
    grid = {b: report.grid_recall(F.col("curve"), b) for b in FA_BUDGETS}
    bumped = {**grid, 1.0: F.when(F.col("stream_id") % 4 == 1, grid[1.0] + 0.0005).otherwise(grid[1.0])}
    fits = F.filter("curve", lambda r: r["false_accepts_per_hour"] <= BUDGET)
    base = base.withColumns({
        "recall_at_fa": F.when(F.col("stream_id") % 4 != 2, F.create_map(*[
            x for b in FA_BUDGETS for x in (F.lit(str(b)), bumped[b])])),
        "gate": F.array_min(F.transform(fits, lambda r: r["threshold"])),
    })
    keep = {**dict(zip(CONDITIONS, [1.0, 0.9, 0.8, 0.7, 0.6])),
            **dict(zip(STRESS_CELLS, [0.75, 0.65, 0.85]))}
    shares = frames.where(wins).join(base.select("stream_id", "gate"), "stream_id").groupBy("stream_id").agg(
        *[F.avg((F.col("score") * k > F.col("gate")).cast("double")).alias(c) for c, k in keep.items()]
    )
    key = F.lit(str(BUDGET))
    cell = lambda c: F.create_map(key, F.struct(F.col(f"`{c}`").alias("recall"), F.col("gate").alias("threshold")))
    clear = lambda c: F.struct(
        F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("median"),
        F.create_map(key, F.col(f"`{c}`")).alias("clear_frac"))
    conditions = F.create_map(*[x for c in CONDITIONS for x in (F.lit(c), cell(c))])
    cells = F.create_map(*[x for c in STRESS_CELLS for x in (F.lit(c), clear(c))])
    stream = F.col("stream_id")
    return base.join(shares, "stream_id", "left").select(
        "stream_id",
        F.when(stream % 10 == 0, F.lit("")).when(stream % 10 != 1, F.concat(F.lit("run-"), stream)).alias("run_name"),
        F.lit("final").alias("selected"), "val_set_hrs",
        F.when(stream % 3 != 0, stream % 3).cast("int").alias("metrics_version"),
        "curve", "recall_at_fa",
        F.when(stream % 5 == 0, F.create_map(key, F.struct(
            F.lit(0.5).alias("recall"), F.lit(0.5).alias("threshold")))).alias("recall_at_fa_exact"),
        conditions.alias("recall_at_fa_by_condition"),
        F.when(stream % 2 == 0, F.struct((stream % 7).cast("int").alias("merged"))).alias("selection"),
        F.create_map(F.lit("final"), F.struct(cells.alias("rows"))).alias("stress"),
        F.concat(F.lit("lab/exp-"), stream).alias("repo"),
        F.when(stream % 3 == 0, F.struct(F.lit("stock").alias("model"), F.create_map(*[
            x for c in CONDITIONS[:3] for x in (F.lit(c), F.create_map(key, F.struct(
                (F.col(f"`{c}`") / 2).alias("recall"), F.col("gate").alias("threshold"))))
        ]).alias("recall_at_fa_by_condition"))).alias("baseline"),
    )


def runs(spark, sf_dir):
    return report.with_profiles(report.named_runs(run_metrics(spark, sf_dir), ["13"]))


EFFECTIVE_SQL = """effective AS (
  SELECT stream_id, budget, CASE WHEN stream_id % 4 = 2 THEN grid ELSE recall END AS recall
  FROM profile JOIN grid USING (stream_id, budget))"""
RANKED_SQL = RUNS_SQL + f""", {EFFECTIVE_SQL},
ranked AS (
  SELECT stream_id, name, recall, row_number() OVER (ORDER BY recall DESC, stream_id) AS place
  FROM effective JOIN runs USING (stream_id) WHERE budget = {BUDGET} AND recall IS NOT NULL)
"""


@query("flt2_skip_runs", RUNS_SQL + "SELECT stream_id, name FROM runs")
def skip_runs(spark, sf_dir):
    return report.named_runs(run_metrics(spark, sf_dir), ["13"]).select("stream_id", "name")


@query("flt3_run_names", """
SELECT url, CASE WHEN page_id % 3 = 0 OR page_id % 3 = 1 THEN regexp_extract(url, '[^/]*$') ELSE url END AS name
FROM pages""")
def run_names(spark, sf_dir):
    given = F.when(F.col("page_id") % 3 == 0, F.lit("")).when(F.col("page_id") % 3 == 2, F.col("url"))
    return table(spark, sf_dir, "pages").select("url", report.run_name(given, F.col("url")).alias("name"))


@query("src10_metrics_scan", RUNS_SQL + f"""
SELECT stream_id % 10 AS kind, count(*) AS runs, round(sum(grid), 6) AS recall
FROM grid WHERE budget = {BUDGET} GROUP BY 1""")
def metrics_scan(spark, sf_dir):
    folder = publish.mounted(publish.shared_folder(spark, "runs"))
    stored = run_metrics(spark, sf_dir).withColumn("run_name", F.col("stream_id").cast("string"))
    metrics.write_metrics(stored.drop("stream_id", "repo"), folder)
    rows, _ = metrics.read_metrics(spark, {"lab/exp": folder}, multi_line=False)
    return rows.groupBy((F.col("run_name").cast("long") % 10).alias("kind")).agg(
        F.count(F.lit(1)).alias("runs"),
        F.round(F.sum(report.grid_recall(F.col("curve"), BUDGET)), 6).alias("recall"),
    )


@query("agg14_poisson_interval", RUNS_SQL + """
SELECT stream_id, events,
       round(CASE WHEN events = 0 THEN 0.0 ELSE greatest(0.0, events * pow(1 - 1 / (9.0 * events) - 1.96 / (3 * sqrt(events)), 3)) END / hours, 6) AS low,
       round(CASE WHEN events = 0 THEN 3.69 ELSE (events + 1) * pow(1 - 1 / (9.0 * (events + 1)) + 1.96 / (3 * sqrt(events + 1)), 3) END / hours, 6) AS high
FROM curve JOIN runs USING (stream_id) WHERE threshold = 0.5""")
def poisson_interval(spark, sf_dir):
    events, hours = F.col("half.events"), F.col("val_set_hrs")
    return runs(spark, sf_dir).select(
        "stream_id", events.alias("events"),
        F.round(scalars.poisson_low(events) / hours, 6).alias("low"),
        F.round(scalars.poisson_high(events) / hours, 6).alias("high"),
    )


@query("agg15_mean_recall", RUNS_SQL + f""", {EFFECTIVE_SQL}
SELECT name, stream_id, round(coalesce(round(sum(recall), 9) / nullif(count(recall), 0), 0.0), 6) AS mean_recall,
       CAST(count(recall) AS INTEGER) AS budgets,
       row_number() OVER (ORDER BY coalesce(round(sum(recall), 9), 0) DESC, stream_id) - 1 AS place
FROM effective JOIN runs USING (stream_id) GROUP BY name, stream_id""")
def mean_recall(spark, sf_dir):
    return report.mean_recall(runs(spark, sf_dir), "stream_id")


@query("agg16_exact_flag", RUNS_SQL + f""", {EFFECTIVE_SQL},
odd AS (
  SELECT stream_id, count(*) AS n FROM effective e WHERE recall IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM curve c WHERE c.stream_id = e.stream_id AND c.recall = e.recall)
  GROUP BY 1)
SELECT stream_id, stream_id % 3 = 2 OR stream_id % 5 = 0 OR coalesce(n, 0) > 0 AS exact
FROM runs LEFT JOIN odd USING (stream_id)""")
def exact_flag(spark, sf_dir):
    return runs(spark, sf_dir).select("stream_id", "exact")


@query("agg17_budget_wins", RANKED_SQL + """,
pair AS (SELECT a.budget, a.recall AS first, b.recall AS second
         FROM effective a JOIN effective b USING (budget)
         WHERE a.stream_id = (SELECT stream_id FROM ranked WHERE place = 1)
           AND b.stream_id = (SELECT stream_id FROM ranked WHERE place = 2))
SELECT CAST(count(*) FILTER (first > second) AS INTEGER) AS wins,
       CAST(count(*) FILTER (first IS NOT NULL AND second IS NOT NULL) AS INTEGER) AS seen FROM pair""")
def budget_wins(spark, sf_dir):
    rows = report.at_budget(runs(spark, sf_dir), BUDGET)
    return report.budget_wins(report.leader_and_runner_up(rows, "stream_id"))


#: With a condition, that condition's recall at the one budget is all there is of a profile.
ON_SPEECH_SQL = RUNS_SQL + """, spoken AS (
  SELECT stream_id, name, recall, row_number() OVER (ORDER BY recall DESC NULLS LAST, stream_id) AS place
  FROM runs LEFT JOIN (SELECT * FROM cond WHERE condition = 'speech') USING (stream_id))
"""


@query("agg15_condition_mean_recall", ON_SPEECH_SQL + """
SELECT name, stream_id, round(coalesce(round(recall, 9), 0.0), 6) AS mean_recall,
       CAST(recall IS NOT NULL AS INTEGER) AS budgets,
       row_number() OVER (ORDER BY coalesce(round(recall, 9), 0) DESC, stream_id) - 1 AS place
FROM spoken""")
def condition_mean_recall(spark, sf_dir):
    return report.mean_recall(report.at_budget(runs(spark, sf_dir), BUDGET, "speech"), "stream_id")


@query("agg17_condition_wins", ON_SPEECH_SQL + """
SELECT CAST(a.recall > b.recall AS INTEGER) AS wins, 1 AS seen
FROM spoken a JOIN spoken b ON a.place = 1 AND b.place = 2 AND b.recall IS NOT NULL""")
def condition_wins(spark, sf_dir):
    rows = report.at_budget(runs(spark, sf_dir), BUDGET, "speech")
    return report.budget_wins(report.leader_and_runner_up(rows, "stream_id"))


def shown(condition: str, alias: str) -> str:
    return f"coalesce(max(printf('%.3f', recall)) FILTER (condition = '{condition}'), '-') AS {alias}"


@query("agg18_condition_report", RUNS_SQL + "SELECT name, 'run' AS line, " + ", ".join(
    shown(c, c.replace("@", "_")) for c in [*CONDITIONS, *STRESS_CELLS]
) + " FROM runs LEFT JOIN cond USING (stream_id) GROUP BY name UNION ALL SELECT name, 'baseline', " + ", ".join(
    shown(c, c) for c in CONDITIONS
) + "".join(", NULL" for _ in STRESS_CELLS) + f""" FROM runs LEFT JOIN (
  SELECT stream_id, condition, recall / 2 AS recall FROM cond WHERE condition IN {tuple(CONDITIONS[:3])}) USING (stream_id)
WHERE stream_id % 3 = 0 GROUP BY name""")
def condition_report(spark, sf_dir):
    return report.condition_report(runs(spark, sf_dir), BUDGET)


def board_cell(budget: float) -> str:
    column = f"recall_at_{budget}".replace(".", "_")
    return f"coalesce(max(printf('%.3f', recall)) FILTER (budget = {budget}), '-') AS {column}"


@query("agg18_leaderboard", RUNS_SQL + f""", {EFFECTIVE_SQL},
odd AS (
  SELECT stream_id, count(*) AS n FROM effective e WHERE recall IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM curve c WHERE c.stream_id = e.stream_id AND c.recall = e.recall)
  GROUP BY 1),
half AS (
  SELECT stream_id, printf('%.3f', recall) AS recall_at_half, printf('%.2f', rate) AS rate_at_half,
         printf('%.2f', CASE WHEN events = 0 THEN 0.0 ELSE greatest(0.0, events * pow(1 - 1 / (9.0 * events) - 1.96 / (3 * sqrt(events)), 3)) END / hours)
         || '-' ||
         printf('%.2f', CASE WHEN events = 0 THEN 3.69 ELSE (events + 1) * pow(1 - 1 / (9.0 * (events + 1)) + 1.96 / (3 * sqrt(events + 1)), 3) END / hours) AS interval
  FROM curve WHERE threshold = 0.5),
cells AS (
  SELECT stream_id, {', '.join(board_cell(b) for b in FA_BUDGETS)} FROM effective GROUP BY 1)
SELECT name, substr(name, 1, 18) || CASE WHEN stream_id % 3 = 2 OR stream_id % 5 = 0 OR coalesce(n, 0) > 0 THEN '' ELSE ' ~' END AS run,
       'final' AS selected, cells.* EXCLUDE (stream_id), half.* EXCLUDE (stream_id),
       CASE WHEN stream_id % 2 = 0 THEN CAST(stream_id % 7 AS VARCHAR) ELSE '-' END AS merged
FROM runs JOIN cells USING (stream_id) JOIN half USING (stream_id) LEFT JOIN odd USING (stream_id)""")
def leaderboard(spark, sf_dir):
    return report.leaderboard(runs(spark, sf_dir))


@query("win7_ranking", RANKED_SQL + "SELECT stream_id, name, recall, place FROM ranked")
def ranking(spark, sf_dir):
    rows = report.at_budget(runs(spark, sf_dir), BUDGET)
    return report.ranking(rows, "stream_id").select("stream_id", "name", "recall", "place")


@query("win7_condition_ranking", RUNS_SQL + """
SELECT name, round(recall, 9) AS recall, row_number() OVER (ORDER BY recall DESC, stream_id) AS place
FROM cond JOIN runs USING (stream_id) WHERE condition = 'speech' AND recall IS NOT NULL""")
def condition_ranking(spark, sf_dir):
    rows = report.at_budget(runs(spark, sf_dir), BUDGET, "speech")
    return report.ranking(rows, "stream_id").select("name", F.round("recall", 9).alias("recall"), "place")


@query("win8_margin_verdict", RANKED_SQL + """
SELECT a.name AS leader, b.name AS second, round(a.recall - b.recall, 6) AS delta,
       CASE WHEN a.recall - b.recall < 0.03 THEN 'noise' WHEN a.recall - b.recall > 0.05 THEN 'real'
            ELSE 'inconclusive on its own' END AS verdict
FROM ranked a JOIN ranked b ON a.place = 1 AND b.place = 2""")
def margin_verdict(spark, sf_dir):
    rows = report.at_budget(runs(spark, sf_dir), BUDGET)
    return report.margin_verdict(report.leader_and_runner_up(rows, "stream_id"))


# --- scalars ------------------------------------------------------------------------------


@query("scl1_path_parts", """
SELECT url, regexp_replace(regexp_extract(url, '[^/]*$'), '(.)[.][^.]+$', '\\1') AS stem,
       lower(regexp_extract(regexp_extract(url, '[^/]*$'), '.[.]([^.]+)$', 1)) AS suffix,
       CASE WHEN length(page_id::VARCHAR) >= 5 THEN page_id::VARCHAR ELSE lpad(page_id::VARCHAR, 5, '0') END || '.wav' AS name
FROM (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '/a.b.WAV' WHEN 1 THEN '/.hidden' ELSE '/x' END AS url FROM pages)""")
def path_parts(spark, sf_dir):
    tail = F.when(F.col("page_id") % 3 == 0, "/a.b.WAV").when(F.col("page_id") % 3 == 1, "/.hidden").otherwise("/x")
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat("url", tail).alias("url"))
    return rows.select(
        "url", scalars.path_stem("url").alias("stem"), scalars.path_suffix("url").alias("suffix"),
        F.concat(scalars.indexed_name("page_id"), F.lit(".wav")).alias("name"),
    )


@query("scl6_json_navigation", """
SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k,
       coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events""")
def json_navigation(spark, sf_dir):
    parsed = F.from_json("props", "k bigint, missing string")
    return table(spark, sf_dir, "events").select("event_id", parsed.alias("p")).select(
        "event_id", F.coalesce("p.k", F.lit(-1)).alias("k"),
        F.coalesce("p.missing", F.lit("none")).alias("missing"),
    )


@query("scl8_times", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS finished_at,
       round((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1000000, 1) AS elapsed, count(*) AS n
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def times(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    size = orders.count() + items.count()
    rows = spread(orders, size, "o_orderkey").join(
        spread(items, size, "l_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    return rows.groupBy(
        "o_orderkey", scalars.iso_utc("o_orderdate").alias("finished_at"),
        scalars.elapsed_seconds("o_orderdate", "l_shipdate").alias("elapsed"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("scl9_fixed_point", """
SELECT l_quantity AS q, l_discount AS d, count(*) AS n,
       coalesce(printf('%.3f', CASE WHEN l_discount > 0 THEN l_quantity / 16 END), '-') AS shown,
       printf('%.2f', l_discount * l_quantity / 8) AS rate
FROM lineitem GROUP BY ALL""")
def fixed_point(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_quantity").alias("q"), F.col("l_discount").alias("d")
    ).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(
        "q", "d", "n", scalars.fixed_point(F.when(F.col("d") > 0, F.col("q") / 16)).alias("shown"),
        scalars.fixed_point(F.col("d") * F.col("q") / 8, 2).alias("rate"),
    )
