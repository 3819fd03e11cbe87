"""The background pool, windows, batches, augmentation plans and input checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.constants import AUGMENT_PROBABILITY, BATCH_ROWS, CONDITIONS
from earshot.functions import scalars
from earshot.operators import batches, pool, positions, quality, windows
from earshot.plans import fixtures as fx
from earshot.plans.registry import query, table

SEED = 5
SEGMENT, SHORTEST = 2000, 600
#: Hours of each role that the pool asks for; the cap of a role and the floor follow from it.
HOURS = 0.25
CAP = pool.segment_cap(HOURS)
WINDOW = 16

# --- pool ------------------------------------------------------------------------

SEGMENTS_SQL = f"""
laid AS (
  SELECT lang AS role, string_agg(text, '' ORDER BY doc_id) AS content, sum(length(text)) AS total
  FROM documents GROUP BY lang),
segments AS (
  SELECT role, seg, length(content) AS n_samples, content,
         seg > max(seg) OVER (PARTITION BY role) - 6 AS reserved
  FROM (SELECT role, seg, substring(content, seg * {SEGMENT} + 1, {SEGMENT}) AS content
        FROM laid, LATERAL (SELECT unnest(range(0, CAST(ceil(total / {SEGMENT}) AS BIGINT))) AS seg))
  WHERE length(content) >= {SHORTEST}),
least AS (SELECT min(n) AS balanced FROM (SELECT count(*) AS n FROM segments WHERE NOT reserved GROUP BY role)),
balanced AS (
  SELECT * FROM (
    SELECT role, seg, row_number() OVER (PARTITION BY role
             ORDER BY sha256('{SEED}|' || role || '|' || seg), seg) AS place
    FROM segments WHERE NOT reserved) CROSS JOIN least
  WHERE place <= balanced)"""


def segments(spark, sf_dir, cap=None):
    clips = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("role"), "doc_id", F.col("text").alias("content")
    )
    cut = pool.recut(clips, ["doc_id"], "content", SEGMENT, SHORTEST, cap, text=True)
    return pool.hold_back_reserve(cut)


@query("flt1_silence_filter", """
WITH r AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda v:
             (v * CASE WHEN label < 3 THEN 0.0005 ELSE 1 END)::DOUBLE
             * (v * CASE WHEN label < 3 THEN 0.0005 ELSE 1 END)::DOUBLE)) / len(embedding)) AS rms
           FROM (SELECT vec_id, label, embedding::DOUBLE[] AS embedding FROM embeddings))
SELECT vec_id, round(rms, 9) AS rms FROM r WHERE rms >= 1e-4""")
def silence_filter(spark, sf_dir):
    quiet = F.when(F.col("label") < 3, F.lit(0.0005)).otherwise(F.lit(1.0))
    clips = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda v: v.cast("double") * quiet).alias("pcm")
    )
    return pool.drop_silent(clips).select("vec_id", F.round(scalars.rms("pcm"), 9).alias("rms"))


@query("jn9_segment_overlaps", f"""
WITH placed AS (
  SELECT lang AS role, doc_id, n_chars,
         sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id) - n_chars AS start FROM documents)
SELECT role, doc_id, seg,
       CAST(greatest(start, seg * {SEGMENT}) AS BIGINT) AS at,
       CAST(least(start + n_chars, (seg + 1) * {SEGMENT}) - greatest(start, seg * {SEGMENT}) AS BIGINT) AS take
FROM placed, LATERAL (SELECT unnest(range(CAST(start // {SEGMENT} AS BIGINT),
                                          CAST((start + n_chars - 1) // {SEGMENT} + 1 AS BIGINT))) AS seg)
WHERE n_chars > 0""")
def segment_overlaps(spark, sf_dir):
    clips = table(spark, sf_dir, "documents").select(F.col("lang").alias("role"), "doc_id", "n_chars")
    return pool.segment_overlaps(clips, ["doc_id"], "n_chars", SEGMENT).select(
        "role", "doc_id", "seg", "at", "take"
    )


@query("aud2_recut_segments", f"""WITH {SEGMENTS_SQL}
SELECT role, seg, CAST(n_samples AS BIGINT) AS n_samples, sha256(content) AS digest FROM segments""")
def recut_segments(spark, sf_dir):
    return segments(spark, sf_dir).select(
        "role", "seg", "n_samples", F.sha2("content", 256).alias("digest")
    )


@query("aud2_capped_segments", f"""WITH {SEGMENTS_SQL}
SELECT role, seg, CAST(n_samples AS BIGINT) AS n_samples, sha256(content) AS digest FROM segments WHERE seg < {CAP}""")
def capped_segments(spark, sf_dir):
    """The hours asked for, and no more, of each role."""
    return segments(spark, sf_dir, CAP).select(
        "role", "seg", "n_samples", F.sha2("content", 256).alias("digest")
    )


@query("smp6_reserve", f"WITH {SEGMENTS_SQL} SELECT role, seg, reserved FROM segments")
def reserve(spark, sf_dir):
    return segments(spark, sf_dir).select("role", "seg", "reserved")


@query("smp7_balanced_pool", f"WITH {SEGMENTS_SQL} SELECT role, seg FROM balanced")
def balanced_pool(spark, sf_dir):
    return pool.balance(segments(spark, sf_dir), SEED).select("role", "seg")


@query("smp7_pool_floor", f"""WITH {SEGMENTS_SQL}
SELECT role, count(*) FILTER (NOT reserved) AS pool, count(*) AS total, any_value(balanced) AS balanced,
       count(*) > 6 AS has_reserve, any_value(balanced) >= 45 AS above_floor
FROM segments CROSS JOIN least GROUP BY role""")
def pool_floor(spark, sf_dir):
    return pool.role_counts(segments(spark, sf_dir), HOURS)


@query("agg2_pool_summary", f"""WITH {SEGMENTS_SQL}
SELECT role, files, stress_reserve, round(files * 10 / 3600, 2) AS hours
FROM (SELECT role, count(*) AS files FROM balanced GROUP BY role)
JOIN (SELECT role, count(*) AS stress_reserve FROM segments WHERE reserved GROUP BY role) USING (role)""")
def pool_summary(spark, sf_dir):
    cut = segments(spark, sf_dir)
    return pool.pool_summary(pool.balance(cut, SEED), cut.where("reserved"))


JOB_SEGMENT, JOB_SHORTEST = 80, 24


@query("agg2_pool_job", f"""
WITH laid AS (
  SELECT ['speech', 'music', 'env'][label % 3 + 1] AS role, sum(len(embedding)) AS total
  FROM embeddings WHERE vec_id % 11 <> 0 GROUP BY 1),
cut AS (
  SELECT role, total // {JOB_SEGMENT} + CASE WHEN total % {JOB_SEGMENT} >= {JOB_SHORTEST} THEN 1 ELSE 0 END AS n
  FROM laid),
size AS (SELECT CAST(min(n) - 6 AS BIGINT) AS files FROM cut)
SELECT role, files, CAST(6 AS BIGINT) AS stress_reserve, round(files * 10 / 3600, 2) AS hours, true AS level
FROM size CROSS JOIN (VALUES ('speech'), ('music'), ('env'), ('babble')) r(role)""")
def pool_job(spark, sf_dir):
    """From clips to the balanced pool with babble; every segment comes out at one level."""
    role = F.element_at(F.array(F.lit("speech"), F.lit("music"), F.lit("env")), F.col("label") % 3 + 1)
    silent = F.when(F.col("vec_id") % 11 == 0, 0.0).otherwise(1.0)
    clips = table(spark, sf_dir, "embeddings").select(
        role.alias("role"), "vec_id", F.transform("embedding", lambda v: v.cast("double") * silent).alias("pcm")
    )
    # Hours for all of the largest role; aud2_capped_segments has the cap.
    longest = clips.groupBy("role").agg(F.sum(F.size("pcm")).alias("n")).agg(F.max("n")).first()[0] or 0
    hours = (longest // JOB_SEGMENT + 1) * 10 / 3600
    made, held = pool.build(clips, ["vec_id"], JOB_SEGMENT, JOB_SHORTEST, hours, SEED)
    peak = F.aggregate("pcm", F.lit(0.0), lambda top, v: F.greatest(top, F.abs(v)))
    right = (F.abs(scalars.rms("pcm") - 0.1) < 1e-6) | (F.abs(peak - 0.99) < 1e-6)
    level = made.groupBy("role").agg(F.bool_and(right).alias("level"))
    return pool.pool_summary(made, held).join(level, "role")


@query("aud12_stress_assets", f"""WITH {SEGMENTS_SQL}
SELECT role, count(*) AS parts, CAST(sum(n_samples) AS BIGINT) AS n_samples,
       sha256(string_agg(content, '' ORDER BY seg)) AS digest
FROM segments WHERE reserved GROUP BY role""")
def stress_assets(spark, sf_dir):
    held = segments(spark, sf_dir).where("reserved")
    return pool.reserve_audio(held, "content", text=True).select(
        "role", "parts", "n_samples", F.sha2("content", 256).alias("digest")
    )


@query("aud3_babble")
def babble(spark, sf_dir):
    speech = positions.row_positions(
        table(spark, sf_dir, "embeddings").where("label < 5")
        .select("vec_id", F.col("embedding").alias("pcm")), [], ["vec_id"], "pos",
    )
    pool_size = speech.count()
    wanted = table(spark, sf_dir, "embeddings").where("label >= 5").select(
        F.col("vec_id").alias("babble")
    )
    members = pool.babble_members(wanted, pool_size, 80, SEED)
    return pool.babble(members, speech, 80).select(
        "babble", "talkers", F.size("pcm").alias("n_samples"),
        F.round(scalars.rms("pcm"), 9).alias("rms"),
    )


# --- windows ---------------------------------------------------------------------


def frames(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("frame_idx"), F.col("embedding").alias("x")
    )


def total_of(arrays):
    return F.aggregate(
        F.flatten(arrays), F.lit(0.0), lambda acc, v: acc + v.cast("double")
    )


@query("win1_sliding_windows", f"""
SELECT idx, n, total FROM (
  SELECT vec_id AS idx, len(x) AS n, round(list_sum(flatten(x)), 4) AS total FROM (
    SELECT vec_id, list(embedding::DOUBLE[]) OVER (
      ORDER BY vec_id ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS x FROM embeddings))
WHERE n = {WINDOW}""")
def sliding_windows(spark, sf_dir):
    rows = windows.sliding_windows(frames(spark, sf_dir), [], WINDOW)
    return rows.select(
        "idx", F.size("x").cast("long").alias("n"), F.round(total_of("x"), 4).alias("total")
    )


@query("win1_stream_windows", "WITH" + fx.FRAMES_SQL + """
SELECT stream_id, idx, first_score, last_score, top FROM (
  SELECT stream_id, frame_idx AS idx, count(*) OVER w AS n, first(score) OVER w AS first_score,
         last(score) OVER w AS last_score, max(score) OVER w AS top
  FROM frames WINDOW w AS (PARTITION BY stream_id ORDER BY frame_idx
                           ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)) WHERE n = 16""")
def stream_windows(spark, sf_dir):
    rows = windows.sliding_windows(fx.frames(spark, sf_dir), ["stream_id"], WINDOW, "score")
    return rows.select(
        "stream_id", "idx", F.col("score")[0].alias("first_score"),
        F.element_at("score", -1).alias("last_score"), F.array_max("score").alias("top"),
    )


@query("win1_set_windows", f"""
SELECT CAST(label AS BIGINT) AS stream_id, count(*) AS frames,
       CASE WHEN count(*) >= {WINDOW} THEN count(*) - {WINDOW} + 1 END AS windows,
       CASE WHEN count(*) < {WINDOW} THEN count(*) || ' frames are shorter than the {WINDOW}-frame window' END AS error
FROM embeddings WHERE label <> 3 OR vec_id IN (SELECT vec_id FROM embeddings WHERE label = 3 ORDER BY vec_id LIMIT 9)
GROUP BY 1""")
def set_windows(spark, sf_dir):
    """Windows of each set; one of the sets is cut shorter than a window."""
    vectors = table(spark, sf_dir, "embeddings")
    short = vectors.where("label = 3").orderBy("vec_id").limit(9)
    rows = vectors.where("label <> 3").unionByName(short)
    sized = rows.groupBy(F.col("label").cast("long").alias("stream_id")).agg(F.count(F.lit(1)).alias("frames"))
    return windows.window_counts(sized, WINDOW)


@query("win2_flat_recut", f"""
SELECT idx, count(*) AS n, round(sum(list_sum(embedding::DOUBLE[])), 4) AS total
FROM (SELECT *, vec_id // {WINDOW} AS idx, count(*) OVER () AS size FROM embeddings)
WHERE idx * {WINDOW} < size - {WINDOW} GROUP BY idx""")
def flat_recut(spark, sf_dir):
    rows = frames(spark, sf_dir)
    cut = windows.recut_flat(rows, F.lit(rows.count()), WINDOW)
    return cut.select(
        "idx", F.size("x").cast("long").alias("n"), F.round(total_of("x"), 4).alias("total")
    )


@query("win3_window_counts", f"""
SELECT l_orderkey AS frames, count(*) AS sets,
       CAST(greatest(ceil((l_orderkey - {WINDOW}) / {WINDOW}), 0) AS BIGINT) AS recut,
       greatest(CAST(floor((l_orderkey - {WINDOW}) / {WINDOW}) AS BIGINT), 0) AS estimate
FROM lineitem GROUP BY l_orderkey""")
def window_counts(spark, sf_dir):
    sizes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("frames")).agg(
        F.count(F.lit(1)).alias("sets")
    )
    return sizes.select(
        "*", windows.recut_count(F.col("frames"), WINDOW).alias("recut"),
        windows.batch_estimate(F.col("frames"), WINDOW).alias("estimate"),
    )


@query("win4_prewindowed", """
SELECT vec_id AS idx, len(embedding) AS n FROM embeddings""")
def prewindowed(spark, sf_dir):
    rows = frames(spark, sf_dir).select(F.col("frame_idx").alias("idx"), "x")
    return windows.prewindowed(rows, 64).select("idx", F.size("x").cast("long").alias("n"))


@query("win5_framing", """
SELECT doc_id, 'file' AS mode, start, substring(text, start + 1, 1280) AS piece
FROM documents, LATERAL (SELECT unnest(range(0, n_chars - 1279, 1280)) AS start)
UNION ALL
SELECT doc_id, 'check', start, substring(text, start + 1, 1280)
FROM documents, LATERAL (SELECT unnest(range(0, n_chars - 1280, 1280)) AS start)""")
def framing(spark, sf_dir):
    length = F.col("n_chars")
    modes = F.array(
        F.struct(F.lit("file").alias("mode"), windows.frame_starts(length).alias("starts")),
        F.struct(F.lit("check").alias("mode"),
                 windows.frame_starts(length, drop_exact_last=True).alias("starts")),
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.inline(modes))
    return rows.select("doc_id", "mode", "text", F.explode("starts").alias("start")).select(
        "doc_id", "mode", "start",
        F.substring(F.col("text"), (F.col("start") + 1).cast("int"), F.lit(1280)).alias("piece"),
    )


@query("win10_grouping_width", """
SELECT l_quantity AS q, CAST(greatest(1, round_even(4.0::DOUBLE / (l_quantity / 10), 0)) AS INTEGER) AS width
FROM lineitem GROUP BY l_quantity""")
def grouping_width(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("q")).distinct()
    return rows.select("q", scalars.grouping_width(F.col("q") / 10).alias("width"))


# --- holdout, batches, augmentation --------------------------------------------------

BANK_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
BANK_SQL = f"""bank AS (
  SELECT *, row_number() OVER (ORDER BY {', '.join(BANK_ORDER)}) - 1 AS idx FROM lineitem)"""


def bank(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*BANK_ORDER, "l_returnflag")
    return positions.row_positions(rows, [], BANK_ORDER, "idx")


@query("smp12_tail_holdout", f"""WITH {BANK_SQL},
cut AS (SELECT count(*) - CAST(floor(2.5 * 3600 / 1.28) AS BIGINT) AS cutoff FROM lineitem)
SELECT CASE WHEN idx < cutoff THEN 'train' ELSE 'evaluate' END AS side, l_returnflag,
       count(*) AS n, min(idx) AS lo, max(idx) AS hi, CAST(sum(l_partkey) AS BIGINT) AS parts
FROM bank CROSS JOIN cut GROUP BY ALL""")
def tail_holdout(spark, sf_dir):
    rows = bank(spark, sf_dir)
    total = table(spark, sf_dir, "lineitem").count()
    return batches.tail_holdout(rows, total, 2.5, WINDOW).groupBy("side", "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.min("idx").alias("lo"), F.max("idx").alias("hi"),
        F.sum("l_partkey").alias("parts"),
    )


@query("smp13_cyclic_batches", f"""WITH {BANK_SQL},
pos AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders WHERE o_orderstatus <> 'F'),
adv AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders WHERE o_orderstatus = 'F'),
steps AS (SELECT unnest(range(0, (SELECT CAST(ceil(2 * count(*) / 1024) AS BIGINT) FROM lineitem))) AS step),
draws AS (
  SELECT step, 'negative' AS class, (step * 1024 + slot) % (SELECT count(*) FROM bank) AS idx, 0 AS label
  FROM steps, range(0, 1024) r(slot) UNION ALL
  SELECT step, 'positive', (step * 50 + slot) % (SELECT count(*) FROM pos), 1 FROM steps, range(0, 50) r(slot)
  UNION ALL
  SELECT step, 'adversarial', (step * 50 + slot) % (SELECT count(*) FROM adv), 0 FROM steps, range(0, 50) r(slot)),
examples AS (
  SELECT 'negative' AS class, idx, l_orderkey AS id FROM bank UNION ALL
  SELECT 'positive', idx, o_orderkey FROM pos UNION ALL SELECT 'adversarial', idx, o_orderkey FROM adv)
SELECT step, class, label, count(*) AS n, CAST(sum(idx) AS BIGINT) AS idx_sum, CAST(sum(id) AS BIGINT) AS id_sum
FROM draws JOIN examples USING (class, idx) GROUP BY ALL""")
def cyclic_batches(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    adversarial = F.col("o_orderstatus") == "F"
    parts = {"negative": bank(spark, sf_dir).select("idx", F.col("l_orderkey").alias("id"))}
    for name, chosen in {"positive": ~adversarial, "adversarial": adversarial}.items():
        rows = orders.where(chosen).select(F.col("o_orderkey").alias("id"))
        parts[name] = positions.row_positions(rows, [], ["id"], "idx")
    examples = None
    for name, rows in parts.items():
        rows = rows.select(F.lit(name).alias("class"), "idx", "id")
        examples = rows if examples is None else examples.unionByName(rows)
    kinds = orders.agg(
        F.count_if(~adversarial).alias("positive"), F.count_if(adversarial).alias("adversarial")
    ).first()
    sizes = {"negative": table(spark, sf_dir, "lineitem").count(), **kinds.asDict()}
    steps = -(-2 * sizes["negative"] // 1024)
    drawn = batches.drawn_examples(examples, steps, sizes, BATCH_ROWS)
    return drawn.groupBy("step", "class", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("idx").alias("idx_sum"), F.sum("id").alias("id_sum")
    )


CLIPS_SQL = """
clips AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS clip_no FROM documents),
rounds AS (
  SELECT doc_id, clip_no, r.round::INTEGER AS round, r.round * (SELECT count(*) FROM clips) + clip_no AS pos
  FROM clips CROSS JOIN (VALUES (0), (1), (2)) r(round))"""
BITS_SQL = "CAST('0x' || substr(sha256({0}), 1, 12) AS BIGINT)"


def bits_sql(*parts: str) -> str:
    return BITS_SQL.format(f"'{SEED}|' || " + " || '|' || ".join(parts))


def clips(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id")
    return positions.row_positions(rows, [], ["doc_id"], "clip_no")


def rounds(spark, sf_dir, n=3):
    return batches.augmentation_rounds(
        clips(spark, sf_dir), table(spark, sf_dir, "documents").count(), n
    )


@query("smp14_augmentation_rounds", f"WITH {CLIPS_SQL} SELECT * FROM rounds")
def augmentation_rounds(spark, sf_dir):
    return rounds(spark, sf_dir)


CONDITION_SQL = ", ".join(
    "('{}', {}, {})".format(
        c, "NULL" if c == "clean" else f"'{c}'",
        ", ".join(f"{p}::DOUBLE" for p in batches.condition_settings(c).values()))
    for c in CONDITIONS
)


@query("smp15_condition_fan_out", f"""WITH {CLIPS_SQL}
SELECT * FROM clips CROSS JOIN (VALUES {CONDITION_SQL}) c(condition, pool_role,
  {', '.join('p_' + name for name in AUGMENT_PROBABILITY)})""")
def condition_fan_out(spark, sf_dir):
    return batches.condition_fan_out(clips(spark, sf_dir))


BACKGROUND_SQL = f"""WITH {CLIPS_SQL},
pool AS (SELECT lang AS role, doc_id AS file, row_number() OVER (ORDER BY lang, doc_id) - 1 AS file_no
         FROM documents),
drawn AS (
  SELECT r.round, r.clip_no, p.file_no, p.role, p.file FROM rounds r JOIN pool p
    ON p.file_no = {bits_sql("'bg'", "r.round", "r.clip_no")} % (SELECT count(*) FROM pool))"""


def drawn_backgrounds(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    files = positions.row_positions(
        documents.select(F.col("lang").alias("role"), F.col("doc_id").alias("file")),
        [], ["role", "file"], "file_no",
    )
    return batches.draw_backgrounds(rounds(spark, sf_dir), files, documents.count(), SEED)


@query("jn7_background_draws", BACKGROUND_SQL + " SELECT * FROM drawn")
def background_draws(spark, sf_dir):
    return drawn_backgrounds(spark, sf_dir).select("round", "clip_no", "file_no", "role", "file")


@query("agg22_draw_shares", BACKGROUND_SQL + """
SELECT role, count(*) AS draws, round(count(*) / (SELECT count(*) FROM drawn), 6) AS share
FROM drawn GROUP BY role""")
def draw_shares(spark, sf_dir):
    return batches.draw_shares(drawn_backgrounds(spark, sf_dir))


def unit_sql(*parts: str) -> str:
    return f"({bits_sql(*parts)} / 281474976710656.0)"


EFFECTS_SQL = ", ".join(
    "{} < {} AS use_{}".format(
        unit_sql(f"'{name}'", "batch") if name == "rir" else unit_sql(f"'{name}'", "round", "clip_no"),
        p, name)
    for name, p in AUGMENT_PROBABILITY.items()
)


@query("aud7_augmentation_plan", f"""WITH {CLIPS_SQL},
b AS (SELECT *, pos // 16 AS batch FROM rounds)
SELECT round, clip_no, pos, batch, {EFFECTS_SQL},
       round(-10.0 + {unit_sql("'snr'", "round", "clip_no")} * 25, 6) AS snr_db,
       {bits_sql("'rir_no'", "batch")} % 272 AS rir_no FROM b""")
def augmentation_plan(spark, sf_dir):
    plan = batches.augmentation_plan(rounds(spark, sf_dir), 272, SEED)
    return plan.drop("doc_id").withColumn("snr_db", F.round("snr_db", 6))


# --- checks --------------------------------------------------------------------------


@query("flt4_hard_examples", "WITH" + fx.CANDIDATES_SQL + """
SELECT candidate, event_id, label, score FROM (
  SELECT candidate, event_id, CASE event_type WHEN 'purchase' THEN 1 ELSE 0 END AS label, score FROM scored)
WHERE NOT ((label = 0 AND score < 0.1) OR (label = 1 AND score > 0.7))""")
def hard_examples(spark, sf_dir):
    rows = fx.candidate_scores(spark, sf_dir).select(
        "candidate", "event_id", (F.col("event_type") == "purchase").cast("int").alias("label"), "score"
    )
    return quality.hard_examples(rows, 0.1, 0.7)


@query("flt5_shape_audit", """
SELECT label, count(*) AS n_rows, 4 AS min_frames, 4 AS max_frames, 16 AS min_width, 16 AS max_width,
       true AS fits FROM embeddings GROUP BY label""")
def shape_audit(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        "label",
        F.transform(
            F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(F.col("embedding"), i * 16 + 1, 16)
        ).alias("x"),
    )
    return quality.shape_audit(rows, ["label"], "x", 4, 16)


#: Inputs of a job, as (name, dimensions, frames, width, input of the same shape). Two are
#: made by cutting the vectors of a label another way, one isn't there.
EXPECTED = [
    ("positive", [3], 4, 16, None), ("positive_noise", [3], 4, 16, "positive"), ("positive_short", [3], 4, 16, "positive"),
    ("flat", [2], None, 64, None), ("either", [2, 3], 4, 64, None), ("windows", [2, 3], 4, 16, None),
    ("wide", [3], 4, 96, None), ("stacked", [2], None, 16, None), ("absent", [3], 4, 16, None),
]


@query("flt5_input_violations", """
WITH sizes AS (SELECT count(*) AS n, count(*) FILTER (label = 0) AS n0 FROM embeddings),
rules AS (
  SELECT 'positive_short' AS input, 'same shape' AS rule, '(' || n0 || ', 4, 16)' AS found,
         '(' || n || ', 4, 16)' AS wanted, n0 <> n AS broken FROM sizes
  UNION ALL SELECT 'windows', 'frames', '(' || n || ', 8, 16)', '4', true FROM sizes
  UNION ALL SELECT 'wide', 'width', '(' || n || ', 4, 16)', '96', true FROM sizes
  UNION ALL SELECT 'stacked', 'dimensions', '(' || n || ', 4, 16)', '2', true FROM sizes
  UNION ALL SELECT 'absent', 'missing', NULL, 'an array', true FROM sizes)
SELECT input, rule, found, wanted FROM rules WHERE broken""")
def input_violations(spark, sf_dir):
    """Each rule broken once, and inputs that keep all of them."""
    vectors = table(spark, sf_dir, "embeddings")

    def cut(name, frames, width, rows=vectors):
        x = F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda i: F.slice("embedding", i % 4 * width + 1, width))
        return rows.select(F.lit(name).alias("input"), x.alias("x"))

    made = cut("positive", 4, 16)
    for part in (
        cut("positive_noise", 4, 16), cut("positive_short", 4, 16, vectors.where("label = 0")),
        cut("windows", 8, 16), cut("wide", 4, 16), cut("stacked", 4, 16),
    ):
        made = made.unionByName(part)
    headers = quality.shapes(made, ["input"], "x").select(
        "input", F.array("n_rows", F.col("max_frames").cast("long"), F.col("max_width").cast("long")).alias("shape")
    )
    flat = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).cast("long").alias("width"))
    for name in ("flat", "either"):
        headers = headers.unionByName(flat.select(F.lit(name).alias("input"), F.array("n", "width").alias("shape")))
    expected = spark.createDataFrame(
        EXPECTED, "input string, dims array<int>, frames long, width long, same_as string"
    )
    return quality.input_violations(expected, headers)


@query("flt6_probe_checksum", """
SELECT count(*) AS n_rows, round(sum(list_sum(embedding::DOUBLE[])), 4) AS checksum FROM embeddings""")
def probe_checksum(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), "embedding")
    return quality.probe_checksum(rows, "embedding")


@query("flt7_score_sanity", "WITH" + fx.CANDIDATES_SQL + """,
s AS (SELECT candidate, CASE WHEN event_id % 50 = 0 THEN score * 2 WHEN event_id % 77 <> 0 THEN score END AS score
      FROM scored)
SELECT candidate, count(*) AS n, count(*) FILTER (score IS NULL OR NOT score BETWEEN 0 AND 1) AS bad,
       count(*) FILTER (score IS NULL OR NOT score BETWEEN 0 AND 1) = 0 AS sane
FROM s GROUP BY candidate""")
def score_sanity(spark, sf_dir):
    scores = fx.candidate_scores(spark, sf_dir).withColumn(
        "score",
        F.when(F.col("event_id") % 50 == 0, F.col("score") * 2)
        .when(F.col("event_id") % 77 != 0, F.col("score")),
    )
    return quality.score_sanity(scores, ["candidate"])


@query("flt8_score_parity", """
WITH s AS (SELECT value / (value + 35.0) AS a, CAST(value / (value + 35.0) AS FLOAT)::DOUBLE AS b FROM events)
SELECT count(*) AS n, max(abs(a - b)) AS max_diff, max(abs(a - b)) < 1e-4 AS agrees FROM s""")
def score_parity(spark, sf_dir):
    score = F.col("value") / (F.col("value") + 35.0)
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), score.alias("score"))
    narrow = rows.withColumn("score", F.col("score").cast("float").cast("double"))
    return quality.score_parity(rows, narrow)


@query("flt9_resolve_threshold", """
WITH requests AS (
  SELECT c_custkey AS request, c_nationkey AS model, CASE c_mktsegment WHEN 'BUILDING' THEN 0.2
         WHEN 'MACHINERY' THEN 0.5 WHEN 'FURNITURE' THEN 1.0 ELSE 2.0 END::DOUBLE AS budget,
         CASE WHEN c_custkey % 7 = 0 THEN c_acctbal / 10000 END AS given FROM customer),
profiles AS (
  SELECT n_nationkey AS model, b.budget::DOUBLE AS budget,
         CASE WHEN (n_nationkey + b.budget * 10) % 3 <> 0 THEN n_nationkey / 100.0 + b.budget / 10 END::DOUBLE AS threshold
  FROM nation CROSS JOIN (VALUES (0.2::DOUBLE), (0.5), (1.0)) b(budget) WHERE n_nationkey % 4 <> 0)
SELECT request, r.model, r.budget, given, round(coalesce(given, threshold, 0.5), 9) AS used,
       CASE WHEN given IS NOT NULL THEN 'given'
            WHEN r.model NOT IN (SELECT model FROM profiles) THEN 'default: no metrics'
            WHEN threshold IS NULL THEN 'default: budget not reachable' ELSE 'measured' END AS reason
FROM requests r LEFT JOIN profiles p ON p.model = r.model AND p.budget = r.budget""")
def resolve_threshold(spark, sf_dir):
    segment = F.col("c_mktsegment")
    requests = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("request"), F.col("c_nationkey").alias("model"),
        F.when(segment == "BUILDING", 0.2).when(segment == "MACHINERY", 0.5)
        .when(segment == "FURNITURE", 1.0).otherwise(2.0).alias("budget"),
        F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") / 10000).alias("given"),
    )
    budgets = F.array(F.lit(0.2), F.lit(0.5), F.lit(1.0))
    profiles = table(spark, sf_dir, "nation").where("n_nationkey % 4 <> 0").select(
        F.col("n_nationkey").alias("model"), F.explode(budgets).alias("budget")
    ).withColumn("threshold", F.when(
        (F.col("model") + F.col("budget") * 10) % 3 != 0,
        F.col("model") / 100.0 + F.col("budget") / 10))
    return quality.resolve_thresholds(requests, profiles).withColumn("used", F.round("used", 9))


@query("flt10_frame_count", """
SELECT l_orderkey * 7 AS n_samples,
       CAST(floor((ceil(l_orderkey * 7 / 160.0 - 3) - 76) / 8) + 1 AS BIGINT) AS frames
FROM lineitem GROUP BY l_orderkey""")
def frame_count(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 7).alias("n_samples")).distinct()
    return rows.select("n_samples", scalars.frame_count("n_samples").alias("frames"))


@query("flt11_set_hours", """
SELECT label, count(*) AS frames, round(count(*) * 0.08 / 3600, 6) AS hours_by_frames,
       round((count(*) - 15) * 0.08 / 3600, 6) AS hours_by_windows FROM embeddings GROUP BY label""")
def set_hours(spark, sf_dir):
    sizes = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("frames"))
    by_frames, by_windows = quality.set_hours(F.col("frames"), WINDOW, F.lit(0.08))
    return sizes.select(
        "label", "frames", F.round(by_frames, 6).alias("hours_by_frames"),
        F.round(by_windows, 6).alias("hours_by_windows"),
    )


@query("src11_frame_limit", "WITH" + fx.FRAMES_SQL + """
SELECT stream_id, frames, frame_limit, least(frames, coalesce(frame_limit, frames)) AS kept,
       round(greatest((least(frames, coalesce(frame_limit, frames)) - 15) * 0.08 / 3600, 0), 6) AS hours
FROM (SELECT stream_id, count(*) AS frames FROM frames GROUP BY 1)
CROSS JOIN (VALUES (20::BIGINT), (60), (NULL)) l(frame_limit)""")
def frame_limit(spark, sf_dir):
    sizes = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("stream_id")).agg(
        F.count(F.lit(1)).alias("frames")
    )
    return quality.limited_hours(sizes, [20, 60, None], WINDOW, 0.08)
