"""Audio jobs and scoring on vectors read as short clips."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.constants import STRESS_SNRS
from earshot.functions import scalars
from earshot.operators import audio, batches, positions, roc, scoring, stress
from earshot.plans import evaluation, live
from earshot.plans import fixtures as fx
from earshot.plans.registry import query, table
from earshot.session import broadcast_if_small, spread
from earshot.sources import ingest, npy, publish

SEED = 3
SEGMENT = 64
PAD = 16
ROLES = ["speech", "music", "env"]

POOL_ROLE_SQL = "CASE WHEN label < 5 THEN 'speech' WHEN label < 7 THEN 'music' ELSE 'env' END"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def pools(spark, sf_dir):
    """(role, seg, pcm): the vectors of a role laid end to end."""
    label = F.col("label")
    role = F.when(label < 5, "speech").when(label < 7, "music").otherwise("env")
    rows = vectors(spark, sf_dir).where("label >= 2").select(role.alias("role"), "vec_id")
    placed = positions.row_positions(rows, ["role"], ["vec_id"], "seg")
    audio_of = vectors(spark, sf_dir).select("vec_id", F.col("embedding").alias("pcm"))
    return placed.join(audio_of, "vec_id").drop("vec_id")


# --- levels -----------------------------------------------------------------------

LOUD_SQL = """loud AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda v: v * (label + 1)) AS x FROM embeddings),
power AS (
  SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)) AS rms,
         list_max(list_transform(x, lambda v: abs(v))) AS peak FROM loud)"""


def loud(spark, sf_dir):
    return vectors(spark, sf_dir).select(
        "vec_id", F.transform("embedding", lambda v: v.cast("double") * (F.col("label") + 1)).alias("x")
    )


def total(column):
    return F.aggregate(column, F.lit(0.0), lambda a, v: a + v.cast("double"))


@query("agg1_rms", f"""WITH {LOUD_SQL}
SELECT vec_id, round(rms, 9) AS rms, round(greatest(rms, 1e-6), 9) AS floored, round(rms + 1e-9, 9) AS padded
FROM power""")
def rms(spark, sf_dir):
    return loud(spark, sf_dir).select(
        "vec_id", F.round(scalars.rms("x"), 9).alias("rms"),
        F.round(scalars.rms_floored("x"), 9).alias("floored"),
        F.round(scalars.rms_padded("x"), 9).alias("padded"),
    )


@query("scl2_peak_guard", f"""WITH {LOUD_SQL}
SELECT vec_id, round(list_max(g), 9) AS top, round(list_sum(g), 6) AS total
FROM (SELECT vec_id, list_transform(x, lambda v: v / greatest(1, peak)) AS g FROM power)""")
def peak_guard(spark, sf_dir):
    rows = loud(spark, sf_dir).select("vec_id", scalars.peak_guard("x").alias("g"))
    return rows.select(
        "vec_id", F.round(F.array_max("g"), 9).alias("top"), F.round(total("g"), 6).alias("total")
    )


@query("scl3_level_normalise", f"""WITH {LOUD_SQL}
SELECT vec_id, round(list_max(g), 9) AS top, round(list_sum(g), 6) AS total
FROM (SELECT vec_id, list_transform(x, lambda v: v / greatest(greatest(rms, 1e-6) / 0.1, peak / 0.99)) AS g FROM power)""")
def level_normalise(spark, sf_dir):
    rows = loud(spark, sf_dir).select("vec_id", scalars.level_normalise("x").alias("g"))
    return rows.select(
        "vec_id", F.round(F.array_max("g"), 9).alias("top"), F.round(total("g"), 6).alias("total")
    )


@query("scl4_pcm16", """
SELECT vec_id, i - 1 AS at, CAST(trunc(embedding[i]::DOUBLE * 32767) AS INTEGER) AS sample
FROM embeddings CROSS JOIN range(1, 65) r(i)""")
def pcm16(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(
        "vec_id", scalars.pcm16(F.col("embedding").cast("array<double>")).alias("pcm")
    )
    return rows.select("vec_id", F.posexplode("pcm").alias("at", "sample")).select(
        "vec_id", F.col("at").cast("long").alias("at"), F.col("sample").cast("int").alias("sample")
    )


@query("scl5_snr_gain", f"""WITH {LOUD_SQL}
SELECT vec_id, snr, round((rms + 1e-9) / pow(10.0, snr / 20), 9) AS gain
FROM power CROSS JOIN (VALUES (20), (15), (10), (5), (0)) s(snr)""")
def snr_gain(spark, sf_dir):
    snrs = F.array(*[F.lit(s) for s in STRESS_SNRS])
    return loud(spark, sf_dir).select("vec_id", "x", F.explode(snrs).alias("snr")).select(
        "vec_id", "snr", F.round(scalars.snr_gain(scalars.rms_padded("x"), F.col("snr")), 9).alias("gain")
    )


@query("aud6_right_aligned", """
SELECT vec_id, i AS at, CASE WHEN i >= lead AND i < lead + 64 THEN embedding[i - lead + 1] ELSE 0 END::DOUBLE AS sample
FROM (SELECT vec_id, embedding, 100 - 64 - vec_id % 20 AS lead FROM embeddings) CROSS JOIN range(0, 100) r(i)""")
def right_aligned(spark, sf_dir):
    jitter = (F.col("vec_id") % 20).cast("int")
    placed = audio.right_aligned(F.col("embedding"), 100, jitter)
    return vectors(spark, sf_dir).select("vec_id", F.posexplode(placed).alias("at", "sample")).select(
        "vec_id", F.col("at").cast("long").alias("at"), "sample"
    )


# --- decoding, archives, feature arrays ----------------------------------------------


def encoded(spark, sf_dir):
    """WAV bytes per vector; odd vectors are stereo."""
    return vectors(spark, sf_dir).select(
        "vec_id", "label",
        audio.encode("embedding", F.lit(16000), (F.col("vec_id") % 2 + 1)).alias("content"),
    )


@query("aud1_decode", """
WITH q AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda v: trunc(v * 32767) / 32768) AS x FROM embeddings)
SELECT vec_id, CASE WHEN vec_id % 2 = 1 THEN 32 ELSE 64 END AS n_samples,
       round(list_sum(x) / (vec_id % 2 + 1), 5) AS total FROM q""")
def decode(spark, sf_dir):
    rows = encoded(spark, sf_dir).select("vec_id", audio.decode("content").alias("pcm"))
    return rows.select("vec_id", F.size("pcm").alias("n_samples"), F.round(total("pcm"), 5).alias("total"))


@query("src4_archive_scan", """
SELECT label || '/' || vec_id || CASE WHEN vec_id % 3 = 0 THEN '.WAV' ELSE '.wav' END AS path,
       CASE WHEN vec_id % 2 = 1 THEN 32 ELSE 64 END AS n_samples
FROM embeddings WHERE vec_id % 7 <> 0""")
def archive_scan(spark, sf_dir):
    """Archives with audio and other members, packed by tasks, then scanned."""
    folder = publish.mounted(publish.shared_folder(spark, "archives"))
    suffix = (
        F.when(F.col("vec_id") % 7 == 0, ".txt").when(F.col("vec_id") % 3 == 0, ".WAV").otherwise(".wav")
    )
    members = encoded(spark, sf_dir).select(
        F.concat("label", F.lit("/"), "vec_id", suffix).alias("path"), "content"
    )
    publish.write_archives(members, folder)
    found = ingest.scan_archives(spark, folder)
    return found.select("path", F.size(audio.decode("content")).alias("n_samples"))


@query("src9_npy_scan", """
SELECT 4 AS frames, 16 AS width, round(list_sum(embedding::DOUBLE[]), 4) AS total, count(*) AS n
FROM embeddings GROUP BY ALL""")
def npy_scan(spark, sf_dir):
    folder = publish.mounted(publish.shared_folder(spark, "arrays"))
    windows = vectors(spark, sf_dir).select(F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(F.col("embedding"), i * 16 + 1, 16)).alias("x"))
    npy.register(spark)
    npy.write_npy(windows, folder)
    rows = spark.read.format("npy").load(folder)
    return rows.groupBy(
        F.size("x").alias("frames"), F.size(F.col("x")[0]).alias("width"),
        F.round(total(F.flatten("x")), 4).alias("total"),
    ).agg(F.count(F.lit(1)).alias("n"))


# --- mixing -----------------------------------------------------------------------------

CELL_SQL = "vec_id || '/' || role || '@' || snr"


def grid(spark, sf_dir):
    voices = vectors(spark, sf_dir).where("label < 2").select("vec_id", F.col("embedding").alias("pcm"))
    cells = stress.stress_grid(voices, ROLES)
    name = F.concat_ws("/", F.col("vec_id").cast("string"), stress.cell_key())
    return cells.withColumn("row_id", name)


@query("aud4_mix_at_snr", f"""
WITH pool AS (
  SELECT {POOL_ROLE_SQL} AS role, flatten(list(embedding::DOUBLE[] ORDER BY vec_id)) AS pcm
  FROM embeddings WHERE label >= 2 GROUP BY 1),
leveled AS (SELECT role, pcm, len(pcm) AS n, sqrt(list_sum(list_transform(pcm, lambda v: v * v)) / len(pcm)) AS rms FROM pool),
voices AS (
  SELECT vec_id, embedding::DOUBLE[] AS v,
         sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) / 64) + 1e-9 AS rms
  FROM embeddings WHERE label < 2),
cells AS (
  SELECT {CELL_SQL} AS row_id, v, role, snr, voices.rms / pow(10.0, snr / 20) / leveled.rms AS gain, pcm,
         CAST('0x' || substr(sha256('{SEED}|' || {CELL_SQL} || '|' || role), 1, 12) AS BIGINT) % (n - 96) AS start
  FROM voices CROSS JOIN leveled CROSS JOIN (VALUES (20), (15), (10), (5), (0)) s(snr)),
mixed AS (
  SELECT row_id, role, snr, list_transform(range(1, 97), lambda i:
    (CASE WHEN i > {PAD} AND i <= {PAD} + 64 THEN v[i - {PAD}] ELSE 0 END) + pcm[start + i] * gain) AS x FROM cells)
SELECT row_id, role, snr, round(list_sum(x), 6) AS total,
       round(sqrt(list_sum(list_transform(x, lambda s: s * s)) / 96), 8) AS rms FROM mixed
UNION ALL
SELECT vec_id || '/clean', 'clean', NULL, round(list_sum(v), 6),
       round(sqrt(list_sum(list_transform(v, lambda s: s * s)) / 96), 8) FROM voices""")
def mix_at_snr(spark, sf_dir):
    mixed = audio.mix_at_snr(grid(spark, sf_dir), pools(spark, sf_dir), SEGMENT, SEED, PAD)
    return mixed.select(
        "row_id", "role", "snr", F.round(total("pcm"), 6).alias("total"),
        F.round(scalars.rms("pcm"), 8).alias("rms"),
    )


@query("aud5_reverb")
def reverb(spark, sf_dir):
    """Every vector through the response of its pool's first vector."""
    rooms = pools(spark, sf_dir).where("seg = 0").select("role", F.col("pcm").alias("response"))
    label = F.col("label")
    role = F.when(label < 5, "speech").when(label < 7, "music").otherwise("env")
    rows = vectors(spark, sf_dir).select("vec_id", role.alias("role"), F.col("embedding").alias("voice"))
    wet = rows.join(broadcast_if_small(rooms), "role").select(
        "vec_id", audio.reverb("voice", "response").alias("wet")
    )
    return wet.select("vec_id", F.size("wet").alias("n_samples"), F.round(scalars.rms("wet"), 6).alias("rms"))


def augmented(spark, sf_dir):
    clips = positions.row_positions(
        vectors(spark, sf_dir).select("vec_id", F.col("embedding").alias("pcm")), [], ["vec_id"], "clip_no"
    )
    files = vectors(spark, sf_dir).count()
    rounds = batches.augmentation_rounds(clips, files, 2)
    bank = clips.select(F.col("clip_no").alias("file_no"), F.col("pcm").alias("noise"))
    planned = batches.augmentation_plan(
        batches.draw_backgrounds(rounds, bank, files, SEED), 10, SEED
    )
    responses = vectors(spark, sf_dir).groupBy(F.col("label").cast("long").alias("rir_no")).agg(
        F.min_by("embedding", "vec_id").alias("response")
    )
    # Rows are small and their work is not: dealt by number, not left to be put together by size.
    planned = spread(planned, 2 * files, "round", "clip_no", rows_per_task=20_000)
    return audio.apply_augmentation(planned, responses, SEED)


@query("aud8_augment")
def augment(spark, sf_dir):
    return augmented(spark, sf_dir).select(
        "round", "clip_no", "pos", F.size("augmented").alias("n_samples"),
        F.round(scalars.rms("augmented"), 6).alias("rms"),
    )


@query("aud9_noise_pools")
def noise_pools(spark, sf_dir):
    kinds = F.array(F.lit("white"), F.lit("pink"))
    wanted = vectors(spark, sf_dir).select(F.explode(kinds).alias("role"), F.col("vec_id").alias("seg"))
    drawn = audio.noise_pools(wanted, 256, SEED)
    return drawn.select("role", "seg", F.size("pcm").alias("n_samples"), F.round(scalars.rms("pcm"), 6).alias("rms"))


@query("aud10_stress_babble")
def stress_babble(spark, sf_dir):
    speech = pools(spark, sf_dir).where("role = 'speech'")
    wanted = vectors(spark, sf_dir).select(F.col("vec_id").alias("babble"))
    made = audio.stress_babble(wanted, speech, SEGMENT, 200, SEED)
    return made.select("babble", F.size("pcm").alias("n_samples"), F.round(scalars.rms("pcm"), 6).alias("rms"))


@query("aud11_features")
def features(spark, sf_dir):
    rows = augmented(spark, sf_dir).select("round", "clip_no", "augmented")
    made = audio.featurise(rows, "augmented")
    return made.select(
        "round", "clip_no", F.size("x").alias("frames"), F.size(F.col("x")[0]).alias("width")
    )


# --- scoring ----------------------------------------------------------------------------


@query("ml1_score_windows", f"SELECT vec_id, round({live.LINEAR_SQL}, 6) AS score FROM embeddings")
def score_windows(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("vec_id", "embedding")
    scored = scoring.score_windows(rows, "embedding", scoring.LinearScorer(live.WEIGHTS, 0.1))
    return scored.select("vec_id", F.round("score", 6).alias("score"))


@query("ml1_linear_score", f"SELECT vec_id, round({live.LINEAR_SQL}, 9) AS score FROM embeddings")
def linear_score(spark, sf_dir):
    return vectors(spark, sf_dir).select(
        "vec_id", F.round(scoring.linear_score(F.col("embedding"), live.WEIGHTS, 0.1), 9).alias("score")
    )


@query("ml4_weighted_fit")
def weighted_fit(spark, sf_dir):
    """Mean score per label of a head that separates labels 0 to 2 from the rest."""
    rows = vectors(spark, sf_dir).select(
        "embedding", F.col("label").alias("kind"), (F.col("label") < 3).cast("int").alias("label")
    )
    model = scoring.fit_weighted(rows, "embedding", 2.0)
    weights, bias = model.coefficients.tolist(), float(model.intercept)
    return rows.groupBy("kind", "label").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(scoring.linear_score(F.col("embedding"), weights, bias)), 3).alias("mean_score"),
    )


@query("agg23_split_half", evaluation.transfer_sql(3))
def split_half(spark, sf_dir):
    scores, fa, sets = evaluation.scores_and_sets(spark, sf_dir)
    keep = ["final", "merged", "best_single", "baseline"]
    return roc.split_half_transfer(
        fa.where(F.col("candidate").isin(keep)), fx.positives(scores), sets, [0, 1, 2]
    )


# Half precision keeps 11 significant bits, fewer below 2 ** -14.
HALF_SQL = """),
scored AS (
  SELECT * EXCLUDE (score, step), round_even(score * step, 0) / step AS score FROM (
    SELECT *, CASE WHEN score < pow(2, -14) THEN pow(2, 24)
              ELSE pow(2, 10 - floor(log2(score))) END AS step FROM wide)),
fa AS ("""


@query("agg24_half_precision", evaluation.CURVE_SQL.replace("scored AS (", "wide AS (", 1).replace(
    "),\nfa AS (", HALF_SQL, 1) + "SELECT * FROM curve")
def half_precision(spark, sf_dir):
    scores, _, sets = evaluation.scores_and_sets(spark, sf_dir)
    narrow = scoring.half_precision(scores)
    return roc.curve(fx.false_accepts(narrow), fx.positives(narrow), sets)
