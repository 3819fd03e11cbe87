"""Audio jobs: decoding, mixing at a ratio, reverb, augmentation and features.

Whole-table work (which clip meets which background, which stretch of a pool is
needed) is joins and expressions; NumPy sees one clip at a time inside tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType

from earshot.constants import SAMPLE_RATE, WINDOW_FRAMES
from earshot.functions import dsp, scalars
from earshot.session import broadcast_if_small, pin


# Types are objects here: strings would need a session at import time.
@pandas_udf(ArrayType(FloatType()))
def decode(content: pd.Series) -> pd.Series:
    """Mono 16 kHz samples of a PCM WAV; NULL when it cannot be read."""
    return content.map(dsp.decode_wav)


@pandas_udf(BinaryType())
def encode(samples: pd.Series, rate: pd.Series, channels: pd.Series) -> pd.Series:
    return pd.Series([
        dsp.encode_wav(s, int(r), int(c)) for s, r, c in zip(samples, rate, channels)
    ])


@pandas_udf(ArrayType(DoubleType()))
def reverb(voice: pd.Series, response: pd.Series) -> pd.Series:
    return pd.Series([dsp.reverberate(v, r) for v, r in zip(voice, response)])


def right_aligned(samples: Column, length: int, jitter: Column) -> Column:
    """Place a clip so that it ends ``jitter`` samples before the end of a window."""
    before = F.lit(length) - F.size(samples) - jitter
    kept = F.slice(samples, F.greatest(F.lit(1), 1 - before), F.size(samples))
    zeros = lambda n: F.array_repeat(F.lit(0.0), F.greatest(n, F.lit(0)).cast("int"))
    placed = F.concat(zeros(before), kept.cast("array<double>"), zeros(jitter))
    return F.slice(placed, F.lit(1), F.lit(length))


def padded(samples: Column, pad: int) -> Column:
    silence = F.array_repeat(F.lit(0.0), pad)
    return F.concat(silence, samples.cast("array<double>"), silence)


def pool_levels(pools: DataFrame) -> DataFrame:
    """Per role: samples and RMS of a whole pool of (role, seg, pcm), one row each."""
    power = F.aggregate("pcm", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return pools.groupBy("role").agg(
        F.sum(F.size("pcm")).cast("long").alias("pool_len"),
        F.sqrt(F.sum(power) / F.sum(F.size("pcm"))).alias("pool_rms"),
    )


def interference_slices(
    plan: DataFrame, pools: DataFrame, segment: int, seed: int | str, starts: str | None = None
) -> DataFrame:
    """Add ``noise``: a random stretch of the role's pool, ``need`` samples long.

    ``plan`` rows have ``role``, ``row_id`` and ``need``. A pool is stored as
    segments of ``segment`` samples numbered from 0; only the segments that a
    stretch touches are joined, so the pool is never copied whole.
    """
    levels = pin(pool_levels(pools))
    pools = broadcast_if_small(pools)
    room = F.col("pool_len") - F.col("need")
    fits = F.assert_true(room > 0, F.lit("pool is shorter than a padded clip"))
    start = (
        F.col(starts) if starts else F.pmod(scalars.seeded_bits(seed, "row_id", "role"), room)
    )
    located = (
        plan.join(broadcast_if_small(levels), "role").where(fits.isNull())
        .withColumn("_start", start)
    )
    last = F.col("_start") + F.col("need") - 1
    pieces = located.select("row_id", "role", "_start", "need", F.explode(F.sequence(
        F.floor(F.col("_start") / segment), F.floor(last / segment))).alias("seg"))
    offset = F.col("seg") * segment
    first = F.greatest(F.col("_start") - offset, F.lit(0))
    stop = F.least(F.col("_start") + F.col("need") - offset, F.lit(segment))
    cut = F.slice("pcm", (first + 1).cast("int"), (stop - first).cast("int"))
    stretches = (
        pieces.join(pools, ["role", "seg"])
        .groupBy("row_id", "role")
        .agg(F.flatten(F.transform(
            F.array_sort(F.collect_list(F.struct("seg", cut.alias("pcm")))), lambda p: p["pcm"]
        )).alias("noise"))
    )
    return located.join(stretches, ["row_id", "role"]).drop("_start", "pool_len")


def mix_at_snr(
    grid: DataFrame, pools: DataFrame, segment: int, seed: int, pad: int = SAMPLE_RATE
) -> DataFrame:
    """Rows (row_id, role, snr, pcm): voices padded and mixed at a true SNR.

    ``grid`` has (row_id, role, snr, pcm); a NULL snr stays clean. Pools are brought
    to unit RMS, so the label of a cell is the ratio that was mixed.
    """
    rows = grid.withColumn("pcm", F.col("pcm").cast("array<double>"))
    clean = rows.where(F.col("snr").isNull()).select(
        "row_id", "role", "snr", padded(F.col("pcm"), pad).alias("pcm")
    )
    noisy = interference_slices(
        rows.where(F.col("snr").isNotNull()).withColumn(
            "need", (F.size("pcm") + 2 * pad).cast("long")),
        pools, segment, seed,
    )
    gain = scalars.snr_gain(scalars.rms_padded("pcm"), F.col("snr")) / F.col("pool_rms")
    mixed = F.zip_with(
        padded(F.col("pcm"), pad), "noise", lambda v, n: v + n.cast("double") * F.col("_gain")
    )
    return clean.unionByName(
        noisy.withColumn("_gain", gain).select("row_id", "role", "snr", mixed.alias("pcm"))
    )


def noise_pools(pools: DataFrame, segment: int, seed: int) -> DataFrame:
    """Rows (role, seg, pcm) of unit-RMS white and pink noise for (role, seg) rows.

    Every segment is drawn on its own from a seed made of the role and its number.
    """

    @pandas_udf("array<double>")
    def draw(role: pd.Series, seg: pd.Series, key: pd.Series) -> pd.Series:
        make = {"white": dsp.white_noise, "pink": dsp.pink_noise}
        return pd.Series([make[r](segment, int(k)) for r, k in zip(role, key)])

    keyed = pools.withColumn("_key", scalars.seeded_bits(seed, "role", "seg"))
    return keyed.select("role", "seg", draw("role", "seg", "_key").alias("pcm"))


def stress_babble(
    wanted: DataFrame, speech: DataFrame, segment: int, length: int, seed: int, talkers: int = 4
) -> DataFrame:
    """Rows (babble, pcm): copies of real speech at random starts, offset and summed.

    ``speech`` is a pool of (role, seg, pcm). Copy i is rolled by 3 * i seconds; the
    sum has unit RMS.
    """
    copies = wanted.select(
        "babble", F.explode(F.sequence(F.lit(0), F.lit(talkers - 1))).alias("copy")
    ).withColumns({
        "role": F.lit("speech"), "need": F.lit(length).cast("long"),
        "row_id": F.concat_ws("/", F.col("babble").cast("string"), F.col("copy").cast("string")),
    })
    cut = interference_slices(copies, speech, segment, seed)
    shift = F.pmod(F.col("copy") * 3 * SAMPLE_RATE, F.lit(length)).cast("int")
    turned = F.concat(
        F.slice("noise", length - shift + 1, shift), F.slice("noise", F.lit(1), length - shift)
    )
    parts = cut.groupBy("babble").agg(
        F.array_sort(F.collect_list(F.struct("copy", turned.alias("pcm")))).alias("parts")
    )
    total = F.aggregate(
        "parts", F.array_repeat(F.lit(0.0), length),
        lambda acc, p: F.zip_with(acc, p["pcm"], lambda a, b: a + b.cast("double")),
    )
    return parts.select("babble", total.alias("pcm")).withColumn(
        "pcm", scalars.scaled("pcm", scalars.rms_padded("pcm"))
    )


def apply_augmentation(planned: DataFrame, responses: DataFrame, seed: int) -> DataFrame:
    """Add ``augmented`` to rows with ``pcm``, ``noise`` and the columns of the plan.

    ``responses`` has (rir_no, response). Each row is treated alone, in the order
    background, impulse response, gain, saturation, noise; there is no state
    between rows or batches.
    """

    @pandas_udf("array<double>")
    def treat(voice: pd.Series, noise: pd.Series, response: pd.Series, draws: pd.DataFrame) -> pd.Series:
        import numpy as np

        out = []
        for v, n, r, d in zip(voice, noise, response, draws.itertuples(index=False)):
            y = np.asarray(v, dtype=np.float64)
            if d.use_background and n is not None:
                n = np.resize(np.asarray(n, dtype=np.float64), len(y))
                gain = dsp.level(y) / 10 ** (d.snr_db / 20) / (dsp.level(n) + 1e-9)
                y = y + n * gain
            if d.use_rir and r is not None:
                y = dsp.reverberate(y, r, tail=0.0)
            if d.use_gain:
                y = y * 10 ** (d.gain_db / 20)
            if d.use_tanh:
                y = np.tanh(y)
            if d.use_noise:
                y = y + dsp.white_noise(len(y), int(d.noise_key)) * dsp.level(y) * 10 ** (-d.noise_snr / 20)
            out.append(y)
        return pd.Series(out)

    key = ["round", "clip_no"]
    draws = F.struct(
        "use_background", "use_rir", "use_gain", "use_tanh", "use_noise", "snr_db",
        (scalars.seeded_unit(seed, F.lit("gain_db"), *key) * 12 - 6).alias("gain_db"),
        (scalars.seeded_unit(seed, F.lit("noise_snr"), *key) * 27 + 3).alias("noise_snr"),
        scalars.seeded_bits(seed, F.lit("noise_key"), *key).alias("noise_key"),
    )
    used = responses.select("rir_no", F.slice("response", 1, SAMPLE_RATE).alias("response"))
    return planned.join(broadcast_if_small(used), "rir_no", "left").withColumn(
        "augmented", treat("pcm", "noise", "response", draws)
    )


def featurise(clips: DataFrame, column: str = "pcm", model_path: str | None = None) -> DataFrame:
    """Add ``x``, a (16, 96) array per clip, from an ONNX model or log-mel energies.

    The session is opened once per worker. Without a model the shape is the same
    but the values are not those of the embedding.
    """

    @pandas_udf("array<array<float>>")
    def extract(parts: pd.Series) -> pd.Series:
        if model_path is None:
            return parts.map(lambda s: list(dsp.log_mel_features(s)))
        import numpy as np

        from earshot.operators.scoring import onnx_session

        session = onnx_session(model_path)
        name = session.get_inputs()[0].name
        return parts.map(lambda s: list(
            session.run(None, {name: np.asarray(s, dtype=np.float32)[None, :]})[0].reshape(
                WINDOW_FRAMES, -1)))

    return clips.withColumn("x", extract(column))


def require_rows(features: DataFrame, planned: int) -> DataFrame:
    """Fail when the number of feature rows is not the number planned."""
    return features.agg(F.count(F.lit(1)).alias("n_rows")).where(
        F.assert_true(F.col("n_rows") == planned, F.lit(f"expected {planned} rows")).isNull()
    )
