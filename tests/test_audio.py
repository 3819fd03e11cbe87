import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.functions import dsp
from earshot.operators import audio, scoring


def level(x):
    return np.sqrt(np.mean(np.square(x)))


def test_wav_round_trip_and_bad_input():
    x = np.sin(np.arange(3200) / 20) * 0.5
    assert np.allclose(dsp.decode_wav(dsp.encode_wav(x)), np.trunc(x * 32767) / 32768)
    assert len(dsp.decode_wav(dsp.encode_wav(x, 32000))) == 1600
    whole = dsp.encode_wav(x)
    for cut in (1, 2, 3):
        assert len(dsp.decode_wav(whole[:-cut])) in (len(x) - 1, len(x) - 2)
    wide = io.BytesIO()
    with wave.open(wide, "wb") as writer:
        writer.setnchannels(1)
        writer.setsampwidth(3)
        writer.setframerate(16000)
        writer.writeframes(b"".join(int(v * (1 << 23)).to_bytes(3, "little", signed=True) for v in (-1, -0.5, 0, 0.25)))
    assert dsp.decode_wav(wide.getvalue()).tolist() == [-1, -0.5, 0, 0.25]
    assert dsp.decode_wav(b"not audio") is None and dsp.decode_wav(None) is None


def test_resampling_keeps_a_tone():
    t = np.arange(22050) / 22050
    y = dsp.resample(np.sin(2 * np.pi * 440 * t), 22050, 16000)
    assert np.abs(y - np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)).max() < 1e-6


def test_mix_has_the_labelled_ratio(spark):
    rng = np.random.default_rng(0)
    voice = (rng.standard_normal(40) * 0.02).tolist()
    pool = [(seg, (rng.standard_normal(32) * 3).tolist()) for seg in range(20)]
    pools = spark.createDataFrame([("env", s, p) for s, p in pool], "role string, seg long, pcm array<double>")
    grid = spark.createDataFrame([(str(s), "env", s, voice) for s in (20, 0)] + [("c", "clean", None, voice)],
                                 "row_id string, role string, snr int, pcm array<double>")
    whole = np.concatenate([p for _, p in pool])
    clean = np.pad(voice, 8)
    for r in audio.mix_at_snr(grid, pools, 32, 1, pad=8).collect():
        noise = np.array(r.pcm) - clean
        if r.snr is None:
            assert np.allclose(noise, 0)
            continue
        gain = (level(voice) + 1e-9) / 10 ** (r.snr / 20) / level(whole)
        stretches = np.lib.stride_tricks.sliding_window_view(whole * gain, len(clean))
        assert np.isclose(np.abs(stretches - noise).max(axis=1).min(), 0, atol=1e-9)


def test_short_pool_is_an_error(spark):
    pools = spark.createDataFrame([("env", 0, [1.0] * 8)], "role string, seg long, pcm array<double>")
    grid = spark.createDataFrame([("a", "env", 0, [1.0] * 8)], "row_id string, role string, snr int, pcm array<double>")
    with pytest.raises(Exception, match="pool is shorter"):
        audio.mix_at_snr(grid, pools, 8, 1, pad=8).collect()


def test_reverb_equals_direct_convolution():
    rng = np.random.default_rng(2)
    voice, room = rng.standard_normal(50), rng.standard_normal(9)
    wet = np.convolve(voice, room)[:58]
    assert np.allclose(dsp.reverberate(voice, room), wet / (level(wet) + 1e-9) * (level(voice) + 1e-9))


def test_noise_is_unit_level_and_pink_falls():
    for make in (dsp.white_noise, dsp.pink_noise):
        assert level(make(4096, 1)) == pytest.approx(1, abs=1e-6)
    power = np.abs(np.fft.rfft(dsp.pink_noise(1 << 16, 1))) ** 2
    assert power[100:200].mean() / power[10000:20000].mean() == pytest.approx(100, rel=0.3)


def test_stress_babble_has_unit_level(spark):
    rng = np.random.default_rng(0)
    speech = spark.createDataFrame([("speech", s, rng.standard_normal(16).tolist()) for s in range(30)],
                                   "role string, seg long, pcm array<double>")
    made = audio.stress_babble(spark.range(3).withColumnRenamed("id", "babble"), speech, 16, 50, 1)
    assert [level(r.pcm) for r in made.collect()] == pytest.approx([1, 1, 1], abs=1e-6)


def test_smoke_features_have_the_model_shape(spark):
    rng = np.random.default_rng(0)
    clips = spark.createDataFrame([(i, (rng.standard_normal(9600) * 0.05).tolist()) for i in range(3)],
                                  "n long, pcm array<double>")
    rows = audio.featurise(clips).collect()
    assert np.array([r.x for r in rows]).shape == (3, 16, 96)
    assert np.isfinite(np.array([r.x for r in rows])).all()


def test_augmentation_applies_only_what_was_drawn(spark):
    base = dict(round=0, clip_no=1, pcm=[0.1, -0.2, 0.3], noise=[1.0, 1.0, 1.0], snr_db=0.0, rir_no=0)
    flags = ["background", "rir", "gain", "tanh", "noise"]
    rows = [{**base, **{f"use_{f}": f == on for f in flags}, "clip_no": i} for i, on in enumerate(["none", "tanh", "background"])]
    schema = "round int, clip_no long, pcm array<double>, noise array<double>, snr_db double, rir_no long, " + ", ".join(f"use_{f} boolean" for f in flags)
    responses = spark.createDataFrame([(0, [1.0])], "rir_no long, response array<double>")
    df = spark.createDataFrame([[r[c.split()[0]] for c in schema.replace("array<double>", "x").split(", ")] for r in rows], schema)
    got = {r.clip_no: np.array(r.augmented) for r in audio.apply_augmentation(df, responses, 1).collect()}
    x = np.array(base["pcm"])
    assert np.allclose(got[0], x) and np.allclose(got[1], np.tanh(x))
    assert np.allclose(got[2], x + level(x) * np.ones(3), atol=1e-6)


def test_scorers_agree(spark):
    weights = [0.5, -1.0, 2.0]
    rows = spark.createDataFrame([(i, [i / 10, 0.3, -0.1]) for i in range(50)], "idx long, x array<float>")
    scored = scoring.score_windows(rows, "x", scoring.LinearScorer(weights, 0.2)).withColumn(
        "jvm", scoring.linear_score(F.col("x"), weights, 0.2))
    assert all(abs(r.score - r.jvm) < 1e-9 for r in scored.collect()) and scored.count() == 50


def test_half_precision(spark):
    rows = spark.createDataFrame([(0.1,), (0.5,), (0.99951,)], "score double")
    got = sorted(r.score for r in scoring.half_precision(rows).collect())
    assert got == [float(np.float16(v)) for v in (0.1, 0.5, 0.99951)]

def test_weighted_fit_separates_and_obeys_the_weight(spark):
    rng = np.random.default_rng(0)
    rows = [(i % 2, (rng.standard_normal(3) + (i % 2)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "label int, x array<double>")
    mean = lambda weight: df.withColumn("s", scoring.linear_score(
        F.col("x"), (m := scoring.fit_weighted(df, "x", weight)).coefficients.tolist(), float(m.intercept))
    ).groupBy("label").agg(F.avg("s")).collect()
    light, heavy = (dict(map(tuple, mean(w))) for w in (1.0, 20.0))
    assert light[1] > light[0] + 0.3
    assert heavy[0] < light[0] and heavy[1] < light[1]
