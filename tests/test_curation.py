import gzip
import hashlib
import io
import os
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.functions import dsp, scalars
from earshot.operators import pool, splits, windows
from earshot.sources import ingest, metrics, npy, publish


def test_sources_split_at_the_first_sign(spark):
    rows = spark.createDataFrame(
        [("music=a=b",), ("http://x?y=1",), ("plain",), ("babble=z",)], "entry string")
    got = {r.entry: (r.role, r.source) for r in ingest.parse_sources(rows).collect()}
    assert got == {
        "music=a=b": ("music", "a=b"), "http://x?y=1": ("env", "http://x?y=1"),
        "plain": ("env", "plain"), "babble=z": ("env", "babble=z"),
    }


def test_budget_keeps_the_row_that_crosses_and_counts_repeats(spark):
    rows = [
        (0, "r", "a", 10, True), (1, "r", "a", 99, True), (2, "r", "b", None, True),
        (3, "r", "c", 10, False), (4, "r", "d", 10, True), (5, "r", "e", 10, True),
        (0, "q", "a", None, True), (1, "q", "a", 7, True), (2, "q", "a", None, True), (3, "q", "a", None, False),
        (4, "q", "b", 1, True),
    ]
    clips = spark.createDataFrame(rows, "n long, role string, stem string, n_samples long, allowed boolean")
    found = ingest.budgeted_ingest(clips, ["n"], 25, rows_per_task=2).collect()
    # Once stored, a repeat counts whether or not it can be read; before that it doesn't.
    assert sorted((r.n, r.before) for r in found if r.role == "q") == [(0, 0), (1, 0), (2, 7), (3, 14), (4, 14)]
    met = {r.n: r for r in found if r.role == "r"}
    assert sorted(met) == [0, 1, 2, 3, 4]
    assert [met[i].before for i in range(5)] == [0, 10, 20, 20, 20]
    assert [i for i in met if met[i].stored] == [0, 4]


def test_a_role_without_audio_fails(spark):
    columns = "role string, samples long, hours double"
    report = spark.createDataFrame([("env", 0, 0.0)], columns)
    with pytest.raises(Exception, match="no audio ingested"):
        ingest.require_audio(report).collect()
    little = spark.createDataFrame([("env", 16_000, 0.0)], columns)
    assert ingest.require_audio(little).count() == 1
    with pytest.raises(Exception, match="no audio ingested for role music"):
        ingest.require_audio(little, spark.createDataFrame([("env",), ("music",)], "role string")).collect()


def test_rows_without_a_path_are_stored_by_shard_and_number(spark):
    rows = spark.createDataFrame(
        [("a/b.c.wav", "s1", 0), (None, "s1", 1), ("", "s2", 2), ("x", "s2", 3)], "path string, shard string, n int"
    )
    assert [r.stem for r in ingest.storage_keys(rows).orderBy("n").collect()] == ["b.c", "s1_1", "s2_2", "x"]


def test_config_hash_tells_null_from_absent(spark):
    row = spark.createDataFrame([(1, None)], "a int, b int")
    both, one = (row.select(publish.config_hash(c)).first()[0] for c in (["a", "b"], ["a"]))
    assert both != one and both == hashlib.sha256(b'{"a":1,"b":null}').hexdigest()


def test_file_and_archive_scans(spark, tmp_path):
    wav = dsp.encode_wav(np.zeros(160))
    (tmp_path / "d").mkdir()
    for name in ("a.wav", "d/b.FLAC", "c.txt"):
        (tmp_path / name).write_bytes(wav)
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as archive:
        archive.writestr("in/e.wav", wav)
        archive.writestr("in/readme.md", "no")
    with tarfile.open(tmp_path / "y.tar", "w") as archive:
        info = tarfile.TarInfo("f.ogg")
        info.size = len(wav)
        archive.addfile(info, io.BytesIO(wav))
    with tarfile.open(tmp_path / "z.tar.gz", "w:gz") as archive:
        info = tarfile.TarInfo("deep/g.MP3")
        info.size = len(wav)
        archive.addfile(info, io.BytesIO(wav))
    for suffix, mode in (("tar.bz2", "w:bz2"), ("txz", "w:xz")):
        with tarfile.open(tmp_path / f"p.{suffix}", mode) as archive:
            info = tarfile.TarInfo(f"{suffix}.wav")
            info.size = len(wav)
            archive.addfile(info, io.BytesIO(wav))
    (tmp_path / "notes.gz").write_bytes(gzip.compress(b"no archive"))
    files = {os.path.basename(r.path) for r in ingest.scan_audio_files(spark, str(tmp_path)).collect()}
    assert files == {"a.wav", "b.FLAC"}
    members = {r.path: r.content for r in ingest.scan_archives(spark, str(tmp_path)).collect()}
    assert {k: bytes(v) for k, v in members.items()} == {"in/e.wav": wav, "f.ogg": wav, "deep/g.MP3": wav,
        "tar.bz2.wav": wav, "txz.wav": wav}


def test_audio_rows_with_and_without_labels(spark, tmp_path):
    bare = spark.range(2).select(F.struct(
        F.lit(b"x").alias("bytes"), F.lit("p").alias("path")).alias("audio"))
    bare.write.parquet(str(tmp_path / "bare"))
    bare.withColumn("human_labels", F.array(F.lit("Music"))).write.parquet(str(tmp_path / "full"))
    assert ingest.read_audio_rows(spark, str(tmp_path / "bare")).first().human_labels is None
    assert ingest.read_audio_rows(spark, str(tmp_path / "full")).first().human_labels == ["Music"]


@pytest.mark.parametrize("shape", [(10, 96), (7, 16, 96)])
def test_npy_reader_splits_rows(spark, tmp_path, shape):
    array = np.random.default_rng(0).standard_normal(shape).astype("float16")
    np.save(tmp_path / "f.npy", array)
    npy.register(spark)
    rows = spark.read.format("npy").option("rowsPerPartition", 3).load(str(tmp_path)).orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(shape[0]))
    assert np.array_equal(np.array([r.x for r in rows], dtype="float32"), array.astype("float32"))


def test_metrics_of_several_repositories(spark, tmp_path):
    (tmp_path / "a" / "v1").mkdir(parents=True)
    (tmp_path / "a" / "v1" / "metrics.json").write_text(
        '{"run_name": "one",\n "curve": [{"threshold": 0.5, "recall": 0.25}], "recall_at_fa": {"0.5": null}}')
    (tmp_path / "a" / "other.json").write_text('{"run_name": "not this"}')
    rows, skipped = metrics.read_metrics(spark, {"lab/a": str(tmp_path / "a"), "lab/b": str(tmp_path / "none")})
    assert skipped == ["lab/b"]
    row = rows.first()
    assert rows.count() == 1 and row.run_name == "one" and row.repo == "lab/a"
    assert row.curve[0].recall == 0.25 and row.recall_at_fa == {"0.5": None} and row.stress is None


def test_publish_notices_a_changed_artifact(spark, tmp_path):
    artifacts = spark.createDataFrame([("a", b"1"), ("b", b"2")], "name string, content binary")
    read_back = publish.publish(artifacts, str(tmp_path / "out"))
    assert publish.require_same(read_back).count() == 2
    broken = read_back.withColumn("same", F.col("name") != "b")
    with pytest.raises(Exception, match="read-back differs for b"):
        publish.require_same(broken).collect()


def test_ledger_skips_finished_stages(spark, tmp_path):
    plan = spark.createDataFrame([("h", "sources"), ("h", "train")], "config_hash string, stage string")
    publish.record_stage(plan.where("stage = 'sources'"), str(tmp_path / "ledger"))
    ledger = spark.read.parquet(str(tmp_path / "ledger"))
    assert [r.stage for r in publish.pending_stages(plan, ledger).collect()] == ["train"]
    assert publish.pending_stages(plan, ledger, force=True).count() == 2


@pytest.mark.parametrize("n,held,train,val", [(10, [2, 7], 100, 30), (7, [0], 5, 40), (5, [1, 4], 1, 1), (6, [3], 90, 2)])
def test_smallest_total_equals_a_walk(spark, n, held, train, val):
    got_train = got_val = total = 0
    while got_train < train or got_val < val:
        a, b = divmod(total % (n * n), n)
        if a in held or b in held:
            got_val += 1
        else:
            got_train += 1
        total += 1
    speakers = spark.range(n).withColumnRenamed("id", "speaker")
    row = splits.smallest_total(speakers, speakers.where(F.col("speaker").isin(held)), train, val).first()
    assert row.total == total


def test_splits_share_no_speaker(spark):
    a, b = splits.speaker_pair(F.col("id"), 20)
    examples = spark.range(2000).select(F.lit("positive").alias("kind"), F.col("id").alias("idx"), a.alias("spk_a"), b.alias("spk_b"))
    held = splits.held_out_speakers(spark.range(20).withColumnRenamed("id", "speaker"), 4, 1)
    rows = splits.assign_split(examples, held)
    names = {r.speaker for r in held.collect()}
    for r in rows.collect():
        assert (r.split == "val") == (r.spk_a in names or r.spk_b in names)


def recut_by_hand(clips, segment, shortest, cap):
    buffer, out = [], []
    for clip in clips:
        buffer += clip
        while len(buffer) >= segment and len(out) < cap:
            out.append(buffer[:segment])
            buffer = buffer[segment:]
    if len(buffer) >= shortest and len(out) < cap:
        out.append(buffer)
    return out


@pytest.mark.parametrize("cap", [4, 1000])
def test_recut_of_arrays_matches_a_running_buffer(spark, cap):
    rng = np.random.default_rng(4)
    clips = {r: [rng.random(int(rng.integers(1, 25))).tolist() for _ in range(30)] for r in "ab"}
    df = spark.createDataFrame(
        [(r, i, c) for r, cs in clips.items() for i, c in enumerate(cs)], "role string, n long, pcm array<double>")
    cut = pool.recut(df, ["n"], "pcm", 16, 5, cap, rows_per_task=7)
    for role, parts in clips.items():
        got = [r.pcm for r in cut.where(F.col("role") == role).orderBy("seg").collect()]
        assert got == recut_by_hand(parts, 16, 5, cap)


def test_balanced_roles_are_equal_and_keep_the_reserve_out(spark):
    segments = spark.createDataFrame(
        [(r, i, 10) for r, n in [("a", 30), ("b", 9), ("c", 14)] for i in range(n)], "role string, seg long, n_samples long")
    marked = pool.hold_back_reserve(segments)
    assert {r["count"] for r in marked.where("reserved").groupBy("role").count().collect()} == {6}
    kept = pool.balance(marked, 1, rows_per_task=5)
    assert {r["count"] for r in kept.groupBy("role").count().collect()} == {3}
    assert kept.where("reserved").isEmpty()


def test_babble_sums_distinct_rolled_members(spark):
    rng = np.random.default_rng(1)
    speech = [rng.random(int(rng.integers(5, 12))).tolist() for _ in range(6)]
    df = spark.createDataFrame(list(enumerate(speech)), "pos long, pcm array<double>")
    wanted = spark.range(20).withColumnRenamed("id", "babble")
    members = pool.babble_members(wanted, 6, 10, 1)
    chosen = {}
    for r in members.collect():
        chosen.setdefault(r.babble, []).append((r.pos, r.offset))
    assert all(2 <= len(m) <= 5 and len({p for p, _ in m}) == len(m) for m in chosen.values())
    for r in pool.babble(members, df, 10).collect():
        mix = sum(np.roll(np.resize(speech[p], 10), o) for p, o in chosen[r.babble])
        level = max(max(np.sqrt(np.mean(mix ** 2)), 1e-6) / 0.1, np.abs(mix).max() / 0.99)
        assert np.allclose(r.pcm, mix / level)


@pytest.mark.parametrize("n,window", [(64, 16), (70, 16), (1030, 16)])
def test_recut_windows_and_estimates(spark, n, window):
    frames = spark.range(n).select(F.col("id").alias("frame_idx"), F.col("id").alias("x"))
    starts = list(range(0, n - window, window))
    cut = windows.recut_flat(frames, F.lit(n), window).orderBy("idx").collect()
    assert [r.x for r in cut] == [list(range(s, s + window)) for s in starts]
    row = spark.range(1).select(
        windows.recut_count(F.lit(n), window).alias("a"), windows.batch_estimate(F.lit(n), window).alias("b")).first()
    assert row.a == len(starts) and row.b == max(0, (n - window) // window)


@pytest.mark.parametrize("chunk", [5, 16, 4096])
def test_sliding_windows_cross_chunks(spark, chunk):
    frames = spark.range(40).select(F.col("id").alias("frame_idx"), F.col("id").alias("x"))
    rows = windows.sliding_windows(frames, [], 5, "x", chunk).orderBy("idx").collect()
    assert [(r.idx, r.x) for r in rows] == [(i, list(range(i, i + 5))) for i in range(36)]


@pytest.mark.parametrize("length", [0, 1, 1279, 1280, 1281, 2560, 2561])
def test_framing_modes(spark, length):
    row = spark.range(1).select(
        windows.frame_starts(F.lit(length)).alias("a"),
        windows.frame_starts(F.lit(length), drop_exact_last=True).alias("b")).first()
    assert row.a == list(range(0, length - 1280 + 1, 1280))
    assert row.b == list(range(0, length - 1280, 1280))


def test_frame_count_and_grouping(spark):
    row = spark.range(1).select(
        *[scalars.frame_count(F.lit(n)).alias(f"n{n}") for n in (32000, 48000, 20480, 31680, 31681, 32960, 32961)],
        scalars.grouping_width(F.lit(0.08)).alias("g1"), scalars.grouping_width(F.lit(1.28)).alias("g2"),
        scalars.grouping_width(F.lit(9.0)).alias("g3")).first()
    assert (row.n32000, row.n48000, row.n20480) == (16, 28, 7)
    assert (row.n31680, row.n31681, row.n32960, row.n32961) == (15, 16, 16, 17)
    assert (row.g1, row.g2, row.g3) == (50, 3, 1)
