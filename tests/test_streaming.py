import brute
from pyspark.sql import functions as F

from earshot.streaming import activations as live

FRAMES = "stream_id long, frame_idx long, ts timestamp, score double"


def land(spark, folder, frames):
    rows = spark.createDataFrame(frames, "stream_id long, frame_idx long, score double")
    rows.withColumn("ts", F.timestamp_seconds(F.col("frame_idx"))).select(
        "stream_id", "frame_idx", "ts", "score").write.mode("append").parquet(folder)


def run(spark, folder, blocks, grouping=4, patience=0.0):
    for block in blocks:
        land(spark, f"{folder}/in", block)
        stream = live.read_frames(spark, f"{folder}/in")
        live.count_to(stream, folder, 0.5, grouping, patience).awaitTermination()


def test_state_survives_restarts_and_replays_do_not_count(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live.events.chunk_hits, "__defaults__", (None, 16))
    monkeypatch.setattr(live.events.chunk_entries, "__defaults__", (16, 2, None))
    folder = str(tmp_path)
    frames = [(s, i, 0.9 if (i * (s + 3)) % 7 < 3 else 0.1) for s in range(2) for i in range(90)]
    run(spark, folder, [
        [f for f in frames if f[1] < 40],
        [f for f in frames if 30 <= f[1] < 60],  # frames 30 to 39 arrive twice
        [f for f in frames if f[1] >= 60 and f[0] == 1], [f for f in frames if f[1] >= 60 and f[0] == 0],
    ])
    got = {}
    for r in live.fired(spark, folder).collect():
        got.setdefault(r.stream_id, []).append((r.frame_idx, r.activations))
        assert r.ts.timestamp() == r.frame_idx
    for s in range(2):
        want = brute.events([i for k, i, x in frames if k == s and x >= 0.5], 4)
        assert sorted(got[s]) == [(i, n + 1) for n, i in enumerate(want)]
    assert {r.stream_id: r.late for r in live.rates(spark, folder, 1.0).collect()} == {0: 10, 1: 10}
    assert sorted(live._batches(spark, f"{folder}/state")) == [2, 3]  # older state is gone


def test_rates(spark, tmp_path):
    folder = str(tmp_path)
    run(spark, folder, [[(7, i, 1.0 if i in (0, 2, 60) else 0.0) for i in part]
                        for part in (range(0, 50), [*range(45, 50), *range(50, 100)])])
    row = live.rates(spark, folder, 36.0).first()
    assert (row.stream_id, row.activations, row.frames, row.hours, row.per_hour) == (7, 2, 100, 1.0, 2.0)
    assert row.late == 5  # frames that arrived twice
    level = 0.0
    for i in range(100):
        level = max(0.7 * level, 1.0 if i in (0, 2, 60) else 0.0)
    assert abs(row.recent - level) < 1e-12


def test_frames_in_another_order_wait_and_count_in_their_place(spark, tmp_path):
    hits = [3, 4, 9, 17, 18, 30, 41, 55]
    rows = [(1, i, 1.0 if i in hits else 0.0) for i in range(60)]
    swapped = [rows[:10] + rows[15:20], rows[10:15] + rows[20:40:2], rows[21:40:2] + rows[40:]]
    run(spark, str(tmp_path / "patient"), swapped, 4, 20.0)
    state = live.rates(spark, str(tmp_path / "patient"), 1.0).first()
    assert (state.frames, state.late) == (40, 0)  # frames up to 39 are 20 s behind the newest
    assert sorted(r.frame_idx for r in live.fired(spark, str(tmp_path / "patient")).collect()) == brute.events(
        [h for h in hits if h < 40], 4)
    run(spark, str(tmp_path / "hasty"), swapped, 4)
    assert live.rates(spark, str(tmp_path / "hasty"), 1.0).first().late == 14


def test_a_trigger_that_runs_again_starts_from_the_same_state(spark, tmp_path):
    folder = str(tmp_path)
    first = spark.createDataFrame([(1, i, 1.0) for i in range(10)], "stream_id long, frame_idx long, score double")
    first = first.withColumn("ts", F.timestamp_seconds("frame_idx"))
    state = spark.createDataFrame([], live.STATE_SCHEMA)
    for _ in range(2):
        found, after = live.advance(first, state, 0.5, 4)
        assert sorted((r.frame_idx, r.activations) for r in found.collect()) == [(0, 1), (5, 2)]
        assert [tuple(r) for r in after.collect()] == [(1, 2, 10, 9, 10, 1.0, 0)]
