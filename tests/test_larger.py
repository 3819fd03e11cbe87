"""What only shows on larger tables, on small ones made to show it."""

import os
import sys

import duckdb
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402

import __spark_entry__ as entrypoint  # noqa: E402
from earshot import plans, session  # noqa: E402
from earshot.functions import dsp  # noqa: E402
from earshot.operators import batches, positions, splits  # noqa: E402
from earshot.plans import evaluation  # noqa: E402


def test_examples_work_out_their_own_draws(spark, monkeypatch):
    monkeypatch.setattr(batches, "TURNS", 3)
    sizes, per_class = {"negative": 23, "positive": 2, "adversarial": 40}, {"negative": 7, "positive": 5, "adversarial": 2}
    examples = None
    for name, size in sizes.items():
        rows = spark.range(size).select(F.lit(name).alias("class"), F.col("id").alias("idx"), (F.col("id") * 10).alias("key"))
        examples = rows if examples is None else examples.unionByName(rows)
    drawn = batches.drawn_examples(examples, 9, sizes, per_class)
    joined = batches.batch_plan(spark, 9, sizes, per_class).join(examples, ["class", "idx"]).select(drawn.columns)
    assert drawn.dtypes == joined.dtypes
    assert sorted(drawn.collect()) == sorted(joined.collect())
    assert drawn.count() == 9 * 14


def test_the_batch_plan_is_never_broadcast(spark, sf_dir):
    plan = plans.queries()["smp13_cyclic_batches"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "BroadcastExchange" not in plan


def test_thresholds_in_sql_for_any_number_of_scores(sf_dir):
    """A fixed number of rounds ends before the search does once there are more scores than it reaches."""
    con = check.connect(sf_dir)
    rows = lambda sql: sorted(con.execute(sql + "SELECT * FROM exact").fetchall())
    found = rows(evaluation.exact_sql(None))
    assert found == rows(evaluation.exact_sql(18)) != rows(evaluation.exact_sql(5))
    named = entrypoint.oracle_sql()
    for name in ("agg7_exact_profile", "jn2_condition_thresholds", "agg23_split_half"):
        assert "bisected" in named[name] and "b18" not in named[name]


def test_overlaps_in_sql_of_a_role_with_many_segments(spark, tmp_path):
    """Segment numbers beyond 100,000, as a gigabyte of documents has them."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT i AS doc_id, 'en' AS lang, 150000000 + i AS n_chars FROM range(2) r(i)")
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
    assert check.compare(spark, con, "jn9_segment_overlaps", str(tmp_path)).startswith("ok: 15000")


def test_smallest_total_in_sql_with_many_speakers(spark, tmp_path):
    """With 1,000 speakers, 4,000 clips of held-out ones take more than 60,000 clips."""
    con = duckdb.connect()
    con.execute("CREATE TABLE supplier AS SELECT i AS s_suppkey FROM range(1000) r(i)")
    con.execute("CREATE TABLE orders AS SELECT i AS o_orderkey FROM range(3) r(i)")
    con.execute(f"COPY supplier TO '{tmp_path}/supplier.parquet'")
    assert check.compare(spark, con, "smp3_smallest_total", str(tmp_path)).startswith("ok")


def test_tasks_grow_in_number_with_the_rows(spark):
    few, many = (session.spread(spark.range(10), rows, "id").rdd.getNumPartitions() for rows in (10, 36_000_000))
    assert few == 4 and many == 72


def test_elapsed_times_are_dealt_by_order_once(spark, sf_dir):
    rows = plans.queries()["scl8_times"](spark, sf_dir)
    assert "REPARTITION_BY_NUM" in rows._jdf.queryExecution().toString()


def test_only_the_rows_near_the_quota_are_sorted(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 > 0, F.lit("a")).alias("kind"),
        F.when(F.col("id") % 7 == 0, "val").when(F.col("id") % 11 == 0, "rest").otherwise("train").alias("split"),
        F.when(F.col("id") % 5000 != 4999, F.col("id") * F.col("id") - 10 ** 7).alias("idx"), "id",
    )
    wanted = F.when(F.col("split") == "val", 20).when(F.col("split") == "train", 500)
    near = positions.head(rows, ["kind", "split"], "idx", wanted)
    assert near.count() < 3000
    place = lambda df: positions.row_positions(df, ["kind", "split"], ["idx", "id"], "place").where(F.col("place") < wanted)
    assert sorted(place(near).collect(), key=str) == sorted(place(rows).collect(), key=str)
    assert positions.head(rows.limit(0), ["kind", "split"], "idx", wanted).isEmpty()


def test_quotas_do_not_sort_every_example(spark, monkeypatch):
    sorted_rows = []
    whole = splits.row_positions
    monkeypatch.setattr(splits, "row_positions", lambda df, *rest: sorted_rows.append(df.count()) or whole(df, *rest))
    rows = spark.range(50_000).selectExpr("'k' as kind", "if(id % 9 = 0, 'val', 'train') as split", "id as idx")
    capped = splits.cap_to_quota(rows, {"train": 100, "val": 10})
    assert capped.count() == 110 and sorted_rows[0] < 1000


def test_pieces_by_steps_of_a_whole_number(spark, monkeypatch):
    """Found without splitters; nulls first, gaps, ties and negative numbers."""
    rows = spark.range(6000).selectExpr(
        "if(id % 500 = 3, null, (id div 3) * (id div 3) - 100000) as a", "id", "abs(hash(id)) % 9 as v"
    )
    plain = positions.prefix_sum(rows, [], ["a", "id"], "v", "before")
    monkeypatch.setattr(positions, "_split_hot_groups", None)
    cut = positions.prefix_sum(rows, [], ["a", "id"], "v", "before", rows_per_task=200)
    assert "_piece" in cut._jdf.queryExecution().toString()
    assert sorted(cut.collect(), key=str) == sorted(plain.collect(), key=str)


def test_mel_tables_are_made_once_for_a_block_size():
    dsp._mel_tables.cache_clear()
    for seed in range(5):
        dsp.log_mel_features(dsp.white_noise(64, seed))
    assert dsp._mel_tables.cache_info().misses == 1


def test_augmentation_is_dealt_by_rows(spark, sf_dir):
    plan = plans.queries()["aud11_features"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan
