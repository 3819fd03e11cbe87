import pytest
from pyspark.sql import functions as F

from earshot.operators.positions import prefix_sum, row_positions


@pytest.mark.parametrize("group", [["g"], []])
def test_split_scan_equals_plain_window(spark, group):
    """A third of the rows in one group, many ties in the first order column."""
    df = spark.range(6000).selectExpr(
        "id", "case when id % 3 = 0 then 'hot' else cast(id % 40 as string) end as g",
        "abs(hash(id)) % 5 as o", "abs(hash(id, 1)) % 7 as v",
    )
    plain = prefix_sum(df, group, ["o", "id"], "v", "before")
    split = prefix_sum(df, group, ["o", "id"], "v", "before", rows_per_task=200)
    assert split.exceptAll(plain).isEmpty() and plain.exceptAll(split).isEmpty()


def test_one_tied_value_is_split_by_the_tiebreak(spark):
    df = spark.range(3000).select(F.lit(1).alias("o"), "id")
    rows = row_positions(df, [], ["o", "id"], "p", rows_per_task=100)
    assert rows.where("p <> id").isEmpty() and rows.count() == 3000


def test_timestamps_and_strings_as_order(spark):
    df = spark.range(2000).select(
        "id", F.timestamp_micros(F.col("id") * 7_000_001).alias("ts"), F.sha2(F.col("id").cast("string"), 256).alias("k")
    )
    by_time = row_positions(df, [], ["ts", "id"], "p", rows_per_task=100)
    assert by_time.where("p <> id").isEmpty()
    by_key = row_positions(df, [], ["k", "id"], "p", rows_per_task=100)
    assert by_key.exceptAll(row_positions(df, [], ["k", "id"], "p")).isEmpty()


def test_empty_input(spark):
    df = spark.range(0).withColumn("g", F.lit("a"))
    assert row_positions(df, ["g"], ["id"], "p").count() == 0
