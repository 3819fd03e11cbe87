import glob
import time

from pyspark.sql import functions as F

from earshot.session import pin


def _shuffled(spark) -> set[str]:
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for folder in folders for f in glob.glob(f"{folder}/**/shuffle_*.data", recursive=True)}


def _counts(spark):
    return spark.range(20_000).groupBy((F.col("id") % 500).alias("k")).agg(F.count("*").alias("c"))


def test_pinning_leaves_no_shuffle_files(spark):
    before = _shuffled(spark)
    pinned = pin(_counts(spark).join(_counts(spark).hint("merge"), "k"))
    until = time.time() + 20
    while _shuffled(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not _shuffled(spark) - before
    assert pinned.count() == 500


def test_a_plan_that_has_run_can_run_again_after_it_is_pinned(spark):
    counts = _counts(spark)
    assert len(counts.collect()) == 500
    pinned = pin(counts)
    assert len(counts.collect()) == 500 and pin(pinned).exceptAll(counts).isEmpty()
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
