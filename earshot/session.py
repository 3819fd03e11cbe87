"""Session construction and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", app: str = "earshot", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own: a path on one
    machine would not survive the loss of that machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")


def pin(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    The shuffle files it was made from go as soon as it is written. Left to the driver's
    garbage collection, those of all steps would stay on the disks together.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        # A plan of its own: the one ``df`` may have run already keeps its files.
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(_CLEAN_UP, before)


def broadcast_if_small(
    df: DataFrame, max_rows: int = 100_000, max_bytes: int = 32 << 20
) -> DataFrame:
    """Broadcast ``df`` only when rows and bytes are counted and small; else a shuffle join.

    The count stops after ``max_rows`` + 1 rows, so it stays cheap on a large side. Only
    one number for each row is moved for it, never the row.
    """
    sizes = df.select(row_bytes(df).alias("bytes")).limit(max_rows + 1)
    rows, size = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


def spread(df: DataFrame, rows: int, *keys: str, rows_per_task: int = 500_000) -> DataFrame:
    """Deal ``df`` by ``keys`` over so many tasks that their share doesn't grow with ``rows``."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // rows_per_task)), *keys)


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes in memory."""
    size = F.lit(16 * len(df.columns)).cast("long")
    for field in df.schema.fields:
        size = size + F.coalesce(_extra_bytes(F.col(f"`{field.name}`"), field.dataType), F.lit(0))
    return size


def _extra_bytes(column: Column, kind: DataType) -> Column:
    if isinstance(kind, (StringType, BinaryType)):
        return F.octet_length(column).cast("long")
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (ArrayType, StringType, BinaryType)):
        return F.aggregate(
            column, F.lit(0).cast("long"),
            lambda total, item: total + 16 + F.coalesce(_extra_bytes(item, kind.elementType), F.lit(0)),
        )
    if isinstance(kind, ArrayType):
        fields = len(kind.elementType.fields) if isinstance(kind.elementType, StructType) else 1
        return F.size(column).cast("long") * 16 * fields
    if isinstance(kind, MapType):
        return F.size(column).cast("long") * 64
    return F.lit(0).cast("long")


def for_each(df: DataFrame, choices: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Every row of ``df`` with every row of a table of choices.

    For tables such as sets, budgets and conditions, whose number is a matter of
    configuration. Up to ``max_rows`` of them ride along as one array, read once; more
    are dealt into packs of ``max_rows``, and every row meets each pack by an equi-join
    on the pack's number.
    """
    count = choices.count()
    if count <= max_rows:
        packed = choices.agg(F.collect_list(F.struct(*choices.columns)).alias("all"))
        return df.withColumn("_choices", packed.scalar()).select(*df.columns, F.inline("_choices"))
    packs = -(-count // max_rows)
    dealt = choices.withColumn("_pack", F.pmod(F.xxhash64(*choices.columns), F.lit(packs)).cast("int"))
    numbered = df.withColumn("_pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))
    return numbered.join(dealt, "_pack").select(*df.columns, *choices.columns)
