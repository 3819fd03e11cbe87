"""Publishing named artifacts, reading them back, syncing and the run ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder, on storage that every executor sees."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def mounted(folder: str) -> str:
    """The path under which tasks open files of a shared folder themselves."""
    scheme, rest = folder.split(":", 1) if ":" in folder else ("file", folder)
    if scheme != "file":
        raise ValueError(f"{folder} is not a mounted folder")
    return "/" + rest.lstrip("/")


def checksums(artifacts: DataFrame) -> DataFrame:
    """(name, length, sha256) from (name, content)."""
    return artifacts.select(
        "name", F.octet_length("content").cast("long").alias("length"),
        F.sha2(F.col("content").cast("binary"), 256).alias("sha256"),
    )


def publish(artifacts: DataFrame, path: str) -> DataFrame:
    """Write (name, content), read it back and compare checksums name by name."""
    artifacts.select("name", "content").write.mode("errorifexists").parquet(path)
    stored = checksums(artifacts.sparkSession.read.parquet(path))
    want, got = checksums(artifacts).alias("want"), stored.alias("got")
    same = F.col("want.sha256").eqNullSafe(F.col("got.sha256"))
    return want.join(got, F.col("want.name") == F.col("got.name"), "full").select(
        F.coalesce("want.name", "got.name").alias("name"),
        "want.length", "want.sha256", same.alias("same"),
    )


def require_same(read_back: DataFrame) -> DataFrame:
    """Fail the job at the first artifact that did not survive publication."""
    check = F.assert_true("same", F.concat(F.lit("read-back differs for "), F.col("name")))
    return read_back.where(check.isNull())


def missing_names(required: DataFrame, listing: DataFrame) -> DataFrame:
    """Required names that the listing lacks."""
    return required.select("name").distinct().join(listing, "name", "left_anti")


def files_to_copy(source: DataFrame, target: DataFrame) -> DataFrame:
    """Source (name, length) rows that the target lacks or holds at another size."""
    return source.join(target.select("name", "length"), ["name", "length"], "left_anti")


def pending_stages(plan: DataFrame, ledger: DataFrame, force: bool = False) -> DataFrame:
    """Planned (config_hash, stage) rows without a finished record."""
    if force:
        return plan
    return plan.join(ledger.select("config_hash", "stage"), ["config_hash", "stage"], "left_anti")


def record_stage(stage: DataFrame, path: str) -> None:
    """Append a finished stage; called after the stage's own output is written."""
    stage.withColumn("finished_at", F.current_timestamp()).write.mode("append").parquet(path)


def config_hash(columns: list[str]) -> Column:
    """SHA-256 of compact JSON with sorted keys, NULL settings as null. Leave run labels
    out of ``columns``."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def write_archives(members: DataFrame, folder: str) -> None:
    """Pack (path, content) rows into one zip archive per non-empty partition.

    An archive has one name per partition and appears in one step, so a task that
    runs again replaces its own output.
    """

    def pack(batches):
        import os
        import zipfile

        import pyarrow as pa
        from pyspark import TaskContext

        os.makedirs(folder, exist_ok=True)
        task = TaskContext.get()
        name = os.path.join(folder, f"{task.partitionId():06d}.zip")
        part, rows = f"{name}.{task.taskAttemptId()}", 0
        with zipfile.ZipFile(part, "w") as archive:
            for batch in batches:
                for path, content in zip(batch.column("path").to_pylist(),
                                         batch.column("content").to_pylist()):
                    archive.writestr(path, content)
                    rows += 1
        if rows:
            os.replace(part, name)
        else:
            os.remove(part)
        yield pa.RecordBatch.from_pydict({"n_rows": pa.array([rows], pa.int64())})

    members.select("path", "content").mapInArrow(pack, "n_rows bigint").agg({"n_rows": "sum"}).collect()
