"""Run metrics stored as JSON documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_AT = "struct<recall: double, threshold: double>"
_BY_CONDITION = f"map<string, map<string, {_AT}>>"

METRICS_SCHEMA = f"""
run_name string, selected string, val_set_hrs double, metrics_version int,
curve array<struct<threshold: double, recall: double, false_accepts_per_hour: double,
                   events: bigint, frames: bigint>>,
recall_at_fa map<string, double>,
recall_at_fa_exact map<string, {_AT}>,
recall_at_fa_by_condition {_BY_CONDITION},
selection struct<merged: int>,
stress map<string, struct<rows: map<string, struct<min: double, median: double,
                                                   clear_frac: map<string, double>>>>>,
baseline struct<model: string, recall_at_fa_by_condition: {_BY_CONDITION}>
"""


def read_metrics(
    spark: SparkSession, repos: dict[str, str], multi_line: bool = True
) -> tuple[DataFrame, list[str]]:
    """Metrics of several repositories (name -> folder), and those that were unavailable.

    Every file whose name ends in ``metrics.json`` is read; rows carry ``repo``
    and ``path``. Blocks an older run lacks come out as NULL.
    """
    found, skipped = None, []
    for repo, root in repos.items():
        try:
            rows = spark.read.json(
                root, schema=METRICS_SCHEMA, multiLine=multi_line,
                pathGlobFilter="*metrics.json", recursiveFileLookup=True,
            )
        except AnalysisException:
            skipped.append(repo)
            continue
        rows = rows.select(
            "*", F.lit(repo).alias("repo"), F.col("_metadata.file_path").alias("path")
        )
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = spark.createDataFrame([], f"{METRICS_SCHEMA}, repo string, path string")
    return found, skipped


def write_metrics(metrics: DataFrame, folder: str) -> None:
    """Write metrics rows as JSON lines, one ``*.metrics.json`` file per partition.

    The folder must be on storage that is mounted on every executor.
    """
    documents = metrics.select(F.to_json(F.struct(*metrics.columns)).alias("doc"))

    def write(batches):
        import os

        import pyarrow as pa
        from pyspark import TaskContext

        os.makedirs(folder, exist_ok=True)
        task = TaskContext.get()
        name = os.path.join(folder, f"{task.partitionId():06d}.metrics.json")
        part = f"{name}.{task.taskAttemptId()}"
        rows = 0
        # One name per partition, put in place in one step: a task that runs
        # again replaces its own file and a lost one leaves nothing to read.
        with open(part, "w", encoding="utf-8") as out:
            for batch in batches:
                for doc in batch.column("doc").to_pylist():
                    out.write(doc + "\n")
                    rows += 1
        os.replace(part, name)
        yield pa.RecordBatch.from_pydict({"file": [name], "n_rows": pa.array([rows], pa.int64())})

    written = documents.mapInArrow(write, "file string, n_rows bigint")
    written.agg(F.sum("n_rows")).collect()
