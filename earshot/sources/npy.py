"""A reader and writer for ``.npy`` feature arrays, 2-D or 3-D.

The reader takes the schema from file headers and maps each task's row range, so
a file larger than memory is read in slices by many tasks. Half-precision values
come out as floats. Files must be on storage mounted on every executor.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, DataType, FloatType, LongType, StringType, StructField, StructType

ROWS_PER_PARTITION = 262_144
ROWS_PER_BATCH = 2048


def _files(path: str) -> list[str]:
    if os.path.isdir(path):
        return sorted(glob.glob(os.path.join(path, "**", "*.npy"), recursive=True))
    return sorted(glob.glob(path))


def header(path: str) -> tuple[tuple[int, ...], str]:
    """Shape and dtype from the header alone."""
    import numpy as np

    array = np.load(path, mmap_mode="r")
    return array.shape, str(array.dtype)


class NpyPartition(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class NpySource(DataSource):
    """``spark.read.format("npy").load(folder)``: rows (file, idx, x)."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> StructType:
        shapes = {header(f)[0][1:] for f in _files(self.options["path"])}
        if len({len(s) for s in shapes}) != 1:
            raise ValueError(f"arrays of different dimensions under {self.options['path']}")
        value: DataType = FloatType()
        for _ in next(iter(shapes)):
            value = ArrayType(value, containsNull=False)
        return StructType([
            StructField("file", StringType()), StructField("idx", LongType()),
            StructField("x", value),
        ])

    def reader(self, schema: StructType) -> DataSourceReader:
        return NpyReader(self.options, schema)


class NpyReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path = options["path"]
        self.rows = int(options.get("rowsPerPartition", ROWS_PER_PARTITION))
        self.result_schema = schema

    def partitions(self) -> list[InputPartition]:
        parts = []
        for path in _files(self.path):
            total = header(path)[0][0]
            parts += [
                NpyPartition(path, start, min(start + self.rows, total))
                for start in range(0, total, self.rows)
            ]
        return parts

    def read(self, partition: NpyPartition) -> Iterator:
        import numpy as np
        import pyarrow as pa

        array = np.load(partition.path, mmap_mode="r")
        name = os.path.basename(partition.path)
        for start in range(partition.start, partition.stop, ROWS_PER_BATCH):
            stop = min(start + ROWS_PER_BATCH, partition.stop)
            block = np.asarray(array[start:stop], dtype=np.float32)
            value = pa.array(np.ascontiguousarray(block).reshape(-1))
            for size in reversed(block.shape[1:]):
                offsets = pa.array(np.arange(0, len(value) + 1, size, dtype=np.int32))
                value = pa.ListArray.from_arrays(offsets, value)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (stop - start)), pa.array(np.arange(start, stop)), value],
                names=["file", "idx", "x"],
            )


def register(spark) -> None:
    spark.dataSource.register(NpySource)


def write_npy(arrays: DataFrame, folder: str, column: str = "x", dtype: str = "float32") -> None:
    """Write one ``.npy`` file per non-empty partition, rows in partition order.

    A file has one name per partition and appears in one step, so a task that runs
    again replaces its own output. Batches go to a growing file, not to memory.
    """

    def write(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        os.makedirs(folder, exist_ok=True)
        task = TaskContext.get()
        name = os.path.join(folder, f"{task.partitionId():06d}.npy")
        raw = f"{name}.{task.taskAttemptId()}"
        rows, inner = 0, None
        with open(raw, "wb") as out:
            for batch in batches:
                block = batch.column(column).to_pylist()
                if block:
                    block = np.asarray(block, dtype=dtype)
                    rows, inner = rows + len(block), block.shape[1:]
                    out.write(block.tobytes())
        if rows:
            _add_header(raw, (rows, *inner), dtype)
            os.replace(raw, name)
        else:
            os.remove(raw)
        yield pa.RecordBatch.from_pydict({"n_rows": pa.array([rows], pa.int64())})

    arrays.select(column).mapInArrow(write, "n_rows bigint").agg({"n_rows": "sum"}).collect()


def _add_header(raw: str, shape: tuple[int, ...], dtype: str) -> None:
    """Put the array header in front of raw values, copying in blocks."""
    import shutil

    import numpy as np

    with open(raw, "rb") as body, open(raw + ".npy", "wb") as out:
        np.lib.format.write_array_header_1_0(out, {
            "descr": np.lib.format.dtype_to_descr(np.dtype(dtype)), "fortran_order": False,
            "shape": shape,
        })
        shutil.copyfileobj(body, out, 16 << 20)
    os.replace(raw + ".npy", raw)
