"""Adding columns to a table batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Texts a batch function works on at a time are cut after about so many bytes.
CHUNK_BYTES = 2 << 20


def map_columns(
    df: DataFrame, fields: list[T.StructField],
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
) -> DataFrame:
    """``df`` with ``fields`` added, or in place of columns of those names.

    ``make`` runs once in each task and returns the function of a batch.
    """
    names = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType(kept + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for batch in cut(whole):
                if batch.num_rows:
                    arrays = [batch.column(f.name) for f in kept] + work(batch)
                    yield pa.RecordBatch.from_arrays(arrays, [f.name for f in schema.fields])
        # Workers outlive their tasks; what was freed should go back to the system.
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def cut(batch: pa.RecordBatch, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, so that long texts don't pile up."""
    rows = max(1, min(batch.num_rows, int(batch.num_rows * size / max(1, batch.nbytes))))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def strings(column: pa.Array) -> list[str]:
    """Texts, null as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of texts, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def meetings(batches: Iterator[pa.RecordBatch], key: str, side: str) -> Iterator[tuple[pa.Table, pa.RecordBatch]]:
    """Of rows sorted by ``key`` and ``side``: all rows of a key on side 0, with some of its rows on side 1.

    The first is held, and is the same object as long as the key is; the second streams.
    """
    held: list[pa.RecordBatch] = []
    table, current = None, None
    for batch in batches:
        keys, sides = batch.column(key).to_numpy(), batch.column(side).to_numpy()
        new = np.flatnonzero((keys[1:] != keys[:-1]) | (sides[1:] != sides[:-1])) + 1
        for a, b in zip([0, *new.tolist()], [*new.tolist(), len(keys)]):
            if a == b:
                continue
            if keys[a] != current:
                held, table, current = [], None, keys[a]
            if sides[a] == 0:
                held.append(batch.slice(a, b - a))
            elif held:
                table = table or pa.Table.from_batches(held)
                yield table, batch.slice(a, b - a)
