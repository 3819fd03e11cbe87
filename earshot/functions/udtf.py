"""Table functions for SQL callers."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StructField, StructType


@udtf(returnType=StructType([StructField("frame_idx", LongType())]))
class RefractoryEvents:
    """``refractory_events(marks, grouping, free)``: the frames of one array that start
    events, when frames before ``free`` are blocked by what came earlier (NULL: none)."""

    def eval(self, marks: list, grouping: int, free: int):
        for mark in sorted(marks or []):
            if free is None or mark >= free:
                free = mark + grouping + 1
                yield (mark,)


def register(spark: SparkSession) -> None:
    spark.udtf.register("refractory_events", RefractoryEvents)
