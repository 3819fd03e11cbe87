"""Scoring windows in batches, and fitting a weighted head."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

SCORE_BATCH = 4096


def linear_score(values: Column, weights: list[float], bias: float) -> Column:
    """Logistic score of a flat array under a linear head, all in the JVM."""
    held = F.array(*[F.lit(float(w)) for w in weights])
    dot = F.aggregate(
        F.zip_with(values, held, lambda v, w: v.cast("double") * w), F.lit(0.0), lambda a, v: a + v
    )
    return 1 / (1 + F.exp(-(dot + bias)))


@lru_cache(maxsize=4)
def onnx_session(path: str):
    """One session per worker process and model."""
    import onnxruntime

    return onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])


class LinearScorer:
    """A dense head as a scorer: float32 rows in, one float per row out."""

    def __init__(self, weights: list[float], bias: float):
        self.weights, self.bias = weights, bias

    def __call__(self, rows):
        import numpy as np

        flat = rows.reshape(len(rows), -1).astype(np.float64)
        return 1 / (1 + np.exp(-(flat @ np.asarray(self.weights) + self.bias)))


class OnnxScorer:
    def __init__(self, path: str):
        self.path = path

    def __call__(self, rows):
        session = onnx_session(self.path)
        return session.run(None, {session.get_inputs()[0].name: rows})[0].reshape(-1)


def score_windows(windows: DataFrame, column: str, scorer) -> DataFrame:
    """Add ``score`` by a scorer that takes (n, ...) float32 and returns n floats.

    Rows arrive as Arrow batches and are scored at most ``SCORE_BATCH`` at a time;
    their order and number do not change.
    """

    @pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        for batch in batches:
            scores = [
                np.asarray(scorer(_stacked(batch.iloc[i:i + SCORE_BATCH])), dtype=np.float64)
                for i in range(0, len(batch), SCORE_BATCH)
            ]
            yield pd.Series(np.concatenate(scores) if scores else [], dtype="float64")

    return windows.withColumn("score", run(column))


def _stacked(rows: pd.Series):
    """One float32 array of all rows, flat or nested, without a Python object for each value."""
    import numpy as np

    return np.stack([np.stack(x) if x.dtype == object else x for x in rows]).astype(np.float32, copy=False)


def half_precision(scores: DataFrame) -> DataFrame:
    """Scores after a round trip through half precision."""

    @pandas_udf("double")
    def narrow(values: pd.Series) -> pd.Series:
        return values.astype("float16").astype("float64")

    return scores.withColumn("score", narrow("score"))


def fit_weighted(examples: DataFrame, column: str, negative_weight: float, iterations: int = 50):
    """Logistic head on flat arrays with (label), negatives weighted in the loss."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = examples.select(
        array_to_vector(F.col(column).cast("array<double>")).alias("features"),
        F.col("label").cast("double").alias("label"),
        F.when(F.col("label") == 0, F.lit(negative_weight)).otherwise(1.0).alias("weight"),
    )
    return LogisticRegression(weightCol="weight", maxIter=iterations, regParam=1e-4).fit(rows)
