"""Approximate nearest neighbours by an adaptive scan of dimensions.

Nearness is the inner product. A coordinate that brings all vectors to the length of the
longest turns it into distance (queries are scaled, which keeps their order). Vectors are
dealt into lists by the nearest of some centres, and a query looks into the lists whose
centres are nearest. In a list the vectors are rotated at random and stored in blocks of
columns. A scan adds up the squared distance block by block; after each, the distance so
far, scaled up, is an estimate, and a vector for which the hypothesis "within the best
known distance" is rejected is given up. What is left gets its exact inner product from
the original vectors, in double precision, added up from the first component to the last.
Queries are scanned many at a time, so a block is one matrix product as long as many
vectors are left.

A query first scans its nearest list; its worst kept score is the bound it takes to all
others. Lists are dealt into parts of at most ``PART`` vectors on average, queries into
chunks, and each part meets each chunk that looks into it in a task of its own.

Equal vectors are one entry with their smallest ids, as many as a result can show; equal
queries are searched once. The centres, and the number of lists that have to be looked
into, come from a sample of about ``SAMPLE`` distinct vectors, chosen by a hash of the id:
the number is the fewest that hold ``recall`` of the true neighbours of sampled queries
among the sample (all lists, if ``recall`` is None). Every vector is indexed.

Cases: vectors that are null, empty or zero, or hold a null or a number that isn't finite
take no part, nor do rows without an id or with another length than most vectors have (of
equally many the longest); rows that share an id are one, with the vector that comes
first in order; equal scores go by id; extra columns aren't read; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from earshot.llm import arrow
from earshot.session import pin

TOP = 20
SAMPLE = 16_384
#: Sampled queries by which the number of lists to look into is set.
TRIALS = 256
RECALL = 0.97
#: Vectors to a list, where there are not too many lists.
LIST, MAX_LISTS = 2048, 1024
PART, CHUNK = 8192, 4096
COLUMNS, ROWS = 16, 1024
#: Queries scanned together; pairs are looked at one by one when one in ``FEW`` is left,
#: and get their exact products ``PAIRS`` at a time.
TOGETHER, FEW, PAIRS = 256, 16, 1 << 15
#: How sure a test must be: the larger, the fewer true neighbours it gives up.
EPSILON = 2.1
SEED = 5
RESULT = "query_id long, rank int, vec_id long, score double"


@dataclass
class Index:
    """What a scan needs to know: lengths, rotation, centres, lists to look into."""

    reach: float
    rotation: np.ndarray
    centres: np.ndarray
    looks: int

    def stored(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors with the coordinate that makes all equally long, rotated."""
        rest = np.sqrt(np.maximum(self.reach**2 - (vectors**2).sum(axis=1), 0))
        return np.column_stack([vectors, rest]) @ self.rotation

    def asked(self, vectors: np.ndarray) -> np.ndarray:
        long = vectors * (self.reach / lengths(vectors))[:, None]
        return np.column_stack([long, np.zeros(len(long))]) @ self.rotation

    def nearest_lists(self, rotated: np.ndarray, n: int) -> np.ndarray:
        far = (self.centres**2).sum(axis=1) - 2 * rotated @ self.centres.T
        return np.argsort(far, axis=1, kind="stable")[:, :n]


def lengths(vectors: np.ndarray) -> np.ndarray:
    return np.maximum(np.sqrt((vectors**2).sum(axis=1)), np.finfo(float).tiny)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def fit(sample: np.ndarray, reach: float, lists: int, top: int, recall: float | None) -> Index:
    """Centres by k-means of the sample, and how many lists a query has to look into."""
    rng = np.random.default_rng(SEED)
    width = sample.shape[1] + 1
    rotation = np.linalg.qr(rng.standard_normal((width, width)))[0]
    index = Index(reach, rotation, np.zeros((1, width)), 1)
    stored = index.stored(sample)
    lists = min(lists, len(stored))
    index.centres = stored[rng.choice(len(stored), lists, replace=False)]
    for _ in range(12):
        mine = index.nearest_lists(stored, 1)[:, 0]
        sums, counts = np.zeros_like(index.centres), np.bincount(mine, minlength=lists)
        np.add.at(sums, mine, stored)
        some = counts > 0
        index.centres[some] = sums[some] / counts[some, None]
    mine = index.nearest_lists(stored, 1)[:, 0]
    trials = rng.choice(len(sample), min(TRIALS, len(sample)), replace=False)
    near = sample[trials] @ sample.T
    near[np.arange(len(trials)), trials] = -np.inf
    best = np.argsort(-near, axis=1)[:, :min(top, len(sample) - 1)]
    place = np.argsort(index.nearest_lists(index.asked(sample[trials]), lists), axis=1)
    places = np.sort(np.take_along_axis(place, mine[best], axis=1).ravel())
    index.looks = int(places[math.ceil(recall * len(places)) - 1]) + 1 if len(places) and recall else lists
    return index


class Part:
    """Some vectors of a list, in blocks of columns."""

    def __init__(self, index: Index, vectors: np.ndarray, ids: np.ndarray, begin: np.ndarray):
        self.index, self.vectors, self.ids, self.begin = index, vectors, ids, begin
        stored = index.stored(vectors)
        self.width = stored.shape[1]
        self.blocks = [np.column_stack([x, np.ones(len(x)), (x**2).sum(axis=1)]) for x in self._cut(stored)]

    def _cut(self, rotated: np.ndarray) -> list[np.ndarray]:
        return [rotated[:, k:k + COLUMNS] for k in range(0, self.width, COLUMNS)]

    def _asked(self, rotated: np.ndarray) -> list[np.ndarray]:
        """Blocks whose product with a block of vectors is the squared distance in its columns."""
        return [np.column_stack([-2 * x, (x**2).sum(axis=1), np.ones(len(x))]) for x in self._cut(rotated)]

    def scan(self, vector: np.ndarray, rotated: np.ndarray, bound: float, top: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the ``top`` best rows with at least the score ``bound``."""
        return self.scan_all(vector[None], rotated[None], np.array([bound]), top)[1:]

    def scan_all(
        self, vectors: np.ndarray, rotated: np.ndarray, bounds: np.ndarray, top: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, scores, ids): for the query at each place what ``scan`` gives, best first."""
        found = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))]
        for at in range(0, len(vectors), TOGETHER):
            some = slice(at, at + TOGETHER)
            places, scores, ids = self._scan(vectors[some], rotated[some], bounds[some], top)
            found.append((places + at, scores, ids))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _scan(
        self, vectors: np.ndarray, rotated: np.ndarray, bounds: np.ndarray, top: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scale = 2 * self.index.reach / lengths(vectors)
        square = 2 * self.index.reach**2
        asked, bounds = self._asked(rotated), bounds.copy()
        places, scores, ids = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        for at in range(0, len(self.vectors), ROWS):
            # Rounding must not lose a vector at the bound itself.
            limits = (square - scale * bounds) * (1 + 1e-9) + square * 1e-12
            query, row = self._pairs(asked, limits, at, min(at + ROWS, len(self.vectors)), top)
            if not len(row):
                continue
            exact = np.concatenate([
                np.cumsum(self.vectors[row[k:k + PAIRS]] * vectors[query[k:k + PAIRS]], axis=1)[:, -1]
                for k in range(0, len(row), PAIRS)
            ])
            copies = self.begin[row + 1] - self.begin[row]
            first = np.cumsum(copies) - copies
            rows = np.arange(copies.sum()) + np.repeat(self.begin[row] - first, copies)
            places = np.concatenate([places, np.repeat(query, copies)])
            scores, ids = np.concatenate([scores, np.repeat(exact, copies)]), np.concatenate([ids, self.ids[rows]])
            order = np.lexsort((ids, -scores, places))
            starts = np.searchsorted(places[order], np.arange(len(vectors)))
            rank = np.arange(len(order)) - starts[places[order]]
            last = order[rank == top - 1]
            bounds[places[last]] = np.maximum(bounds[places[last]], scores[last])
            order = order[rank < top]
            places, scores, ids = places[order], scores[order], ids[order]
        return places, scores, ids

    def _pairs(
        self, asked: list[np.ndarray], limits: np.ndarray, low: int, high: int, top: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """The queries and vectors that no test gives up, pair by pair.

        While many are left, whole blocks are multiplied; after that, single pairs are. A query
        without a limit keeps its ``top`` nearest vectors, and those as near up to rounding.
        """
        far = np.zeros((len(limits), high - low))
        alive = np.ones(far.shape, bool)
        pairs = None
        for k, (mine, block) in enumerate(zip(asked, self.blocks)):
            done = min((k + 1) * COLUMNS, self.width)
            sure = limits if done == self.width else limits * done / self.width * (1 + EPSILON / math.sqrt(done)) ** 2
            if pairs is None:
                far += mine @ block[low:high].T
                alive &= far <= sure[:, None]
                if np.count_nonzero(alive) * FEW < alive.size and done < self.width:
                    pairs = np.nonzero(alive)
                    far = far[pairs]
            else:
                query, row = pairs
                far = far + np.einsum("ij,ij->i", mine[query], block[row + low])
                ok = far <= sure[query]
                pairs, far = (query[ok], row[ok]), far[ok]
        if pairs is None:
            free = np.flatnonzero(limits == np.inf)
            if len(free) and top < high - low:
                last = np.partition(far[free], top - 1, axis=1)[:, top - 1]
                alive[free] = far[free] <= (last * (1 + 1e-9) + self.index.reach**2 * 1e-9)[:, None]
            pairs = np.nonzero(alive)
        return pairs[0], pairs[1] + low

    def _alive(self, rotated: np.ndarray, limit: float, low: int, high: int) -> np.ndarray:
        """The vectors that no test gives up for one query."""
        return self._pairs(self._asked(rotated[None]), np.array([limit]), low, high, high - low)[1]


def _usable(vector: str) -> Column:
    real = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(real & F.exists(vector, lambda x: x != 0), F.lit(False))


def _meet(entries: DataFrame, asked: DataFrame, parts: list[int], chunks: int, index: Index, top: int) -> DataFrame:
    """``rep, score, vec_id`` of the best rows in each part of the lists that are asked for.

    ``entries``: list, rep, vec, ids; ``asked``: list, rep, vec, bound.
    """
    of = F.element_at(F.lit(parts), F.col("list") + 1)
    part, chunk = F.pmod(F.xxhash64("rep"), of).cast("int"), F.pmod(F.xxhash64("rep"), F.lit(chunks)).cast("int")
    held = entries.withColumn("part", part).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    held = held.withColumn("bound", F.lit(None).cast("double")).withColumn("side", F.lit(0))
    looking = asked.withColumn("chunk", chunk).withColumn("part", F.explode(F.sequence(F.lit(0), of - 1)))
    looking = looking.withColumn("ids", F.lit(None).cast("array<long>")).withColumn("side", F.lit(1))
    columns = [F.xxhash64("list", "part", "chunk").alias("meet"), "side", "rep", "vec", "ids", "bound"]
    shared = asked.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known, block = shared.value, None, None
        for table, batch in arrow.meetings(batches, "meet", "side"):
            if table is not known:
                ids = table.column("ids").combine_chunks()
                begin = ids.offsets.to_numpy() - ids.offsets[0].as_py()
                known, block = table, Part(index, matrix(table.column("vec")), ids.flatten().to_numpy(), begin)
            vectors = matrix(batch.column("vec"))
            rotated = index.asked(vectors)
            bounds = batch.column("bound").fill_null(-np.inf).to_numpy()
            places, scores, ids = block.scan_all(vectors, rotated, bounds, top)
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column("rep").to_numpy()[places]), pa.array(scores), pa.array(ids)], ["rep", "score", "vec_id"]
            )

    rows = held.select(*columns).unionByName(looking.select(*columns))
    return rows.repartition("meet").sortWithinPartitions("meet", "side").mapInArrow(run, "rep long, score double, vec_id long")


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(
    vectors: DataFrame, asks: Column, top: int = TOP, recall: float | None = RECALL,
    key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest rows of those for which ``asks`` holds."""
    spark = vectors.sparkSession
    given = vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].alias("vec"), asks.alias("asks"))
    kind = given.schema["vec"].dataType.elementType
    if not isinstance(kind, (T.FloatType, T.DoubleType)):
        given = given.withColumn("vec", F.col("vec").cast("array<double>"))
    given = given.where(F.col("id").isNotNull() & _usable("vec"))
    common = given.groupBy(F.size("vec").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if common is None:
        return spark.createDataFrame([], RESULT)
    given = given.where(F.size("vec") == common.width)
    rows = pin(given.groupBy("id").agg(F.min("vec").alias("vec"), F.max("asks").alias("asks")))
    # Of equal vectors no result shows more than the first few ids.
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    few = rows.select("vec", "id", place.alias("place")).where(F.col("place") <= top + 1)
    groups = pin(few.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(
        F.col("ids")[0].alias("rep"), "vec", "ids"
    ))
    square = F.aggregate("vec", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    n, longest = groups.agg(F.count(F.lit(1)), F.sqrt(F.max(square))).first()
    share = min(1.0, 1.1 * SAMPLE / n)
    drawn = groups.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < share * (1 << 30)).select("vec").limit(2 * SAMPLE)
    sample = matrix(drawn.toArrow().column("vec"))
    if not len(sample):
        sample = matrix(groups.select("vec").limit(SAMPLE).toArrow().column("vec"))
    index = fit(sample, longest, min(MAX_LISTS, -(-n // LIST)), top, recall)
    shared = spark.sparkContext.broadcast(index)

    def dealt(asking: bool):
        def make():
            index = shared.value

            def work(batch: pa.RecordBatch) -> list[pa.Array]:
                found = matrix(batch.column("vec"))
                if asking:
                    near = index.nearest_lists(index.asked(found), index.looks).astype(np.int32)
                    return [pa.ListArray.from_arrays(
                        pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel()))]
                return [pa.array(index.nearest_lists(index.stored(found), 1)[:, 0].astype(np.int32))]

            return work

        return make

    entries = arrow.map_columns(groups, [T.StructField("list", T.IntegerType())], dealt(False))
    sizes = {r.list: r["count"] for r in entries.groupBy("list").count().collect()}
    parts = [max(1, -(-sizes.get(k, 0) // PART)) for k in range(len(index.centres))]
    queries = rows.where("asks").join(groups.select("vec", "rep"), "vec").select(F.col("id").alias("query_id"), "rep")
    queries = pin(queries)
    wanted = groups.join(queries.select("rep").distinct(), "rep", "left_semi").select("rep", "vec")
    chunks = max(1, -(-queries.count() // CHUNK))
    lists = pin(arrow.map_columns(wanted, [T.StructField("lists", T.ArrayType(T.IntegerType()))], dealt(True)))
    first = lists.select(F.col("lists")[0].alias("list"), "rep", "vec", F.lit(None).cast("double").alias("bound"))
    near = pin(_best(_meet(entries, first, parts, chunks, index, top + 1), top + 1))
    bounds = near.where(F.col("rank") == top + 1).select("rep", F.col("score").alias("bound"))
    rest = lists.join(bounds, "rep", "left").select(
        F.explode(F.slice("lists", 2, index.looks)).alias("list"), "rep", "vec", "bound"
    )
    found = near.drop("rank").unionByName(_meet(entries, rest, parts, chunks, index, top + 1))
    answers = _best(found, top + 1).groupBy("rep").agg(
        F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("best")
    )
    shown = queries.join(answers, "rep").select(
        "query_id", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, top).alias("best")
    )
    return shown.select("query_id", F.posexplode("best").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )
