"""Exact and approximate nearest vectors by inner product.

Exact search scores every row against each query and keeps the best k in each task. The approximate index (IVF) learns cells by k-means on a bounded sample and
assigns every row to its cell; a query looks into the nearest cells only, which a
join on the cell prunes. Cells hold CELL_ROWS rows on average until there are MAX_CELLS of
them, which bounds the table of centres that is broadcast; beyond that, cells grow with the
table and are searched in parallel parts. How many cells a query looks into is set when the index
is built, by the recall against exact search of TRIED of its rows. ``build_index`` searches exactly up to EXACT_ROWS
rows and by cells beyond; ``save`` and ``load`` keep an index as Parquet, rows by cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import dot, squared_distance, unit

#: Rows up to which search is exact by default, rows of a cell, most cells, and rows on which cells are learned at most.
EXACT_ROWS, CELL_ROWS, MAX_CELLS, SAMPLE_ROWS = 10_000, 4_000, 4_096, 100_000
#: Parts of a cell that are searched apart, least cells that a query looks into, and the recall and number of queries by which more are set.
PARTS, PROBES, RECALL, TRIED = 16, 32, 0.95, 200
#: Queries that go to the tasks at once.
BLOCK_QUERIES = 2_048


def top_k(vectors: DataFrame, query: list[float], k: int, order: str = "vec_id") -> DataFrame:
    """The k rows of the highest inner product with one query, ties by order, with score."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.withColumn("score", dot(F.col("embedding"), q)).orderBy(F.desc("score"), order).limit(k)


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int, order: str = "vec_id", block: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, order, score, rank): the k best rows of each query, ties by order (a long).

    The queries are a stated set against all rows. They go out in blocks of a fixed
    number, each one scan of the rows: a task multiplies a batch of rows with the
    block as matrices and keeps k rows a query, so that only those are shuffled.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(order).cast("bigint").alias(order), F.col("embedding").cast("array<double>").alias("embedding")).filter("embedding is not null")
    kinds, found = f"query_id long, {order} long, score double", None
    for names, q in _blocks(queries, block):
        part = rows.mapInArrow(_best(names, q, k, order), kinds)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], kinds)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), order))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _blocks(queries: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    names, vectors = [], []
    for r in queries.select(F.col("query_id").cast("bigint"), F.col("embedding").cast("array<double>")).filter("embedding is not null").toLocalIterator():
        names.append(r[0]), vectors.append(r[1])
        if len(names) == block:
            yield np.array(names), np.array(vectors)
            names, vectors = [], []
    if names:
        yield np.array(names), np.array(vectors)


def _best(names: np.ndarray, q: np.ndarray, k: int, order: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(order).to_numpy()
            m = batch.column("embedding").flatten().to_numpy().reshape(batch.num_rows, -1)
            scores = q @ m.T
            best = _top(scores, ids, k)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, best.shape[1])), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(scores, best, 1).ravel())], names=["query_id", order, "score"])

    return task


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Of each row of scores, the places of the k highest, ties by id."""
    n = scores.shape[1]
    if n <= 4 * k:
        return np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
    out = np.empty((len(scores), k), np.int64)
    least = np.partition(scores, n - k, axis=1)[:, n - k]
    for i, (row, bound) in enumerate(zip(scores, least)):
        # all that reach the k-th score, as ties at it are told apart by id
        at = np.flatnonzero(row >= bound)
        out[i] = at[np.lexsort((ids[at], -row[at]))[:k]]
    return out


def search(vectors: DataFrame, query: list[float], k: int = 6, least: float = 0.25, group: str = "label", order: str = "vec_id", over: int = 4, filters: str | None = None) -> DataFrame:
    """The best row of each group among the best over * k rows that score at least so much, k groups at most.

    The cut to over * k comes before the filter and the grouping, so fewer than k can come out.
    """
    best = top_k(vectors, query, over * k, order).filter(F.col("score") >= least)
    if filters:
        best = best.filter(filters)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), order))
    return best.withColumn("_r", rank).filter("_r = 1").drop("_r").orderBy(F.desc("score"), order).limit(k)


class CellIndex:
    """Rows with their cell, and the cells' centres; without centres (one cell), search is exact."""

    def __init__(self, rows: DataFrame, centres: DataFrame | None, cells: int, probes: int = PROBES):
        self.rows, self.centres, self.cells, self.probes = rows, centres, cells, probes

    def _near(self, queries: DataFrame) -> DataFrame:
        """(query_id, _q, cell, n): all cells of each query, the nearest first."""
        # the centres are at most MAX_CELLS rows
        near = queries.select("query_id", F.col("embedding").alias("_q")).join(F.broadcast(self.centres.select("cell", "centre")))
        near = near.withColumn("d", squared_distance(F.col("centre"), F.col("_q")))
        return near.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("d", "cell"))).select("query_id", "_q", "cell", "n")

    def tune(self, k: int = 10, target: float = RECALL, tried: int = TRIED, order: str = "vec_id") -> None:
        """Set probes to the least number of cells that reach the target recall of the k best, on some of the rows as queries."""
        asked = self.rows.orderBy(F.xxhash64(order, F.lit(3)), order).limit(tried).select(F.col(order).cast("bigint").alias("query_id"), "embedding")
        best = top_k_each(self.rows, asked, k, order).select("query_id", order)
        at = best.join(self.rows.select(order, "cell"), order).join(self._near(asked).select("query_id", "cell", "n"), ["query_id", "cell"])
        # at most k * tried numbers
        ranks = sorted(r["n"] for r in at.select("n").collect())
        self.probes = max(PROBES, ranks[min(len(ranks) - 1, int(target * len(ranks)))] if ranks else PROBES)

    def search(self, queries: DataFrame, k: int, probes: int | None = None, order: str = "vec_id") -> DataFrame:
        """(query_id, order, score, rank): the k best rows of the probed cells of each query."""
        if self.centres is None:
            return top_k_each(self.rows, queries, k, order)
        probed = self._near(queries).filter(F.col("n") <= (probes or self.probes)).select("query_id", "cell", "_q", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
        # a cell is searched in parts, as one may hold a third of the rows
        parts = self.rows.withColumn("part", F.pmod(F.xxhash64(order), F.lit(PARTS)).cast("int"))
        scored = parts.join(probed, ["cell", "part"]).withColumn("score", dot(F.col("embedding"), F.col("_q"))).drop("_q")
        best = F.row_number().over(Window.partitionBy("query_id", "cell", "part").orderBy(F.desc("score"), order))
        scored = scored.withColumn("rank", best).filter(F.col("rank") <= k)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), order))
        return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", order, "score", "rank")

    def save(self, path: str) -> None:
        """Write the index into a folder: rows, by cell, and centres."""
        (self.rows if self.centres is not None else self.rows.withColumn("cell", F.lit(0))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        if self.centres is not None:
            self.centres.withColumn("probes", F.lit(self.probes)).write.mode("overwrite").parquet(f"{path}/centres")


def load_index(spark: SparkSession, path: str) -> CellIndex:
    """An index that ``save`` wrote."""
    rows = spark.read.parquet(f"{path}/rows")
    try:
        centres = spark.read.parquet(f"{path}/centres")
    except AnalysisException:
        return CellIndex(rows, None, 1)
    cells, probes = centres.agg(F.count("*"), F.max("probes")).first()
    return CellIndex(rows, centres, cells, probes)


def build_cells(vectors: DataFrame, cells: int | None = None, seed: int = 7, sample: int = SAMPLE_ROWS, order: str = "vec_id") -> CellIndex:
    """Cells learned on about sample rows at most, every row assigned to one. Without rows, or with fewer than cells, the index is exact."""
    n = vectors.count()
    cells = cells or max(1, min(MAX_CELLS, max(min(256, n // 10), n // CELL_ROWS)))
    if n < max(2, cells):
        return CellIndex(vectors, None, 1)
    some = vectors.filter(F.pmod(F.xxhash64(order, F.lit(seed)), F.lit(1 << 20)) < min(1.0, sample / n) * (1 << 20))
    model: KMeansModel = KMeans(k=cells, seed=seed, maxIter=15, featuresCol="v").fit(some.select(array_to_vector("embedding").alias("v")))
    rows = model.transform(vectors.withColumn("v", array_to_vector("embedding"))).withColumnRenamed("prediction", "cell").drop("v")
    centres = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, centre array<double>")
    index = CellIndex(rows, centres, cells)
    index.tune(order=order)
    return index


def build_index(vectors: DataFrame, exact_rows: int = EXACT_ROWS, order: str = "vec_id") -> CellIndex:
    """Exact search up to exact_rows rows, cells beyond."""
    return CellIndex(vectors, None, 1) if vectors.count() <= exact_rows else build_cells(vectors, order=order)


def recall(found: DataFrame, exact: DataFrame, order: str = "vec_id") -> DataFrame:
    """(queries, wanted, hits, recall) of found against exact, both (query_id, order)."""
    hit = exact.join(found.select("query_id", order).withColumn("hit", F.lit(1)), ["query_id", order], "left")
    return hit.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("hits")).withColumn("recall", F.expr("try_divide(hits, wanted)"))


def normalised(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("embedding", unit(F.col("embedding")))
