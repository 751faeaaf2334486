"""Exact top-k search by cosine, for vectors and for texts, and the vector table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.embed import Buckets, unit_counts
from .curate import keep_first, new_rows

#: Bytes of query vectors that are sent to the executors for one pass over the index.
QUERY_BYTES = 128 << 20
#: Queries and rows of the index that are multiplied at a time.
QUERY_BLOCK, ROWS = 1024, 2048


def score(cosine: Column) -> Column:
    """0..1 with four places."""
    return F.round((1 + cosine) / 2, 4)


def ranked(hits: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """The best ``k`` per query with their rank; equal cosines (to ten places) by key."""
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.round("cosine", 10).desc(), key))
    return hits.withColumn("rank", place).where(F.col("rank") <= k).withColumn("score", score(F.col("cosine")))


def unit_vectors(length: int, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit vectors) of the lists of ``length`` finite numbers that are not all zero."""
    at = np.flatnonzero(np.diff(column.offsets.to_numpy()) == length) if length else np.empty(0, np.int64)
    if not len(at):
        return at, np.empty((0, length))
    x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
    norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return at[good], x[good] / norm[good][:, None]


def dense_topk(queries: DataFrame, index: DataFrame, query: str, key: str, vec: str = "embedding", k: int = 10, units: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]] | None = None, least: float = -2.0) -> DataFrame:
    """(query, key, cosine, score, rank) of the ``k`` nearest rows of the index for every query.

    Query vectors are sent out, at most QUERY_BYTES of them for one pass over the index; every task
    multiplies its rows with blocks of them and gives on what may still be among the best, so about
    tasks x queries x k rows are shuffled. Left out are null and zero vectors, vectors of another length
    than most queries have, and cosines up to ``least``. ``units`` makes unit vectors of a batch's
    column, if they are no lists of numbers.
    """
    if units is None:
        usual = queries.groupBy(F.size(vec).alias("length")).count().where("length > 0").orderBy(F.desc("count"), "length").first()
        units = partial(unit_vectors, usual["length"] if usual else 0)
    schema = f"`{query}` {queries.schema[query].dataType.simpleString()}, `{key}` {index.schema[key].dataType.simpleString()}, cosine double"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    parts: list[DataFrame] = []
    ids: list[pa.Array] = []
    vectors: list[np.ndarray] = []

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = units(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([v.tobytes() for v in x], pa.binary())], names=[query, "unit"])

    def search() -> None:
        shared = index.sparkSession.sparkContext.broadcast((pa.concat_arrays(ids), np.concatenate(vectors)))
        parts.append(index.where(F.col(vec).isNotNull()).select(key, vec).mapInArrow(_best(shared, k, units, least, arrow), schema))
        ids.clear()
        vectors.clear()

    packed = queries.where(F.col(vec).isNotNull()).select(query, vec).mapInArrow(unit, f"`{query}` {queries.schema[query].dataType.simpleString()}, unit binary")
    size = 0
    for r in packed.toLocalIterator(prefetchPartitions=True):
        ids.append(pa.array([r[0]], arrow.field(0).type))
        vectors.append(np.frombuffer(r[1])[None])
        size += len(r[1])
        if size >= QUERY_BYTES:
            search()
            size = 0
    if ids:
        search()
    empty = index.sparkSession.createDataFrame([], schema)
    return ranked(reduce(DataFrame.unionByName, parts) if parts else empty, query, key, k)


def _best(shared: Broadcast, k: int, units: Callable, least: float, arrow: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        floor = np.full(len(q), least)  # the k-th best that the task has seen for each query
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                at, x = units(part.column(1))
                if not len(at):
                    continue
                keys = part.column(0).take(pa.array(at))
                for a in range(0, len(q), QUERY_BLOCK):
                    cos = q[a : a + QUERY_BLOCK] @ x.T
                    if cos.shape[1] >= k:
                        best = -np.partition(-cos, k - 1, axis=1)[:, k - 1]
                        floor[a : a + QUERY_BLOCK] = np.maximum(floor[a : a + QUERY_BLOCK], best)
                    # ties at the cut are kept, the ranking after the shuffle settles them
                    i, j = np.nonzero((cos >= floor[a : a + QUERY_BLOCK, None] - 1e-9) & (cos > least))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(i + a)), keys.take(pa.array(j)), pa.array(cos[i, j])], schema=arrow)

    return run


def text_topk(queries: DataFrame, index: DataFrame, query: str, question: str, key: str, text: str = "text", k: int = 10) -> DataFrame:
    """As :func:`dense_topk` for the bags of words of two columns of text; rows that share no word with a query are no hits."""
    asked = queries.select(query, F.col(question).alias("_text"))
    return dense_topk(asked, index.select(key, F.col(text).alias("_text")), query, key, "_text", k, partial(unit_counts, Buckets()), 0.0)


def threshold(hits: DataFrame, least: float = 0.25) -> DataFrame:
    """Applied to the rounded score, after the top-k."""
    return hits.where(F.col("score") >= least)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system that Spark knows."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def append(rows: DataFrame, path: str, key: str = "chunk_id", order: str | None = None, embed: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Append the rows whose key the vector table lacks, the first of each key by ``order``; the table is made if it is missing.

    Without ``order`` the row that comes first by all its columns is taken. Rows without a key are left out.
    ``embed`` maps the rows that are new to rows with vectors.
    """
    rows = rows.where(F.col(key).isNotNull())
    first = keep_first(rows, key, order) if order else keep_first(rows, key, *(c for c, kind in rows.dtypes if c != key and not kind.startswith("map")))
    spark = rows.sparkSession
    if exists(spark, path):
        first = new_rows(first, spark.read.parquet(path), key)
    (embed(first) if embed else first).write.mode("append").parquet(path)


def create(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Open the vector table, made empty if it is missing."""
    if not exists(spark, path):
        spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def truncate(spark: SparkSession, path: str) -> None:
    """Empties the vector table; its columns stay."""
    spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)
