"""Exact top-k retrieval by inner product and what follows it.

The scores of all (query, document) pairs are never rows.  A task multiplies its block of
document vectors with one block of query vectors after the other and keeps the best k per
query, so it emits k rows per query and shard however many documents the shard has.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from flowloom.functions.vectors import norm, unit
from flowloom.schemas import TOP_K
from flowloom.session import open_folder, plan_bytes, work_path

# Query vectors lie in the shared folder in blocks of this size; a task reads them one after
# the other for each shard of the corpus that it holds.
QUERY_BLOCK_BYTES = 32 << 20
SHARD_BYTES = 128 << 20
SMALL_SHARE = 8  # a plan's bound may be of compressed files, which hold vectors in half the bytes
SCORE_CELLS = 4_000_000
ENCODED_CELLS = 1 << 18  # words and vector components that a task encodes at once
QUERIES_AT_ONCE = 2_000  # so that a product of SCORE_CELLS has as many documents
MERGE_SALTS = 64
# A product of matrices may differ from a plain sum by less than this for unit vectors.
SLACK = 1e-9

HIT_SCHEMA = "query_id long, doc_pos long, score double"
HIT_ARROW = pa.schema([("query_id", pa.int64()), ("doc_pos", pa.int64()), ("score", pa.float64())])


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) == 0:
        return values.reshape(0, 0)
    if len(values) % len(column):
        raise ValueError("vectors differ in length")
    return values.reshape(len(column), -1)


def _unit_matrix(column) -> np.ndarray:
    vectors = _matrix(column)
    lengths = np.sqrt((vectors * vectors).sum(axis=1))
    if len(vectors) and not ((lengths == 0) | (np.abs(lengths - 1) < 1e-3)).all():
        raise ValueError("vectors must be L2-normalised")
    return vectors


class _Best:
    """The best k documents per query seen so far: score descending, then position.

    A matrix product finds the few documents that can be among the best; their scores are
    then summed in one fixed order, so equal vectors have equal scores wherever they lie.
    """

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, skip_self: bool):
        self.query_ids, self.queries, self.k, self.skip_self = query_ids, queries, k, skip_self
        self.least = np.full(len(query_ids), -np.inf)
        self.at, self.docs, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, docs: np.ndarray, vectors: np.ndarray) -> None:
        if len(docs) == 0 or len(self.query_ids) == 0:
            return
        step = max(self.k, SCORE_CELLS // len(self.query_ids))
        for start in range(0, len(docs), step):
            self._add_block(docs[start : start + step], vectors[start : start + step])

    def _add_block(self, docs: np.ndarray, vectors: np.ndarray) -> None:
        rough = vectors @ self.queries.T
        if self.skip_self:
            rough[docs[:, None] == self.query_ids[None, :]] = -np.inf
        least = self.least
        if len(docs) > self.k:
            least = np.maximum(least, np.partition(rough, len(docs) - self.k, axis=0)[len(docs) - self.k])
        row, at = np.nonzero((rough >= least[None, :] - SLACK) & (rough > -np.inf))
        exact = np.zeros(len(row))
        for j in range(vectors.shape[1]):
            exact += vectors[row, j] * self.queries[at, j]
        at, docs = np.concatenate([self.at, at]), np.concatenate([self.docs, docs[row]])
        scores = np.concatenate([self.scores, exact])
        order = np.lexsort((docs, -scores, at))
        at, docs, scores = at[order], docs[order], scores[order]
        first = np.searchsorted(at, np.arange(len(self.query_ids) + 1))
        kept = np.arange(len(at)) - first[at] < self.k
        self.at, self.docs, self.scores = at[kept], docs[kept], scores[kept]
        full = np.flatnonzero(np.diff(first) >= self.k)
        self.least[full] = scores[first[full] + self.k - 1]

    def rows(self) -> dict[str, np.ndarray]:
        return {"query_id": self.query_ids[self.at], "doc_pos": self.docs, "score": self.scores}


def _shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The positions and vectors that a task reads, in shards of about ``shard_bytes``."""
    held, size = [], 0
    for batch in batches:
        vectors = _unit_matrix(batch.column("embedding"))
        if not len(vectors):
            continue
        held.append((batch.column("doc_pos").to_numpy(zero_copy_only=False), vectors))
        size += vectors.nbytes
        if size >= shard_bytes:
            yield np.concatenate([d for d, _ in held]), np.concatenate([v for _, v in held])
            held, size = [], 0
    if held:
        yield np.concatenate([d for d, _ in held]), np.concatenate([v for _, v in held])


def _query_blocks(queries: DataFrame, block_bytes: int) -> list[str]:
    """Write the queries to the shared folder, in files of at most about ``block_bytes``.

    Few queries, as the plan's bound of their size tells, are one file and need not be counted.
    """
    if SMALL_SHARE * plan_bytes(queries) <= block_bytes:
        path = work_path(queries.sparkSession, "query-blocks")
        queries.coalesce(1).write.parquet(path)
        return sorted(queries.sparkSession.read.schema(queries.schema).parquet(path).inputFiles())
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    rows = max(1, block_bytes // (8 * max(1, size["dim"] or 1)))
    path = work_path(queries.sparkSession, "query-blocks")
    dealt = queries.repartition(max(1, -(-size["n"] // rows)), "query_id")
    dealt.write.option("maxRecordsPerFile", rows).parquet(path)
    return sorted(queries.sparkSession.read.schema(queries.schema).parquet(path).inputFiles()) if size["n"] else []


def _read_block(path: str) -> pa.Table:
    system, name = open_folder(path)
    with system.open_input_file(name) as file:
        return pq.read_table(file)


def top_k(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = TOP_K,
    skip_self: bool = False,
    block_bytes: int = QUERY_BLOCK_BYTES,
) -> DataFrame:
    """The k best documents per query: ``(query_id, rank, doc_pos, score)``.

    ``queries(query_id, embedding)`` and ``corpus(doc_pos, embedding)`` hold unit vectors.
    Equal scores rank by position; a corpus smaller than k gives fewer rows.
    ``skip_self`` leaves out the document whose position equals the query id.
    The queries are written to the shared folder at once and never reach the driver, which
    only has the names of their files.
    """
    queries = queries.select(F.col("query_id").cast("long"), "embedding")
    corpus = corpus.select(F.col("doc_pos").cast("long"), "embedding")
    files = _query_blocks(queries, block_bytes)
    if not files:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, doc_pos long, score double")

    shard_bytes = SHARD_BYTES

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, vectors in _shards(batches, shard_bytes):
            for path in files:
                block = _read_block(path)
                ids, wanted = block.column("query_id").to_numpy(), _unit_matrix(block.column("embedding"))
                for at in range(0, len(ids), QUERIES_AT_ONCE):
                    best = _Best(ids[at : at + QUERIES_AT_ONCE], wanted[at : at + QUERIES_AT_ONCE], k, skip_self)
                    best.add(docs, vectors)
                    yield pa.RecordBatch.from_pydict(best.rows(), schema=HIT_ARROW)

    return merged_hits(corpus.mapInArrow(scan, HIT_SCHEMA), k)


def merged_hits(partial: DataFrame, k: int) -> DataFrame:
    """The k best of each query; every shard has k rows per query, so they are merged in two steps."""
    order = [F.desc("score"), F.col("doc_pos")]
    salt = F.pmod(F.xxhash64("doc_pos"), F.lit(MERGE_SALTS))
    some = Window.partitionBy("query_id", "salt").orderBy(*order)
    best = Window.partitionBy("query_id").orderBy(*order)
    return (
        partial.withColumn("salt", salt)
        .withColumn("rank", F.row_number().over(some))
        .where(F.col("rank") <= k)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "doc_pos", "score")
    )


def with_documents(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Look up the text and label of every hit; an id without a document vanishes."""
    return hits.join(documents.select("doc_pos", "input", "output"), "doc_pos").select(
        "query_id", "rank", "doc_pos", "score", "input", F.coalesce("output", F.lit("")).alias("output")
    )


def neighbour_vote(hits: DataFrame) -> DataFrame:
    """Most frequent label among the hits of a query, the smaller label on a tie."""
    best = Window.partitionBy("query_id").orderBy(F.desc("votes"), "output")
    return (
        hits.groupBy("query_id", "output")
        .agg(F.count("*").alias("votes"))
        .withColumn("place", F.row_number().over(best))
        .where(F.col("place") == 1)
        .select("query_id", F.col("output").alias("suggested"), "votes")
    )


def normalised(df: DataFrame, column: str = "embedding") -> DataFrame:
    """L2-normalise a vector column."""
    return (
        df.withColumn("_length", norm(F.col(column)))
        .withColumn(column, unit(F.col(column), F.col("_length")))
        .drop("_length")
    )


def class_centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """Unit mean vector per class, one partial sum per task and class."""
    means = vectors.groupBy(label).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))).alias(
            "embedding"
        )
    )
    return normalised(means.select(F.col(label).cast("long").alias("query_id"), "embedding"))


@dataclass(frozen=True)
class CorpusEncoder:
    """Text encoder: words -> hashed counts -> inverse document frequency -> unit length (M6).

    Words are runs of letters and digits of any script, lower-cased.  A word's bucket is the
    number in the first eight hex digits of its MD5 hash, modulo the dimension.  Words that
    share a bucket cannot be told apart: with few buckets similar texts still meet, but so do
    unrelated ones, so give a large vocabulary a large dimension.
    """

    idf: tuple[float, ...]

    @property
    def dim(self) -> int:
        return len(self.idf)

    def __call__(self, texts: DataFrame, key: str = "doc_pos", text: str = "input") -> DataFrame:
        """Add ``embedding``, row by row; a text without words, or null, has zeros."""
        weights, dim, most = np.array(self.idf), self.dim, ENCODED_CELLS

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, end in _parts(batch.column(batch.num_columns - 1), dim, most):
                    part = batch.slice(at, end - at)
                    buckets = part.column(part.num_columns - 1)
                    row = np.repeat(np.arange(part.num_rows), np.diff(buckets.offsets.to_numpy()))
                    row *= dim
                    row += buckets.flatten().to_numpy()
                    vectors = np.bincount(row, minlength=part.num_rows * dim).reshape(-1, dim) * weights
                    length = np.sqrt((vectors * vectors).sum(axis=1))[:, None]
                    vectors /= np.where(length > 0, length, 1)
                    offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * dim)
                    column = pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], column], names=[*part.schema.names[:-1], "embedding"])

        rest = texts.drop("embedding")
        buckets = F.coalesce(word_buckets(F.col(text), dim), F.array().cast("array<int>")).alias("embedding")
        schema = StructType([*rest.schema.fields, StructField("embedding", ArrayType(DoubleType()))])
        return rest.select(*rest.columns, buckets).mapInArrow(count, schema)


def _parts(lists: pa.ListArray, dim: int, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` words and vector components, or of one row."""
    reach = lists.offsets.to_numpy().astype(np.int64) + dim * np.arange(len(lists) + 1)
    at = 0
    while at < len(lists):
        end = max(at + 1, int(np.searchsorted(reach, reach[at] + most, side="right")) - 1)
        yield at, end
        at = end


def word_buckets(text: Column, dim: int) -> Column:
    """The bucket of every word of a text."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dim).cast("int"))


def fit_corpus_encoder(corpus: DataFrame, dim: int = 256, text: str = "input") -> CorpusEncoder:
    """Weights ln((documents + 1) / (documents with the bucket + 1)), in one aggregation."""
    buckets = corpus.select(F.explode_outer(F.array_distinct(word_buckets(F.col(text), dim))).alias("i"))
    seen = {r["i"]: r["count"] for r in buckets.groupBy("i").count().collect()}  # at most ``dim`` + 1 rows
    documents = corpus.count()
    return CorpusEncoder(tuple(math.log((documents + 1) / (seen.get(i, 0) + 1)) for i in range(dim)))


def encode_corpus(corpus: DataFrame, encoder: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Add ``embedding`` to every row that has an ``input`` text."""
    return encoder(corpus)
