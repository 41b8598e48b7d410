"""A vector index that is stored, loaded, appended to and searched (M6, M7, J3, SNK6, SRC5).

An inverted file: vectors lie in lists by their nearest centre, one folder per list, so a search reads
only the lists it needs by partition pruning.  Of every list the index keeps how far its vectors turn away
from the centre and how long they are, which bounds the inner product of any query with all of
them.  An exact search reads the lists that can still hold one of the best; a probing search
reads a fixed number of lists per query.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.vectors import norm
from flowloom.operators.retrieval import (
    HIT_ARROW,
    HIT_SCHEMA,
    QUERIES_AT_ONCE,
    QUERY_BLOCK_BYTES,
    SCORE_CELLS,
    SLACK,
    _matrix,
    merged_hits,
)
from flowloom.schemas import TOP_K
from flowloom.session import materialise, open_folder, work_path

MOST_LISTS = 4_096  # centres are held by every task
SAMPLE_ROWS = 100_000  # at about this many vectors the centres are fitted; all are listed and bounded
FIRST_LISTS = 4  # an exact search begins with these
TRIED_QUERIES = 500  # of the indexed vectors, about, show how many probes the target recall needs
TARGET_RECALL = 0.97
MARKED_CELLS = 16_000_000  # queries of a block, times lists
LIST_BYTES = 16 << 20  # vectors of a list that a task holds at once
TASKS_PER_CORE = 2  # each reads the lists its queries need

_LISTED = "list int, doc_pos long, embedding array<double>, turn double, length double"


@dataclass(frozen=True)
class VectorIndex:
    """Centres and bounds, at most ``MOST_LISTS`` rows; the lists stay in ``path``."""

    path: str
    centres: np.ndarray
    size: np.ndarray
    turn: np.ndarray  # the least cosine of a member with its centre
    shortest: np.ndarray
    longest: np.ndarray
    probes: int = 1  # lists that a probing search reads, unless told otherwise

    def lists(self, spark: SparkSession, wanted: list[int] | None = None) -> DataFrame:
        """(list, doc_pos, embedding); only the folders of ``wanted`` lists are read."""
        rows = spark.read.schema("doc_pos long, embedding array<double>, list int").parquet(f"{self.path}/lists")
        return rows if wanted is None else rows.where(F.col("list").isin(wanted))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(query, list): no member's inner product with the query is larger."""
        lengths = np.sqrt((queries * queries).sum(axis=1))
        cosine = queries @ self.centres.T / np.where(lengths, lengths, 1)[:, None]
        between = np.arccos(np.clip(cosine, -1, 1)) - np.arccos(np.clip(self.turn, -1, 1))[None, :]
        best = np.cos(np.maximum(between, 0))
        most = np.where(best > 0, self.longest, np.where(self.size > 0, self.shortest, 0))
        reach = best * most * lengths[:, None]
        return np.where(self.size > 0, reach, -np.inf)


def indexable(vector: Column, dim: int) -> Column:
    """A vector of the right length whose components are all finite."""
    wide = vector.cast("array<double>")
    odd = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(wide) == dim) & ~odd, F.lit(False))


def unindexable(corpus: DataFrame, dim: int) -> DataFrame:
    """Rows that an index leaves out, with the reason."""
    wrong = F.when(F.col("embedding").isNull(), "missing").when(F.size("embedding") != dim, "length").otherwise("not finite")
    return corpus.where(~indexable(F.col("embedding"), dim)).select("doc_pos", wrong.alias("reason"))


def _fitted_centres(corpus: DataFrame, lists: int, rows: int) -> np.ndarray:
    """Unit centres by k-means on a sample; fewer if the sample has fewer distinct vectors."""
    step = max(1, rows // SAMPLE_ROWS)
    sample = corpus.where((norm(F.col("embedding")) > 0) & (F.pmod(F.xxhash64("doc_pos"), F.lit(step)) == 0))
    sample = materialise(sample.select(array_to_vector("embedding").alias("features")))
    if sample.isEmpty():
        return np.empty((0, 0))
    model = KMeans(k=max(2, lists), maxIter=8, seed=7).fit(sample)
    centres = np.array(model.clusterCenters())
    lengths = np.sqrt((centres * centres).sum(axis=1))
    return centres[lengths > 0] / lengths[lengths > 0][:, None]


def _listed(corpus: DataFrame, centres: np.ndarray) -> DataFrame:
    """Every vector with its list, its cosine with the centre and its length."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES_AT_ONCE):
                part = batch.slice(at, QUERIES_AT_ONCE)
                vectors = _matrix(part.column(1))
                lengths = np.sqrt((vectors * vectors).sum(axis=1))
                near = vectors @ centres.T
                own = near.argmax(axis=1)
                turn = np.where(lengths > 0, near[np.arange(len(own)), own] / np.where(lengths > 0, lengths, 1), 1.0)
                columns = [pa.array(own.astype(np.int32)), *part.columns, pa.array(turn), pa.array(lengths)]
                yield pa.RecordBatch.from_arrays(columns, names=["list", "doc_pos", "embedding", "turn", "length"])

    return corpus.select(F.col("doc_pos").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(place, _LISTED)


def _append(corpus: DataFrame, centres: np.ndarray, path: str) -> None:
    rows = _listed(corpus.where(indexable(F.col("embedding"), centres.shape[1])), centres)
    # Large lists are written by several tasks, small ones share one.
    rows = materialise(rows)
    rows.select("list", "doc_pos", "embedding").hint("rebalance", "list").write.mode("append").partitionBy("list").parquet(f"{path}/lists")
    bounds = rows.groupBy("list").agg(
        F.count("*").alias("n"), F.min("turn").alias("turn"), F.min("length").alias("shortest"), F.max("length").alias("longest")
    )
    bounds.write.mode("append").parquet(f"{path}/bounds")


def build_index(corpus: DataFrame, path: str, lists: int | None = None) -> VectorIndex:
    """Index ``corpus(doc_pos, embedding)`` in a new folder, by default in as many lists as the root of its size.

    Vectors that are missing, not finite or of another length than the most frequent one are left out;
    ``unindexable`` tells which.  An empty corpus gives an index without lists.
    """
    spark = corpus.sparkSession
    usual = corpus.groupBy(F.size("embedding").alias("dim")).count().where("dim > 0").orderBy(F.desc("count"), "dim").first()
    dim = usual["dim"] if usual else 0
    rows = usual["count"] if usual else 0
    good = corpus.where(indexable(F.col("embedding"), dim))
    centres = _fitted_centres(good, min(MOST_LISTS, lists or max(1, int(rows**0.5))), rows) if rows else np.empty((0, 0))
    if rows and not len(centres):  # zero vectors only
        centres = np.eye(1, dim)
    table = [(i, c.tolist()) for i, c in enumerate(centres)]
    spark.createDataFrame(table, "list int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    if rows:
        _append(good, centres, path)
        step = max(1, rows // TRIED_QUERIES)
        tried = good.where(F.pmod(F.xxhash64("doc_pos", F.lit(1)), F.lit(step)) == 0)
        index = load_index(spark, path)
        probes = fitting_probes(tried.select(F.col("doc_pos").alias("query_id"), "embedding"), index, skip_self=True)
        spark.createDataFrame([(probes,)], "probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/probes")
    return load_index(spark, path)


def fitting_probes(queries: DataFrame, index: VectorIndex, target: float = TARGET_RECALL, k: int = TOP_K, skip_self: bool = False) -> int:
    """The fewest probes that find ``target`` of the exact k best of these queries.

    Each exact hit needs as many probes as its list has places among the lists by nearness to the query.
    """
    hits = pruned_search(queries, index, k, skip_self).select("query_id", "doc_pos")
    where = index.lists(queries.sparkSession).select("doc_pos", "list")
    pairs = hits.join(where, "doc_pos").join(queries.select("query_id", F.col("embedding").cast("array<double>")), "query_id")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.where(index.size > 0, _matrix(batch.column(0)) @ index.centres.T, -np.inf) if batch.num_rows else np.empty((0, 1))
            own = np.take_along_axis(near, batch.column(1).to_numpy().astype(np.int64)[:, None], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array((near > own).sum(axis=1) + 1)], names=["probes"])

    counts = pairs.select("embedding", "list").mapInArrow(place, "probes long").groupBy("probes").count().orderBy("probes").collect()
    total, found = sum(r["count"] for r in counts), 0  # one row per list at most
    for r in counts:
        found += r["count"]
        if found >= target * total:
            return r["probes"]
    return 1


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    """The stored index: centres, and bounds gathered over all appends."""
    centres = sorted(spark.read.parquet(f"{path}/centres").collect(), key=lambda r: r["list"])  # at most MOST_LISTS
    n = len(centres)
    size, turn, shortest, longest = np.zeros(n, np.int64), np.ones(n), np.full(n, np.inf), np.zeros(n)
    if n:
        bounds = spark.read.parquet(f"{path}/bounds").groupBy("list")
        for r in bounds.agg(F.sum("n"), F.min("turn"), F.min("shortest"), F.max("longest")).collect():
            size[r[0]], turn[r[0]], shortest[r[0]], longest[r[0]] = r[1:]
    try:
        probes = spark.read.parquet(f"{path}/probes").first()["probes"]
    except AnalysisException:  # not tried yet
        probes = 1
    return VectorIndex(path, np.array([r["centre"] for r in centres]) if n else np.empty((0, 0)), size, turn, shortest, longest, probes)


def append_to_index(index: VectorIndex, corpus: DataFrame) -> VectorIndex:
    """New rows go to the lists of the centres that there are; only new files are written."""
    _append(corpus, index.centres, index.path)
    return load_index(corpus.sparkSession, index.path)


def _wanted(queries: DataFrame, choose) -> DataFrame:
    """(query_id, list) for the lists that ``choose(vectors, least)`` marks for each query."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES_AT_ONCE):
                part = batch.slice(at, QUERIES_AT_ONCE)
                row, found = np.nonzero(choose(_matrix(part.column(1)), part.column(2).to_numpy(zero_copy_only=False)))
                chosen = part.column(0).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([chosen, pa.array(found.astype(np.int32))], names=["query_id", "list"])

    return queries.select("query_id", "embedding", "least").mapInArrow(mark, "query_id long, list int")


class _BestOfBlock:
    """The best k rows of every query of a block over all lists seen so far."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, skip_self: bool):
        self.query_ids, self.queries, self.k, self.skip_self = query_ids, queries, k, skip_self
        self.scores = np.full((len(query_ids), k), -np.inf)
        self.docs = np.full((len(query_ids), k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, docs: np.ndarray, vectors: np.ndarray) -> None:
        """Vectors of a list, for the queries in ``rows``."""
        step = max(self.k, SCORE_CELLS // QUERIES_AT_ONCE)
        for low in range(0, len(rows), QUERIES_AT_ONCE):
            for at in range(0, len(docs), step):
                self._add_block(rows[low : low + QUERIES_AT_ONCE], docs[at : at + step], vectors[at : at + step])

    def _add_block(self, rows: np.ndarray, docs: np.ndarray, vectors: np.ndarray) -> None:
        """A product of matrices finds the few candidates; their scores are summed in one fixed order."""
        queries, least = self.queries[rows], self.scores[rows, -1]
        rough = queries @ vectors.T
        if self.skip_self:
            rough[self.query_ids[rows][:, None] == docs[None, :]] = -np.inf
        new = np.flatnonzero(least == -np.inf)
        if len(new) and len(docs) > self.k:
            least[new] = np.partition(rough[new], len(docs) - self.k, axis=1)[:, len(docs) - self.k]
        at, row = np.nonzero((rough >= least[:, None] - SLACK) & (rough > -np.inf))
        if not len(at):
            return
        exact = np.zeros(len(row))
        for j in range(vectors.shape[1]):
            exact += vectors[row, j] * queries[at, j]
        order = np.lexsort((docs[row], -exact, at))
        at, row, exact = at[order], row[order], exact[order]
        some, first, at = np.unique(at, return_index=True, return_inverse=True)
        place = np.arange(len(at)) - first[at]
        kept = place < self.k
        at, row, exact, place = at[kept], row[kept], exact[kept], place[kept]
        scores, found = np.full((len(some), self.k), -np.inf), np.full((len(some), self.k), np.iinfo(np.int64).max)
        scores[at, place], found[at, place] = exact, docs[row]
        scores = np.concatenate([self.scores[rows[some]], scores], axis=1)
        found = np.concatenate([self.docs[rows[some]], found], axis=1)
        order = np.lexsort((found, -scores), axis=-1)[:, : self.k]
        self.scores[rows[some]] = np.take_along_axis(scores, order, axis=1)
        self.docs[rows[some]] = np.take_along_axis(found, order, axis=1)

    def rows(self) -> dict[str, np.ndarray]:
        row, place = np.nonzero(self.scores > -np.inf)
        return {"query_id": self.query_ids[row], "doc_pos": self.docs[row, place], "score": self.scores[row, place]}


def _search_lists(asked: DataFrame, index: VectorIndex, k: int, skip_self: bool, *choices) -> DataFrame:
    """The best k of each query in the lists that ``choices`` mark, one choice after the other.

    Queries with the same nearest list lie together, in blocks of bounded size.  A task reads the
    files of the lists that its block needs and keeps the best k so far, whose scores the next
    choice knows: neither vectors by list nor hits by list are ever rows.
    """
    spark = asked.sparkSession
    files = defaultdict(list)
    for name in sorted(index.lists(spark).inputFiles()):
        files[int(re.search(r"/list=(\d+)/", name)[1])].append(name)
    files = dict(files)
    width = 8 * index.centres.shape[1]
    most = max(1, min(QUERY_BLOCK_BYTES // max(1, width), MARKED_CELLS // len(index.centres)))
    read_rows = max(1, LIST_BYTES // max(1, width))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES_AT_ONCE):
                part = batch.slice(at, QUERIES_AT_ONCE)
                own = (_matrix(part.column(1)) @ index.centres.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.astype(np.int32))], names=["query_id", "embedding", "near"])

    def searched(ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        best = _BestOfBlock(ids, vectors, k, skip_self)
        for choose in choices:
            parts = [slice(low, low + QUERIES_AT_ONCE) for low in range(0, len(ids), QUERIES_AT_ONCE)]
            marked = np.concatenate([choose(vectors[p], best.scores[p, -1]) for p in parts])
            for at in np.flatnonzero(marked.any(axis=0)):
                rows = np.flatnonzero(marked[:, at])
                for name in files.get(int(at), ()):
                    for docs, listed in _read_list(name, read_rows):
                        best.add(rows, docs, listed)
        return pa.RecordBatch.from_pydict(best.rows(), schema=HIT_ARROW)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, most - size)
                batch = batch.slice(part.num_rows)
                held.append((part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1))))
                size += part.num_rows
                if size == most:
                    yield searched(*map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            yield searched(*map(np.concatenate, zip(*held, strict=True)))

    placed = asked.select("query_id", "embedding").mapInArrow(near, "query_id long, embedding array<double>, near int")
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    return placed.repartitionByRange(tasks, "near", "query_id").select("query_id", "embedding").mapInArrow(scan, HIT_SCHEMA)


def _read_list(name: str, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and vectors of one file of a list, some rows at a time."""
    system, path = open_folder(name)
    with system.open_input_file(path) as file:
        for batch in pq.ParquetFile(file).iter_batches(batch_size=rows, columns=["doc_pos", "embedding"]):
            if batch.num_rows:
                yield batch.column(0).to_numpy(), _matrix(batch.column(1))


def _asked(queries: DataFrame, index: VectorIndex) -> DataFrame:
    """Usable queries; the least score that matters is not known yet."""
    rows = queries.where(indexable(F.col("embedding"), index.centres.shape[1]))
    return rows.select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>"), F.lit(float("-inf")).alias("least"))


def probe_search(
    queries: DataFrame, index: VectorIndex, k: int = TOP_K, probes: int | None = None, skip_self: bool = False
) -> DataFrame:
    """The best k of the ``probes`` lists whose centres are nearest: (query_id, rank, doc_pos, score).

    Without ``probes``, as many lists as the index found necessary when it was built.
    """
    probes = probes or index.probes
    if not len(index.centres):
        return _no_hits(queries)

    def nearest(vectors: np.ndarray, _) -> np.ndarray:
        near = np.where(index.size > 0, vectors @ index.centres.T, -np.inf)
        chosen = np.zeros(near.shape, bool)
        np.put_along_axis(chosen, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, axis=1)
        return chosen & (index.size > 0)

    return merged_hits(_search_lists(_asked(queries, index), index, k, skip_self, nearest), k)


def _no_hits(queries: DataFrame) -> DataFrame:
    return queries.sparkSession.createDataFrame([], "query_id long, rank int, doc_pos long, score double")


def _first_lists(index: VectorIndex, k: int):
    """The lists with the highest bounds: some, and as many as k rows need."""

    def choose(vectors: np.ndarray, _) -> np.ndarray:
        bound = index.bounds(vectors)
        order = np.argsort(-bound, axis=1, kind="stable")
        ahead = np.cumsum(index.size[order], axis=1) - index.size[order]
        chosen = np.zeros(bound.shape, bool)
        np.put_along_axis(chosen, order, (np.arange(bound.shape[1]) < FIRST_LISTS) | (ahead <= k), axis=1)
        return chosen & (bound > -np.inf)

    return choose


def _other_lists(index: VectorIndex, k: int):
    """The lists not among the first whose bound reaches the k-th score found there."""
    first = _first_lists(index, k)

    def choose(vectors: np.ndarray, least: np.ndarray) -> np.ndarray:
        return (index.bounds(vectors) >= least[:, None] - SLACK) & ~first(vectors, least) & (index.size > 0)

    return choose


def search_plan(queries: DataFrame, index: VectorIndex, k: int = TOP_K, skip_self: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits of the first lists, queries with their first lists, queries with the lists that remain)."""
    asked = _asked(queries, index)
    hits = materialise(merged_hits(_search_lists(asked, index, k, skip_self, _first_lists(index, k)), k))
    reached = hits.where(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
    known = asked.join(reached, "query_id", "left").withColumn("least", F.coalesce("reached", "least"))
    return hits, _wanted(asked, _first_lists(index, k)), _wanted(known, _other_lists(index, k))


def pruned_search(queries: DataFrame, index: VectorIndex, k: int = TOP_K, skip_self: bool = False) -> DataFrame:
    """The k best rows of the whole index per query, ties by position, as ``top_k`` finds them.

    Most lists are never read: after the first ones, only those whose bound reaches the k-th
    score so far.  Queries that are missing, not finite or of another length find nothing.
    ``query_id`` must be unique.
    """
    if not len(index.centres):
        return _no_hits(queries)
    return merged_hits(_search_lists(_asked(queries, index), index, k, skip_self, _first_lists(index, k), _other_lists(index, k)), k)


def recall_by_probes(queries: DataFrame, index: VectorIndex, probes: list[int], k: int = TOP_K, skip_self: bool = False) -> DataFrame:
    """For each number of probes, the share of the exact k best that it finds: (probes, wanted, found, recall)."""
    exact = materialise(pruned_search(queries, index, k, skip_self).select("query_id", "doc_pos"))
    out = None
    for n in probes:
        found = probe_search(queries, index, k, n, skip_self).select("query_id", "doc_pos", F.lit(1).alias("hit"))
        row = exact.join(found, ["query_id", "doc_pos"], "left").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))
        row = row.select(F.lit(n).alias("probes"), "wanted", "found", F.try_divide("found", "wanted").alias("recall"))
        out = row if out is None else out.union(row)
    return out
