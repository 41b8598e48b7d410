"""Embedding near-dedup (2): pivot-permutation index.

Vectors are described by their ``prefix`` nearest pivots, in order.  Inverted lists per (label,
pivot) hold the vectors that have the pivot there; two vectors that share at least
``shared`` pivots are candidates, and the exact cosine decides.  A pair is looked at in the
list of its first shared pivot only.

Equal vectors are one entry with a count.  Lists longer than ``BLOCK`` are cut into blocks and
pairs of blocks, each a group of its own, and a group returns one row per vector (how many
it links with, and its class there), never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import stored
from flowloom.llm.components import components

PIVOTS_PER_ROOT = 4  # pivots = 4 * sqrt(vectors), which keeps lists and pivot tables alike in size
MOST_PIVOTS = 16_384
PREFIX = 12
SHARED = 2
BLOCK = 1_024


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite, and is not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def unit_rows(column: pa.Array) -> np.ndarray:
    """A list column as unit vectors in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _classes(linked: np.ndarray) -> np.ndarray:
    """The smallest row that each row of a symmetric link matrix reaches."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(1, initial=len(linked)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _linked_in_list(table: pa.Table, least: float, shared: int) -> pa.Table:
    """Links of one (list, block pair): a row per linked vector."""
    column = lambda name: table.column(name).combine_chunks()
    vec, copies, block = (column(c).to_numpy(zero_copy_only=False) for c in ("node", "copies", "block"))
    order = np.argsort(vec)
    near = np.sort(column("near").flatten().to_numpy().reshape(len(vec), -1), 1)[order]
    x = unit_rows(column("embedding"))[order]
    vec, copies, block = vec[order], copies[order], block[order]
    first, second, pivot = (int(column(c)[0].as_py()) for c in ("a", "b", "pivot"))
    linked = (x @ x.T) >= least
    np.fill_diagonal(linked, False)
    if first != second:
        linked &= block[:, None] != block[None, :]
    i, j = np.nonzero(np.triu(linked))
    same = near[i][:, :, None] == near[j][:, None, :]
    in_both = same.any(2)
    lowest = np.where(in_both, near[i], np.iinfo(np.int32).max).min(1, initial=np.iinfo(np.int32).max)
    keep = (in_both.sum(1) >= shared) & (lowest == pivot)
    linked = np.zeros_like(linked)
    linked[i[keep], j[keep]] = True
    linked |= linked.T
    label = _classes(linked)
    some = np.flatnonzero(linked.any(1))
    return pa.table(
        {"node": vec[some], "links": (linked[some] @ copies).astype(np.int64), "class": vec[label[some]]}
    )


def near_duplicate_vectors(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    least: float = 0.93,
    prefix: int = PREFIX,
    shared: int = SHARED,
) -> DataFrame:
    """Link vectors of equal, non-null label whose cosine is at least ``least``.

    Returns one row per input row: id, ``n_links`` (other rows linked directly),
    ``component_id`` (the smallest id reachable by links, itself included) and ``kept``.
    Every pair that is returned as linked was verified in double precision; the index may miss
    pairs that share fewer than ``shared`` of their ``prefix`` nearest pivots.  Vectors that are
    null, empty, zero, or hold null or non-finite components link with nothing.  Vectors of different
    lengths do not link; each length has an index of its own.  An empty table gives no rows.  Rows with equal ids and vectors link like any others; a null id stays null and
    links with nothing.  Pivots are a hash-chosen sample of the vectors, 4 * sqrt(n) of them,
    at most ``MOST_PIVOTS``; every vector is indexed.
    """
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(label_column).cast("string").alias("label"),
        F.col(vector_column).cast("array<double>").alias("embedding"),
    )
    good = rows.where(usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("id").isNotNull())
    classes = None
    for length in good.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows")).orderBy("n").collect():
        part = _classes_of_length(good.where(F.size("embedding") == length["n"]), length["rows"], least, prefix, shared)
        classes = part if classes is None else classes.union(part)
    if classes is None:
        return rows.select(F.col("id").alias(id_column), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    usable_row = usable(F.col("l.embedding")) & F.col("l.id").isNotNull()
    same = (F.col("l.label") == F.col("r.label")) & (F.col("l.embedding") == F.col("r.embedding")) & usable_row
    out = rows.alias("l").join(classes.alias("r"), same, "left")
    component = F.coalesce("r.first", "l.id")
    return out.select(
        F.col("l.id").alias(id_column),
        (F.coalesce("r.links", F.lit(0)) + F.coalesce(F.col("r.copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("l.id") == component, F.lit(True)).alias("kept"),
    )


def _classes_of_length(good: DataFrame, count: int, least: float, prefix: int, shared: int) -> DataFrame:
    """(label, embedding, copies, links, first) for distinct labelled vectors of one length."""
    whole = good.groupBy("label", "embedding").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    whole = whole.select(F.monotonically_increasing_id().alias("node"), "rep", "label", "embedding", "copies")
    whole = stored(whole, "vectors")
    wanted = int(min(MOST_PIVOTS, max(16, PIVOTS_PER_ROOT * count ** 0.5)))
    sample = whole.orderBy(F.xxhash64("rep", F.lit(11)), "rep").limit(wanted).select("embedding").toArrow()
    pivots = unit_rows(sample.column("embedding").combine_chunks()).astype(np.float32)
    depth = min(prefix, len(pivots))
    needed = min(shared, depth)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                score = unit_rows(part.column(1)).astype(np.float32) @ pivots.T
                top = np.argpartition(-score, depth - 1, axis=1)[:, :depth]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable"), 1)
                near = pa.FixedSizeListArray.from_arrays(pa.array(top.astype(np.int32).ravel()), depth).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), near], names=["node", "near"])

    index = stored(whole.select("node", "embedding").mapInArrow(described, "node long, near array<int>"), "vector-index")
    index = index.join(whole, "node")
    sizes = index.select("label", F.explode("near").alias("pivot")).groupBy("label", "pivot").agg(F.count("*").alias("n"))
    sizes = sizes.where("n > 1").select("label", "pivot", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    lists = index.withColumn("pivot", F.explode("near")).join(sizes, ["label", "pivot"])
    lists = lists.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    lists = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lists = lists.withColumn("a", F.least("block", "other")).withColumn("b", F.greatest("block", "other")).drop("other", "blocks")
    found = lists.groupBy("label", "pivot", "a", "b").applyInArrow(_lister(least, needed), "node long, links long, class long")
    found = stored(found, "vector-links")
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("node").alias("a"), F.col("class").alias("b")).where("a <> b"))
    classes = whole.join(degree, "node", "left").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = classes.groupBy("component").agg(F.min("rep").alias("first"))
    return classes.join(first, "component").select("label", "embedding", "copies", F.coalesce("links", F.lit(0)).alias("links"), "first")


def _lister(least: float, shared: int):
    return lambda table: _linked_in_list(table, least, shared)
