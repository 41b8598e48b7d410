"""Filter interaction audit (13): min-plus removal ranks.

Every document gets a mask of the filters that it fails.  A mask is a row of a matrix that holds
0 for a failed filter and infinity for a passed one; an order of the filters is, by its inverse
permutation, a row of the places at which each filter stands.  The min-plus product of both gives
the place at which an order removes a mask.  Counts per mask are then scattered to these places,
for all orders at once.  Only the at most 32 counts of a part ever meet the 120 orders; documents
are read once, and what leaves the tasks that read them is an id, a mask and a text hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import stored
from flowloom.llm.words import Block, blocks, words

LETTERS = "ABCDE"
ORDERS = np.array(list(permutations(range(len(LETTERS)))))
#: Values that the contract of the audit fixes.
FEWEST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 100, 80, 10, b"#$%&*|"
_COPY = 1 << LETTERS.index("E")

_REPORT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def _per_row(block: Block, flags: np.ndarray) -> np.ndarray:
    """How many bytes of each row are flagged."""
    places = np.flatnonzero(flags)
    return np.searchsorted(places, block.ends) - np.searchsorted(places, block.starts)


def text_masks(block: Block) -> np.ndarray:
    """Filters A to D as bits 0 to 3: which of them each text fails.

    Distinct words are told apart by 64-bit hashes.
    """
    found = words(block)
    count = np.diff(found.first)
    order = np.lexsort((found.hash, found.row))
    value, row = found.hash[order], found.row
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    distinct = np.bincount(row[new], minlength=len(count))
    data = block.data
    capitals = _per_row(block, (data >= 65) & (data <= 90))
    points = (block.ends - block.starts) - _per_row(block, (data & 0xC0) == 0x80)
    symbol = _per_row(block, np.isin(data, np.frombuffer(SYMBOLS, np.uint8))) > 0
    fails = (count < FEWEST_WORDS, 100 * distinct < LEAST_DISTINCT * count, 100 * capitals > MOST_CAPITALS * points, symbol)
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def failed_filters(docs: DataFrame, id_column: str, text_column: str, part_column: str) -> DataFrame:
    """(id, part, digest, mask) of every row; the mask holds A to D."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = np.zeros(batch.num_rows, np.int32)
            for block in blocks(batch.column(3)):
                mask[block.rows] = text_masks(block)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(mask)], names=["id", "part", "digest", "mask"])

    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.md5(text)).alias("digest"),
        text.alias("text"),
    )
    return rows.mapInArrow(judge, "id long, part string, digest binary, mask int")


def mask_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail exactly these filters.

    Copies are counted before they meet: a text that a third of all rows holds is, beyond the first
    shuffle, one row per part and label.
    """
    marked = (
        labels.where("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    )
    rows = stored(failed.groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n")), "failed-filters")
    no = F.lit(0)
    named = rows.where("id IS NOT NULL").join(marked, "id", "left")
    named = named.withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
    rows = named.unionByName(rows.where("id IS NULL").withColumns({"good": no, "toxic": no}))
    # Ids are unique within (digest, part, good, toxic); a null id comes after all others.
    own = F.struct(F.col("id").isNull().alias("unnamed"), "id", "n")
    groups = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min(own).alias("first"))
    first = F.struct("first.unnamed", F.coalesce("first.id", F.lit(0)).alias("id"))
    least = F.min(first).over(Window.partitionBy("digest"))  # at most a few rows per part
    groups = groups.withColumn("kept", F.when(first == least, F.col("first.n")).otherwise(0))
    counts = groups.groupBy("part", "mask", "good", "toxic").agg(F.sum("kept").alias("kept"), F.sum("n").alias("n"))
    split = F.explode(
        F.array(
            F.struct("mask", F.col("kept").alias("n")),
            F.struct(F.col("mask").bitwiseOR(F.lit(_COPY)).alias("mask"), (F.col("n") - F.col("kept")).alias("n")),
        )
    )
    return (
        counts.select("part", "good", "toxic", split.alias("s"))
        .groupBy("part", F.col("s.mask").alias("mask"))
        .agg(
            F.sum("s.n").alias("n"),
            F.sum(F.col("s.n") * F.col("good")).alias("good"),
            F.sum(F.col("s.n") * F.col("toxic")).alias("toxic"),
        )
    )


def removal_ranks(masks: np.ndarray) -> np.ndarray:
    """(mask, order) -> the place, from 0, of the filter that removes it; 5 if none does."""
    size = len(LETTERS)
    cost = np.where(masks[:, None] >> np.arange(size) & 1, 0, size)  # size stands for infinity
    place = np.argsort(ORDERS, axis=1)
    return np.minimum((cost[:, None, :] + place[None, :, :]).min(axis=2), size)


def audit(masks: np.ndarray, n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """All counts of one part, as (order, step) matrices."""
    orders, size = ORDERS.shape
    rank = removal_ranks(masks)
    cell = np.arange(orders) * (size + 1) + rank

    def scattered(weight: np.ndarray) -> np.ndarray:
        out = np.zeros(orders * (size + 1), np.int64)
        np.add.at(out, cell, np.broadcast_to(weight[:, None], cell.shape))
        return out.reshape(orders, size + 1)[:, :size]

    removed = scattered(n)
    fails = (masks[:, None, None] >> ORDERS[None] & 1).astype(bool)  # of the filter at each step
    earlier = fails & (rank[:, :, None] < np.arange(size))
    alone = np.array([n[masks == 1 << f].sum() for f in range(size)], np.int64)
    shapley = np.zeros(size, np.int64)
    np.add.at(shapley, ORDERS, removed)
    return {
        "kept": n.sum() - np.cumsum(removed, axis=1),
        "removed": removed,
        "redundant": (earlier * n[:, None, None]).sum(axis=0),
        "unique_fails": alone[ORDERS],
        "good_lost": scattered(good),
        "toxic_lost": scattered(toxic),
        "shapley": shapley[ORDERS],
    }


def _report(table: pa.Table) -> pa.Table:
    column = lambda name: table.column(name).to_numpy().astype(np.int64)
    orders, size = ORDERS.shape
    found = audit(column("mask"), column("n"), column("good"), column("toxic"))
    names = ["".join(LETTERS[f] for f in order) for order in ORDERS]
    return pa.table(
        {
            "part": pa.array([table.column("part")[0].as_py()] * (orders * size), pa.string()),
            "filter_order": pa.array(np.repeat(names, size), pa.string()),
            "step": pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), orders)),
        }
        | {name: pa.array(value.ravel().astype(np.int64)) for name, value in found.items()}
    )


def audit_filters(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang"
) -> DataFrame:
    """What each of five filters removes from each part, in every order and at every step.

    Fails A: under 100 words; B: 100 * distinct words < 80 * words; C: 100 * capitals A-Z > 10 *
    code points; D: holds one of ``#$%&*|``; E: the same text under a smaller id, anywhere in the table.
    Returns 600 rows per part: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost and shapley (see README).

    A null part is the part of the empty string.  A null text counts as empty: it fails A, and E
    if an earlier text is null or empty.  A null id is larger than every id; rows with equal ids and
    texts do not make each other fail E.  Repeated rows count each.  A document is good (toxic)
    if one of its labels is; null labels are neither, labels with a null id belong to nobody.
    Texts of any length are judged whole, in strips.  Other columns are not read.  An empty table has
    no parts and gives no rows.  Texts are equal if their MD5 digests are.
    """
    counts = mask_counts(failed_filters(docs, id_column, text_column, part_column), labels)
    return counts.groupBy("part").applyInArrow(_report, _REPORT)  # at most 32 rows of a part
