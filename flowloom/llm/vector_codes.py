"""Vector code compression (12): product codes whose assignment is memoised by grid cell.

Vectors become whole numbers and are cut into eight parts; every part position has a codebook of
sixteen entries.  For the nearest entry, a part's coarse grid cell is looked up first: the first
part that falls into a cell leaves there the entries that may be nearest to some point of
the cell's box, namely those whose least distance to the box is not above the smallest of all
entries' greatest distances to it.  Only these are then measured exactly.  A round moves nothing but
the sums and counts of each task, at most 128 rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from flowloom.llm.common import stored

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Whole components are held within this, so that squares and their sums stay exact integers.
LARGEST = 1 << 24
MOST_CELLS = 50_000  # remembered per part position by a task
ROWS_AT_ONCE = 8_192
#: A label with more than one row in this many is hot; there are fewer hot labels than that.
HOT_SHARE = 1_000


def whole_components(vector: Column) -> Column:
    """``floor(4096 * x)`` of every component, within ``LARGEST``."""
    wide = vector.cast("array<double>")
    return F.transform(wide, lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))))


def codable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    wide = vector.cast("array<double>")
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def box_candidates(low: np.ndarray, side: int, book: np.ndarray) -> np.ndarray:
    """Which entries may be nearest in each box ``low .. low + side - 1``, as bit masks."""
    low = low[:, None, :]
    high = low + (side - 1)
    below, above = low - book[None], book[None] - high
    least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=2)
    most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=2)
    open_ones = least <= most.min(axis=1)[:, None]
    return (open_ones.astype(np.int64) << np.arange(len(book))).sum(axis=1)


class CellCoder:
    """Nearest entries of one part position's codebook, ties to the lower index."""

    def __init__(self, book: np.ndarray, shift: int):
        self.book, self.shift, self.cells = book, shift, {}
        self.measured = self.asked = 0

    def _masks(self, parts: np.ndarray) -> np.ndarray:
        cells = np.ascontiguousarray(parts >> self.shift)
        keys = cells.view(f"V{cells.shape[1] * 8}").ravel().tolist()
        if len(self.cells) > MOST_CELLS:
            self.cells.clear()
        new = {key: i for i, key in enumerate(keys) if key not in self.cells}
        if new:
            low = cells[list(new.values())] << self.shift
            self.cells.update(zip(new, box_candidates(low, 1 << self.shift, self.book).tolist(), strict=True))
        return np.fromiter(map(self.cells.__getitem__, keys), np.int64, len(keys))

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) for each row of ``parts``."""
        masks = self._masks(parts)
        best = np.full(len(parts), np.iinfo(np.int64).max)
        index = np.zeros(len(parts), np.int64)
        for entry, point in enumerate(self.book):
            rows = np.flatnonzero(masks >> entry & 1)
            distance = ((parts[rows] - point) ** 2).sum(axis=1)
            nearer = distance < best[rows]
            best[rows[nearer]], index[rows[nearer]] = distance[nearer], entry
            self.measured += len(rows)
        self.asked += len(parts) * len(self.book)
        return index, best


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows of eight parts, filled with zeros at the end."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy().astype(np.int64)
    if len(size) and (size == PARTS * width).all():
        return flat.reshape(-1, PARTS, width)
    out = np.zeros((len(size), PARTS * width), np.int64)
    out[np.arange(PARTS * width) < size[:, None]] = flat
    return out.reshape(-1, PARTS, width)


def _coded(batch: pa.RecordBatch, place: int, coders: list[CellCoder], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, parts, indexes, squared distances) of some rows after the other."""
    for at in range(0, batch.num_rows, ROWS_AT_ONCE):
        parts = _matrix(batch.column(place).slice(at, ROWS_AT_ONCE), width)
        found = [coder.nearest(parts[:, p]) for p, coder in enumerate(coders)]
        yield at, parts, np.stack([i for i, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def _coders(books: np.ndarray, shift: int) -> list[CellCoder]:
    return [CellCoder(book, shift) for book in books]


def refined(rows: DataFrame, books: np.ndarray, shift: int) -> np.ndarray:
    """The codebooks after one round."""
    parts, entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = _coders(books, shift)
        sums, count = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, cut, index, _ in _coded(batch, 0, coders, width):
                for p in range(parts):
                    np.add.at(sums[p], index[:, p], cut[:, p])
                    count[p] += np.bincount(index[:, p], minlength=entries)
        part, entry = np.nonzero(count)
        names = ["part", "entry", "n", "sums"]
        columns = [pa.array(part), pa.array(entry), pa.array(count[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    found = rows.select("whole").mapInArrow(add, "part long, entry long, n long, sums array<long>")
    total = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    books = books.copy()
    for row in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():  # at most 128 rows
        books[row["part"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return books


def first_codebooks(rows: DataFrame, width: int) -> np.ndarray:
    """The parts of the sixteen smallest ids, ascending."""
    least = rows.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(ENTRIES).select("whole").collect()
    books = np.zeros((PARTS, len(least), width), np.int64)
    for entry, row in enumerate(least):
        flat = np.zeros(PARTS * width, np.int64)
        flat[: len(row["whole"])] = row["whole"]
        books[:, entry] = flat.reshape(PARTS, width)
    return books


def coded_vectors(rows: DataFrame, books: np.ndarray, shift: int) -> DataFrame:
    """(vec_id, label, code, error) of every row."""
    width = books.shape[2]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = _coders(books, shift)
        for batch in batches:
            for at, _, index, distance in _coded(batch, 2, coders, width):
                text = [x.tobytes().hex() for x in index.astype(np.uint8)]
                names = ["vec_id", "label", "code", "error"]
                ids = [batch.column(i).slice(at, ROWS_AT_ONCE) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(text, pa.string()), pa.array(distance.sum(axis=1))], names=names)

    rows = rows.select("vec_id", "label", "whole")
    schema = StructType([*rows.schema.fields[:2], StructField("code", StringType()), StructField("error", LongType())])
    return rows.mapInArrow(code, schema)


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Add ``label_error``, the errors of a label's rows together; null labels are one label."""
    totals = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    rows = totals.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = (F.col("n") * HOT_SHARE > rows) | F.col("label").isNull()
    few = [r.asDict() for r in totals.where(hot).collect()]  # at most HOT_SHARE rows and the null label
    same = F.col("l.label").eqNullSafe(F.col("r.label"))
    out = ["l.vec_id", "l.code", "l.error", "r.label_error"]
    spark = coded.sparkSession
    hottest = F.broadcast(spark.createDataFrame([(r["label"], r["label_error"]) for r in few], totals.drop("n").schema))
    large = coded.alias("l").join(hottest.alias("r"), same).select(*out)
    others = coded.alias("l").join(hottest.alias("r"), same, "left_anti")
    small = others.alias("l").join(totals.where(~hot).alias("r"), F.col("l.label") == F.col("r.label")).select(*out)
    return large.union(small)


def compress_vectors(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label"
) -> DataFrame:
    """Eight 4-bit codes per vector, from codebooks refined in six rounds over all vectors.

    Returns one row per vector: vec_id, code (two hex digits per part), error (squared distances,
    summed), label_error (summed again over equal labels, nulls together) and codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components are left out.  Codebooks start from
    the sixteen smallest ids; equal ids come in the order of their components, null ids last.  With
    fewer vectors there are fewer entries.  Repeated rows count and are returned each.  Vectors that are
    shorter than the longest, or whose length eight does not divide, count as filled with zeros at
    their end.  Components beyond 4096 in size count as 4096.  Other columns are not read.  An empty
    table, or one without a usable vector, gives no rows.
    """
    rows = vectors.where(codable(F.col(vector_column))).select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.col(label_column).alias("label"),
        whole_components(F.col(vector_column)).alias("whole"),
    )
    rows = stored(rows, "whole-vectors")
    each = F.explode_outer("whole")
    spread = F.stddev_pop("x")
    state = rows.agg(F.max(F.size("whole")).alias("size"), F.count("*").alias("n")).first()
    width = max(1, -(-(state["size"] or 0) // PARTS))
    deviation = rows.select(each.alias("x")).agg(spread.alias("s")).first()["s"] or 1.0
    shift = max(0, int(np.log2(max(1.0, deviation))))  # a cell is half to one standard deviation wide
    books = first_codebooks(rows, width)
    for _ in range(ROUNDS if state["n"] else 0):
        books = refined(rows, books, shift)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = stored(coded_vectors(rows, books, shift), "vector-codes")
    return with_label_errors(coded).withColumn("codebooks_sha256", F.lit(digest))
