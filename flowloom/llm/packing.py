"""Best-fit packing (1): bound-certified repacking.

Documents become token ids and pieces of at most ``capacity``.  Pieces are packed in groups by
best-fit decreasing.  Dual-feasible functions bound from below how many sequences a group
needs: a group that meets its bound is certified, and only its emptiest sequence is open.
The open sequences, and those with gaps of uncertified groups, are exchanged as wholes, the
pieces they hold are packed anew, and the new packing is kept where it is smaller.  This
goes on until the whole meets the bound of all lengths together, or a turn saves nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import batch_rows, stored
from flowloom.llm.tokens import encoder

GROUP_PIECES = 20_000
BATCH_ROWS = 2_000  # documents that a worker gets at once

_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, ids binary"
_PLACES = "row long, length int, sequence_id long, offset int, certified boolean, fill int"


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that pieces of these lengths need at least, by dual-feasible functions."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1) if len(lengths) else np.zeros(capacity + 1, np.int64), capacity)


def bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """The same for ``count[n]`` pieces of length n, from 0 to ``capacity``."""
    count = count.astype(np.int64)
    if not count.any():
        return 0
    size = np.arange(capacity + 1)
    many, room = np.cumsum(count), np.cumsum(count * size)
    best = -(-int(room[-1]) // capacity)
    # Threshold functions: above capacity - t a piece fills a sequence, below t it is nothing.
    t = np.arange(1, capacity // 2 + 1)
    filled = (many[-1] - many[capacity - t]) * capacity + room[capacity - t] - room[t - 1]
    best = max(best, int((-(-filled // capacity)).max(initial=0)))
    for k in range(1, 33):  # rounding functions, in units of 1 / k
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each piece, its offset there, fill of each bin)."""
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fill: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            bins = by_room[room]
            b = bins.pop()
            if not bins:
                rooms ^= 1 << room
        else:
            b, room = len(fill), capacity
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += length
        left = room - length
        bins = by_room.setdefault(left, [])
        if not bins:
            rooms |= 1 << left
        bins.append(b)
    return where, offset, np.array(fill, np.int64)


def token_pieces(docs: DataFrame, id_column: str, text_column: str, path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Every document's ids and the end id, cut into pieces of at most ``capacity``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(path), np.uint32(end_id).tobytes()
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in _PIECES.split(", ")]
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False) if not batch.column(0).null_count else batch.column(0).to_pylist()
            for rows, ids, at in coder.encode_column(batch.column(1)):
                ids = ids.astype("<u4")
                out: list[list] = [[] for _ in types]
                for row, low, high in zip(rows.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    for piece, first in enumerate(range(0, high - low + 1, capacity)):
                        own = ids[low + first : min(low + first + capacity, high)].tobytes()
                        if first + capacity > high - low:
                            own += end
                        for column, value in zip(out, (docs[row], piece, first, len(own) // 4, zlib.crc32(own), own), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(cut, _PIECES)


def _packed(table: pa.Table, capacity: int, turn: int, used: int) -> pa.Table:
    """Pack one group; keep the sequences it came with unless the new ones are fewer.

    ``used`` is the number of groups of all turns before: it keeps sequence numbers apart.
    """
    column = lambda name: table.column(name).to_numpy()
    group, row, length = int(table.column("group")[0].as_py()), column("row"), column("length").astype(np.int64)
    where, offset, fill = best_fit_decreasing(length, capacity)
    certified = len(fill) <= lower_bound(length, capacity)
    sequence = (np.int64(used + group) << 24) + where
    fills = fill[where]
    if turn:
        old, at = np.unique(column("sequence_id"), return_inverse=True)
        if len(old) <= len(fill):
            sequence, offset = column("sequence_id"), column("offset").astype(np.int64)
            fills = np.bincount(at, weights=length).astype(np.int64)[at]
    open_fill = fills.min()
    certify = certified & (fills > open_fill)
    return pa.table(
        {
            "row": row,
            "length": length.astype(np.int32),
            "sequence_id": sequence,
            "offset": offset.astype(np.int32),
            "certified": pa.array(certify | (fills == capacity)),
            "fill": fills.astype(np.int32),
        }
    )


def _packer(capacity: int, turn: int, used: int):
    return lambda table: _packed(table, capacity, turn, used)


def place_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """(row, sequence_id, offset) for pieces (row, length)."""
    whole = pieces.where(F.col("length") == capacity)
    parts = pieces.where(F.col("length") < capacity)
    count = np.zeros(capacity + 1, np.int64)
    for r in parts.groupBy("length").count().collect():  # at most ``capacity`` rows
        count[r["length"]] = r["count"]
    bound, total = bound_of_counts(count, capacity), int(count.sum())
    alone = whole.select("row", (-F.col("row") - 1).alias("sequence_id"), F.lit(0).alias("offset"))
    settled, turn, last, used = [], 0, None, 0
    left = parts.select(
        "row", "length", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).alias("offset"), F.xxhash64("row").alias("_deal")
    )
    while total:
        groups = max(1, -(-total // GROUP_PIECES))
        dealt = left.withColumn("group", F.pmod("_deal", F.lit(groups)).cast("int")).drop("_deal")
        packed = stored(dealt.groupBy("group").applyInArrow(_packer(capacity, turn, used), _PLACES), f"pack-{turn}")
        done = F.col("certified")
        state = packed.agg(
            F.count_distinct("sequence_id").alias("n"),
            F.count_distinct(F.when(done, F.col("sequence_id"))).alias("kept"),
            F.sum((~done).cast("int")).alias("open"),
        ).first()
        stop = groups == 1 or state["n"] <= bound or state["n"] == last
        if stop:
            settled.append(packed)
            break
        settled.append(packed.where(done))
        left = packed.where(~done).select("row", "length", "sequence_id", "offset", F.xxhash64("sequence_id", F.lit(turn)).alias("_deal"))
        bound, last, total = bound - state["kept"], state["n"] - state["kept"], state["open"]
        turn, used = turn + 1, used + groups
    for part in settled:
        alone = alone.union(part.select("row", "sequence_id", "offset"))
    return alone


def pack_documents(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = 2048
) -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` ids as the method finds.

    Only documents longer than ``capacity`` are cut.  Returns one row per piece: doc_id, piece,
    start, length, ids_crc32, ``ids`` (little-endian unsigned 32-bit), sequence_id and offset;
    pieces lie in a sequence from offset 0 without gaps.  A null or empty text is its end id
    alone.  Every input row is packed, also rows with a null or repeated id; other columns are
    not read.  An empty table gives no rows.
    """
    pieces = token_pieces(docs, id_column, text_column, path, capacity).withColumn("row", F.monotonically_increasing_id())
    with batch_rows(docs.sparkSession, BATCH_ROWS):
        pieces = stored(pieces, "pieces")
    places = place_pieces(pieces.select("row", "length"), capacity)
    out = pieces.join(places, "row")
    return out.select(
        "doc_id",
        "piece",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        "sequence_id",
        F.col("offset").cast("long").alias("offset"),
        "ids",
    )
