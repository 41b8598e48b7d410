"""Substring dedup (7): prefix-partitioned suffix trees over words.

Suffixes are sampled where the text itself says so: of the ``window - prefix + 1`` prefixes
(hashes of ``prefix`` words) that start inside a window, the smallest one is the window's
anchor, so equal windows have equal anchors at equal offsets.  The windows of one anchor are
the paths of its suffix down to the depth of ``window`` words.

1. Map side, every block of texts builds its own tree: of equal windows only the earliest goes
   on, the others are removed at once.  So a passage that a third of all documents share
   reaches the shuffle once per block, not once per document.
2. Suffixes are dealt out by prefix.  A prefix that (by a sample of documents, used for this
   choice only) would overfill its group is lengthened from ``prefix`` words to the whole
   window.  Groups are sized to memory; their number follows the input.
3. Each group sorts its suffixes by (prefix, window): nodes that are ``window`` words deep and
   have several leaves are the repeats; all leaves but the first are removed.
4. Runs of removed windows, the maximal repeats, go back to their documents.

Paths are compared by 112 bits of two independent hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowloom.llm.common import keyed, shuffle_partitions
from flowloom.llm.words import Block, blocks, grams, mixed, runs, words

GROUP_BYTES = 16 << 20  # text per group of suffixes
PART_LEAVES = 1 << 18  # suffixes of a group that are spread out and sorted at once
BLOCK_BYTES = 4 << 20  # of text whose repeats are removed before the shuffle
SAMPLE = 16  # one document of so many is looked at to find overfull prefixes
LEAST_SHARE = 1e-6  # of all windows; bounds the number of lengthened prefixes to a million

_ROWS = (
    "bucket int, docs binary, run_doc binary, run_pos binary, run_len binary, run_key binary, "
    "path_high binary, path_low binary, known_doc binary, known_pos binary, known_len binary"
)
_MARKS = "uid long, start long, length long"


def _windows(block: Block, window: int, prefix: int):
    """Every window of a block: (place, row, first word of the row, anchor, prefix hash, path hash)."""
    w = words(block)
    if len(w.hash) < window:
        return None
    row = w.row
    place = np.arange(len(w.hash) - window + 1)
    place = place[place + window <= w.first[1:][row[: len(place)]]]
    if not len(place):
        return None
    prefixes = grams(w.hash, prefix, 3)
    anchor, least = place.copy(), prefixes[place]
    for ahead in range(1, window - prefix + 1):  # the first of the smallest ones
        value = prefixes[place + ahead]
        less = value < least
        anchor[less], least[less] = place[less] + ahead, value[less]
    path = grams(w.hash, window, 5)[place] >> np.uint64(16)
    return place, row[place], w.first, anchor, prefixes[anchor], path


def _repeats(key: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Which leaves follow an equal one; the input is in document order."""
    order = np.lexsort((path, key))
    again = np.zeros(len(key), bool)
    same = (key[order[1:]] == key[order[:-1]]) & (path[order[1:]] == path[order[:-1]])
    again[order[1:][same]] = True
    return again


def _suffix_rows(block: Block, uids: np.ndarray, groups: int, long_prefixes: np.ndarray, window: int, prefix: int):
    found = _windows(block, window, prefix)
    if found is None:
        return
    place, row, first, anchor, key, path = found
    again = _repeats(key, path)
    known_at, known_len = runs(place[again], row[again])
    known_row = row[again][known_at]
    known_pos = place[again][known_at] - first[known_row]
    place, row, anchor, key, path = (x[~again] for x in (place, row, anchor, key, path))
    lengthened = np.isin(key, long_prefixes)
    route = np.where(lengthened, mixed(key ^ (path * np.uint64(0x9E3779B97F4A7C15))), mixed(key))
    bucket = ((route >> np.uint64(16)) % np.uint64(groups)).astype(np.int64)
    cut = np.flatnonzero((np.diff(place) != 1) | (np.diff(anchor) != 0) | (np.diff(bucket) != 0)) + 1
    at = np.concatenate([[0], cut])
    size = np.diff(np.append(at, len(place)))
    order = np.argsort(bucket[at], kind="stable")
    at, size = at[order], size[order]
    owner = bucket[at]
    leaves = np.repeat(at - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    path, offset = path[leaves], np.concatenate([[0], np.cumsum(size)])
    run_cut = np.searchsorted(owner, np.arange(groups + 1))
    known_owner = (mixed(uids[known_row].astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
    known_order = np.argsort(known_owner, kind="stable")
    known_cut = np.searchsorted(known_owner[known_order], np.arange(groups + 1))
    columns: list[list] = [[] for _ in range(11)]
    for g in range(groups):
        r = slice(run_cut[g], run_cut[g + 1])
        k = known_order[known_cut[g] : known_cut[g + 1]]
        if r.start == r.stop and not len(k):
            continue
        docs, place_of = np.unique(row[at[r]], return_inverse=True)
        p = path[offset[r.start] : offset[r.stop]]
        for column, value in zip(
            columns,
            (
                g,
                np.diff(uids[docs], prepend=0).astype("<i8").tobytes(),
                place_of.astype("<u4").tobytes(),
                (place[at[r]] - first[row[at[r]]]).astype("<u4").tobytes(),
                size[r].astype("<u1").tobytes(),
                key[at[r]].astype("<u8").tobytes(),
                (p >> np.uint64(16)).astype("<u4").tobytes(),
                (p & np.uint64(0xFFFF)).astype("<u2").tobytes(),
                uids[known_row[k]].astype("<i8").tobytes(),
                known_pos[k].astype("<u4").tobytes(),
                known_len[k].astype("<u4").tobytes(),
            ),
            strict=True,
        ):
            column.append(value)
    types = [pa.int32()] + [pa.binary()] * 10
    names = [x.split()[0] for x in _ROWS.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _group_repeats(table: pa.Table) -> pa.Table:
    """One group of suffixes: sort, find the deep nodes, mark all leaves but the first."""
    uid, pos, size, key, high, low, known = [], [], [], [], [], [], ([], [], [])
    for row in table.to_batches():
        cols = [row.column(i) for i in range(row.num_columns)]
        for i in range(row.num_rows):
            raw = lambda j: cols[j][i].as_buffer()  # noqa: E731, B023
            docs = np.cumsum(np.frombuffer(raw(1), "<i8"))
            uid.append(docs[np.frombuffer(raw(2), "<u4")])
            pos.append(np.frombuffer(raw(3), "<u4"))
            size.append(np.frombuffer(raw(4), "<u1"))
            key.append(np.frombuffer(raw(5), "<u8"))
            high.append(np.frombuffer(raw(6), "<u4"))
            low.append(np.frombuffer(raw(7), "<u2"))
            for part, (j, kind) in zip(known, ((8, "<i8"), (9, "<u4"), (10, "<u4")), strict=True):
                part.append(np.frombuffer(raw(j), kind))
    uid, pos, size, key = (np.concatenate(x) for x in (uid, pos, size, key))
    high, low, size = np.concatenate(high), np.concatenate(low), size.astype(np.int64)
    at = np.cumsum(size) - size
    # Equal suffixes have equal prefixes, so parts of the prefixes are spread out and sorted one by one.
    parts = max(1, -(-len(high) // PART_LEAVES))
    which = (mixed(key + np.uint64(0x14057B7EF767814F)) % np.uint64(parts)).astype(np.int64)
    found = []
    for part in range(parts):
        r = np.flatnonzero(which == part)
        n = size[r]
        leaf = np.repeat(at[r] - np.cumsum(n) + n, n) + np.arange(n.sum())
        path = (high[leaf].astype(np.uint64) << np.uint64(16)) | low[leaf]
        start = np.repeat(pos[r].astype(np.int64) - at[r], n) + leaf
        found.append(_later_leaves(np.repeat(uid[r], n), start, np.repeat(key[r], n), path))
    found.append(tuple(np.concatenate(x).astype(np.int64) for x in known))
    return pa.table({name: np.concatenate(x) for name, x in zip(("uid", "start", "length"), zip(*found, strict=True), strict=True)})


def _later_leaves(uid: np.ndarray, pos: np.ndarray, key: np.ndarray, path: np.ndarray) -> tuple:
    """Runs of leaves that follow an equal one: (uid, start, length)."""
    # Most leaves stand alone; only those whose mixed path occurs again are sorted in full.
    blend = mixed(key ^ (path * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(blend)
    twin = np.zeros(len(order), bool)
    equal = blend[order[1:]] == blend[order[:-1]]
    twin[order[1:][equal]] = True
    twin[order[:-1][equal]] = True
    some = np.flatnonzero(twin)
    order = some[np.lexsort((pos[some], uid[some], path[some], key[some]))]
    same = (key[order[1:]] == key[order[:-1]]) & (path[order[1:]] == path[order[:-1]])
    gone = np.sort(order[1:][same])
    at, length = runs(pos[gone], uid[gone])
    return uid[gone][at], pos[gone][at], length.astype(np.int64)


def repeated_runs(rows: DataFrame, window: int, prefix: int) -> DataFrame:
    """Runs of windows that also start earlier: (uid, start, length in windows)."""
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.octet_length("_text")).alias("n")).first()["n"] or 0
    groups = max(shuffle_partitions(spark), -(-total // GROUP_BYTES))
    expected = max(1, total // 6)  # windows, at six bytes a word
    limit = max(expected / groups / 8, expected * LEAST_SHARE) / SAMPLE

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), block_bytes=BLOCK_BYTES):
                found = _windows(block, window, prefix)
                if found is not None:
                    key, n = np.unique(found[4], return_counts=True)
                    often = n >= 4
                    yield pa.RecordBatch.from_arrays([pa.array(key[often].astype(np.int64)), pa.array(n[often])], names=["key", "n"])

    overfull = (
        rows.where(F.pmod(F.xxhash64("_uid"), F.lit(SAMPLE)) == 0)
        .select("_uid", "_text")
        .mapInArrow(counted, "key long, n long")
        .groupBy("key")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= limit)
    )
    # At most 1 / LEAST_SHARE keys reach the limit.
    long_prefixes = np.sort(np.array([r["key"] for r in overfull.select("key").collect()], np.int64).astype(np.uint64))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column(0).to_numpy()
            order = np.argsort(uids, kind="stable")
            for block in blocks(batch.column(1), order, BLOCK_BYTES):
                yield from _suffix_rows(block, uids[block.rows], groups, long_prefixes, window, prefix)

    dealt = rows.select("_uid", "_text").mapInArrow(suffixes, _ROWS)
    return dealt.groupBy("bucket").applyInArrow(_group_repeats, _MARKS)


def drop_repeated_passages(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    window: int = 20,
    prefix: int = 8,
    keep: list[str] | None = None,
) -> DataFrame:
    """Remove every word covered by a ``window`` of words that also starts earlier.

    Earlier means in a smaller id, or further ahead in the same document; windows are judged
    on the input.  Returns one row per input row: the id, ``n_words``, ``n_removed``,
    ``kept_text`` (kept words joined by one blank) and ``removed`` (the maximal removed word
    ranges, as [start, end) pairs).  A null or empty text has no words and an empty
    ``kept_text``.  Rows with a null or repeated id count as separate documents, in the order
    of (id, text hash), null first.  Other columns are not read, except those of ``keep``: they
    come along as a struct ``kept``, with the text itself as ``text``, so that texts move once.
    Texts of any length are taken whole; their words are hashed in strips.  An empty table gives no rows.
    """
    rows, _ = keyed(docs, id_column, text_column, keep)
    marks = (
        repeated_runs(rows, window, prefix)
        .groupBy("uid")
        .agg(F.collect_list(F.struct("start", "length")).alias("_marks"))
    )  # bounded by the words of one document

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n_words, n_removed, kept, removed = batch.column(0), [], [], [], []
            marked = batch.column(2)
            for i, text in enumerate(batch.column(1)):
                found = text.as_py().encode().split() if text.is_valid else []
                gone = []
                if marked[i].is_valid:
                    spans = marked[i].values
                    start = spans.field(0).to_numpy()
                    step = np.zeros(len(found) + 1, np.int64)
                    np.add.at(step, start, 1)
                    np.add.at(step, start + spans.field(1).to_numpy() + window - 1, -1)
                    stays = np.cumsum(step)[:-1] == 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[1], stays.astype(np.int8), [1]])))
                    gone = edges.reshape(-1, 2).tolist()
                    left = [w for w, k in zip(found, stays.tolist(), strict=True) if k]
                else:
                    left = found
                n_words.append(len(found))
                n_removed.append(len(found) - len(left))
                kept.append(b" ".join(left).decode())
                removed.append(gone)
            arrays = [
                ids,
                pa.array(n_words, pa.int64()),
                pa.array(n_removed, pa.int64()),
                pa.array(kept, pa.string()),
                pa.array(removed, pa.list_(pa.list_(pa.int64()))),
            ]
            names = ["doc_id", "n_words", "n_removed", "kept_text", "removed"]
            if keep:
                arrays, names = [*arrays, batch.column(1), batch.column(3)], [*names, "text", "kept"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    joined = rows.join(marks, rows["_uid"] == marks["uid"], "left").select("_id", "_text", "_marks", *(["_kept"] if keep else []))
    schema = StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_text string, removed array<array<bigint>>")
    if keep:
        schema = schema.add("text", "string").add("kept", rows.schema["_kept"].dataType)
    out = joined.mapInArrow(cut, schema)
    return out.withColumnRenamed("doc_id", id_column)
