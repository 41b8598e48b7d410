"""Token counts (11): a two-tier look-up on the map side.

Few pre-tokens make up most of a corpus.  A first pass over all texts keeps a bounded summary of
frequent pre-tokens in every task; summaries are merged, a fixed number at a time, into the most
frequent ones.  Their token counts form a compact table of bounded size that is broadcast.  The
second pass looks up the distinct pre-tokens of each block of text in it; what is not there goes to a
memory that lives as long as the worker, and only what is new there is encoded.  Pre-tokens
never leave the tasks that read them.  Which of them are in the table changes only the time taken.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import stored, worker_cache
from flowloom.llm.tokens import TEXT_BLOCK, WordEncoder, cut_chunks, distinct_chunks
from flowloom.llm.words import blocks

TABLE_ENTRIES = 1 << 15
LONGEST_ENTRY = 48  # bytes: the table holds at most 1.5 MiB of pre-tokens
MERGED_AT_ONCE = 64  # summaries
MOST_MISSES = 400_000  # pre-tokens remembered by a worker beside the table

_SUMMARY = "slot long, chunks array<binary>, counts array<long>"


class Counter:
    """Token counts of pre-tokens; ``known`` is the worker's memory."""

    def __init__(self, path: str):
        self.coder = None if path.endswith(".model") else WordEncoder(path, ordinary=False)
        if self.coder is None:
            from sentencepiece import SentencePieceProcessor

            self.pieces = SentencePieceProcessor(model_file=path)
        self.known: dict[bytes, int] = {}

    def cut(self, block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """See ``cut_chunks``; sentence pieces depend on the whole text."""
        return cut_chunks(block, *(("whole", False) if self.coder is None else self.coder.cut_mode(block)))

    def sizes(self, chunks: list[bytes]) -> np.ndarray:
        """Encode chunks and count."""
        if self.coder is None:
            return np.array([len(self.pieces.encode(c.decode(), num_threads=1)) for c in chunks], np.int64)
        return self.coder.sizes(chunks)

    def remembered(self, chunks: list[bytes]) -> list[int]:
        """Counts of chunks that the table does not hold."""
        if len(self.known) + len(chunks) > MOST_MISSES:
            self.known.clear()
        found = list(map(self.known.get, chunks))
        new = [i for i, n in enumerate(found) if n is None]
        for i, n in zip(new, self.sizes([chunks[i] for i in new]).tolist(), strict=True):
            found[i] = n
            if len(chunks[i]) <= 4 * LONGEST_ENTRY:
                self.known[chunks[i]] = n
        return found


def counter(path: str) -> Counter:
    """The worker's counter for this file."""
    cache = worker_cache("counters")
    if path not in cache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache[path] = Counter(path)
    return cache[path]


def _most(counts: dict[bytes, int], entries: int) -> dict[bytes, int]:
    """The most frequent ones, ties in byte order."""
    if len(counts) <= entries:
        return counts
    return dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:entries])


def frequent_chunks(texts: DataFrame, path: str, entries: int = TABLE_ENTRIES) -> list[bytes]:
    """The pre-tokens that occur most often in all texts, as far as bounded summaries tell."""

    def summary(slot: int, counts: dict[bytes, int]) -> pa.RecordBatch:
        chunks = pa.array([list(counts)], pa.list_(pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array([slot]), chunks, pa.array([list(counts.values())], pa.list_(pa.int64()))], names=["slot", "chunks", "counts"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        own = counter(path)
        for batch in batches:
            for block in blocks(batch.column(0), block_bytes=TEXT_BLOCK):
                data, offsets, _ = own.cut(block)
                for distinct, which in distinct_chunks(data, offsets):
                    n = np.bincount(which, minlength=len(distinct))
                    # A pre-token that occurs once in a block is not worth its place in the summary.
                    often = np.flatnonzero((n > 1) & (pc.binary_length(distinct).to_numpy() <= LONGEST_ENTRY))
                    for chunk, more in zip(distinct.take(pa.array(often)).to_pylist(), n[often].tolist(), strict=True):
                        counts[chunk] = counts.get(chunk, 0) + more
                if len(counts) > 8 * entries:
                    counts = dict(_most(counts, 4 * entries))
        yield summary(TaskContext.get().partitionId(), _most(counts, entries))

    def merge(table: pa.Table) -> pa.Table:
        counts: dict[bytes, int] = {}
        for chunks, more in zip(table.column("chunks"), table.column("counts"), strict=True):
            for chunk, n in zip(chunks.as_py(), more.as_py(), strict=True):
                counts[chunk] = counts.get(chunk, 0) + n
        slot = table.column("slot")[0].as_py() // MERGED_AT_ONCE
        return pa.Table.from_batches([summary(slot, _most(counts, entries))])

    found = stored(texts.mapInArrow(scan, _SUMMARY), "frequent")
    left = found.count()
    while left > 1:
        bundle = F.floor(F.col("slot") / MERGED_AT_ONCE).alias("bundle")
        found = stored(found.groupBy(bundle).applyInArrow(merge, _SUMMARY), "frequent")
        left = found.count()
    rows = found.select("chunks").collect()  # one row of at most ``entries`` short pre-tokens
    return [bytes(c) for c in rows[0]["chunks"]] if rows else []


def token_counts(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 2048, entries: int = TABLE_ENTRIES
) -> DataFrame:
    """How many tokens the library of a tokenizer file finds in every whole text.

    ``path`` names a .json file of tokenizers or a .model file of sentencepiece.  No special tokens are
    added; their names inside a text are treated as the library does by default; nothing is cut
    off or filled up.  Returns one row per input row: id, ``n_bytes`` (UTF-8), ``n_tokens`` and
    ``over_limit`` (more than ``limit`` tokens).

    A null text counts as empty: 0 bytes, 0 tokens.  Rows with null or repeated ids are counted each.
    Long texts are counted whole.  Other columns are not read.  An empty table gives no rows.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    chunks = frequent_chunks(rows.select("text"), path, entries)
    sizes = Counter(path).sizes(chunks) if chunks else np.empty(0, np.int64)
    table = docs.sparkSession.sparkContext.broadcast((chunks, sizes))  # at most ``entries`` short ones

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        keys = pa.array(table.value[0], pa.large_binary())
        known = table.value[1]
        for batch in batches:
            tokens = np.zeros(batch.num_rows, np.int64)
            for block in blocks(batch.column(1), block_bytes=TEXT_BLOCK):
                data, offsets, edges = own.cut(block)
                each = [np.zeros(1, np.int64)]
                for distinct, which in distinct_chunks(data, offsets):
                    place = pc.fill_null(pc.index_in(distinct, value_set=keys), -1).to_numpy()
                    size = known[place] if len(known) else np.zeros(len(place), np.int64)
                    missed = np.flatnonzero(place < 0)
                    size[missed] = own.remembered(distinct.take(pa.array(missed)).to_pylist())
                    each.append(size[which])
                total = np.cumsum(np.concatenate(each))[np.searchsorted(offsets, edges)]
                tokens[block.rows] = np.diff(total)
            size = pc.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(tokens)], names=["id", "n_bytes", "n_tokens"])

    out = rows.mapInArrow(count, "id long, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
