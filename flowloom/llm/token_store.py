"""Token ids in binary files of directly addressable codes (4).

An id is split into chunks, lowest bits first, of ``CHUNK_BITS``.  Level j of a file holds the
j-th chunk of every id that has one, bit-packed; a continuation bitmap says which of them go
on to level j + 1, and a rank directory counts the set bits before every 512th position.  The
place of an id on the next level is the rank of its bit, so any single token is read by a few
byte accesses, without decoding a block.

File layout, little-endian: ``DACS``, version, number of levels, documents and tokens
(u32, u32, u64, u64); doc ids (i64 each); first token of each document in the file and the
number of tokens (u64 each); per level: chunk width and number of chunks (u64, u64), packed
chunks padded to 8 bytes, and, on all but the last level, the padded bitmap and the ranks (u64).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import keyed, shuffle_partitions, stored
from flowloom.llm.tokens import encoder
from flowloom.session import open_folder, work_path

CHUNK_BITS = (10, 6, 16)
RANK_STEP = 512
TEXT_BYTES = 16 << 20  # of text per file, about
FILE_TOKENS = 6_000_000  # a task begins a new file beyond this

_HEAD = "<4sIIQQ"
_MANIFEST = "part int, number int, path string, n_docs long, n_tokens long"


def _padded(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 8)


_STEP = 1 << 15  # values packed at a time, so that their bits stay in the cache


def _pack(chunks: np.ndarray, bits: int) -> bytes:
    wide = 16 if bits <= 16 else 32
    out = []
    for at in range(0, len(chunks), _STEP):  # _STEP values fill whole bytes at any width
        part = chunks[at : at + _STEP].astype(f"<u{wide // 8}")
        flags = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, wide)[:, :bits]
        out.append(np.packbits(flags, axis=None, bitorder="little").tobytes())
    return _padded(b"".join(out))


def _unpack(raw: np.ndarray, bits: int, count: int) -> np.ndarray:
    wide = 16 if bits <= 16 else 32
    value = np.empty(count, np.uint32)
    flags = np.zeros((_STEP, wide), np.uint8)
    for at in range(0, count, _STEP):
        n = min(_STEP, count - at)
        part = raw[at * bits // 8 : -(-(at + n) * bits // 8)]
        flags[:n, :bits] = np.unpackbits(part, count=n * bits, bitorder="little").reshape(n, bits)
        value[at : at + n] = np.packbits(flags[:n], axis=None, bitorder="little").view(f"<u{wide // 8}")
    return value


def encode_file(doc_ids: np.ndarray, starts: np.ndarray, ids: np.ndarray, chunk_bits: tuple[int, ...] = CHUNK_BITS) -> bytes:
    """One file: documents with their first token (and the total at the end), and all ids."""
    out = [struct.pack(_HEAD, b"DACS", 1, len(chunk_bits), len(doc_ids), len(ids))]
    out += [np.asarray(doc_ids, "<i8").tobytes(), np.asarray(starts, "<u8").tobytes()]
    left = np.asarray(ids, np.uint32)
    for level, bits in enumerate(chunk_bits):
        out += [struct.pack("<QQ", bits, len(left)), _pack(left & np.uint32((1 << bits) - 1), bits)]
        if level + 1 < len(chunk_bits):
            left = left >> np.uint32(bits)
            more = left > 0
            bitmap = _padded(np.packbits(more, bitorder="little").tobytes())
            ahead = np.concatenate([[0], np.cumsum(more)])[: len(more) + 1 : RANK_STEP]
            out += [bitmap, ahead.astype("<u8").tobytes()]
            left = left[more]
        elif len(left) and int(left.max()) >> bits:
            raise ValueError("an id does not fit the chunk widths")
    return b"".join(out)


class TokenFile:
    """Read a file: any token, any document, or everything."""

    def __init__(self, raw):
        self.raw = np.frombuffer(raw, np.uint8)
        magic, version, levels, docs, self.n_tokens = struct.unpack_from(_HEAD, raw, 0)
        if magic != b"DACS" or version != 1:
            raise ValueError("not a token file")
        at = struct.calcsize(_HEAD)
        self.doc_ids = np.frombuffer(raw, "<i8", docs, at)
        at += 8 * docs
        self.starts = np.frombuffer(raw, "<u8", docs + 1, at).astype(np.int64)
        at += 8 * (docs + 1)
        self.levels = []
        for level in range(levels):
            bits, count = struct.unpack_from("<QQ", raw, at)
            at += 16
            chunks = at
            at += -(-bits * count // 64) * 8
            bitmap = ranks = None
            if level + 1 < levels:
                bitmap = at
                at += -(-count // 64) * 8
                ranks = np.frombuffer(raw, "<u8", count // RANK_STEP + 1, at)
                at += 8 * len(ranks)
            self.levels.append((bits, count, chunks, bitmap, ranks))

    def token(self, i: int) -> int:
        """The i-th id of the file, by rank and direct access alone."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for bits, _, chunks, bitmap, ranks in self.levels:
            first = i * bits
            low, high = chunks + first // 8, chunks + (first + bits - 1) // 8 + 1
            word = int.from_bytes(self.raw[low:high].tobytes(), "little")
            value |= ((word >> (first % 8)) & ((1 << bits) - 1)) << shift
            shift += bits
            if bitmap is None or not (self.raw[bitmap + i // 8] >> (i % 8)) & 1:
                break
            step = i // RANK_STEP
            low = bitmap + step * RANK_STEP // 8
            inside = np.unpackbits(self.raw[low : bitmap + i // 8 + 1], bitorder="little")[: i % RANK_STEP]
            i = int(ranks[step]) + int(inside.sum())
        return value

    def tokens(self) -> np.ndarray:
        """All ids."""
        found = []
        for bits, count, chunks, bitmap, _ in self.levels:
            value = _unpack(self.raw[chunks : chunks + -(-bits * count // 8)], bits, count)
            more = None
            if bitmap is not None:
                more = np.unpackbits(self.raw[bitmap : bitmap + -(-count // 8)], count=count, bitorder="little").astype(bool)
            found.append((bits, value, more))
        deeper = None
        for bits, value, more in reversed(found):
            if more is not None:
                value[more] |= deeper << np.uint32(bits)
            deeper = value
        return deeper

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, token by token."""
        return np.array([self.token(i) for i in range(self.starts[k], self.starts[k + 1])], np.uint32)


def _write(folder: str, name: str, raw: bytes) -> str:
    """Write under a name of this attempt, then move into place: a repeated task overwrites."""
    system, root = open_folder(folder)
    system.create_dir(root)
    own = f"{root}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(raw)
    system.move(own, f"{root}/{name}")
    return f"{folder}/{name}"


def write_tokens(
    rows: DataFrame, folder: str, path: str, end_id: int = 0, chunk_bits: tuple[int, ...] = CHUNK_BITS
) -> DataFrame:
    """Encode (_uid, _text), range-partitioned by ``_uid``, into files; returns the stored manifest.

    The texts are moved once, before they are encoded; ids go from the encoder to the file.
    """
    total = rows.agg(F.sum(F.octet_length("_text")).alias("n")).first()["n"] or 0
    parts = max(shuffle_partitions(rows.sparkSession), -(-total // TEXT_BYTES))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, part, number = encoder(path), np.array([end_id], "<u4"), TaskContext.get().partitionId(), 0
        uids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            raw = encode_file(np.concatenate(uids), starts, np.concatenate(ids), chunk_bits)
            saved = _write(folder, f"tokens-{part:08d}-{number:06d}.dac", raw)
            row = [[part], [number], [saved], [len(starts) - 1], [int(starts[-1])]]
            types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], names=[x.split()[0] for x in _MANIFEST.split(", ")])

        held = 0
        for batch in batches:
            own = batch.column(0).to_numpy()
            for some, coded, at in coder.encode_column(batch.column(1)):
                uids.append(own[some])
                sizes.append(np.diff(at) + 1)
                ids.append(np.insert(coded.astype("<u4"), at[1:], end))
                held += len(ids[-1])
                if held >= FILE_TOKENS:
                    yield flush()
                    uids, sizes, ids, held, number = [], [], [], 0, number + 1
        if uids:
            yield flush()

    moved = rows.select("_uid", "_text").repartitionByRange(parts, "_uid").sortWithinPartitions("_uid")
    return stored(moved.mapInArrow(save, _MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Read the files back: (_uid, start, n_tokens, ids_crc32) of every document."""
    spark = manifest.sparkSession
    ahead = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    firsts = manifest.select(
        F.substring_index("path", "/", -1).alias("file"), F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0)).alias("first")
    )
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(folder)
    files = files.select(F.substring_index("path", "/", -1).alias("file"), "content")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0), batch.column(1), strict=True):
                file = TokenFile(raw.as_buffer())
                ids = file.tokens().astype("<u4")
                size = np.diff(file.starts)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(file.starts[:-1], file.starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py()] * len(size)), pa.array(file.doc_ids), pa.array(file.starts[:-1]), pa.array(size), pa.array(crc, pa.int64())],
                    names=["file", "_uid", "local", "n_tokens", "ids_crc32"],
                )

    docs = files.mapInArrow(load, "file string, _uid long, local long, n_tokens long, ids_crc32 long")
    return docs.join(firsts, "file").select("_uid", (F.col("local") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def token_output(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", folder: str | None = None
) -> DataFrame:
    """Write every whole text as ids and an end id (0) in ascending id order, and read them back.

    Returns one row per input row: id, ``start`` (ids of all documents before it), ``n_tokens``
    and ``ids_crc32`` of its little-endian unsigned 32-bit ids, all from the files.  A null or
    empty text is the end id alone.  Rows with a null or repeated id are kept, in the order of
    (id, text hash), null first.  An empty table gives no rows.  Other columns are not read.
    The files go to ``folder``, by default a new one in the shared folder.
    """
    rows, renumbered = keyed(docs, id_column, text_column)
    folder = folder or work_path(docs.sparkSession, "tokens")
    manifest = write_tokens(rows, folder, path)
    if manifest.isEmpty():
        return docs.sparkSession.createDataFrame([], f"`{id_column}` long, start long, n_tokens long, ids_crc32 long")
    out = read_tokens(manifest, folder)
    ident = F.col("_uid")
    if renumbered:
        out, ident = out.join(rows.select("_uid", "_id"), "_uid"), F.col("_id")
    return out.select(ident.alias(id_column), "start", "n_tokens", "ids_crc32")
