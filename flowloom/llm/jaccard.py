"""N-gram Jaccard join (10): an exact similarity join in the metric 1 - Jaccard.

With similarity t, two linked documents are at most eps = 1 - t apart.

1. *Isolation.*  Every shingle that no other document has adds 1 / size to a document's
   distance from everything else.  Shingles of a fixed half of the hash space are dealt out
   by hash, counted, and reported back where they are shared; documents whose own shingles
   alone put them beyond eps are done.  (Shingles held by a large share of all documents are
   left out of the half, by a bounded list that all tasks share.)
2. *First regions.*  One-shingle sets are the first pivots.  A document is nearer than 1 to the
   pivots of its own shingles only; it is copied to the regions of its rarest ones, one more
   than it may lack in a linked document, so every linked pair meets in a region.
3. *Document pivots.*  Regions that overlap in their smallest documents become one, so each set
   is sent about once, to a task of bounded size; two blocks of a region that is larger
   meet in a task of their own.  There documents far from each other become pivots and
   the exact distance of every member to them is computed.  The triangle inequality cuts the
   region: a document is compared only with those whose distances to all pivots differ from its own
   by at most eps, so one in the ball of a pivot only with the window of 2 eps around it.
   What is connected is not compared again, and a task returns a spanning forest of its
   links, never pairs.

Equal shingle sets are one document from the start, so a group of copies is one member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import keyed, light_driver, shuffle_partitions, stored
from flowloom.llm.components import components
from flowloom.llm.words import blocks, mixed, shingles

GROUP_BYTES = 16 << 20  # text per group of counted shingles
SAMPLE = 16  # one document of so many is looked at to find very common shingles
COMMON_SHARE = 1e-6  # of all shingles; bounds the list of common ones to a million
PIVOTS = 16  # whose distances to all members of a region are kept
BLOCK_BYTES = 4 << 20  # of sets in one group, or in one block of a larger region
BLOCK_ROWS = 4096  # sets in one block
SLOTS = 1 << 24  # bits of the filter that keeps texts without a region from being shuffled

_HALF = np.uint64(1 << 63)
_DEALT = "bucket int, docs binary, counts binary, low binary, high binary, meta binary"
_BACK = "home int, bucket int, docs binary, counts binary, shared binary, meta binary"


def _allowed(n, percent: int):
    """Shingles that a set of n may lack in a set it is linked with."""
    return n * (100 - percent) // 100


def _deal(block, uids, groups: int, common: np.ndarray, shingle: int, percent: int):
    value, first = shingles(block, shingle)
    n = np.diff(first)
    rows = len(n)
    row = np.repeat(np.arange(rows), n)
    total = lambda x: np.diff(np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])[first])
    f1, f2 = total(mixed(value ^ np.uint64(0x5851F42D4C957F2D))), total(mixed(value + np.uint64(0x14057B7EF767814F)))
    half = (value < _HALF) & ~np.isin(value, common)
    n_half = np.bincount(row[half], minlength=rows)
    whole = n_half <= _allowed(n, percent)
    ship = half | whole[row]
    shipped = np.where(whole, n, n_half)
    value, row, outside = value[ship], row[ship], ~half[ship]
    code = mixed(value)
    bucket = ((code >> np.uint64(40)) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    value, row, code = bucket[order], row[order], code[order]
    low = (code & np.uint64(0xFFFFFFFF)).astype("<u4")
    high = ((code >> np.uint64(32)) & np.uint64(0x7F)).astype("<u1") | (outside[order].astype("<u1") << 7)
    cut = np.searchsorted(value, np.arange(groups + 1))
    home = _home(uids, groups)
    meta = np.stack([uids, n, n_half, shipped, f1.astype(np.int64), f2.astype(np.int64)], 1).astype("<i8")
    columns: list[list] = [[] for _ in range(6)]
    for g in range(groups):
        part = slice(cut[g], cut[g + 1])
        here = meta[home == g]
        if part.start == part.stop and not len(here):
            continue
        docs, counts = np.unique(row[part], return_counts=True)
        for column, x in zip(
            columns,
            (
                g,
                np.diff(uids[docs], prepend=0).astype("<i8").tobytes(),
                counts.astype("<u4").tobytes(),
                low[part].tobytes(),
                high[part].tobytes(),
                here.tobytes(),
            ),
            strict=True,
        ):
            column.append(x)
    types = [pa.int32()] + [pa.binary()] * 5
    names = [x.split()[0] for x in _DEALT.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _home(uids: np.ndarray, groups: int) -> np.ndarray:
    return (mixed(uids.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _count_group(table: pa.Table, groups: int) -> pa.Table:
    """Count the shingles of one group; report the shared ones to the homes of their documents."""
    bucket = table.column(0)[0].as_py()
    read = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)])
    uid = np.concatenate([np.cumsum(np.frombuffer(x.as_buffer(), "<i8")) for x in table.column("docs")])
    owner = np.repeat(uid, read("counts", "<u4").astype(np.int64))
    key = (read("high", "<u1").astype(np.uint64) << np.uint64(32)) | read("low", "<u4")
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
    size = np.diff(edge)
    held = np.empty(len(key), np.int64)
    held[order] = np.repeat(size, size)
    some = np.flatnonzero(held > 1)
    home = _home(owner[some], groups)
    order = np.lexsort((owner[some], home))
    some, home = some[order], home[order]
    cut = np.searchsorted(home, np.arange(groups + 1))
    held, key = np.minimum(held[some], 65535).astype("<u2"), key[some].astype("<u8")
    meta = read("meta", "<i8").tobytes()
    columns: list[list] = [[] for _ in range(6)]
    for g in range(groups):
        part = slice(cut[g], cut[g + 1])
        own = meta if g == bucket else b""
        if part.start == part.stop and not own:
            continue
        docs, counts = np.unique(owner[some[part]], return_counts=True)
        raw = key[part].view("u1").reshape(-1, 8)[:, :5].tobytes() + held[part].tobytes()
        delta = np.diff(docs, prepend=0).astype("<i8").tobytes()
        for column, x in zip(columns, (g, bucket, delta, counts.astype("<u4").tobytes(), raw, own), strict=True):
            column.append(x)
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _BACK.split(", ")])


def _gather_home(table: pa.Table, percent: int) -> pa.Table:
    """The documents of one home: sizes, fingerprints and region keys (null: isolated)."""
    owner, key, held, meta = [], [], [], []
    for i in range(table.num_rows):
        raw = lambda name: table.column(name)[i].as_buffer()  # noqa: E731, B023
        counts = np.frombuffer(raw("counts"), "<u4").astype(np.int64)
        owner.append(np.repeat(np.cumsum(np.frombuffer(raw("docs"), "<i8")), counts))
        c = int(counts.sum())
        wide = np.zeros((c, 8), "u1")
        wide[:, :5] = np.frombuffer(raw("shared"), "u1", 5 * c).reshape(-1, 5)
        key.append(wide.view("<i8").ravel() + (table.column("bucket")[i].as_py() << 40))
        held.append(np.frombuffer(raw("shared"), "<u2", c, 5 * c))
        meta.append(np.frombuffer(raw("meta"), "<i8").reshape(-1, 6))
    owner, key, held, meta = (np.concatenate(x) for x in (owner, key, held, meta))
    meta = meta[np.argsort(meta[:, 0])]
    order = np.argsort(owner, kind="stable")
    key, held = key[order], held[order]
    first = np.searchsorted(owner[order], meta[:, 0], side="left")
    last = np.searchsorted(owner[order], meta[:, 0], side="right")
    keys = [
        _prefix(int(n), int(n_half), int(shipped), key[a:b], held[a:b], percent)
        for n, n_half, shipped, a, b in zip(*meta[:, 1:4].T, first, last, strict=True)
    ]
    names = ["uid", "n", "f1", "f2", "keys"]
    columns = [pa.array(meta[:, 0]), pa.array(meta[:, 1].astype(np.int32)), pa.array(meta[:, 4]), pa.array(meta[:, 5])]
    return pa.table([*columns, pa.array(keys, pa.list_(pa.int64()))], names=names)


def _prefix(n: int, n_half: int, shipped: int, key: np.ndarray, held: np.ndarray, percent: int) -> list[int] | None:
    """The region keys of one document from its shared shingles; None if its own ones isolate it."""
    allowed = _allowed(n, percent)
    if not len(key):
        return None
    outside = (key >> 39) & 1
    order = np.lexsort((key, held, outside))
    key, inner = key[order], int((outside == 0).sum())
    # Shingles outside the half were dealt out by some documents only, so they prove isolation
    # only among those: from the others this document must then share nothing in the half.
    if shipped - len(key) > allowed and (shipped == n_half or not inner):
        return None
    # In this order a document's unshared shingles come first in either half.
    keys = key[: max(0, min(inner, allowed + 1 - (n_half - inner)))].tolist()
    if shipped > n_half:
        room = allowed + 1 - n_half - (shipped - n_half - (len(key) - inner))
        keys += key[inner : inner + max(0, room)].tolist()
    return keys


def _regions(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Every document with its set size, set fingerprint and region keys (null: isolated)."""
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.octet_length("_text")).alias("n")).first()["n"] or 0
    groups = max(shuffle_partitions(spark), -(-total // GROUP_BYTES))
    limit = max(4, total / 6 * COMMON_SHARE / SAMPLE)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                value, n = np.unique(shingles(block, shingle)[0], return_counts=True)
                often = n >= 2
                yield pa.RecordBatch.from_arrays([pa.array(value[often].astype(np.int64)), pa.array(n[often])], names=["value", "n"])

    often = (
        rows.where(F.pmod(F.xxhash64("_uid"), F.lit(SAMPLE)) == 0)
        .select("_uid", "_text")
        .mapInArrow(counted, "value long, n long")
        .groupBy("value")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= limit)
        .select("value")
    )
    # At most 1 / COMMON_SHARE values reach the limit.
    common = np.sort(np.array([r["value"] for r in often.collect()], np.int64).astype(np.uint64))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column(0).to_numpy()
            for block in blocks(batch.column(1), np.argsort(uids, kind="stable")):
                yield from _deal(block, uids[block.rows], groups, common, shingle, percent)

    counted_groups = rows.select("_uid", "_text").mapInArrow(dealt, _DEALT).groupBy("bucket")
    back = counted_groups.applyInArrow(lambda table: _count_group(table, groups), _BACK)
    schema = "uid long, n int, f1 long, f2 long, keys array<bigint>"
    return back.groupBy("home").applyInArrow(lambda table: _gather_home(table, percent), schema)


class _Sets:
    """The shingle sets of one region, and their exact distances."""

    def __init__(self, elements: list, percent: int):
        self.percent, self.eps = percent, (100 - percent) / 100 + 1e-9
        sets = [np.frombuffer(x, "<u8") for x in elements]
        self.size = np.array([len(x) for x in sets], np.int64)
        self.first = np.cumsum(self.size) - self.size
        vocabulary, code = np.unique(np.concatenate(sets), return_inverse=True)
        self.code, self.marks = code.astype(np.int32), np.zeros(len(vocabulary), np.uint8)

    def shared(self, pivot: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of ``pivot`` with ``others``."""
        own = self.code[self.first[pivot] : self.first[pivot] + self.size[pivot]]
        self.marks[own] = 1
        n = self.size[others]
        at = np.cumsum(n) - n
        hits = self.marks[self.code[np.repeat(self.first[others] - at, n) + np.arange(n.sum())]]
        self.marks[own] = 0
        return np.add.reduceat(hits, at, dtype=np.int64)

    def links(self, side: np.ndarray) -> tuple[list[int], list[int]]:
        """A spanning forest of the links; with two sides, of those between them.

        Every document in turn is a pivot.  By the triangle inequality it is measured only against
        documents whose distances to the pivots of the table differ from its own by at most eps
        (for one in a pivot's ball, those are the window of 2 eps around that pivot), and
        only against those not connected with it yet.
        """
        rows, root = len(self.size), np.arange(len(self.size))
        crossing = side.min() != side.max()
        waiting = np.ones(rows, bool)
        if crossing:  # pivots of the smaller side meet all of the other
            waiting = side == (side.min() if 2 * (side == side.min()).sum() <= rows else side.max())
        table: list[np.ndarray] = []
        nearest = np.full(rows, 2.0)
        a, b = [], []
        while waiting.any() and (root != root[0]).any():
            # The table takes documents far from each other, then all follow in their order.
            use_table = len(table) < PIVOTS and rows > 2 * PIVOTS
            pivot = int(np.argmax(np.where(waiting, nearest, -1.0))) if use_table else int(np.argmax(waiting))
            waiting[pivot] = False
            open_ones = root != root[pivot]
            if crossing:
                open_ones &= side != side[pivot]
            else:
                open_ones &= waiting
            if use_table:
                every = np.arange(rows)
                inter = self.shared(pivot, every)
                distance = 1 - inter / (self.size + self.size[pivot] - inter)
                table.append(distance)
                nearest = np.minimum(nearest, distance)
                others = np.flatnonzero(open_ones)
                inter = inter[others]
            else:
                small, large = np.minimum(self.size, self.size[pivot]), np.maximum(self.size, self.size[pivot])
                open_ones &= 100 * small >= self.percent * large
                for distance in table:
                    open_ones &= np.abs(distance - distance[pivot]) <= self.eps
                others = np.flatnonzero(open_ones)
                inter = self.shared(pivot, others) if len(others) else np.empty(0, np.int64)
            total = self.size[others] + self.size[pivot] - inter
            linked = others[100 * inter >= self.percent * total]
            if len(linked):
                joined, at = np.unique(root[linked], return_index=True)
                a += [pivot] * len(at)
                b += linked[at].tolist()
                root[np.isin(root, joined)] = root[pivot]
        return a, b


def _region_links(table: pa.Table, percent: int) -> pa.Table:
    """Links of the regions of one group: whole regions, or two blocks of a large one."""
    region, side, uid = (table.column(c).to_numpy() for c in ("region", "side", "uid"))
    order = np.lexsort((uid, region))
    elements = table.column("elements").combine_chunks()
    a, b = [], []
    for part in np.split(order, np.flatnonzero(np.diff(region[order])) + 1):
        if len(part) > 1:
            x, y = _Sets([elements[i].as_buffer() for i in part.tolist()], percent).links(side[part])
            a.append(uid[part][x])
            b.append(uid[part][y])
    none = np.empty(0, np.int64)
    return pa.table({c: pa.array(np.concatenate([none, *x]).astype(np.int64)) for c, x in (("a", a), ("b", b))})


def _merged(members: DataFrame) -> DataFrame:
    """(region, uid, n): first regions (rid) that overlap in their smallest documents are one region.

    Each takes the smallest document of all regions of its members, so a family of near copies
    that meets in many regions is sent and compared about once; no region grows further.
    """
    least = members.groupBy("rid").agg(F.min("uid").alias("region"), F.count("*").alias("rows")).where("rows > 1")
    met = members.join(least.drop("rows"), "rid")
    near = met.groupBy("uid").agg(F.min("region").alias("region"))
    joined = met.select("rid", "uid").join(near, "uid").groupBy("rid").agg(F.min("region").alias("region"))
    return members.join(joined, "rid").select("region", "uid", "n").distinct()


def _routes(regions: DataFrame) -> DataFrame:
    """(uid, to): the groups each set is sent to.

    Small regions share groups of bounded size.  A region beyond that is cut into blocks, and
    each pair of blocks is a group.
    """
    parts = F.greatest(F.ceil(F.sum("n") * 8 / BLOCK_BYTES), F.ceil(F.count("*") / BLOCK_ROWS)).cast("int")
    sizes = stored(regions.groupBy("region").agg(parts.alias("parts"), F.sum("n").alias("n")), "jaccard-sizes")
    total = sizes.where("parts = 1").agg(F.sum("n").alias("n")).first()["n"] or 0
    packs = max(shuffle_partitions(regions.sparkSession), -(-total * 8 // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")
    routed = regions.drop("n").join(sizes.drop("n"), "region").withColumn("side", F.when(F.col("parts") > 1, block).otherwise(-1))
    other = F.explode(F.when(F.col("parts") > 1, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(-1))))
    routed = routed.select("*", other.alias("other"))
    pack = F.when(F.col("parts") > 1, F.col("region")).otherwise(F.pmod(F.xxhash64("region"), F.lit(packs)))
    to = F.struct(pack.alias("pack"), F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "region", "side")
    return routed.groupBy("uid").agg(F.collect_list(to).alias("to"))


def _slots(uids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    slot = mixed(uids.astype(np.uint64)) % np.uint64(SLOTS)
    return (slot >> np.uint64(6)).astype(np.int64), slot & np.uint64(63)


def _filter(routes: DataFrame) -> np.ndarray:
    """Two megabytes of bits, set for every document that is sent anywhere (and by chance for some others)."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, bit = _slots(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array((np.uint64(1) << bit).view(np.int64))], names=["word", "bits"])

    found = routes.select("uid").mapInArrow(marked, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(SLOTS // 64, np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return bits.view(np.uint64)


def jaccard_components(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, percent: int = 75
) -> DataFrame:
    """Classes of documents linked by 100 * intersection >= percent * union of word shingles.

    Returns one row per input row: the id, ``n_shingles`` (distinct ``shingle``-word runs; a
    shorter text is one shingle as a whole; null, empty or blank texts have none and link with
    nothing) and ``component_id`` (the smallest id reachable by links, itself included).
    Equal texts link.  Rows with a null or repeated id count as separate documents, and then
    ``component_id`` is the id of the first row in the order of (id, text hash), null first.
    Texts of any length are taken whole; their words are hashed in strips.  Other columns are not
    read.  An empty table gives no rows.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    rows, renumbered = keyed(docs, id_column, text_column)
    every = stored(_regions(rows, shingle, percent), "jaccard-regions")
    near = every.where(F.col("keys").isNotNull() & (F.col("n") > 0))
    first_copy = near.groupBy("n", "f1", "f2").agg(F.min("uid").alias("rep"))
    copies = near.join(first_copy, ["n", "f1", "f2"]).select("uid", "rep", "n", F.when(F.col("uid") == F.col("rep"), F.col("keys")).alias("keys"))
    copies = stored(copies, "jaccard-copies")
    members = copies.where("uid = rep").select(F.explode("keys").alias("rid"), "uid", "n")
    regions = stored(_merged(stored(members, "jaccard-members")), "jaccard-merged")
    routes = stored(_routes(regions), "jaccard-routes")

    sent = _filter(routes)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, bit = _slots(batch.column(0).to_numpy())
            wanted = np.flatnonzero((sent[word] >> bit) & np.uint64(1))
            for block in blocks(batch.column(1), wanted):
                value, first = shingles(block, shingle)
                value = value.astype("<u8")
                elements = [value[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(block.rows)), pa.array(elements, pa.binary())], names=["uid", "elements"])

    sets = rows.select("_uid", "_text").mapInArrow(encoded, "uid long, elements binary").join(routes, "uid")
    sets = sets.select("uid", "elements", F.explode("to").alias("to")).select("uid", "elements", "to.*")
    links = sets.groupBy("pack", "lo", "hi").applyInArrow(lambda table: _region_links(table, percent), "a long, b long")
    links = stored(links, "jaccard-links")
    with light_driver(docs.sparkSession):
        labels = None if links.isEmpty() else components(links)
    out = every.select("uid", "n").join(copies.select("uid", "rep"), "uid", "left")
    if labels is not None:
        out = out.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    else:
        out = out.withColumn("component", F.lit(None).cast("long"))
    out = out.select("uid", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "rep", "uid").alias("_class"))
    if renumbered:  # give the ids back
        ids = rows.select(F.col("_uid").alias("uid"), "_id")
        out = out.join(ids, "uid").join(ids.select(F.col("uid").alias("_class"), F.col("_id").alias("component_id")), "_class")
        return out.select(F.col("_id").alias(id_column), "n_shingles", "component_id")
    return out.select(F.col("uid").alias(id_column), "n_shingles", F.col("_class").alias("component_id"))
