"""Approximate nearest neighbours (3): NN-descent and greedy graph search.

The graph starts from cells around hash-chosen pivots.  Each turn of NN-descent joins the
lists of a node's neighbours and of those it is a neighbour of, and compares them with each
other where one of the two is new to the list; nodes keep the best.  Turns end when few lists
change.  A query walks the graph: it expands the best nodes of its pool that it has not
expanded yet, until the best ``EXPAND`` are all expanded.

Graph and walk use copies of the vectors with four bytes per component; what is returned is
scored anew in double precision on the original vectors.  Vectors of different lengths have no
inner product: each length has a graph of its own.

Equal vectors are one node with their smallest ids, which join the found nodes again before the
last ranking.  Queries with equal vectors share one walk and one ranking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import row_key, stored
from flowloom.llm.vector_dedup import usable

DEGREE = 40  # neighbours kept by a node
REVERSE = 24  # nodes of which it is a neighbour that join in a turn, chosen by hash
EMIT = 6  # best partners that a node gets from one joined list
CELL = 1_024  # vectors compared with each other in one group of the first graph
CELLS_PER_VECTOR = 6
MOST_CELLS = 16_384
TURNS = 12
SETTLED = 0.05  # share of list entries that a turn must change to be followed by another
EXPAND = 32
POOL = 64
SALTS = 64  # a group of equal vectors is first reduced in so many parts

_GRAPH = "id long, vec binary, near array<long>, score array<float>, fresh array<boolean>"


def _packed(vectors: np.ndarray, top: float) -> pa.Array:
    """Vectors, divided by ``top``, with four bytes per component."""
    return pa.array([x.tobytes() for x in (vectors / top).astype("<f4")], pa.binary())


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column), "<f4").reshape(len(column), -1)


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _best(score: np.ndarray, most: int) -> np.ndarray:
    """Column places of the best scores of each row, the first of equal ones."""
    most = min(most, score.shape[1])
    if most == score.shape[1]:
        return np.argsort(-score, axis=1, kind="stable")
    top = np.argpartition(-score, most - 1, axis=1)[:, :most]
    least = np.take_along_axis(score, top, 1).min(1, keepdims=True)
    tied = np.flatnonzero((score >= least).sum(1) > most)
    if len(tied):
        top[tied] = np.argsort(-score[tied], axis=1, kind="stable")[:, :most]
    return top


def _cell_pairs(table: pa.Table) -> pa.Table:
    """The best partners of every vector of one block of a cell."""
    table = table.sort_by("id")
    ids = table.column("id").to_numpy()
    x = _vectors(table.column("vec").combine_chunks())
    out: list[list[np.ndarray]] = [[], [], []]
    for at in range(0, len(ids), 1_024):
        score = x[at : at + 1_024] @ x.T
        rows = np.arange(len(score))
        score[rows, rows + at] = -np.inf
        top = _best(score, DEGREE)
        got = np.take_along_axis(score, top, 1)
        fine = np.isfinite(got)
        for part, value in zip(out, (np.repeat(ids[at : at + 1_024], top.shape[1])[fine.ravel()], ids[top][fine], got[fine]), strict=True):
            part.append(value)
    return pa.table({"id": np.concatenate(out[0]), "other": np.concatenate(out[1]), "score": np.concatenate(out[2]).astype(np.float32)})


def _local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the members of each centre's list; new pairs that rank before a member's last go out."""
    for batch in batches:
        members = batch.column(0)
        out: list[list[np.ndarray]] = [[], [], []]
        flat = members.flatten()
        cut = members.offsets.to_numpy() - members.offsets[0].as_py()
        all_ids = flat.field("member").to_numpy(zero_copy_only=False)
        all_fresh = flat.field("fresh").to_numpy(zero_copy_only=False)
        all_worst = flat.field("worst").to_numpy(zero_copy_only=False)
        all_last = flat.field("last").to_numpy(zero_copy_only=False)
        vectors = _vectors(flat.field("vec"))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if b - a < 2:
                continue
            at = a + np.argsort(all_ids[a:b])
            ids, fresh, worst, last, x = all_ids[at], all_fresh[at].astype(bool), all_worst[at], all_last[at], vectors[at]
            score = x @ x.T
            score[~(fresh[:, None] | fresh[None, :])] = -np.inf
            np.fill_diagonal(score, -np.inf)
            top = _best(score, EMIT)
            got = np.take_along_axis(score, top, 1)
            better = (got > worst[:, None]) | ((got == worst[:, None]) & np.isfinite(got) & (ids[top] < last[:, None]))
            for part, value in zip(out, (np.repeat(ids, top.shape[1])[better.ravel()], ids[top][better], got[better]), strict=True):
                part.append(value)
        columns = [np.concatenate(p) if p else np.empty(0, k) for p, k in zip(out, (np.int64, np.int64, np.float32), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2].astype(np.float32))], names=["id", "other", "score"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge offered partners into each node's list; those that enter are fresh."""
    for batch in batches:
        near, score, fresh = [], [], []
        for i in range(batch.num_rows):
            old = batch.column("near")[i].values
            old = old.to_numpy() if old is not None else np.empty(0, np.int64)
            kept = batch.column("score")[i].values
            kept = kept.to_numpy() if kept is not None else np.empty(0, np.float32)
            offered = batch.column("offers")[i].values
            if offered is None:
                near.append(old)
                score.append(kept)
                fresh.append(np.zeros(len(old), bool))
                continue
            ids = np.concatenate([old, offered.field("other").to_numpy()])
            value = np.concatenate([kept, offered.field("score").to_numpy()])
            new = np.concatenate([np.zeros(len(old), bool), np.ones(len(ids) - len(old), bool)])
            _, first = np.unique(ids, return_index=True)
            first = first[np.lexsort((ids[first], -value[first]))][:DEGREE]
            near.append(ids[first])
            score.append(value[first])
            fresh.append(new[first])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("vec"), _lists(near, pa.int64()), _lists(score, pa.float32()), _lists(fresh, pa.bool_())],
            names=["id", "vec", "near", "score", "fresh"],
        )


def _first_graph(nodes: DataFrame, count: int) -> DataFrame:
    cells = int(min(MOST_CELLS, max(1, round(count * CELLS_PER_VECTOR / CELL))))
    each = min(CELLS_PER_VECTOR, cells)
    blocks = max(1, -(-count * each // (cells * CELL)))
    sample = nodes.orderBy(F.xxhash64("id", F.lit(17)), "id").limit(cells).select("vec").toArrow()
    pivots = _vectors(sample.column("vec").combine_chunks())

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                cell = _best(_vectors(part.column(1)) @ pivots.T, each).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(list(cell), pa.int32())], names=["id", "vec", "cell"])

    dealt = nodes.mapInArrow(placed, "id long, vec binary, cell array<int>")
    dealt = stored(dealt.select("id", "vec", F.explode("cell").alias("cell")), "ann-cells")
    # A crowded cell is cut into blocks by hash; what that misses is for the turns to find.
    crowd = dealt.groupBy("cell").agg(F.ceil(F.count("*") / (CELL * F.lit(blocks) * 2)).cast("int").alias("blocks"))
    dealt = dealt.join(crowd, "cell").withColumn("block", F.pmod(F.xxhash64("id", "cell"), F.col("blocks")).cast("int"))
    pairs = dealt.groupBy("cell", "block").applyInArrow(_cell_pairs, "id long, other long, score float")
    empty = nodes.select("id", "vec", F.lit(None).cast("array<long>").alias("near"), F.lit(None).cast("array<float>").alias("score"))
    return _merged(empty, pairs)


def _merged(graph: DataFrame, pairs: DataFrame) -> DataFrame:
    offers = pairs.groupBy("id").agg(F.collect_list(F.struct("other", "score")).alias("offers"))  # bounded by lists joined
    return stored(graph.select("id", "vec", "near", "score").join(offers, "id", "left").mapInArrow(_merge, _GRAPH), "ann-graph")


def neighbour_graph(nodes: DataFrame, count: int) -> DataFrame:
    """The graph over (id, vec): every node with its ``DEGREE`` best neighbours found."""
    graph = _first_graph(nodes, count)
    for turn in range(TURNS):
        links = graph.select(F.col("id").alias("centre"), F.explode(F.arrays_zip("near", "fresh")).alias("e"))
        links = links.select("centre", F.col("e.near").alias("member"), F.col("e.fresh").alias("fresh"))
        changed = links.agg(F.avg(F.col("fresh").cast("double"))).first()[0]
        if not changed or changed < SETTLED:
            break
        pick = Window.partitionBy("centre").orderBy(F.desc("fresh"), F.xxhash64("centre", "member", F.lit(turn)))
        back = links.select(F.col("member").alias("centre"), F.col("centre").alias("member"), "fresh")
        back = back.withColumn("n", F.row_number().over(pick)).where(F.col("n") <= REVERSE).drop("n")
        joined = links.union(back).groupBy("centre", "member").agg(F.max("fresh").alias("fresh"))
        worst = F.when(F.size("near") < DEGREE, F.lit(float("-inf"))).otherwise(F.array_min("score")).cast("float")
        last = F.when(F.size("near") < DEGREE, F.lit(None)).otherwise(F.element_at("near", -1))
        last = F.coalesce(last, F.lit((1 << 63) - 1)).alias("last")
        known = graph.select(F.col("id").alias("member"), "vec", worst.alias("worst"), last)
        lists = joined.join(known, "member").groupBy("centre").agg(
            F.collect_list(F.struct("member", "fresh", "worst", "last", "vec")).alias("members")
        )  # at most DEGREE + REVERSE members
        pairs = lists.select("members").mapInArrow(_local_join, "id long, other long, score float")
        graph = _merged(graph, pairs)
    return graph


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Score the nodes that a query met, merge them into its pool, and name the next to expand."""
    for batch in batches:
        query = _vectors(batch.column("vec"))
        pool, value, nexts, past = [], [], [], []
        for i in range(batch.num_rows):
            ids, score = batch.column("pool")[i].values.to_numpy(), batch.column("value")[i].values.to_numpy()
            done = batch.column("past")[i].values.to_numpy()
            met = batch.column("met")[i].values
            if met is not None and len(met):
                found = met.field("cand").to_numpy()
                ids = np.concatenate([ids, found])
                score = np.concatenate([score, _vectors(met.field("vec")) @ query[i]]).astype(np.float32)
                _, first = np.unique(ids, return_index=True)
                first = first[np.lexsort((ids[first], -score[first]))][:POOL]
                ids, score = ids[first], score[first]
            new = ids[:EXPAND][~np.isin(ids[:EXPAND], done)]
            pool.append(ids)
            value.append(score)
            nexts.append(new)
            past.append(np.concatenate([done, new]))
        kinds = (pa.int64(), pa.float32(), pa.int64(), pa.int64())
        lists = [_lists(x, k) for x, k in zip((pool, value, nexts, past), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("vec"), *lists], names=["query", "vec", "pool", "value", "next", "past"])


def greedy_search(graph: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, pool): the best nodes met on the walk of each query (query, vec, pool, value)."""
    schema = "query long, vec binary, pool array<long>, value array<float>, next array<long>, past array<long>"
    no_nodes = F.lit(None).cast("array<struct<cand:long,vec:binary>>")
    state = queries.withColumn("past", F.array().cast("array<long>")).withColumn("met", no_nodes)
    state = stored(state.select("query", "vec", "pool", "value", "past", "met").mapInArrow(_walk, schema), "ann-walk")
    while True:
        steps = state.select("query", F.explode("next").alias("id"))
        if steps.isEmpty():
            return state.select("query", "pool")
        seen = state.select("query", F.explode(F.concat(F.col("pool"), F.array("query"))).alias("cand"))
        met = steps.join(graph.select("id", "near"), "id").select("query", F.explode("near").alias("cand")).distinct()
        met = met.join(seen, ["query", "cand"], "left_anti").join(graph.select(F.col("id").alias("cand"), "vec"), "cand")
        met = met.groupBy("query").agg(F.collect_list(F.struct("cand", "vec")).alias("met"))  # at most EXPAND lists
        state = stored(
            state.drop("next").join(met, "query", "left").select("query", "vec", "pool", "value", "past", "met").mapInArrow(_walk, schema),
            "ann-walk",
        )


def _salt(id_column: str) -> Column:
    return F.pmod(F.xxhash64(id_column), F.lit(SALTS)).alias("salt")


def _distinct(rows: DataFrame, most: int) -> DataFrame:
    """Every distinct vector of (id, x) once, as (id, x, ids): its smallest id and its ``most`` smallest."""
    some = Window.partitionBy("x", "salt").orderBy("id")
    few = rows.select("id", "x", _salt("id")).withColumn("n", F.row_number().over(some)).where(F.col("n") <= most)
    ids = F.slice(F.array_sort(F.collect_list("id")), 1, most).alias("ids")  # of at most ``most`` * SALTS
    whole = few.groupBy("x").agg(ids)
    return stored(whole.select(F.col("ids")[0].alias("id"), "x", "ids"), "ann-distinct")


def nearest_neighbours(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", every: int = 20, k: int = 20
) -> DataFrame:
    """The ``k`` rows of largest inner product found for every row whose id is divisible by ``every``.

    Returns query_id, rank (from 1), the id and score (inner product of the original vectors in
    double precision), nearest first, ties to the smaller id; a query is never its own
    neighbour, and gets all other rows of its length if there are fewer than ``k``.  Vectors that
    are null, empty, zero, hold null or non-finite components, or have a null id, take no part.
    Rows with equal ids take part each, in the order of their vectors' hashes.  Other columns are
    not read.  ``k`` may be at most ``POOL``.  An empty table gives no rows.
    """
    if k > POOL:
        raise ValueError(f"k may be at most {POOL}")
    rows = vectors.select(F.col(id_column).cast("long").alias("own"), F.col(vector_column).cast("array<double>").alias("x"))
    rows, key = row_key(rows.where(usable(F.col("x")) & F.col("own").isNotNull()), "own", "x")
    asked = (F.col("own") % every == 0).alias("asked")
    rows = stored(rows.select(F.col(key).alias("id"), "own", "x", asked), "ann-vectors")
    found = None
    for length in rows.groupBy(F.size("x").alias("n")).agg(F.max(F.array_max(F.transform("x", F.abs))).alias("top")).orderBy("n").collect():
        part = _nearest(rows.where(F.size("x") == length["n"]), float(length["top"]), k)
        found = part if found is None else found.union(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], f"query_id long, rank int, `{id_column}` long, score double")
    if key != "own":  # give the ids back
        ids = rows.select("id", "own")
        found = found.join(ids, "id").drop("id").withColumnRenamed("own", "id")
        found = found.join(ids.withColumnsRenamed({"id": "query_id", "own": "asker"}), "query_id").drop("query_id").withColumnRenamed("asker", "query_id")
    return found.select("query_id", "rank", F.col("id").alias(id_column), "score")


def _nearest(rows: DataFrame, top: float, k: int) -> DataFrame:
    """(query_id, rank, id, score) for vectors (id, x, asked) of one length."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), _packed(x, top)], names=["id", "vec"])

    whole = _distinct(rows, k + 1)
    nodes = stored(whole.select("id", "x").mapInArrow(packed, "id long, vec binary"), "ann-nodes")
    graph = neighbour_graph(nodes, nodes.count())
    asked = rows.where("asked").select(F.col("id").alias("query_id"), "x", _salt("id"))
    homes = asked.select("x", "salt").distinct().join(whole.select("x", F.col("id").alias("node")), "x")  # at most SALTS for a node
    homes = stored(homes, "ann-homes")
    asked = asked.join(homes, ["x", "salt"]).select("query_id", "node", "salt")
    homes = homes.select("node", "salt")
    walking = graph.join(homes.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    walking = walking.select(F.col("id").alias("query"), "vec", F.col("near").alias("pool"), F.col("score").alias("value"))
    found = greedy_search(graph, walking).select(F.col("query").alias("node"), F.explode(F.concat("pool", F.array("query"))).alias("id"))
    scored = (
        found.join(whole, "id")
        .join(whole.select(F.col("id").alias("node"), F.col("x").alias("y")), "node")
        .select("node", "ids", F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v).alias("score"))
        .select("node", "score", F.explode("ids").alias("id"))
    )
    # One more than ``k``, as a query may be among them.
    best = Window.partitionBy("node").orderBy(F.desc("score"), "id")
    ranked = scored.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    ranked = ranked.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("best"))
    answers = asked.join(ranked.join(homes, "node"), ["node", "salt"])
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("query_id")), 1, k)
    answers = answers.select("query_id", F.posexplode(others).alias("place", "b"))
    return answers.select("query_id", (F.col("place") + 1).alias("rank"), F.col("b.id").alias("id"), F.col("b.score").alias("score"))
