"""Near duplicates of numeric rows (X4): an epsilon join by grid.

Two rows are near if no feature differs by more than ``eps``.  Features become whole numbers, so
that this is decided exactly.  Equal rows are one point.  The plane of the features that vary most
is cut into cells some times ``eps`` wide; a point lies in its own cell and, where it is within ``eps`` of the
upper border, in the next one as well, so two near points always meet in the cell that is
the larger of theirs in every direction.  A crowded cell is cut again along the next
feature.  A task compares the points of one cell and returns their classes there, as stars; stars
are joined into classes of the whole table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.classes import linked_classes
from flowloom.session import materialise

UNIT = 1e-6  # features are compared in steps of this
FIRST_FEATURES = 2
CELL_WIDTH = 8  # in eps
MOST_IN_CELL = 5_000
COMPARED = 4_000_000  # feature differences looked at in one go


def _whole(column: str, limit: float) -> Column:
    """A feature in steps of ``UNIT``; what is not finite keeps apart from every finite value."""
    value = F.col(column).cast("double")
    large = F.lit(limit)
    held = F.greatest(F.least(value, large), -large)
    odd = F.when(F.isnan(value), 3 * large).when(value == float("inf"), 2 * large).when(value == -float("inf"), -2 * large)
    return F.round(F.coalesce(odd, held, -3 * large) / UNIT + 1e-3).cast("long")


def near_stars(points: np.ndarray, ids: np.ndarray, eps: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id of its class) for points that have a near one, by exact comparison."""
    spread = points.max(axis=0) - points.min(axis=0)
    order = np.argsort(points[:, spread.argmax()], kind="stable")
    points, ids = points[order], ids[order]
    line = points[:, spread.argmax()]
    upto = np.searchsorted(line, line + eps, side="right")
    left, right = [], []
    low = 0
    while low < len(ids):
        high = low + 1
        while high < len(ids) and (high + 1 - low) * (upto[high] - low) * points.shape[1] <= COMPARED:
            high += 1
        block = points[low : upto[high - 1]]
        near = np.ones((high - low, len(block)), bool)
        for j in range(points.shape[1]):
            near &= np.abs(points[low:high, j, None] - block[None, :, j]) <= eps
        a, b = np.nonzero(np.triu(near, 1))
        left.append(a + low)
        right.append(b + low)
        low = high
    a, b = np.concatenate(left), np.concatenate(right)
    label = ids.copy()
    while True:  # classes of this cell
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        if (label == before).all():
            break
    linked = np.unique(np.concatenate([a, b]))
    return ids[linked], label[linked]


def _corner(value: Column, wide: int) -> Column:
    return value - F.pmod(value, F.lit(wide))


def _dealt(points: DataFrame, features: list[str], wide: int, eps: int) -> DataFrame:
    """Points in all their cells: their own and the next one up, in every direction of ``features``.

    ``cell`` is extended, so that cells can be cut again.
    """
    for f in features:
        sides = F.array_distinct(F.array(_corner(F.col(f), wide), _corner(F.col(f) + eps, wide)))
        points = points.withColumn("side", F.explode(sides)).withColumn("cell", F.xxhash64("cell", "side")).drop("side")
    return points


def _feature_order(points: DataFrame, features: list[str], wide: int) -> list[str]:
    """The features by the number of cells that they spread the points over, most first."""
    counts = points.agg(*[F.approx_count_distinct(_corner(F.col(f), wide)).alias(f) for f in features]).first()
    return sorted(features, key=lambda f: (-counts[f], features.index(f)))


def near_links(points: DataFrame, features: list[str], eps: int, most: int = MOST_IN_CELL) -> DataFrame:
    """(a, b): links that join exactly the classes of near points (``id`` and whole features)."""
    wide = max(1, CELL_WIDTH * eps)
    order = _feature_order(points, features, wide)

    def compare(table: pa.Table) -> pa.Table:
        rows = np.stack([table.column(f).to_numpy() for f in features], axis=1)
        a, b = near_stars(rows, table.column("id").to_numpy(), eps)
        return pa.table({"a": a, "b": b})

    found, depth = None, min(FIRST_FEATURES, len(order))
    left = _dealt(points.withColumn("cell", F.lit(0).cast("long")), order[:depth], wide, eps)
    while True:
        left = materialise(left)
        sizes = left.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
        settled = left.join(sizes.where(F.col("n") <= most).select("cell"), "cell", "left_semi")
        crowded = sizes.where(F.col("n") > most).select("cell", "n")
        links = materialise(settled.groupBy("cell").applyInArrow(compare, "a long, b long"))
        found = links if found is None else found.union(links)
        if crowded.isEmpty():
            return found
        rows = left.join(crowded, "cell")
        if depth < len(order):
            left = _dealt(rows.drop("n"), [order[depth]], wide, eps)
            depth += 1
            continue
        # More points than a task should hold lie within one cell of all features: each pair of their
        # blocks meets in a task of its own.
        blocks = F.ceil(F.col("n") * 2 / most)
        own = F.pmod(F.xxhash64("id"), blocks)
        met = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        met = met.withColumn("cell", F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")))
        return found.union(materialise(met.select("cell", "id", *features).groupBy("cell").applyInArrow(compare, "a long, b long")))


def near_duplicates(rows: DataFrame, key: str, features: list[str], eps: float, largest: float = 1e9) -> DataFrame:
    """Per row, the class of rows that chains of near ones connect: (key, near_id, copies).

    ``near_id`` is the smallest key of the class, ``copies`` the number of rows with exactly these
    features (in steps of a millionth).  ``key`` must be unique.  A null, NaN or infinite feature is near its
    own kind only; values beyond ``largest`` count as ``largest``.
    """
    whole = max(1, round(eps / UNIT))
    names = [f"f{i}" for i in range(len(features))]
    values = rows.select(F.col(key).cast("long").alias("id"), *[_whole(f"`{f}`", largest).alias(n) for f, n in zip(features, names, strict=True)])
    values = materialise(values)
    points = materialise(values.groupBy(*names).agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    links = near_links(points.select(F.col("rep").alias("id"), *names), names, whole)
    classes = linked_classes(links).select(F.col("node").alias("rep"), "class")
    named = points.join(classes, "rep", "left").withColumn("near_id", F.coalesce("class", "rep"))
    same = reduce(lambda a, b: a & b, [F.col(f"l.{n}") == F.col(f"r.{n}") for n in names])
    return values.alias("l").join(named.alias("r"), same).select(F.col("l.id").alias(key), "r.near_id", "r.copies")
