"""Margins of tree ensembles (M3, F13): trees as flat arrays, walked level by level for whole batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.schemas import FEATURES, LABELS, quoted

ROWS_AT_ONCE = 4_096


@dataclass(frozen=True)
class Tree:
    """One tree of one class; node 0 is the root.

    A node with ``feature`` -1 is a leaf and holds ``value``.  Others send a row to ``left`` if the feature is
    below ``threshold``, to ``right`` if not, and a missing value to the left if ``missing_left``.
    """

    label: int
    feature: Sequence[int]
    threshold: Sequence[float]
    left: Sequence[int]
    right: Sequence[int]
    missing_left: Sequence[bool]
    value: Sequence[float]


class Forest:
    """All nodes of all trees in flat arrays."""

    def __init__(self, trees: Sequence[Tree], classes: int):
        first = np.cumsum([0] + [len(t.feature) for t in trees])
        self.root = first[:-1]
        self.feature = np.concatenate([np.asarray(t.feature, np.int64) for t in trees]) if trees else np.empty(0, np.int64)
        self.threshold = np.concatenate([np.asarray(t.threshold, float) for t in trees]) if trees else np.empty(0)
        self.left = np.concatenate([np.asarray(t.left, np.int64) + f for t, f in zip(trees, first[:-1], strict=True)]) if trees else np.empty(0, np.int64)
        self.right = np.concatenate([np.asarray(t.right, np.int64) + f for t, f in zip(trees, first[:-1], strict=True)]) if trees else np.empty(0, np.int64)
        self.missing_left = np.concatenate([np.asarray(t.missing_left, bool) for t in trees]) if trees else np.empty(0, bool)
        self.value = np.concatenate([np.asarray(t.value, float) for t in trees]) if trees else np.empty(0)
        self.member = np.zeros((len(trees), classes))
        self.member[np.arange(len(trees)), [t.label for t in trees]] = 1

    def margins(self, rows: np.ndarray) -> np.ndarray:
        """(row, class): the leaves that a row reaches, summed per class."""
        node = np.broadcast_to(self.root, (len(rows), len(self.root))).copy()
        while True:
            feature = self.feature[node]
            walking = feature >= 0
            if not walking.any():
                return self.value[node] @ self.member
            value = np.take_along_axis(rows, np.maximum(feature, 0), axis=1)
            to_left = np.where(np.isnan(value), self.missing_left[node], value < self.threshold[node])
            node = np.where(walking, np.where(to_left, self.left[node], self.right[node]), node)


@dataclass(frozen=True)
class TreeScorer:
    """Softmax over the margins of an ensemble; a scorer like the others.

    Null and NaN features are missing values.  ``prefix`` names the scaled columns when they sit next to the raw
    ones, ``base`` is added to every margin of its class.
    """

    trees: Sequence[Tree]
    base: Sequence[float] = (0.0,) * len(LABELS)
    prefix: str = ""

    def __call__(self, scaled: DataFrame) -> DataFrame:
        names = [quoted(self.prefix + name) for name in FEATURES]
        trees, base = self.trees, np.asarray(self.base, float)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forest = Forest(trees, len(base))
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                    part = batch.slice(at, ROWS_AT_ONCE)
                    inputs = part.column(part.num_columns - 1)
                    rows = inputs.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names))
                    margins = forest.margins(rows.astype(float)) + base
                    powers = np.exp(margins - margins.max(axis=1, keepdims=True))
                    probs = powers / powers.sum(axis=1, keepdims=True)
                    offsets = pa.array(np.arange(len(probs) + 1, dtype=np.int32) * len(base))
                    column = pa.ListArray.from_arrays(offsets, pa.array(probs.ravel()))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], column], names=[*part.schema.names[:-1], "probs"])

        missing = F.lit(float("nan"))
        inputs = F.array(*[F.coalesce(F.col(n).cast("double"), missing) for n in names]).alias("probs")
        schema = T.StructType([*scaled.schema.fields, T.StructField("probs", T.ArrayType(T.DoubleType()))])
        return scaled.select("*", inputs).mapInArrow(run, schema)
