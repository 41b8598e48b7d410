"""Hashed byte-gram features and small linear models."""

from __future__ import annotations

import numpy as np

from flowloom.llm.words import _LOWER, Block


def byte_grams(block: Block, bits: int, lower: bool) -> np.ndarray:
    """The hashed three-byte gram that begins at each byte of a block."""
    data = _LOWER[block.data] if lower else block.data
    data = np.concatenate([data, [32, 32]]).astype(np.uint32)
    key = data[:-2] | (data[1:-1] << np.uint32(8)) | (data[2:] << np.uint32(16))
    return ((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int32)


def gram_counts(block: Block, grams: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Distinct grams of each row and how often each occurs, as packed bytes."""
    ids, counts = [], []
    for a, b in zip(block.starts, block.ends, strict=True):
        found, n = np.unique(grams[a:b], return_counts=True)
        ids.append(found.astype("<u2").tobytes())
        counts.append(n.astype("<u4").tobytes())
    return ids, counts


def gram_sums(block: Block, grams: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """For each row and weight table: the mean weight of the row's grams."""
    length = np.maximum(1, block.ends - block.starts)
    sums = np.empty((len(block.rows), len(tables)))
    for j, table in enumerate(tables):
        total = np.concatenate([[0.0], np.cumsum(table[grams], dtype=np.float64)])
        sums[:, j] = (total[block.ends] - total[block.starts]) / length
    return sums


def gram_matrix(rows: list, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram shares of sampled rows, scaled to like spread, and the scale of each column."""
    x = np.zeros((len(rows), 1 << bits), np.float32)
    for i, r in enumerate(rows):
        counts = np.frombuffer(r["counts"], "<u4").astype(np.float32)
        x[i, np.frombuffer(r["ids"], "<u2")] = counts / max(1.0, counts.sum())
    scale = 1 / np.sqrt(x.mean(0) + 1e-6)
    x *= scale
    more = np.float32(2 / np.sqrt(max(1e-12, float(np.einsum("ij,ij->", x, x)) / len(x))))
    x *= more
    return x, scale * more


def descend(x: np.ndarray, slope, columns: int, turns: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated full-batch descent on a smooth convex loss with a small ridge.

    ``slope`` gives the derivative of the loss of each row by its scores.
    """
    w, b = np.zeros((x.shape[1], columns), np.float32), np.zeros(columns, np.float32)
    ahead_w, ahead_b, step = w, b, np.float32(2.0 / (float(np.einsum("ij,ij->", x, x)) / len(x) + 1))
    for t in range(turns):
        g = (slope(x @ ahead_w + ahead_b) / len(x)).astype(np.float32)
        new_w, new_b = ahead_w - step * (x.T @ g + np.float32(1e-4) * ahead_w), ahead_b - step * g.sum(0)
        speed = np.float32(t / (t + 3))
        ahead_w, ahead_b = new_w + speed * (new_w - w), new_b + speed * (new_b - b)
        w, b = new_w, new_b
    return w, b
