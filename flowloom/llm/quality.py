"""Quality classifier (8): a weak-label model.

Overlapping heuristics vote good, bad or nothing on every document.  Expectation-maximisation
over the counts of vote patterns (at most 3 ** heuristics of them) estimates how often each
one is right on good and on bad documents, without any given label.  The posterior of a
document's pattern is its soft label, and soft labels train a linear scorer on hashed byte
grams, which then scores every document, also those on which no heuristic votes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.linear import byte_grams, descend, gram_counts, gram_matrix, gram_sums
from flowloom.llm.words import Block, blocks, mixed, words

FEATURE_BITS = 12
SAMPLE_ROWS = 2_400  # documents that the scorer is fitted on, about half of them likely bad

# Frequent short words of the languages at hand.
COMMON_WORDS = (
    "the of and to in is it for was that with as on by at this are be from or an "
    "der die das und zu von mit den ein eine nicht ist im für auf "
    "le la les des et un une que qui dans pour sur avec est "
    "el los las del y en que por con para una es no"
).split()

HEURISTICS = (
    "capitals",  # share of upper case among letters
    "symbols",  # share of bytes that are neither letters, digits, space nor plain punctuation
    "shouting",  # share of words that hold "!!" or end in three signs
    "separators",  # share of words that are a lone sign
    "repeats",  # share of words that repeat the one or two before them
    "variety",  # distinct words among the first occurrences expected at this length
    "lines",  # share of lines that occurred before in the text
    "common_words",  # share of frequent short words
    "word_length",  # mean word length
    "length",  # number of words
)


def _sums(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[first])


def _repeated(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many entries of each row occurred before in it."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((value, row))
    again = (value[order][1:] == value[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row[order][1:][again], minlength=len(first) - 1)


def _common_hashes() -> np.ndarray:
    block = next(blocks(pa.array([" ".join(COMMON_WORDS)])))
    return np.unique(words(block).hash)


def votes(block: Block) -> np.ndarray:
    """One row per document: 1 good, 0 bad, -1 no vote, in the order of HEURISTICS."""
    data, n = block.data, len(block.rows)
    edges = np.append(block.starts, len(data))
    w = words(block, lower=True)
    count = np.diff(w.first)
    some = np.maximum(1, count)
    high = data >= 128
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    digit, space = (data >= 48) & (data <= 57), (data == 32) | ((data >= 9) & (data <= 13))
    plain = np.isin(data, np.frombuffer(b".,;:?!'\"()-", np.uint8))
    letter = upper | lower | high
    odd = ~(letter | digit | space | plain)
    size = np.maximum(1, _sums(np.ones(len(data), np.int64), edges))
    capitals = _sums(upper, edges) / np.maximum(1, _sums(upper | lower, edges))
    symbols = _sums(odd, edges) / size
    sign = ~(letter | digit | space)
    three = np.zeros(len(data), bool)
    if len(data) > 2:
        three[2:] = sign[2:] & sign[1:-1] & sign[:-2]
    bang = np.zeros(len(data), bool)
    if len(data) > 1:
        bang[1:] = (data[1:] == 33) & (data[:-1] == 33)
    ends = np.zeros(len(data), bool)
    if len(data):
        ends[:-1] = space[1:]
        ends[block.ends[block.ends > block.starts] - 1] = True
    shouting = _sums((three | bang) & ends, edges) / some
    alone = sign & ends
    if len(data):
        before = np.ones(len(data), bool)
        before[1:] = space[:-1]
        before[block.starts[block.ends > block.starts]] = True
        alone &= before
    separators = _sums(alone, edges) / some
    row, h = w.row, w.hash
    echo = np.zeros(len(h), bool)
    echo[1:] |= (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    echo[2:] |= (h[2:] == h[:-2]) & (row[2:] == row[:-2])
    repeats = _sums(echo, w.first) / some
    variety = 1 - _repeated(h, w.first) / some
    # Lines: blocks of their own, with the line's words as one gram sum.
    cut = np.flatnonzero(data == 10) + 1
    starts = np.unique(np.concatenate([block.starts[block.ends > block.starts], cut[cut < len(data)]]))
    inner = Block(starts, data, starts, np.append(starts[1:], len(data))[: len(starts)])
    lw = words(inner, lower=True)
    place = np.arange(len(lw.hash)) - np.repeat(lw.first[:-1], np.diff(lw.first))
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(lw.hash + place.astype(np.uint64)), dtype=np.uint64)])
    line = np.diff(total[lw.first])
    line_first = np.searchsorted(starts, edges)
    lines = _repeated(line, line_first) / np.maximum(1, np.diff(line_first))
    common = _sums(np.isin(h, _common_hashes()), w.first) / some
    length = _sums(~space, edges) / some
    enough = count >= 20

    def vote(bad, good, where=True):
        return np.where(where, np.where(bad, 0, np.where(good, 1, -1)), -1)

    out = np.stack(
        [
            vote(capitals > 0.5, capitals < 0.2, enough),
            vote(symbols > 0.03, symbols < 0.002, enough),
            vote(shouting > 0.1, shouting < 0.01, enough),
            vote(separators > 0.2, separators < 0.02, enough),
            vote(repeats > 0.2, repeats < 0.03, enough),
            vote(variety < 0.15, variety > 0.35, enough & (count < 3_000)),
            vote(lines > 0.3, lines < 0.02, np.diff(line_first) >= 4),
            vote(common < 0.03, common > 0.1, enough),
            vote((length > 12) | (length < 2.5), (length > 3.5) & (length < 9), enough),
            vote(count < 3, np.zeros(n, bool)),
        ],
        1,
    )
    return out.astype(np.int8)


def estimate(patterns: np.ndarray, counts: np.ndarray, turns: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """EM: the posterior of being good for each vote pattern, P(vote | class), and the share of good.

    Votes are taken as independent given the class; abstaining says nothing.  At the start a
    pattern with a vote for bad is likely bad: most heuristics know one kind of bad text only,
    and miss the others.
    """
    one_hot = np.stack([patterns == v for v in (0, 1)], 2).astype(float)
    post = np.where((patterns == 0).any(1), 0.1, np.where((patterns == 1).any(1), 0.95, 0.5))
    for _ in range(turns):
        weight = np.stack([counts * (1 - post), counts * post])
        seen = np.einsum("cp,pjv->cjv", weight, one_hot) + 1.0
        rates = seen / seen.sum(2, keepdims=True)
        good = float(np.clip(weight[1].sum() / counts.sum(), 0.01, 0.99))
        score = np.einsum("pjv,cjv->pc", one_hot, np.log(rates)) + np.log([1 - good, good])
        new = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -50, 50)))
        if np.abs(new - post).max() < 1e-7:
            break
        post = new
    return new, rates, good


def _vote_column(block: Block) -> np.ndarray:
    code = votes(block).astype(np.int64) + 1
    return code @ (3 ** np.arange(code.shape[1]))


def quality_scores(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """Score every whole text for quality, from weak labels alone.

    Returns one row per input row: id, ``weak_label`` (the posterior of its votes), ``score`` (of
    the linear scorer, 0 to 1) and ``good`` (score >= 0.5).  A text that is null or has no word
    scores 0.  At most ``sample_rows`` documents, half of them of each class and first by a hash of
    text and id, fit the scorer (rows equal in both count once); votes and their counts cover all documents.  Repeated rows get equal results; an empty table gives
    no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0)):
                pattern, n = np.unique(_vote_column(block), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(n)], names=["pattern", "n"])

    # One row per vote pattern, whatever the number of documents.
    found = rows.select("text").mapInArrow(voted, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    schema = "id long, weak_label double, score double, good boolean"
    if not found:
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_column)
    pattern, n = np.array([r["pattern"] for r in found]), np.array([r["n"] for r in found], float)
    digits = pattern[:, None] // 3 ** np.arange(len(HEURISTICS)) % 3 - 1
    post, _, good = estimate(digits, n)

    def weak(block: Block) -> np.ndarray:
        return post[np.searchsorted(pattern, _vote_column(block))]

    share = {c: min(1.0, (sample_rows + 50) / max(1.0, float(n[(post >= 0.5) == c].sum()))) for c in (False, True)}

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0)):
                label = weak(block)
                draw = batch.column(1).take(pa.array(block.rows)).to_numpy()
                pick = np.flatnonzero((draw < np.where(label >= 0.5, share[True], share[False])) & (block.ends > block.starts))
                part = Block(block.rows[pick], block.data, block.starts[pick], block.ends[pick])
                ids, counts = gram_counts(part, byte_grams(block, FEATURE_BITS, lower=False))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(label[pick]), pa.array(draw[pick]), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())],
                    names=["label", "draw", "ids", "counts"],
                )

    draw = (F.pmod(F.xxhash64("text", "id", F.lit(13)), F.lit(1 << 50)) / float(1 << 50)).alias("draw")
    # About twice as many of each class come through as are wanted, and the first ones are taken.
    first = Window.partitionBy(F.col("label") >= 0.5).orderBy("draw")
    sample = rows.select("text", draw).mapInArrow(sampled, "label double, draw double, ids binary, counts binary")
    sample = sample.dropDuplicates(["draw"]).withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample_rows // 2)
    sample = sample.select("label", "ids", "counts").collect()
    sample = sorted(sample, key=lambda r: (r["label"], r["ids"], r["counts"]))
    weights, bias = np.zeros((1, 1 << FEATURE_BITS), np.float32), np.array([np.log(good / (1 - good))])
    if sample:
        x, scale = gram_matrix(sample, FEATURE_BITS)
        goal = np.array([[r["label"]] for r in sample])
        # The sample has as many bad as good documents; the scorer's 0.5 lies between them.
        w, bias = descend(x, lambda m: 1 / (1 + np.exp(-m)) - goal, 1)
        weights = np.ascontiguousarray((w * scale[:, None]).T.astype(np.float32))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, score = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for block in blocks(batch.column(1)):
                margin = gram_sums(block, byte_grams(block, FEATURE_BITS, lower=False), weights)[:, 0] + bias[0]
                has_word = np.diff(words(block).first) > 0
                label[block.rows] = weak(block)
                score[block.rows] = np.where(has_word, 1 / (1 + np.exp(-np.clip(margin, -50, 50))), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label), pa.array(score), pa.array(score >= 0.5)], names=["id", "weak_label", "score", "good"])

    return rows.mapInArrow(scored, schema).withColumnRenamed("id", id_column)
