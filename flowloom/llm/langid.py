"""Language ID (6): hierarchical discrimination.

A linear model predicts the language family first; within the family, one-versus-one linear
support vector machines tell the closely related languages apart by votes.  Features are
hashed three-byte grams of the whole text (A-Z folded), as shares of all its grams, so scoring
is one table lookup per byte and model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowloom.llm.linear import byte_grams, descend, gram_counts, gram_matrix, gram_sums
from flowloom.llm.words import _LOWER, Block, blocks

FEATURE_BITS = 12
SAMPLE_ROWS = 1_600  # labelled documents that the models are fitted on, about as many per language
LEAST_ROWS = 25  # of them per language, however many languages there are
UNKNOWN = "und"

# Related languages; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}

_LETTER = regex.compile(r"\p{L}")


def family_of(lang: str) -> str:
    code = lang.split("-")[0].lower()
    return next((name for name, codes in FAMILIES.items() if code in codes), lang)


def held_out(ident: Column) -> Column:
    """Whether a row is left out of training: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _has_letter(block: Block, texts: pa.Array) -> np.ndarray:
    lower = _LOWER[block.data]
    plain = np.concatenate([[0], np.cumsum((lower >= 97) & (lower <= 122))])
    found = plain[block.ends] > plain[block.starts]
    for i in np.flatnonzero(~found & (block.ends > block.starts)):
        found[i] = _LETTER.search(texts[int(block.rows[i])].as_py()) is not None
    return found


@dataclass
class LanguageModel:
    """Weights per feature: one column per family, then one per pair of related languages."""

    families: list[str]
    pairs: list[tuple[str, str]]
    members: dict[str, list[str]]
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Languages and scores of the rows of a block: families first, then the pairs of the chosen ones."""
        grams = byte_grams(block, FEATURE_BITS, lower=True)
        top = gram_sums(block, grams, self.weights[: len(self.families)]) + self.bias[: len(self.families)]
        share = np.exp(top - top.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        chosen = share.argmax(1)
        lang = np.empty(len(block.rows), object)
        score = share[np.arange(len(lang)), chosen]
        for f in np.unique(chosen):
            rows = np.flatnonzero(chosen == f)
            langs = self.members[self.families[f]]
            if len(langs) == 1:
                lang[rows] = langs[0]
                continue
            votes, sure = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs)))
            at = [p for p, (a, _) in enumerate(self.pairs) if a in langs]
            columns = len(self.families) + np.array(at)
            size = block.ends[rows] - block.starts[rows]
            ends = np.cumsum(size)
            part = Block(block.rows[rows], block.data, ends - size, ends)
            mine = np.concatenate([grams[a:b] for a, b in zip(block.starts[rows], block.ends[rows], strict=True)])
            margin = gram_sums(part, mine, self.weights[columns]) + self.bias[columns]
            for m, p in zip(margin.T, at, strict=True):
                i, j = (langs.index(x) for x in self.pairs[p])
                votes[:, i] += m >= 0
                votes[:, j] += m < 0
                sure[:, i] += m
                sure[:, j] -= m
            best = (votes + 1e-3 * np.tanh(sure)).argmax(1)
            lang[rows] = np.array(langs, object)[best]
            mean = sure[np.arange(len(rows)), best] / (len(langs) - 1)
            score[rows] *= 1 / (1 + np.exp(-np.clip(4 * mean, -30, 30)))
        return lang, score


def fit(rows: list, classes: list[str]) -> LanguageModel:
    """Fit both levels on rows of (lang, gram ids, gram counts)."""
    x, scale = gram_matrix(rows, FEATURE_BITS)
    lang = np.array([r["lang"] for r in rows], object)
    classes = [c for c in classes if (lang == c).any()]
    families = sorted({family_of(c) for c in classes})
    members = {f: sorted(c for c in classes if family_of(c) == f) for f in families}
    goal = np.array([[float(family_of(v) == f) for f in families] for v in lang])

    def softmax(m):
        p = np.exp(m - m.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True) - goal

    weights, bias = descend(x, softmax, len(families))
    columns, biases, pairs = [weights], [bias], []
    for f in families:
        for a, b in combinations(members[f], 2):
            mine = (lang == a) | (lang == b)
            sign = np.where(lang[mine] == a, 1.0, -1.0)[:, None]
            # Squared hinge loss.
            w, c = descend(x[mine], lambda m, s=sign: -s * np.maximum(0, 1 - s * m), 1)
            pairs.append((a, b))
            columns.append(w)
            biases.append(c)
    table = np.concatenate(columns, 1) * scale[:, None]
    return LanguageModel(families, pairs, members, np.ascontiguousarray(table.T.astype(np.float32)), np.concatenate(biases))


def train(docs: DataFrame, id_column: str, text_column: str, lang_column: str, sample_rows: int = SAMPLE_ROWS) -> LanguageModel | None:
    """Fit on a hash-chosen sample of labelled rows, balanced by language and bounded by their number."""
    rows = docs.select(F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang"), F.xxhash64(F.col(text_column).cast("string"), F.col(id_column).cast("string"), F.lit(7)).alias("draw"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("draw").alias("count")).orderBy("lang").collect()  # one row per language
    if not counts:
        return None
    each = max(sample_rows // len(counts), LEAST_ROWS)
    # Well more than ``each`` rows of a language come through, and its first ones are taken.
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, (2 * each + 50) / max(1, r["count"])))])
    pick = F.pmod("draw", F.lit(1 << 30)) / float(1 << 30) < F.element_at(share, F.col("lang"))
    first = Window.partitionBy("lang").orderBy(F.pmod("draw", F.lit(1 << 30)), "draw")
    rows = rows.where(pick).dropDuplicates(["lang", "draw"]).withColumn("n", F.row_number().over(first)).where(F.col("n") <= each)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0)):
                ids, counts = gram_counts(block, byte_grams(block, FEATURE_BITS, lower=True))
                lang = batch.column(1).take(pa.array(block.rows))
                yield pa.RecordBatch.from_arrays([lang, pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["lang", "ids", "counts"])

    sample = rows.select("text", "lang").mapInArrow(counted, "lang string, ids binary, counts binary").collect()
    sample = sorted(sample, key=lambda r: (r["lang"], r["ids"], r["counts"]))
    return fit(sample, [r["lang"] for r in counts]) if sample else None


def identify_languages(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    sample_rows: int = SAMPLE_ROWS,
    keep: list[str] | None = None,
) -> DataFrame:
    """Predict the language of every whole text.

    Learns every language that occurs in rows that are not held out (see ``held_out``).  At most
    ``sample_rows`` of them in equal parts are used, or ``LEAST_ROWS`` per language if that is
    more, first by a hash of text and id; rows equal in both count once.  Returns one row per input row: the id, ``held_out``,
    ``lang_pred`` and ``score`` (0 to 1).  A text that is null or has no letter is ``und`` with
    score 0, and so is every text when there is nothing to learn from.  A null id counts
    as the empty text.  Repeated rows get equal results.  A text of any length is judged whole, in
    blocks; a longer one is a block of its own.  An empty table gives no rows.  ``keep`` adds ``kept``, a struct of these columns
    of each row, so that nothing has to be joined to decide on rows.
    """
    ident = F.col(id_column)
    model = train(docs.where(~held_out(ident)), id_column, text_column, lang_column, sample_rows)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            lang, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            for block in blocks(texts) if model else ():
                found, sure = model.predict(block)
                letters = _has_letter(block, texts)
                lang[block.rows[letters]], score[block.rows[letters]] = found[letters], sure[letters]
            columns = [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score), *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score", "kept"][: len(columns)])

    rows = docs.select(
        ident.cast("long").alias("doc_id"),
        held_out(ident).alias("held_out"),
        F.col(text_column).cast("string").alias("text"),
        *([F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")] if keep else []),
    )
    schema = StructType.fromDDL("doc_id long, held_out boolean, lang_pred string, score double")
    if keep:
        schema = schema.add("kept", rows.schema["kept"].dataType)
    out = rows.mapInArrow(predicted, schema)
    return out.withColumnRenamed("doc_id", id_column)
