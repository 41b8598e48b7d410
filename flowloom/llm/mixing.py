"""Mixing sources to target weights (9), with DataFrame functions only.

Every document gets a hash-random key.  Within its source, documents are range-sorted by the
key, prefix sums of their sizes are formed slice by slice, and the source's budget is cut off
at the exact word; budgets above the source's size take whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import WORD, numbered, prefix_sums, row_key, stored

WEIGHTS = (3, 1, 2)
KEY_BITS = 52


def random_key(ident: Column, seed: str) -> Column:
    """A number in [0, 1) from the leading digits of an MD5 hash."""
    text = F.concat(F.coalesce(ident.cast("string"), F.lit("null")), F.lit(":" + seed))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long") / F.lit(2.0**KEY_BITS)


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Add ``target``: ``share`` of all sizes by weight, at most ``most`` times a source's size.

    ``sources`` has one row per (source, source_size).  What a source cannot take is shared
    again by weight among those below their limit, until no target is above it: each turn is
    one aggregation with one row of result.
    """
    order = [F.col("source").asc_nulls_last()]
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = stored(
        numbered(sources, order, "_rank").select(
            "source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("_limit")
        ),
        "mix-sources",
    )
    level = 0.0
    while True:
        fixed = F.col("_limit") < level * F.col("weight")
        rest = ranked.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(fixed, F.col("_limit"))).alias("taken"),
            F.sum(F.when(~fixed, F.col("weight"))).alias("open"),
        ).first()
        if not rest["open"] or not rest["all"]:
            break
        new = (share * rest["all"] - (rest["taken"] or 0.0)) / rest["open"]
        if new <= level:
            break
        level = new
    return ranked.select("source", "source_size", F.least("_limit", F.col("weight") * F.lit(level)).alias("target"))


def _plan(
    docs: DataFrame,
    key: str,
    text_column: str,
    source_column: str,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """(row, source, size, source_size, target, taken); ``key`` tells the rows of ``docs`` apart."""
    rows = stored(
        docs.select(
            F.col(key).alias("row"),
            F.col(source_column).alias("source"),
            F.coalesce(F.regexp_count(text_column, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            random_key(F.col(key), seed).alias("_key"),
        ),
        "mix-rows",
    )
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sources, weights, share, most), "mix-targets")
    ahead = prefix_sums(rows, ["source"], "_key", ["row"], "size", "_ahead")
    joined = ahead.alias("l").join(targets.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source")))
    budget = F.floor(F.col("r.target") + 0.5)
    epochs = F.when(F.col("r.source_size") > 0, F.floor(budget / F.col("r.source_size"))).otherwise(0)
    rest = budget - epochs * F.col("r.source_size") - F.col("l._ahead")
    taken = epochs * F.col("l.size") + F.greatest(F.lit(0), F.least(F.col("l.size"), rest))
    return joined.select(
        "l.row", "l.source", "l.size", "r.source_size", "r.target", taken.cast("long").alias("taken")
    )


def mix_plan(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options
) -> DataFrame:
    """How many words of each document the mix takes.

    A document's size is its number of words; null and empty texts have 0 and are never taken.
    Sources come in code point order, null last and a source of its own; their weights repeat.
    Returns one row per input row: id, source, size, source_size, target (its source's) and
    ``taken``: whole epochs times the size, plus what the last, partial epoch takes of the
    document.  The taken words of a source are its target, rounded to a word; at most one
    document per source is cut.  If ids are null or repeat, every row gets a key of its own, its number
    in the order of (id, text hash); equal rows are interchangeable.  The result depends on
    the rows and ``seed`` alone.  An empty table gives no rows.  ``options``: weights, share, most, seed.
    """
    rows, key = row_key(docs.select(id_column, text_column, source_column), id_column, text_column)
    plan = _plan(rows, key, text_column, source_column, **options)
    if key == id_column:
        return plan.withColumnRenamed("row", id_column)
    ids = rows.select(F.col(key).alias("row"), F.col(id_column).alias("_id"))
    return plan.join(ids, "row").select(F.col("_id").alias(id_column), *plan.columns[1:])


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as ``mix_plan`` takes them.

    The document on which a source's budget ends contributes its first words only, joined by
    blanks.  Documents that are not taken are left out; all columns stay, whatever their names.
    Rows with null or repeated ids are taken each on their own.  An empty table gives no rows.
    """
    rows, key = row_key(docs, id_column, text_column)
    plan = _plan(rows, key, text_column, source_column, **options).where("taken > 0").select("row", "size", "taken")
    whole = rows.select(F.col(key).alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    epochs = F.ceil(F.col("taken") / F.col("size")).cast("int")
    taken = whole.join(plan, "row").select("doc", "size", "taken", F.explode(F.sequence(F.lit(1), epochs)).alias("epoch"))
    words = F.least("size", F.col("taken") - (F.col("epoch") - 1) * F.col("size")).cast("int")
    text = F.col("doc")[text_column]
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), words), " ")
    text = F.when(words < F.col("size"), cut).otherwise(text)
    return taken.select(*[(text if c == text_column else F.col("doc")[c]).alias(c) for c in docs.columns])
