"""Quotation linking (5), with DataFrame functions only.

Quoted lines of a message (``>`` markers, nested to any depth) are normalised and hashed, and
joined to the first message of the same scope that wrote the line itself.  The message that
most of the shallowest quoted lines come from is the parent; following parents gives the
conversation and the depth of each reply, and the text without quotes is what it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import stored

_MARKS = r"^(?:[ \t]*>)+"


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")


def quote_level(line: Column) -> Column:
    """How many quote marks a line begins with."""
    marks = F.regexp_extract(line, _MARKS, 0)
    return F.length(F.regexp_replace(marks, "[^>]", ""))


def normalised(line: Column) -> Column:
    """A line without quote marks, in lower case, with single blanks."""
    body = F.regexp_replace(line, _MARKS, "")
    return F.lower(F.trim(F.regexp_replace(body, r"[\x09-\x0D\x20]+", " ")))


def without_quotes(text: Column) -> Column:
    """The lines that carry no quote mark."""
    return F.array_join(F.filter(_lines(text), lambda x: ~x.rlike(_MARKS)), "\n")


def link_quotations(
    messages: DataFrame, scope_column: str = "conv_id", order_column: str = "turn", text_column: str = "text"
) -> DataFrame:
    """Find what each message replies to, and rebuild conversations without quotes.

    A quoted line can only come from a message of the same ``scope`` that is smaller in
    ``order``; of several that wrote it, from the first.  Returns one row per input row: scope,
    order, ``levels`` (deepest quote), ``quoted`` and ``linked`` (non-blank quoted lines, and
    those whose origin was found), ``parent`` (order of the message it replies to, null if
    none: the origin of most lines of the shallowest level that has any; of several, the
    latest), ``root`` (order of the first message of its conversation), ``depth`` (replies
    between the two) and ``clean_text``.  (scope, root) is the conversation; (depth, order) is
    its reply order.  A null text is an empty message.  A null scope is a scope of its own.  A message with a
    null order neither quotes nor is quoted and is its own root.  Rows with equal scope and
    order count as one message written in several rows and share parent, root and depth.  Long texts
    are taken whole.  Other columns are not read.  An empty table gives no rows.
    """
    rows = stored(
        messages.select(
            F.col(scope_column).alias("scope"), F.col(order_column).alias("ord"), F.col(text_column).cast("string").alias("text")
        ),
        "messages",
    )
    lines = rows.where("ord is not null").select("scope", "ord", F.explode(_lines(F.col("text"))).alias("line"))
    lines = lines.select("scope", "ord", quote_level(F.col("line")).alias("level"), normalised(F.col("line")).alias("norm"))
    lines = lines.where("norm <> ''").select("scope", "ord", "level", F.xxhash64("norm").alias("h1"), F.hash("norm").alias("h2"))
    # Equal lines of a scope meet in one row before any join, so a very common line is one row.
    origins = lines.where("level = 0").groupBy("scope", "h1", "h2").agg(F.min("ord").alias("origin"))
    quoted = lines.where("level > 0").groupBy("scope", "ord", "level", "h1", "h2").agg(F.count("*").alias("n"))
    same = (
        F.col("q.scope").eqNullSafe(F.col("o.scope"))
        & (F.col("q.h1") == F.col("o.h1"))
        & (F.col("q.h2") == F.col("o.h2"))
        & (F.col("o.origin") < F.col("q.ord"))
    )
    found = quoted.alias("q").join(origins.alias("o"), same, "left").select("q.scope", "q.ord", "q.level", "q.n", "o.origin")
    per_origin = found.groupBy("scope", "ord", "level", "origin").agg(F.sum("n").alias("n"))
    best = F.struct((-F.col("level")).alias("level"), F.col("n"), F.col("origin"))
    parents = per_origin.groupBy("scope", "ord").agg(
        F.max("level").alias("levels"),
        F.sum("n").alias("quoted"),
        F.sum(F.when(F.col("origin").isNotNull(), F.col("n"))).alias("linked"),
        F.max(F.when(F.col("origin").isNotNull(), best)).alias("best"),
    )
    parents = stored(parents.select("scope", "ord", "levels", "quoted", "linked", F.col("best.origin").alias("parent")), "parents")
    # Doubling: each turn replaces a message's ancestor by that ancestor's ancestor.
    jumps = parents.where("parent is not null").select("scope", "ord", F.col("parent").alias("root"), F.lit(1).alias("depth"))
    while True:
        up = jumps.alias("a").join(
            jumps.alias("b"), F.col("a.scope").eqNullSafe(F.col("b.scope")) & (F.col("a.root") == F.col("b.ord")), "left"
        )
        jumps = stored(
            up.select(
                "a.scope",
                "a.ord",
                F.coalesce("b.root", "a.root").alias("root"),
                (F.col("a.depth") + F.coalesce("b.depth", F.lit(0))).alias("depth"),
                F.col("b.root").isNotNull().alias("moved"),
            ),
            "ancestors",
        )
        if jumps.where("moved").isEmpty():
            break
        jumps = jumps.drop("moved")
    at = lambda t: F.col("m.scope").eqNullSafe(F.col(f"{t}.scope")) & (F.col("m.ord") == F.col(f"{t}.ord"))
    out = rows.alias("m").join(parents.alias("p"), at("p"), "left").join(jumps.alias("j"), at("j"), "left")
    return out.select(
        F.col("m.scope").alias(scope_column),
        F.col("m.ord").alias(order_column),
        F.coalesce("p.levels", F.lit(0)).cast("int").alias("levels"),
        F.coalesce("p.quoted", F.lit(0)).cast("long").alias("quoted"),
        F.coalesce("p.linked", F.lit(0)).cast("long").alias("linked"),
        F.col("p.parent").alias("parent"),
        F.coalesce("j.root", "m.ord").alias("root"),
        F.coalesce("j.depth", F.lit(0)).cast("int").alias("depth"),
        without_quotes(F.col("m.text")).alias("clean_text"),
    )


def quoted_mail(conversations: DataFrame) -> DataFrame:
    """Conversation turns as mail: each turn quotes the two before it, the older one twice as deep.

    The tables at hand hold plain turns; this gives the operator messages with nested quotes
    that come from the data.  Returns (conv_id, turn, text), one row per input row.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    quoted = lambda c, mark: F.array_join(F.transform(_lines(c), lambda x: F.concat(F.lit(mark), x)), "\n")
    last = conversations.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    at = lambda t, back: (F.col("m.conv_id") == F.col(f"{t}.conv_id")) & (F.col("m.turn") == F.col(f"{t}.turn") + back)
    rows = turns.alias("m").join(last.alias("p"), at("p", 1), "left").join(last.alias("g"), at("g", 2), "left")
    parts = [
        F.when(F.col("g.text").isNotNull(), quoted(F.col("g.text"), "> > ")),
        F.when(F.col("p.text").isNotNull(), quoted(F.col("p.text"), "> ")),
        F.col("m.text"),
    ]
    return rows.select("m.conv_id", "m.turn", F.concat_ws("\n", *parts).alias("text"))
