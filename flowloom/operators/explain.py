"""Explanations for the first anomalies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.text import example_text, explanation, prompt_text, query_string, without_prompt
from flowloom.operators.retrieval import neighbour_vote, normalised, top_k
from flowloom.operators.scoring import first_anomalies
from flowloom.schemas import FEATURES, FIRST_ANOMALIES, TOP_K, quoted
from flowloom.session import materialise

Z = "z_{}"


def feature_vector(space: str = "raw") -> Column:
    """The 18 features as an array, unscaled or scaled (``z_`` columns)."""
    if space not in ("raw", "scaled"):
        raise ValueError(f"unknown space: {space!r}")
    names = FEATURES if space == "raw" else [Z.format(f) for f in FEATURES]
    return F.expr("array({})".format(", ".join(f"CAST({quoted(n)} AS DOUBLE)" for n in names)))


def flow_vectors(labelled: DataFrame, space: str = "raw") -> DataFrame:
    """Unit feature vectors: ``(doc_pos, embedding)``."""
    return normalised(
        labelled.select(F.col("flow_id").alias("doc_pos"), feature_vector(space).alias("embedding"))
    )


def leading_features(n: int = 3) -> Column:
    """Names of the features furthest from the training mean, largest first."""
    entries = ", ".join(
        f"struct(-round(abs({quoted(Z.format(name))}), 6) AS far, {i} AS position, '{name}' AS name)"
        for i, name in enumerate(FEATURES)
    )
    return F.expr(f"transform(slice(array_sort(array({entries})), 1, {n}), e -> e.name)")


def prompts(queries: DataFrame, documents: DataFrame, detailed: bool = True) -> DataFrame:
    """One prompt per query from its retrieved documents, in rank order; none without documents.

    A query has at most k documents, so the collected list is bounded by k.
    """
    examples = documents.groupBy("query_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct("rank", example_text(F.col("rank"), F.col("input"), F.col("output")).alias("text"))
            )
        ).alias("examples")
    )
    return (
        queries.join(examples, "query_id", "left")
        .withColumn("documents", F.coalesce(F.size("examples"), F.lit(0)))
        .withColumn("context", F.concat_ws("\n", F.transform("examples", lambda e: e["text"])))
        .withColumn(
            "prompt",
            F.when(F.col("documents") > 0, prompt_text(F.col("input"), F.col("context"), detailed)),
        )
        .select("query_id", "documents", "prompt")
    )


def generate(prompt_rows: DataFrame, load: Callable[[], object], write: Callable[[object, str], str]) -> DataFrame:
    """Run a user's text generator over the ``prompt`` column, loading it once per task.

    Adds ``text`` (what follows the prompt, stripped) and ``failed``.
    """
    names = prompt_rows.columns
    fields = ", ".join(f"{n} {t}" for n, t in prompt_rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            texts, failed = [], []
            for prompt in batch["prompt"]:
                try:
                    texts.append(write(model, prompt))
                    failed.append(False)
                except Exception:
                    texts.append(None)
                    failed.append(True)
            yield batch.assign(generated=texts, failed=failed)

    out = prompt_rows.mapInPandas(run, f"{fields}, generated string, failed boolean")
    return out.select(
        *names, without_prompt(F.col("generated"), F.col("prompt")).alias("text"), "failed"
    )


def explain_anomalies(
    labelled: DataFrame,
    n: int = FIRST_ANOMALIES,
    k: int = TOP_K,
    space: str = "raw",
    order: tuple[str, ...] = ("first_us", "flow_id"),
    corpus: DataFrame | None = None,
    encoder: Callable[..., DataFrame] | None = None,
    generator: tuple[Callable[[], object], Callable[[object, str], str]] | None = None,
    detailed: bool = True,
) -> DataFrame:
    """Retrieved documents, vote, leading features and text for the first ``n`` anomalies.

    ``labelled`` has ``flow_id``, ``first_us``, the features, their ``z_`` columns and
    ``label``; give it stored, since it is read several times.  Without a ``corpus`` the
    flows themselves are searched by their feature vectors.  With one (``doc_pos``,
    ``embedding``, ``input``, ``output``) the query strings are encoded by ``encoder`` and its
    documents are searched.  ``generator`` (``load``, ``write``) writes the text from the
    prompt; without one the text names the neighbours' label and the leading features.
    The rank filter runs before retrieval, so only ``n`` vectors are searched.
    """
    # At most n rows, and below at most n * k: stored, so that everything after is a handful.
    facts = materialise(
        first_anomalies(labelled, list(order), n).select(
            F.col("flow_id").alias("query_id"),
            "label",
            query_string().alias("input"),
            leading_features().alias("leading"),
            feature_vector(space).alias("embedding"),
        )
    )
    if corpus is None:
        queries = normalised(facts.select("query_id", "embedding"))
        source = flow_vectors(labelled, space)
        texts = labelled.select(F.col("flow_id").alias("doc_pos"), query_string().alias("input"), F.col("label").alias("output"))
    else:
        if encoder is None:
            raise ValueError("a corpus needs the encoder of its vectors")
        queries = encoder(facts.select("query_id", "input"), "query_id", "input").select("query_id", "embedding")
        source, texts = corpus.select("doc_pos", "embedding"), corpus.select("doc_pos", "input", "output")
    hits = materialise(top_k(queries, source, k, skip_self=corpus is None))
    documents = materialise(
        texts.join(F.broadcast(hits), "doc_pos").select("query_id", "rank", "doc_pos", "score", "input", "output")
    )
    vote = neighbour_vote(documents.withColumn("output", F.coalesce("output", F.lit(""))))
    ids = documents.groupBy("query_id").agg(
        F.concat_ws(
            ",",
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_pos"))), lambda e: e["doc_pos"].cast("string")),
        ).alias("neighbours")
    )
    asked = prompts(facts.select("query_id", "input"), documents, detailed)
    if generator is None:
        written = asked.withColumn("text", F.lit(None).cast("string")).withColumn("failed", F.lit(False))
    else:
        # Only queries with documents have a prompt to write from.
        found = materialise(generate(asked.where(F.col("prompt").isNotNull()), *generator)).select("query_id", "text", "failed")
        written = asked.join(found, "query_id", "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
    built_in = F.concat(
        F.lit("Suggested label: "),
        F.col("suggested"),
        F.lit(" ("),
        F.col("votes").cast("string"),
        F.lit(" of "),
        F.col("documents").cast("string"),
        F.lit(" similar documents). Leading features: " if corpus is not None else " similar flows). Leading features: "),
        F.concat_ws(", ", "leading"),
    )
    text = built_in if generator is None else F.col("text")
    size = 0 if source.isEmpty() else 1
    return (
        facts.drop("input", "embedding")
        .join(written, "query_id")
        .join(vote, "query_id", "left")
        .join(ids, "query_id", "left")
        .withColumn("rag_output", explanation(F.lit(size), F.col("documents"), text, F.col("failed")))
        .withColumn("leading", F.concat_ws(",", "leading"))
        .drop("text", "failed")
    )
