"""Texts built from rows: query strings, prompts, status messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.schemas import FEATURES, INTEGER_FEATURES, quoted

# --- fixed values -----------------------------------------------------------
# Message texts and prompt wording are an external contract.
NO_KNOWLEDGE = "[RAG] No knowledge available"
NO_DOCUMENTS = "[RAG] No relevant documents found"
EMPTY_OUTPUT = "[RAG] Model returned empty output"
FAILED = "[RAG ERROR]"

DETAILED_PROMPT = """
You are a network flow classifier. Use the following examples as context to classify the input flow.

Context examples:
{context}

Now classify the following input flow. Provide a detailed explanation:
- Compare the input with the context examples
- Explain which features influenced your decision
- Conclude with the final label ('normal' or 'anomaly') at the end

INPUT:
{query}
"""

CONCISE_PROMPT = """
You are a network flow classifier. Use the examples in context to classify the input.

Context examples:
{context}

INPUT:
{query}

Return ONLY the label ('normal' or 'anomaly') with no extra text.
"""
# ----------------------------------------------------------------------------


def query_string(decimals: int = 6) -> Column:
    """``name: value | name: value``; doubles carry a fixed number of decimals.

    What is not a finite number reads ``nan``, ``inf`` or ``-inf``.
    """
    parts = []
    for name in FEATURES:
        plain = "BIGINT" if name in INTEGER_FEATURES else f"DECIMAL(38,{decimals})"
        column = quoted(name)
        value = f"CAST({column} AS DOUBLE)" if name in INTEGER_FEATURES else f"round({column}, {decimals})"
        exact = column if name in INTEGER_FEATURES else value
        text = (
            f"CASE WHEN isnan({value}) THEN 'nan' WHEN {value} = double('inf') THEN 'inf' "
            f"WHEN {value} = double('-inf') THEN '-inf' "
            f"ELSE coalesce(CAST(try_cast({exact} AS {plain}) AS STRING), CAST({value} AS STRING), 'nan') END"
        )
        parts.append(f"concat('{name}: ', {text})")
    return F.expr(f"concat_ws(' | ', {', '.join(parts)})")


def example_text(position: Column, text: Column, label: Column) -> Column:
    """One numbered example of the prompt context."""
    return F.concat(
        F.lit("Example "),
        position.cast("string"),
        F.lit(":\nINPUT: "),
        text,
        F.lit("\nLABEL: "),
        F.coalesce(label, F.lit("")),
        F.lit("\n"),
    )


def prompt_text(query: Column, context: Column, detailed: bool = True) -> Column:
    """Fill the prompt with the joined examples and the query."""
    template = DETAILED_PROMPT if detailed else CONCISE_PROMPT
    head, rest = template.split("{context}")
    middle, tail = rest.split("{query}")
    return F.concat(F.lit(head), context, F.lit(middle), query, F.lit(tail))


def without_prompt(generated: Column, prompt: Column) -> Column:
    """A generator repeats its prompt; keep what follows, stripped."""
    rest = F.substring(generated, F.length(prompt) + 1, F.length(generated))
    return F.regexp_replace(rest, r"^\s+|\s+$", "")


def explanation(corpus_rows: Column, documents: Column, text: Column, failed: Column) -> Column:
    """The explanation, or the message that says why there is none (M9)."""
    return (
        F.when(failed, FAILED)
        .when(corpus_rows == 0, NO_KNOWLEDGE)
        .when(documents == 0, NO_DOCUMENTS)
        .when(~F.coalesce(text, F.lit("")).rlike(r"\S"), EMPTY_OUTPUT)
        .otherwise(text)
    )
