import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowloom.functions.text import (
    EMPTY_OUTPUT,
    FAILED,
    NO_DOCUMENTS,
    NO_KNOWLEDGE,
    explanation,
    query_string,
    without_prompt,
)
from flowloom.functions.vectors import inner_product
from flowloom.operators import retrieval
from flowloom.operators.explain import explain_anomalies, generate, prompts
from flowloom.operators.retrieval import (
    class_centroids,
    encode_corpus,
    fit_corpus_encoder,
    neighbour_vote,
    normalised,
    top_k,
    with_documents,
)
from flowloom.schemas import FEATURES


def unit_vectors(n, dim, seed):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, name, vectors, parts=3):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>").repartition(parts)


def brute(queries, corpus, k, skip_self=False):
    scores = np.rint((np.float32(queries).astype(float) @ np.float32(corpus).astype(float).T) * 1e6)
    want = set()
    for q in range(len(queries)):
        ids = [d for d in range(len(corpus)) if not (skip_self and d == q)]
        ids.sort(key=lambda d: (-scores[q, d], d))
        want |= {(q, r, d) for r, d in enumerate(ids[:k], 1)}
    return want


def found(hits):
    return {(r["query_id"], r["rank"], r["doc_pos"]) for r in hits.collect()}


@pytest.mark.parametrize("block_bytes", [1 << 20, 8 * 12 * 9])
@pytest.mark.parametrize("skip_self", [False, True])
def test_top_k_equals_brute_force(spark, skip_self, block_bytes):
    """The small block size takes the path for query sets too large to ship whole."""
    queries, corpus = unit_vectors(37, 12, 1), unit_vectors(211, 12, 2)
    corpus[:37] = queries  # so that every query meets itself
    got = top_k(frame(spark, "query_id", queries), frame(spark, "doc_pos", corpus, 5), 5, skip_self, block_bytes)
    assert found(got) == brute(queries, corpus, 5, skip_self)


def test_equal_scores_rank_by_position(spark):
    corpus = np.tile(unit_vectors(1, 4, 3), (50, 1))
    got = top_k(frame(spark, "query_id", corpus[:1]), frame(spark, "doc_pos", corpus, 7))
    assert found(got) == {(0, r, r - 1) for r in range(1, 6)}


def test_small_and_empty_corpus_give_fewer_hits(spark):
    v = unit_vectors(3, 4, 4)
    queries = frame(spark, "query_id", v[:1])
    assert top_k(queries, frame(spark, "doc_pos", v)).count() == 3
    assert top_k(queries, frame(spark, "doc_pos", v).limit(0)).count() == 0
    assert top_k(queries.limit(0), frame(spark, "doc_pos", v)).count() == 0


def test_search_has_no_join(spark):
    v = unit_vectors(9, 4, 5)
    hits = top_k(frame(spark, "query_id", v), frame(spark, "doc_pos", v))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan
    assert "WindowGroupLimit" in plan


def test_queries_stay_off_the_driver(spark, monkeypatch):
    """The plan has one scan of the corpus however many blocks of queries there are."""
    v = unit_vectors(200, 8, 6)
    queries, corpus = frame(spark, "query_id", v), frame(spark, "doc_pos", v)
    monkeypatch.setattr(type(queries), "toArrow", None)
    hits = top_k(queries, corpus, 3, True, block_bytes=8 * 8 * 10)
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert found(hits) == brute(v, v, 3, True)


def test_shards_of_the_corpus(spark, monkeypatch):
    monkeypatch.setattr("flowloom.operators.retrieval.SHARD_BYTES", 1)
    v = unit_vectors(60, 8, 7)
    got = top_k(frame(spark, "query_id", v), frame(spark, "doc_pos", v, 2), 4, block_bytes=8 * 8 * 10)
    assert found(got) == brute(v, v, 4)


def test_normalise_keeps_zero_vectors(spark):
    df = normalised(spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "embedding array<double>"))
    assert [r[0] for r in df.collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_inner_product(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<float>, b array<float>")
    assert df.select(inner_product(F.col("a"), F.col("b"))).first()[0] == 11.0


def test_class_centroids(spark):
    rows = [([1.0, 0.0], 1), ([0.0, 1.0], 1), ([0.0, -2.0], 2)]
    got = class_centroids(spark.createDataFrame(rows, "embedding array<float>, label int"))
    got = {r["query_id"]: r["embedding"] for r in got.collect()}
    assert got[1] == pytest.approx([0.5**0.5, 0.5**0.5])
    assert got[2] == [0.0, -1.0]


HITS = [(1, 1, 10, 0.9), (1, 2, 11, 0.8), (1, 3, 99, 0.7), (2, 1, 12, 0.6)]
DOCS = [(10, "a", "dos"), (11, "b", None), (12, "c", "worms"), (13, "d", "dos")]


def documents(spark):
    hits = spark.createDataFrame(HITS, "query_id long, rank int, doc_pos long, score double")
    docs = spark.createDataFrame(DOCS, "doc_pos long, input string, output string")
    return with_documents(hits, docs)


def test_hits_without_a_document_vanish_and_labels_default_to_empty(spark):
    got = {(r["query_id"], r["doc_pos"], r["output"]) for r in documents(spark).collect()}
    assert got == {(1, 10, "dos"), (1, 11, ""), (2, 12, "worms")}


def test_vote_prefers_the_smaller_label_on_a_tie(spark):
    got = {r["query_id"]: (r["suggested"], r["votes"]) for r in neighbour_vote(documents(spark)).collect()}
    assert got == {1: ("", 1), 2: ("worms", 1)}


def test_prompts_list_the_examples_in_rank_order(spark):
    asked = spark.createDataFrame([(1, "Q1"), (3, "Q3")], "query_id long, input string")
    got = {r["query_id"]: r for r in prompts(asked, documents(spark), detailed=True).collect()}
    assert "Example 1:\nINPUT: a\nLABEL: dos\n\nExample 2:\nINPUT: b\nLABEL: \n" in got[1]["prompt"]
    assert got[1]["prompt"].startswith("\nYou are a network flow classifier. Use the following")
    assert got[1]["prompt"].endswith("INPUT:\nQ1\n")
    assert (got[1]["documents"], got[3]["documents"]) == (2, 0)
    assert got[3]["prompt"] is None
    concise = prompts(asked, documents(spark), detailed=False).where("query_id = 1").first()["prompt"]
    assert concise.endswith("INPUT:\nQ1\n\nReturn ONLY the label ('normal' or 'anomaly') with no extra text.\n")


def test_generated_text_loses_its_prompt(spark):
    rows = spark.createDataFrame([(1, "say hi:"), (2, "fail"), (3, "blank")], "query_id long, prompt string")

    def write(model, prompt):
        if prompt == "fail":
            raise RuntimeError
        return prompt + ("  \n" if prompt == "blank" else f" {model} \n")

    out = {r["query_id"]: r for r in generate(rows, lambda: "hello", write).collect()}
    assert (out[1]["text"], out[1]["failed"]) == ("hello", False)
    assert (out[2]["text"], out[2]["failed"]) == (None, True)
    assert out[3]["text"] == ""


def test_status_messages(spark):
    rows = [(0, 0, "x", False), (5, 0, "x", False), (5, 2, " \n", False), (5, 2, "x", True), (5, 2, "ok", False)]
    df = spark.createDataFrame(rows, "c int, d int, t string, f boolean")
    got = [r[0] for r in df.select(explanation(F.col("c"), F.col("d"), F.col("t"), F.col("f"))).collect()]
    assert got == [NO_KNOWLEDGE, NO_DOCUMENTS, EMPTY_OUTPUT, FAILED, "ok"]


def test_without_prompt(spark):
    df = spark.createDataFrame([("ab cd ", "ab")], "g string, p string")
    assert df.select(without_prompt(F.col("g"), F.col("p"))).first()[0] == "cd"


def test_query_string(spark):
    columns = ", ".join(f"`{f}` double" for f in FEATURES)
    text = spark.createDataFrame([tuple(float(i) for i in range(18))], columns).select(query_string()).first()[0]
    assert text.startswith("dur: 0.000000 | sbytes: 1 | dbytes: 2 | Sload: 3.000000 | ")
    assert text.count(" | ") == 17


def test_corpus_encoder(spark):
    docs = spark.createDataFrame(
        [(0, "alpha beta"), (1, "alpha beta"), (2, "gamma"), (3, "")], "doc_pos long, input string"
    )
    out = {r["doc_pos"]: r["embedding"] for r in encode_corpus(docs, fit_corpus_encoder(docs, 64)).collect()}
    assert out[0] == out[1] != out[2]
    assert np.linalg.norm(out[2]) == pytest.approx(1.0)
    assert np.linalg.norm(out[3]) == 0.0


def test_corpus_encoder_takes_little_at_once(spark, monkeypatch):
    """Parts end after so many words and components; only a long text is more, alone in its part."""
    lengths = [i % 7 for i in range(40)] + [5000, 0, 3]
    lists = pa.array([[1] * n for n in lengths])
    parts = list(retrieval._parts(lists, 16, 200))
    assert [i for a, b in parts for i in range(a, b)] == list(range(43))
    assert all(b - a == 1 or sum(lengths[a:b]) + 16 * (b - a) <= 200 for a, b in parts) and len(parts) < 10
    assert retrieval.ENCODED_CELLS <= 1 << 20
    docs = spark.createDataFrame([(i, "word " * n) for i, n in enumerate(lengths)], "doc_pos long, input string").coalesce(1)
    encoder = fit_corpus_encoder(docs, 16)
    whole = sorted(map(tuple, encode_corpus(docs, encoder).collect()))
    monkeypatch.setattr(retrieval, "ENCODED_CELLS", 200)
    assert sorted(map(tuple, encode_corpus(docs, encoder).collect())) == whole


def test_explanations(spark):
    def flow(i, label, a, b):
        raw = [a, b] + [0.0] * 16
        return (i, i * 10, *raw, *raw, label)

    flows = [
        flow(1, "normal", 0.0, 1.0),
        flow(2, "dos", 1.0, 0.1),
        flow(3, "worms", 0.1, 1.0),
        flow(4, "dos", 1.0, 0.2),
        flow(5, "generic", 1.0, 0.3),
        flow(6, "dos", 1.0, 0.15),
    ]
    schema = (
        "flow_id long, first_us long, "
        + ", ".join(f"`{f}` double" for f in FEATURES)
        + ", "
        + ", ".join(f"`z_{f}` double" for f in FEATURES)
        + ", label string"
    )
    out = {r["query_id"]: r for r in explain_anomalies(spark.createDataFrame(flows, schema), k=3).collect()}
    assert sorted(out) == [2, 3, 4]
    assert out[2]["neighbours"] == "6,4,5"
    assert (out[2]["suggested"], out[2]["votes"]) == ("dos", 2)
    assert out[3]["neighbours"].startswith("1,")
    assert out[2]["rag_output"] == (
        "Suggested label: dos (2 of 3 similar flows). Leading features: dur, sbytes, dbytes"
    )
