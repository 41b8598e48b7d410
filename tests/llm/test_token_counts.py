import random

import pytest

from flowloom.llm import token_counts as module
from flowloom.llm.token_counts import Counter, frequent_chunks, token_counts
from flowloom.llm.tokens import vocabulary_path

SCHEMA = "doc_id long, text string, id string, n_tokens int, size long, slot long, chunks string"
ATOMS = ["a", "Word", "it's", "'ll", "12", "3", "!?", "é", "é", "J̌", "Σας", "ß", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\xa0", "\x1c", "\x85"]
ATOMS += ["日本", "🙂", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "İ", "İ.", "İ,", "\x00", "\x01", "foo.", "Bar,", " ", "　", "<s>", "▁"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "y") for r in rows], SCHEMA)


def library(name):
    path = vocabulary_path(name)
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        pieces = SentencePieceProcessor(model_file=path)
        return lambda t: len(pieces.encode(t))
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    return lambda t: len(whole.encode(t, add_special_tokens=False).ids)


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(ATOMS) + rng.choice(["", "", " "]) for _ in range(rng.randrange(30))) for _ in range(n)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_are_the_library_s(spark, monkeypatch, name):
    monkeypatch.setattr(module, "MERGED_AT_ONCE", 2)
    count, rng = library(name), random.Random(1)
    rows = list(enumerate(texts(11, 400))) + [(1, "a b"), (1, "a b"), (None, "c <|endoftext|>"), (9001, None), (9002, ""), (9003, "\n\t ")]
    rows += [(9100 + i, "the common words of " + rng.choice(["one", "two"])) for i in range(300)]
    rows += [(9999, "long " * 60_000 + "Text. " * 50_000)]
    got = token_counts(frame(spark, rows).repartition(5), vocabulary_path(name), limit=20, entries=30).collect()
    want = sorted(((i, len((t or "").encode()), count(t or ""), count(t or "") > 20) for i, t in rows), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_table_holds_the_frequent_ones(spark, monkeypatch):
    monkeypatch.setattr(module, "MERGED_AT_ONCE", 2)
    rows = [(i, f"often often also rare{i} twice{i // 2} " + "z" * 60) for i in range(300)]
    docs = frame(spark, rows).repartition(7).select("text")
    assert set(frequent_chunks(docs, vocabulary_path("word_bpe_49k.json"), 4)) >= {b"often", b"also"}
    assert len(frequent_chunks(docs, vocabulary_path("word_bpe_49k.json"), 4)) == 4


def test_worker_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(module, "MOST_MISSES", 50)
    own = Counter(vocabulary_path("word_bpe_49k.json"))
    for i in range(40):
        assert own.remembered([f"w{i}".encode(), b"dog", b"antidisestablishment"]) == own.sizes([f"w{i}".encode(), b"dog", b"antidisestablishment"]).tolist()
        assert len(own.known) <= 50


def test_empty_tables(spark):
    assert token_counts(frame(spark, []), vocabulary_path("word_bpe_49k.json")).count() == 0
    got = token_counts(frame(spark, [(1, None)]), vocabulary_path("word_bpe_49k.json")).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, False)]
