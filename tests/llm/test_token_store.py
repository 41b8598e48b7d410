import random
import zlib

import numpy as np
import pytest
from plain import documents

from flowloom.llm import token_store
from flowloom.llm.token_store import TokenFile, encode_file, token_output
from flowloom.llm.tokens import vocabulary_path

PATH = vocabulary_path("byte_bpe_50k.json")


@pytest.mark.parametrize("bits", [(10, 6, 16), (8, 8, 8, 8), (3, 5, 24), (32,)])
def test_file_round_trip_and_random_access(bits):
    rng = np.random.default_rng(1)
    ids = (rng.integers(0, 2**32, 5000, dtype=np.uint64) >> rng.integers(0, 33, 5000).astype(np.uint64)).astype(np.uint32)
    starts = np.array([0, 0, 17, 1200, 5000])
    file = TokenFile(encode_file(np.array([-4, 2, 9, 11]), starts, ids, bits))
    assert (file.tokens() == ids).all()
    assert file.doc_ids.tolist() == [-4, 2, 9, 11]
    for i in [0, 1, 511, 512, 513, 1023, 1024, 4999, *rng.integers(0, 5000, 300)]:
        assert file.token(int(i)) == ids[i]
    assert (file.document(1) == ids[0:17]).all()
    with pytest.raises(IndexError):
        file.token(5000)


def test_empty_file():
    file = TokenFile(encode_file(np.empty(0, np.int64), np.zeros(1), np.empty(0)))
    assert len(file.tokens()) == 0


def test_ids_beyond_the_chunks_are_refused():
    with pytest.raises(ValueError):
        encode_file(np.array([1]), np.array([0, 1]), np.array([70000]), (8, 8))


def expected(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [0]


def test_equals_plain_version(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(token_store, "FILE_TOKENS", 500)
    rng = random.Random(2)
    words = ["Öl", "the", "don't", "x9!", "\n", "…", "<|endoftext|>", "日本"]
    rows = [(i * 2 - 50, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 80))), "s") for i in range(200)]
    rows += [(1001, None, "s"), (1003, "", None), (1005, "very " * 20_000, "s")]
    df = documents(spark, random.Random(3).sample(rows, len(rows))).repartition(5)
    folder = f"file://{tmp_path}/tokens"
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_output(df, PATH, folder=folder).collect()}
    at, want = 0, {}
    for i, text, _ in sorted(rows):
        ids = expected(text)
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want
    assert len(list((tmp_path / "tokens").glob("*.dac"))) >= 4
    assert not list((tmp_path / "tokens").glob(".*"))


def test_repeated_and_null_ids_and_empty_table(spark):
    got = token_output(documents(spark, [(1, "a", "s"), (1, "a", "s"), (None, "b c", "s")]), PATH).collect()
    assert sorted((r["start"], r["n_tokens"], r["doc_id"] is None) for r in got) == [(0, 3, True), (3, 2, False), (5, 2, False)]
    assert token_output(documents(spark, []), PATH).count() == 0
