import random
import zlib

import numpy as np
import pytest
from plain import documents

from flowloom.llm.packing import best_fit_decreasing, lower_bound, pack_documents
from flowloom.llm.tokens import WordEncoder, vocabulary_path

PATH = vocabulary_path("word_bpe_49k.json")


def expected(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, got, capacity):
    """Every id of every document in its place; sequences gapless and within capacity."""
    docs, places = {}, {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert r["length"] == len(ids) <= capacity
        assert r["ids_crc32"] == zlib.crc32(r["ids"])
        docs.setdefault(r["doc_id"], []).append((r["piece"], r["start"], ids.tolist()))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t, _ in rows:
        at, ids = 0, []
        for n, (piece, start, part) in enumerate(sorted(docs[i])):
            assert (piece, start) == (n, at)
            at += len(part)
            ids += part
            assert len(part) == capacity or at == len(ids)
        assert ids == expected(t)
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_every_piece_has_its_place(spark):
    rng = random.Random(7)
    words = ["Öl", "the", "don't", "x9!", "naïve", "…", "<|endoftext|>", "a b", "日本"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 120))), "s") for i in range(150)]
    rows += [(900, None, "s"), (901, "", None), (902, "\n \t", "s"), (903, "word " * 3000, "s")]
    got = pack_documents(documents(spark, rows).repartition(3), PATH, capacity=256).collect()
    n = check(rows, got, 256)
    assert n <= lower_bound(np.array([r["length"] for r in got]), 256) + 1


def test_repeated_rows_and_null_ids_are_all_packed(spark):
    got = pack_documents(documents(spark, [(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s")]), PATH).collect()
    assert sorted(r["length"] for r in got) == [2, 3, 3]
    assert {r["doc_id"] for r in got} == {1, None}
    assert len({r["sequence_id"] for r in got}) == 1


def test_empty_table(spark):
    assert pack_documents(documents(spark, []), PATH).count() == 0


def test_exchange_between_groups_saves_sequences(spark, monkeypatch):
    from flowloom.llm import packing

    monkeypatch.setattr(packing, "GROUP_PIECES", 40)
    rng = random.Random(8)
    lengths = [rng.randrange(300, 1100) for _ in range(1200)]
    df = spark.createDataFrame(list(enumerate(lengths)), "row long, length int")
    got = packing.place_pieces(df, 2048).collect()
    assert len(got) == len(lengths)
    groups = [np.array(lengths[i::30]) for i in range(30)]
    alone = sum(len(best_fit_decreasing(g, 2048)[2]) for g in groups)
    n = len({r["sequence_id"] for r in got})
    assert lower_bound(np.array(lengths), 2048) <= n < alone
    fill = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + lengths[r["row"]]
    assert max(fill.values()) <= 2048


def test_bounds():
    assert lower_bound(np.array([6, 6, 6]), 10) == 3  # by volume 2
    assert lower_bound(np.array([4, 4, 4, 4]), 10) == 2
    assert lower_bound(np.array([5, 5, 10]), 10) == 2
    rng = np.random.default_rng(0)
    for _ in range(50):
        x = rng.integers(1, 40, rng.integers(1, 60))
        assert lower_bound(x, 40) <= len(best_fit_decreasing(x, 40)[2])


ATOMS = ["a", "Word", "it's", "'ll", "12", "3", "!?", "é", "é", "J̌", "Σας", "ß", " ", "  ", "   ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x85"]
ATOMS += ["\xa0", " \xa0", "\u1680", "\u180e", "\u2003", "\u2028", "\u200b", "\u202f", "\u3000", "\ufeff", "日本", "ひ", "🙂", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>"]
ATOMS += ["İ", "İ.", "İ,", "\x00", "\x01", "foo.", "Bar,", ".", ",", "ñ", "\u0301", "\u0338", "ﬁ", "ǅ", "<", "="]


@pytest.mark.parametrize("ordinary", [True, False])
@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunks_remembered_give_the_ids_of_the_whole_text(name, ordinary):
    from tokenizers import Tokenizer

    path = vocabulary_path(name)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = ordinary
    rng = random.Random(9)
    texts = ["a \x00b", "foo \x01foo", "x İ. y İ, z", ""]
    texts += ["".join(rng.choice(ATOMS) + rng.choice(["", "", " "]) for _ in range(rng.randrange(30))) for _ in range(3000)]
    coder = WordEncoder(path, ordinary)
    assert coder.mode != "whole"
    for at in range(0, len(texts), 40):  # blocks that name special tokens are cut otherwise
        some = texts[at : at + 40]
        for text, ids in zip(some, coder.encode(some)):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_forgetful_encoder(monkeypatch):
    from flowloom.llm import tokens

    monkeypatch.setattr(tokens, "MOST_CHUNKS", 20)
    coder = WordEncoder(PATH)
    for i in range(30):
        assert np.frombuffer(coder.encode([f"dog number {i} w{i}x"])[0], "<u4").tolist() == expected(f"dog number {i} w{i}x")[:-1]
        assert len(coder.known) <= 20


def test_bound_of_a_histogram():
    from flowloom.llm.packing import bound_of_counts

    count = np.zeros(2049, np.int64)
    count[[700, 1100]] = 10**9, 10**9  # one of each fits a sequence
    assert bound_of_counts(count, 2048) == 10**9


KEPT = r'''
import ctypes, re, sys
import numpy as np, pyarrow as pa
from flowloom.llm.tokens import encoder

def held():
    lines = open("/proc/self/smaps_rollup").read()
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", lines))) / 1024

coder, rng = encoder(sys.argv[1]), np.random.default_rng(5)
words = np.array(["".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(20_000)])
for _ in range(3):
    texts = pa.array([" ".join(rng.choice(words, 300)) for _ in range(2_500)])
    for block in coder.encode_column(texts):
        pass
    del texts, block
before = held()
pa.default_memory_pool().release_unused()
ctypes.CDLL(None).malloc_trim(0)
print(before - held())
'''


def test_a_worker_keeps_little_memory_that_it_does_not_use():
    import ctypes
    import os
    import subprocess
    import sys
    from pathlib import Path

    if not Path("/proc/self/smaps_rollup").exists() or not hasattr(ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("memory can't be read or trimmed here")
    env = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[2])}
    done = subprocess.run([sys.executable, "-c", KEPT, PATH], env=env, capture_output=True, text=True, timeout=300, check=True)
    assert float(done.stdout) < 36


def test_freed_memory_is_returned_by_bytes_of_text(monkeypatch):
    import pyarrow as pa

    from flowloom.llm import words

    calls = []
    monkeypatch.setattr(words, "return_memory", lambda: calls.append(1))
    monkeypatch.setitem(words.worker_cache("text_done"), "bytes", 0)
    for _ in range(50):  # small columns pay nothing
        list(words.blocks(pa.array(["a b c"])))
    assert not calls
    list(words.blocks(pa.array(["x" * 1000] * 9_000)))
    assert 3 <= len(calls) <= 9_000_000 // words.RETURN_BYTES


def test_packing_leaves_the_batch_size_as_it_was(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for value in ("7", "0"):
            spark.conf.set(name, value)
            got = pack_documents(documents(spark, [(i, f"w{i} the", "s") for i in range(40)]), PATH).collect()
            assert len(got) == 40 and spark.conf.get(name) == value
    finally:
        spark.conf.set(name, before)
