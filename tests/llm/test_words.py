import random

import numpy as np
import pyarrow as pa

from flowloom.llm.words import STRIP_BYTES, blocks, words


def hashes(texts, lower=False, block_bytes=1 << 30):
    out = [None] * len(texts)
    for block in blocks(pa.array(texts, pa.string()), block_bytes=block_bytes):
        found = words(block, lower)
        for i, row in enumerate(block.rows):
            out[row] = found.hash[found.first[i] : found.first[i + 1]].tolist()
    return out


def test_a_word_has_one_hash_wherever_it_lies():
    rng = random.Random(1)
    vocabulary = ["a", "é", "Word", "x" * 50, "y" * (STRIP_BYTES + 7), "z" * (3 * STRIP_BYTES), "w" * STRIP_BYTES, "日本"]
    known = {w: hashes([w])[0][0] for w in vocabulary}
    assert len(set(known.values())) == len(vocabulary)
    texts = []
    for _ in range(60):
        own = [rng.choice(vocabulary) for _ in range(rng.randrange(12))]
        texts.append((own, rng.choice([" ", "\n", "\t \x0b", "  "]).join(own)))
    for block_bytes in (1 << 30, 1 << 12):
        got = hashes([t for _, t in texts], block_bytes=block_bytes)
        assert got == [[known[w] for w in own] for own, _ in texts]


def test_rows_part_words_and_case_folds():
    edge = "q" * STRIP_BYTES  # the next row begins with a strip
    assert hashes([edge, "q", None, "", " ", "q"]) == [hashes([edge])[0], hashes(["q"])[0], [], [], [], hashes(["q"])[0]]
    assert hashes(["ABC É" * 30_000], lower=True) == hashes(["abc É" * 30_000])


def test_a_long_text_is_hashed_whole():
    text = " ".join(f"w{i}" for i in range(120_000))
    found = hashes([text])[0]
    assert len(set(found)) == 120_000
    assert found[70_000] == hashes(["w70000"])[0][0]
    assert np.asarray(found[-1], np.uint64) == np.uint64(hashes(["w119999"])[0][0])
