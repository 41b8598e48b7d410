import random

from plain import documents, jaccard_classes

from flowloom.llm import jaccard
from flowloom.llm.components import components
from flowloom.llm.jaccard import jaccard_components


def near_copies():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randrange(1, 160))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(0, 5)):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.3:
                w = w[rng.randrange(0, 8) :]
            texts.append(" ".join(w).upper() if rng.random() < 0.2 else "  ".join(w))
    return texts


def run(spark, rows):
    df = documents(spark, [(i, t, "s") for i, t in rows]).repartition(4)
    return [tuple(r) for r in jaccard_components(df).collect()]


def test_equals_plain_version(spark):
    texts = near_copies()
    ids = [3 * i - 20 for i in range(len(texts))]
    got = {i: (n, c) for i, n, c in run(spark, zip(ids, texts))}
    sizes, classes = jaccard_classes(texts)
    assert got == {i: (n, ids[c]) for i, n, c in zip(ids, sizes, classes)}
    assert len(set(classes)) < len(texts) - 20


def test_chain_of_near_copies_needs_several_rounds(spark):
    """Documents that share a hot passage and differ step by step."""
    rng = random.Random(5)
    common = [f"c{i}" for i in range(40)]
    texts = []
    for _ in range(12):
        own = [f"o{rng.randrange(10**6)}" for _ in range(30)]
        for step in range(12):
            texts.append(" ".join(common + own[: 30 - step] + [f"n{rng.randrange(10**6)}" for _ in range(step)]))
    got = {i: c for i, _, c in run(spark, enumerate(texts))}
    assert got == dict(enumerate(jaccard_classes(texts)[1]))


def test_exact_threshold(spark):
    w = [f"t{i}" for i in range(40)]
    texts = [" ".join(w[:20]), " ".join(w[:20] + w[30:32]), " ".join(w[:16]), " ".join(w[:13] + ["z"])]
    assert {i: c for i, _, c in run(spark, enumerate(texts))} == dict(enumerate(jaccard_classes(texts)[1]))


def test_nulls_empty_short_and_repeated(spark):
    rows = [(5, None), (6, ""), (7, " \t "), (8, "One two"), (9, "one TWO"), (10, "one two three"), (None, "one two"), (11, "b c d e f"), (11, "b c d e f")]
    got = sorted(run(spark, rows), key=repr)
    want = [(5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, None), (9, 1, None), (10, 1, 10), (None, 1, None), (11, 1, 11), (11, 1, 11)]
    assert got == sorted(want, key=repr)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50, 70)] + [(100, i) for i in range(101, 400)] + [(7, 3), (3, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 50 for i in range(50, 71)} | {i: 100 for i in range(100, 400)} | {3: 3, 7: 3}


def loose_family():
    """Edited versions of one text: most share much with all others, few are linked."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for _ in range(160):
        w = list(base)
        for at in rng.sample(range(150), rng.choice([1, 4, 7, 8, 9, 12])):
            w[at] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    return texts


def test_rows_do_not_follow_the_pairs_of_a_group(spark, monkeypatch):
    texts, written, plain = loose_family(), {}, jaccard.stored

    def counted(df, name):
        out = plain(df, name)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "stored", counted)
    got = {i: c for i, _, c in run(spark, enumerate(texts))}
    assert got == dict(enumerate(jaccard_classes(texts)[1]))
    assert 20 < len(set(got.values())) < 120
    assert sum(n for name, n in written.items() if name != "jaccard-members") < 10 * len(texts)


def test_blocks_of_a_large_region(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 30)
    texts = loose_family()
    assert {i: c for i, _, c in run(spark, enumerate(texts))} == dict(enumerate(jaccard_classes(texts)[1]))
