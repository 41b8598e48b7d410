import random
from collections import defaultdict

import pytest
from plain import documents, jaccard_classes, repeats_removed, targets, words

import corpus_pipeline as cp

VOCABULARY = {"en": "the of and to in is it for was that", "de": "der die das und zu von mit den nicht für", "fr": "le la les des et une dans pour sur avec"}


def corpus():
    rng = random.Random(11)
    rows, passage = [], [f"p{i}" for i in range(60)]
    for i in range(160):
        lang = rng.choice(list(VOCABULARY))
        w = [rng.choice(VOCABULARY[lang].split()) + rng.choice(["", "x", "y", "z"]) + str(rng.randrange(40)) for _ in range(rng.randrange(8, 120))]
        if i % 10 == 0:
            w += passage
        rows.append((i, " ".join(w), lang, rng.choice(["a", "a", "a", "b", "c", None])))
    for i in range(20):
        rows.append((200 + i, rows[3 * i][1] + " more", rows[3 * i][2], "b"))
    rows += [(300, None, "en", "a"), (301, "12 !? 99", "en", "a"), (302, "", None, "b")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 1, "x") for i, t, lang, s in rows], SCHEMA)


def run(spark, rows):
    docs, out = frame(spark, rows).repartition(3), {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, "")
        out[name] = docs.collect()
        if name != cp.STAGES[-1][0]:
            assert docs.schema == frame(spark, []).schema
    return out


@pytest.fixture(scope="module")
def stages(spark):
    return run(spark, corpus())


def texts(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_language(stages):
    kept = texts(stages["language_id"])
    assert {i for i, t, *_ in corpus() if i < 300} <= kept.keys()
    assert not {300, 301, 302} & kept.keys()


def test_one_of_each_group(stages):
    before = sorted(texts(stages["language_id"]).items())
    _, classes = jaccard_classes([t for _, t in before])
    want = {before[c][0] for c in classes}
    assert texts(stages["ngram_jaccard_join"]).keys() == want
    assert len(want) < len(before)


def test_repeats(stages):
    before = sorted(texts(stages["ngram_jaccard_join"]).items())
    want = {}
    for (i, t), (n, gone, kept) in zip(before, repeats_removed([t for _, t in before])):
        if not gone or gone < n:
            want[i] = kept if gone else t
    assert texts(stages["substring_dedup"]) == want
    assert any(want[i] != t for i, t in before if i in want)


def test_mix(stages):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in stages["substring_dedup"]:
        sizes[r["source"]] += len(words(r["text"]))
    for r in stages["source_mixing"]:
        taken[r["source"]] += len(words(r["text"]))
    assert taken == {s: int(t + 0.5) for s, t in targets(dict(sizes)).items() if t >= 0.5}


def test_packing(stages):
    ids = defaultdict(int)
    for r in stages["best_fit_packing"]:
        ids[r["sequence_id"]] += r["length"]
    assert max(ids.values()) <= 2048
    assert len(ids) >= -(-sum(ids.values()) // 2048)
    pieces = [r for r in stages["best_fit_packing"] if r["piece"] == 0]
    assert sorted(r["doc_id"] for r in pieces) == sorted(r["doc_id"] for r in stages["source_mixing"])


def test_repeated_and_null_ids_and_columns(spark):
    rows = corpus()[:60]
    rows += [rows[0], rows[0], (None, rows[1][1] + " and so on", "en", "a"), (None, " ".join(f"the{i}" for i in range(30)), None, None)]
    out = run(spark, rows)
    assert len(out["language_id"]) == 64
    kept = [r["doc_id"] for r in out["ngram_jaccard_join"]]
    assert kept.count(rows[0][0]) == 1
    assert kept.count(None) == 2 and 1 not in kept  # the null id comes first
    assert len(out["best_fit_packing"]) > 0


def test_empty_table(spark):
    assert all(not rows for rows in run(spark, []).values())
