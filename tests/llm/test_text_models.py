import random
from collections import Counter

import numpy as np
import pytest
from plain import documents

from flowloom.llm import langid
from flowloom.llm.langid import identify_languages
from flowloom.llm.quality import HEURISTICS, estimate, quality_scores

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    from pathlib import Path

    if not Path(SF_DIR).is_dir():
        pytest.skip("test tables not present")
    return spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet")


def test_held_out_languages(corpus):
    docs, _ = corpus
    rows = identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert 0.1 < len(held) / len(rows) < 0.3
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_texts(spark):
    rows = [(i, "the and of " * 10, "s") for i in range(30)] + [(40, None, "s"), (41, "", "s"), (42, "12 !?", "s"), (None, "the", None), (43, "日本", "s")]
    got = {r["doc_id"]: r["lang_pred"] for r in identify_languages(documents(spark, rows)).collect()}
    assert {got[i] for i in (40, 41, 42)} == {"und"}
    assert got[0] == got[None] == got[43] == "en"
    assert identify_languages(documents(spark, [])).count() == 0


def test_held_out_rows_and_ids_do_not_teach(spark):
    import zlib

    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    rows = [(i, "aa bb cc " * 5, "s") for i in held[:40]]
    got = identify_languages(documents(spark, rows)).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}


def test_every_language_is_learned(spark):
    rng = random.Random(3)
    words = {f"x{n:02}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for n in range(70)}
    rows = [(lang, " ".join(rng.choices(own, k=20))) for lang, own in words.items() for _ in range(30)]
    docs = spark.createDataFrame([(i, text, lang) for i, (lang, text) in enumerate(rows)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in identify_languages(docs).collect()}
    assert len(got) == len(rows)
    assert set(got.values()) == set(words)
    assert sum(got[i] == lang for i, (lang, _) in enumerate(rows)) >= 0.97 * len(rows)


def test_copies_crowd_no_language_out(spark):
    """Whichever copied text is drawn, the other languages keep their rows."""
    rng = random.Random(4)
    words = {lang: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for lang in ("x1", "x2", "x3")}
    rows = [("x1", f"{' '.join(words['x1'])} {i % 3}") for i in range(6000)]
    rows += [(lang, " ".join(rng.choices(words[lang], k=20))) for lang in ("x2", "x3") for _ in range(60)]
    docs = spark.createDataFrame([(i, text, lang) for i, (lang, text) in enumerate(rows)], "doc_id long, text string, lang string")
    seen = []
    plain = langid.fit
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(langid, "fit", lambda sample, classes: seen.append(Counter(r["lang"] for r in sample)) or plain(sample, classes))
        got = {r["doc_id"]: r["lang_pred"] for r in identify_languages(docs.coalesce(1), sample_rows=90).collect()}
    assert seen == [{"x1": 30, "x2": 30, "x3": 30}]
    assert sum(got[i] == lang for i, (lang, _) in enumerate(rows)) >= 0.97 * len(rows)


def test_quality_against_given_labels(corpus):
    """The labels are not used for fitting, only here."""
    docs, labels = corpus
    rows = quality_scores(docs).join(labels, "doc_id").collect()
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    order = np.mean([[g > b for b in bad] for g in good])
    assert order >= 0.95
    assert np.mean([r["good"] == (r["quality"] == 1) for r in rows]) >= 0.9


def test_quality_of_odd_texts(spark):
    rows = [(i, "One of the words that " * 8, "s") for i in range(20)] + [(40, None, "s"), (41, "", "s"), (42, " \n", "s"), (None, "a" * 100_000, None)]
    got = {r["doc_id"]: r for r in quality_scores(documents(spark, rows)).collect()}
    assert len(got) == 24
    assert all(got[i]["score"] == 0 and not got[i]["good"] for i in (40, 41, 42))
    assert all(0 <= r["weak_label"] <= 1 for r in got.values())
    assert quality_scores(documents(spark, [])).count() == 0


def test_em_finds_the_rates_of_independent_labellers():
    rng = random.Random(1)
    right = [0.9, 0.8, 0.7, 0.85, 0.6, 0.75, 0.8, 0.9, 0.65, 0.7]
    counts = {}
    truth = {}
    for _ in range(20_000):
        good = rng.random() < 0.8
        row = tuple(-1 if rng.random() < 0.2 else int(good == (rng.random() < p)) for p in right)
        counts[row] = counts.get(row, 0) + 1
        truth.setdefault(row, []).append(good)
    patterns = np.array(list(counts))
    post, rates, share = estimate(patterns, np.array(list(counts.values()), float))
    assert len(right) == len(HEURISTICS)
    assert share == pytest.approx(0.8, abs=0.03)
    for j, p in enumerate(right):
        assert rates[1][j][1] == pytest.approx(p, abs=0.04)
    hits = sum(sum(t == (q >= 0.5) for t in truth[tuple(row)]) for row, q in zip(patterns.tolist(), post))
    assert hits / 20_000 > 0.95
