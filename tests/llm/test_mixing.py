import random
from collections import defaultdict

import pytest
from plain import by_source, documents, targets, words

from flowloom.llm.mixing import mix, mix_plan


def corpus():
    rng = random.Random(6)
    rows = []
    for i in range(700):
        source = rng.choice(["a", "a", "a", "a", "b", "B", "é", "zz", None])
        rows.append((i, " ".join(["w"] * rng.randrange(0, 60)) or None, source))
    return rows


@pytest.fixture(scope="module")
def plan(spark):
    return corpus(), [r.asDict() for r in mix_plan(documents(spark, corpus()).repartition(3)).collect()]


def test_targets_and_exact_cut(plan):
    rows, got = plan
    sizes = by_source((s, len(words(t))) for _, t, s in rows)
    want = targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
        assert r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows)
    assert {s: n for s, n in taken.items()} == {s: int(want[s] + 0.5) for s in sizes}


def test_at_most_one_document_per_source_is_cut(plan):
    cut = [r["source"] for r in plan[1] if r["size"] and r["taken"] % r["size"]]
    assert len(cut) == len(set(cut))


def test_reruns_and_partitionings_agree(spark, plan):
    again = mix_plan(documents(spark, corpus()[::-1]).repartition(7)).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, again)) == sorted(map(key, plan[1]))


def test_mix_holds_what_the_plan_takes(spark, plan):
    rows = mix(documents(spark, corpus())).collect()
    got = defaultdict(int)
    for r in rows:
        got[r["doc_id"]] += len(words(r["text"]))
    assert got == {r["doc_id"]: r["taken"] for r in plan[1] if r["taken"]}


def test_no_words_at_all_and_empty_table(spark):
    got = mix_plan(documents(spark, [(1, None, "a"), (2, "", None), (None, " ", "b")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 3
    assert mix_plan(documents(spark, [])).count() == 0
    assert mix(documents(spark, [(1, None, "a")])).count() == 0


def test_repeated_rows(spark):
    rows = [(1, "a b c", "s")] * 3 + [(1, "d e", "s"), (None, "f", "s"), (None, "f", "s")]
    got = mix_plan(documents(spark, rows)).collect()
    assert sum(r["taken"] for r in got) == int(1.5 * 13 + 0.5)


CLASHING = "doc_id long, text string, source string, _hash string, _size int, _taken int, _slot long, _part long, _row string, row int, taken string, epoch int"


def test_equal_rows_meet_the_target_to_the_word(spark):
    rows = [(7, "one two three " * 200, "a") for _ in range(50)] + [(100 + i, "four five " * 300, "b") for i in range(40)]
    docs = spark.createDataFrame([(*r, "h", 1, 2, 3, 4, "r", 5, "t", 6) for r in rows], CLASHING)
    got = mix(docs.repartition(5), share=0.75).collect()
    assert mix(docs).columns == docs.columns
    goal = targets({"a": 30_000, "b": 24_000}, share=0.75)
    taken = by_source((r["source"], len(words(r["text"]))) for r in got)
    assert taken == {s: int(t + 0.5) for s, t in goal.items()}
    assert {tuple(r)[3:] for r in got} == {("h", 1, 2, 3, 4, "r", 5, "t", 6)}


def test_rows_without_ids_are_spread(spark):
    rows = [(None, f"w{i} x", "a", "h", 1, 2, 3, 4, "r", 5, "t", 6) for i in range(300)]
    got = mix_plan(spark.createDataFrame(rows, CLASHING), share=0.5).collect()
    assert sum(r["taken"] for r in got) == 300 and len(got) == 300
    assert {r["doc_id"] for r in got} == {None}
    assert {r["taken"] for r in got} <= {0, 1, 2}
