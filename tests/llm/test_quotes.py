from flowloom.llm.quotes import link_quotations, quoted_mail

SCHEMA = "conv_id long, turn long, text string, scope string, ord string, level string"


def linked(spark, rows):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    return {(r["conv_id"], r["turn"]): r for r in link_quotations(df).collect()}


def test_nested_quotes_give_a_tree(spark):
    rows = [
        (1, 0, "Hello  there\nHow are you?"),
        (1, 1, "> hello there\n> how are you?\nFine."),
        (1, 2, ">> Hello there\n> Fine.\nGood."),
        (1, 3, "> Hello there\nMe too."),
        (1, 4, "> > Fine.\n> unknown line\nOnly the deeper quote is known."),
        (1, 5, "New topic"),
        (2, 1, "> Hello there\nAnother scope."),
    ]
    got = linked(spark, rows)
    view = lambda r: (r["parent"], r["root"], r["depth"], r["levels"], r["quoted"], r["linked"], r["clean_text"])
    assert view(got[1, 0]) == (None, 0, 0, 0, 0, 0, "Hello  there\nHow are you?")
    assert view(got[1, 1]) == (0, 0, 1, 1, 2, 2, "Fine.")
    assert view(got[1, 2]) == (1, 0, 2, 2, 2, 2, "Good.")
    assert view(got[1, 3]) == (0, 0, 1, 1, 1, 1, "Me too.")
    assert view(got[1, 4]) == (1, 0, 2, 2, 2, 1, "Only the deeper quote is known.")
    assert view(got[1, 5]) == (None, 5, 0, 0, 0, 0, "New topic")
    assert view(got[2, 1]) == (None, 1, 0, 1, 1, 0, "Another scope.")


def test_long_chain(spark):
    rows = [(1, 0, "line 0")] + [(1, i, f"> line {i - 1}\nline {i}") for i in range(1, 40)]
    got = linked(spark, rows)
    assert [(got[1, i]["root"], got[1, i]["depth"]) for i in range(40)] == [(0, i) for i in range(40)]


def test_nulls_ties_and_repeats(spark):
    rows = [(None, 0, "a"), (None, 1, "> a\nb"), (3, None, "> a"), (3, 0, None), (3, 1, ""), (4, 0, "x"), (4, 1, "x"), (4, 2, "> x"), (4, 2, "> x"), (4, 3, "> later"), (4, 4, "later")]
    got = linked(spark, rows)
    assert (got[None, 1]["parent"], got[None, 1]["depth"]) == (0, 1)
    assert (got[3, None]["parent"], got[3, None]["root"]) == (None, None)
    assert got[3, 0]["clean_text"] == got[3, 1]["clean_text"] == ""
    assert got[4, 2]["parent"] == 0  # the first that wrote it
    assert got[4, 3]["parent"] is None  # written only later
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    assert link_quotations(df).count() == len(rows)
    assert link_quotations(df.limit(0)).count() == 0


def test_mail_made_of_turns_is_undone(spark):
    rows = [(c, t, f"Text {c} {t}\nsecond line {t}") for c in range(5) for t in range(6)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    for r in link_quotations(quoted_mail(turns)).collect():
        c, t = r["conv_id"], r["turn"]
        assert r["clean_text"] == f"Text {c} {t}\nsecond line {t}"
        assert (r["parent"], r["root"], r["depth"]) == (t - 1 if t else None, 0, t)
        assert r["quoted"] == r["linked"] == 2 * min(t, 2)


def test_no_python_in_the_plan(spark):
    turns = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "conv_id long, turn long, text string")
    plan = link_quotations(quoted_mail(turns))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
