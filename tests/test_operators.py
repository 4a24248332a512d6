"""Operators on small tables: state machine, writes, retrieval, limits."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import catalog as C
from quillspark.operators import merge as M
from quillspark.operators import metrics as X
from quillspark.operators import pipeline as P
from quillspark.operators import retrieval as R
from quillspark.operators import vectors as V


@pytest.mark.parametrize(
    "counts,want",
    [((10, 0, 0, 10), "complete"), ((8, 2, 0, 10), "partial_failure"), ((0, 10, 0, 10), "failed"), ((5, 0, 0, 10), "in_progress"), ((0, 0, 5, 10), "in_progress"), ((0, 0, 0, 10), "idle"), ((0, 0, 0, 0), "idle")],
)
def test_roll_up(spark, counts, want):
    assert spark.range(1).select(P.rolled_up(*map(F.lit, counts))).first()[0] == want


def test_claims_stop_at_the_next_page(spark):
    issues = spark.createDataFrame([(101, 1, "a", "open"), (102, 1, "a", "open"), (103, 2, "a", "open"), (104, 3, "a", "open"), (105, 1, "a", "open")], "id long, page_id long, word string, status string")
    rules = spark.createDataFrame([("a", "b", True)], "misspelled_word string, corrected_word string, is_active boolean")
    assert [r["id"] for r in X.correctable_claims(issues, rules, 2).orderBy("id").collect()] == [101, 102, 103]
    assert {r["page_id"] for r in X.correctable_claims(issues, rules, 5).collect()} == {1, 2, 3}


def test_hit_rate(spark):
    assert [r[0] for r in spark.createDataFrame([(5, 5), (0, 0)], "h int, m int").select(X.hit_rate(F.col("h"), F.col("m"))).collect()] == [0.5, 0.0]


def test_breaker(spark):
    rows = [(1, i, float(i), False) for i in range(5)] + [(1, 5, 10.0, True), (1, 6, 40.0, True), (2, 7, 0.0, False), (3, 8, 0.0, True)]
    rows += [(4, 20 + i, float(i), False) for i in range(5)] + [(4, 30, 40.0, False), (4, 31, 41.0, True)]
    calls = spark.createDataFrame(rows, "key long, id long, at double, ok boolean")
    got = {r["key"]: (r["state"], r["n_refused"]) for r in X.breaker_states(calls).collect()}
    assert got == {1: ("closed", 1), 2: ("closed", 0), 3: ("closed", 0), 4: ("open", 1)}


def test_cosine_edges(spark):
    v = lambda *xs: F.array(*map(F.lit, xs)).cast("array<float>")
    row = spark.range(1).select(V.cosine(v(1.0, 0.0), v(2.0, 0.0)), V.cosine(v(0.0, 0.0), v(1.0, 0.0)), V.cosine(v(), v())).first()
    assert list(row) == [1.0, 0.0, 0.0]


def test_list_filters(spark):
    df = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [df.where(C.among("id", x)).count() for x in (None, [], ["a"])] == [2, 0, 1]
    assert C.split_volume("history 2") == ("history", 2) and C.split_volume("2") == ("2", None)


def test_upsert_keeps_other_columns(spark):
    old = spark.createDataFrame([(1, "a", 7), (2, "b", 8)], "id int, text string, n int")
    new = spark.createDataFrame([(2, None), (3, "c")], "id int, text string")
    assert sorted(map(tuple, M.upserted(old, new, ["id"]).collect())) == [(1, "a", 7), (2, None, 8), (3, "c", None)]
    assert sorted(map(tuple, M.latest_only(spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "id int, seq int, t string"), ["id"], "seq").collect())) == [(1, 2, "y")]


@pytest.mark.parametrize(
    "question,history,everywhere,want",
    [
        ("ئۇشبۇ تومدا بارمۇ؟", False, False, "current_volume"),
        ("بۇ بەتتە نېمە بار؟", False, False, "current_page"),
        ("بۇ بەتتە نېمە بار؟", False, True, "agent_rag"),
        ("hello", True, False, "agent_rag"),
        (None, True, False, "agent_rag"),
    ],
)
def test_intents(spark, question, history, everywhere, want):
    row = spark.range(1).select(R.intent(F.lit(question).cast("string"), F.lit(history), F.lit(everywhere))).first()
    assert row[0] == want


def test_catalog_questions(spark):
    asks = ["بۇ كىتابنىڭ ئاپتورى كىم؟", "قايسى كىتابلار بار؟", "hello"]
    assert [spark.range(1).select(R.is_catalog_question(F.lit(a))).first()[0] for a in asks] == [True, True, False]


def test_entities_match_with_endings(spark):
    pairs = [("زوردۇن سابىر", "زوردۇن سابىرنىڭ ئەسىرى"), ("ئانا يۇرت", "ئانا يۇرتتا نېمە بار؟"), ("abc", "abc"), ("بابۇرنامە", "«بابۇرنامىنىڭ»")]
    got = [spark.range(1).select(R.entity_in(F.lit(e), R.question_words(F.lit(q)))).first()[0] for e, q in pairs]
    assert got == [True, True, False, True]


def test_context_keeps_first_seen(spark):
    rows = [("q", 0, 0, "b", 1, 0.5, "first"), ("q", 1, 0, "b", 1, 0.9, "later"), ("q", 1, 1, "b", 2, 0.7, "other")]
    seen = spark.createDataFrame(rows, "query_id string, obs_idx int, chunk_idx int, book_id string, page_number int, score double, text string")
    one = R.assembled_context(R.ranked_context(seen)).first()
    assert one["context"] == "other\n\n---\n\nfirst" and one["book_ids"] == ["b"]


def test_single_row_writes(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, t string")
    assert sorted(r["t"] for r in M.updated(rows, F.col("id") == 2, t=F.lit("new")).collect()) == ["a", "c", "new"]
    assert sorted(r["t"] for r in M.deleted(rows, F.col("id") == 2).collect()) == ["a", "c"]
    assert M.inserted(rows, rows.select("id")).count() == 6
    assert {r["updated_at"] for r in M.touched(rows, F.lit(7)).collect()} == {7}
    configs = spark.createDataFrame([("k", "v")], "key string, value string")
    assert [M.config_value(configs, k, "default").first()[0] for k in ("k", "other")] == ["v", "default"]


def test_search_rows_and_keys(spark):
    found = spark.createDataFrame([(None, ""), ("t", "a")], "title string, author string")
    assert [tuple(r) for r in V.shaped(found).collect()] == [("Unknown", None), ("t", "a")]
    key = lambda *a: spark.range(1).select(V.cache_key("[1]", *a)).first()[0]
    assert key(["a", "b"], None) == key(["b", "a"], None) != key(["a"], None) and key(None, None).split(":")[-1] == "all" and key(None, ["x"]) != key(None, None)


def test_history_categories(spark):
    row = spark.range(1).select(R.with_history_categories(F.array(F.lit("h")), "h", ("h", "i")), R.with_history_categories(F.array(F.lit("x")), "h", ("i",))).first()
    assert list(row) == [["h", "i"], ["x"]]
