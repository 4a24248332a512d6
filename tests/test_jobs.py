"""Jobs, corrections, resets and edits on small tables."""

import pytest
from pyspark.sql import types as T

from quillspark.operators import jobs as J
from quillspark.operators import pipeline as P
from quillspark.operators import retrieval as R

PAGES = "id long, book_id string, page_number int, text string, is_toc boolean, ocr_milestone string, chunking_milestone string, embedding_milestone string, spell_check_milestone string, retry_count int, is_indexed boolean, status string, pipeline_step string, error string"


def pages(spark, texts):
    rows = [(i, "b" if i < 3 else "c", i, t, i == 4, "succeeded", "idle", "idle", "idle", 1, True, "ocr_done", "ocr", None) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, PAGES)


def test_a_failing_page_costs_its_own_row(spark):
    def split(text):
        if "bad" in text:
            raise ValueError("e" * 900)
        return [text] if text else []

    p = pages(spark, ["good", "bad", None, "contents bad"])
    results = J.chunked(p, split).persist()
    assert {r["id"]: (r["result"], r["error"] and len(r["error"])) for r in results.collect()} == {1: (["good"], None), 2: (None, 500), 3: ([], None), 4: ([], None)}
    after = {r["id"]: (r["chunking_milestone"], r["retry_count"], r["error"] is not None) for r in J.settled(p, results, "chunking").collect()}
    assert after == {1: ("succeeded", 1, False), 2: ("failed", 2, True), 3: ("succeeded", 1, False), 4: ("succeeded", 1, False)}
    untouched = J.settled(p, results.where("id = 1"), "embedding").collect()
    assert [r["embedding_milestone"] for r in sorted(untouched)] == ["succeeded", "idle", "idle", "idle"]
    events = {r["page_id"]: (r["event_type"], r["payload"]) for r in J.outcome_events(results, "chunking").collect()}
    assert events[1] == ("chunking_succeeded", None) and events[2] == ("chunking_failed", '{"error":"' + "e" * 500 + '"}')
    chunks = spark.createDataFrame([(1, "b", 1, 0, "old", [1.0]), (2, "b", 1, 1, "gone", [1.0]), (3, "b", 2, 0, "stays", [1.0]), (4, "c", 4, 0, "contents", [1.0])], "id long, book_id string, page_number int, chunk_index int, text string, embedding array<double>")
    got = {(r["id"], r["page_number"], r["text"], r["embedding"] is None) for r in J.rechunked_pages(chunks, p, results).collect()}
    assert got == {(1, 1, "good", True), (3, 2, "stays", False)}
    books = spark.createDataFrame([("b", "x"), ("z", "kept")], "id string, chunking_milestone string")
    assert {r["id"]: r["chunking_milestone"] for r in J.books_refreshed(books, J.settled(p, results, "chunking")).collect()} == {"b": "partial_failure", "z": "kept"}


def test_loops_and_tries(spark):
    left = [spark.range(2), spark.range(1), spark.range(0)]
    seen = []
    assert J.until_empty(lambda: left.pop(0), lambda b: seen.append(b.count())) == 2 and seen == [2, 1]

    class Busy(Exception):
        code = 429

    waits, calls = [], []

    def call(x):
        calls.append(x)
        if len(calls) < 3:
            raise Busy
        return x

    assert J.tried(call, 7, wait=waits.append) == 7 and waits == [2.0, 4.0]
    with pytest.raises(ZeroDivisionError):
        J.tried(lambda: 1 / 0, wait=waits.append)
    assert len(waits) == 2


def test_rules(spark):
    rules = spark.createDataFrame([(1, "Teh", "the", "typo", True), (2, "adn", "and", None, False), (3, "x", "the 100%", None, True)], "id long, misspelled_word string, corrected_word string, description string, is_active boolean")
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(J.rules_matching(rules)) == [2, 1, 3] and ids(J.rules_matching(rules, "THE")) == [1, 3]
    assert ids(J.rules_matching(rules, "typ_")) == [1] and ids(J.rules_matching(rules, auto_only=True)) == [1, 3] and ids(J.rule_of(rules, "adn")) == [2]
    patch = spark.createDataFrame([("adn", None, True), ("new", "n", True)], "misspelled_word string, corrected_word string, is_active boolean")
    assert {tuple(r) for r in J.rules_patched(rules, patch).select("id", "corrected_word", "is_active").collect()} == {(1, "the", True), (2, "and", True), (3, "the 100%", True)}
    saved = J.rules_saved(rules, spark.createDataFrame([("adn", "AND"), ("new", "n")], "misspelled_word string, corrected_word string"))
    assert {(r["misspelled_word"], r["corrected_word"], r["is_active"]) for r in saved.collect()} == {("Teh", "the", True), ("adn", "AND", True), ("x", "the 100%", True), ("new", "n", True)}


ISSUES = "id long, page_id long, word string, char_offset int, char_end int, status string"


def test_automatic_corrections(spark):
    p = pages(spark, ["teh cat adn teh dog", "teh", "adn teh"])
    rules = spark.createDataFrame([("teh", "the", True), ("adn", "and", False)], "misspelled_word string, corrected_word string, is_active boolean")
    issues = spark.createDataFrame(
        [(1, 1, "teh", 0, 3, "open"), (2, 1, "teh", 12, 15, "open"), (3, 1, "adn", 8, 11, "open"), (4, 2, "teh", None, None, "open"), (5, 3, "teh", 4, 7, "open"), (6, 3, "adn", 0, 3, "processing")], ISSUES)
    new, after = J.corrected_pages(p, issues, rules)
    got = {r["id"]: (r["text"], r["is_indexed"], r["chunking_milestone"]) for r in new.collect()}
    assert got[1] == ("the cat adn the dog", False, "idle") and got[2][:2] == ("teh", True) and got[3][:2] == ("adn teh", True)
    assert {r["id"]: r["status"] for r in after.collect()} == {1: "corrected", 2: "corrected", 3: "open", 4: "open", 5: "open", 6: "processing"}


def test_manual_corrections(spark):
    p = pages(spark, ["teh quick cat", "zzz"])
    issues = spark.createDataFrame([(1, 1, "teh", 0, 3, "open"), (2, 1, "cat", None, None, "open"), (3, 2, "teh", 0, 3, "open")], ISSUES)
    rules = spark.createDataFrame([("teh", "te", False)], "misspelled_word string, corrected_word string, is_active boolean")
    words = spark.createDataFrame([("quick",)], "word string")
    asked = spark.createDataFrame([(1, "The very", 0, 9, None, True, True), (2, "dog", None, None, None, False, False)], "issue_id long, corrected_word string, start int, end int, original_word string, as_rule boolean, to_dictionary boolean")
    new, after, saved, grown = J.manual_corrections(p, issues, rules, words, asked)
    assert {r["id"]: (r["text"], r["is_indexed"]) for r in new.collect()} == {1: ("The very cat", False), 2: ("zzz", True)}
    assert {r["id"]: r["status"] for r in after.collect()} == {1: "corrected", 2: "open", 3: "ignored"}
    assert [tuple(r) for r in saved.collect()] == [("teh", "The very", True)] and {r["word"] for r in grown.collect()} == {"quick", "teh"}


def test_resets(spark):
    p = pages(spark, ["a", "b", "c"])
    one = {r["id"]: (r["text"], r["status"], r["retry_count"]) for r in J.page_reset(p, "b", 2).collect()}
    assert one == {1: ("a", "ocr_done", 1), 2: (None, "pending", 0), 3: ("c", "ocr_done", 1)}
    books = spark.createDataFrame([("b", "complete", "ocr", "x"), ("c", "complete", "ready", "x"), ("d", None, "ocr", "x")], "id string, ocr_milestone string, status string, pipeline_step string")
    new_books, new_pages = J.bulk_reset(books, p)
    assert {r["id"]: r["status"] for r in new_books.collect()} == {"b": "pending", "c": "ready", "d": "ocr"}
    assert {r["id"]: (r["ocr_milestone"], r["retry_count"]) for r in new_pages.collect()} == {1: ("idle", 0), 2: ("idle", 0), 3: ("succeeded", 1)}
    assert {r["id"]: r["status"] for r in J.bulk_reset(books, p, include_error=True)[0].collect()} == {"b": "pending", "c": "pending", "d": "ocr"}


def test_edits(spark):
    p = pages(spark, ["same", "old", "kept", "none"])
    issues = spark.createDataFrame([(1, 1, "a", 0, 1, "open"), (2, 2, "a", 0, 1, "open")], ISSUES)
    chunks = spark.createDataFrame([(i, "b" if i < 3 else "c", i, 0, "was", [1.0]) for i in (1, 2, 3)], "id long, book_id string, page_number int, chunk_index int, text string, embedding array<float>")
    edits = spark.createDataFrame([(1, "same\r\n"), (2, "# New **text**"), (4, "  ")], "id long, text string")
    for model in (None, lambda texts: [[2.0] for _ in texts]):
        new, left, after = J.edited(p, issues, chunks, edits, model)
        got = {r["id"]: (r["text"], r["status"], r["is_indexed"], r["spell_check_milestone"], r["embedding_milestone"]) for r in new.collect()}
        state = ("indexed", True) if model else ("chunked", False)
        end = "succeeded" if model else "idle"
        assert got[1] == ("same", *state, "idle", end) and got[2] == ("# New **text**", *state, "idle", end)
        assert got[3] == ("kept", "ocr_done", True, "idle", "idle") and got[4] == ("", "indexed", True, "idle", "succeeded")
        assert [r["id"] for r in left.collect()] == [1]
        assert {(r["page_number"], r["text"], None if r["embedding"] is None else r["embedding"][0]) for r in after.collect()} == {(1, "same", 2.0 if model else None), (2, "New text", 2.0 if model else None), (3, "was", 1.0)}


def test_handlers_tools_and_models(spark):
    questions = spark.createDataFrame([(1,), (2,), (3,)], "question_id long")
    found = lambda *ids: spark.createDataFrame([(i,) for i in ids], "question_id long")
    assert {tuple(r) for r in J.answered_first(questions, [("author", found(1)), ("volumes", found(1, 2, 2))]).collect()} == {(1, "author"), (2, "volumes"), (3, "catalog")}
    tools = J.Tools(double=lambda n: spark.range(2 * n))
    assert tools.call("double", n=2).count() == 4
    with pytest.raises(KeyError):
        tools.call("other")
    texts = spark.createDataFrame([(1, "a b"), (2, "fails"), (3, None)], "id long, text string")

    def choose(text, known):
        if text == "fails":
            raise RuntimeError("no")
        return ["poetry", "unheard", "poetry"]

    assert {r["id"]: r["categories"] for r in J.classified(texts, choose, ["poetry", "novel"]).collect()} == {1: ["poetry"], 2: [], 3: ["poetry"]}
    schema = T.StructType().add("title", T.StringType()).add("n", T.LongType())
    got = {r["id"]: (r["answer"], r["error"]) for r in J.structured(texts, lambda t: {"title": t, "more": 1} if t != "fails" else 1 / 0, schema).collect()}
    assert got[1][0].asDict() == {"title": "a b", "n": None} and got[2] == (None, "division by zero")


def test_library_tools(spark, data):
    from quillspark.plans.catalog_queries import shelf
    from quillspark.sources.library import Library

    lib = Library(spark, data)
    vector = lib.embeddings.where("vec_id = 0").first()["embedding"]
    tools = J.library_tools(shelf(lib), lib.pages_v, lib.chunks_v, lib.summaries_v, lambda q: vector)
    assert tools.call("search_chunks", query="x", threshold=-1.0).count() > 0 and tools.call("search_summaries", query="x", threshold=-1.0).count() > 0
    assert [r["title"] for r in tools.call("find_title", question="who wrote Work 3?").collect()] == ["Work 3"]
    assert tools.call("read_page", book_id="src3", page_number=1).count() == 1 and tools.call("search_catalog", query="work 2").count() >= 0


def test_defaults_of_books_without_pages(spark):
    """A ready book without pages counts as done, any other as nothing; new books are claimed up to the cap."""
    books = spark.createDataFrame([("a", "ready", 7), ("z", "pending", 3), ("b", "ready", 9)], "id string, status string, total_pages int")
    p = pages(spark, ["x", "y"])
    stats = {r["book_id"]: (r["ocr"], r["chunking"], r["error_count"]) for r in P.batch_stats(books, p).collect()}
    assert stats == {"a": (7, 7, 0), "z": (0, 0, 0), "b": (2, 0, 0)}
    assert {r["book_id"]: r["chunking_pending"] for r in P.ready_stats(books, p).collect()} == {"a": 0, "z": 3, "b": 0}
    rows = [(i, f"b{i // 2}", i, "", False, "succeeded", "succeeded", "succeeded", "in_progress" if i == 0 else "idle", 0, True, "", "", None) for i in range(12)]
    claimed = P.spell_claims(spark.createDataFrame(rows, PAGES), 3, 40).collect()
    assert {r["book_id"] for r in claimed} == {"b0", "b1", "b2"} and len(claimed) == 5


def test_empty_history(spark):
    turns = spark.createDataFrame([(1, 0, "user", "  hi\nthere "), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    asking = spark.createDataFrame([(1,), (2,)], "conv_id long")
    assert {tuple(r) for r in R.history_lines(turns, asking=asking).collect()} == {(1, "User: hi there\nAI: "), (2, "No previous conversation.")}


def test_contents_pages(spark):
    from pyspark.sql import functions as F

    from quillspark.functions import text as X

    leaders = "\n".join(f"Part ......... {7 * i}" for i in range(1, 7))
    rows = [("plain words", False), (leaders, True), ("prose line\n" * 30 + leaders, False), (None, False), ("|a|b| 1|\n" * 6, True)]
    df = spark.createDataFrame([(t, w) for t, w in rows], "t string, want boolean")
    assert df.where(X.is_contents_page(F.col("t")) != F.col("want")).count() == 0


def test_issues_are_dealt_out_by_page_once(spark):
    """No join of all issues by their places: what they need to know of a page is one row."""
    p = pages(spark, ["teh cat adn teh dog"])
    rules = spark.createDataFrame([("teh", "the", True), ("eh cat", "x", True)], "misspelled_word string, corrected_word string, is_active boolean")
    issues = spark.createDataFrame([(1, 1, "teh", 0, 3, "open"), (2, 1, "eh cat", 1, 7, "open"), (3, 1, "teh", 12, 15, "open")], ISSUES)
    after = J.corrected_pages(p, issues, rules)[1]
    assert {r["id"]: r["status"] for r in after.collect()} == {1: "corrected", 2: "open", 3: "corrected"}
    joins = [x for x in after._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert joins and not [x for x in joins if "char_offset" in x]
