"""Queries of page jobs, corrections, rules and resets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators import jobs as J
from quillspark.operators import metrics as X
from quillspark.operators import retrieval as R
from quillspark.plans.registry import query
from quillspark.plans.text_queries import _ISSUES, issues
from quillspark.plans.vector_queries import _IN, _QUESTIONS, questions

_FAILS = "CASE WHEN strpos(coalesce(text, ''), '***') > 0 THEN 'marked' END"


def _results(lib):
    """Results of a job that fails on every page with three stars and counts the characters of the others."""

    def work(text):
        if "***" in (text or ""):
            raise ValueError("marked")
        return len(text or "")

    return J.worked(lib.pages_v, work, T.LongType())


@query("job_outcomes", "pages_v", f"SELECT id, CASE WHEN {_FAILS} IS NULL THEN length(coalesce(text, '')) END AS result, {_FAILS} AS error FROM pages_v")
def job_outcomes(lib):
    return _results(lib)


@query("job_settled_pages", "pages_v", f"SELECT id, CASE WHEN {_FAILS} IS NULL THEN 'succeeded' ELSE 'failed' END AS chunking_milestone, CAST(retry_count + CASE WHEN {_FAILS} IS NULL THEN 0 ELSE 1 END AS INT) AS retry_count, {_FAILS} AS error FROM pages_v")
def job_settled_pages(lib):
    return J.settled(lib.pages_v, _results(lib), "chunking").select("id", "chunking_milestone", "retry_count", "error")


@query("job_events", "pages_v", f"SELECT id AS page_id, CASE WHEN {_FAILS} IS NULL THEN 'chunking_succeeded' ELSE 'chunking_failed' END AS event_type, '{{\"error\":\"' || {_FAILS} || '\"}}' AS payload FROM pages_v")
def job_events(lib):
    return J.outcome_events(_results(lib), "chunking")


_MILESTONE = """m AS (SELECT book_id, CASE WHEN done = n THEN 'complete' WHEN failed = n THEN 'failed' WHEN done + failed = n THEN 'partial_failure' WHEN done > 0 OR failed > 0 OR active > 0 THEN 'in_progress' ELSE 'idle' END AS ocr_milestone
 FROM (SELECT book_id, count(*) AS n, count(*) FILTER (WHERE ocr_milestone = 'succeeded') AS done, count(*) FILTER (WHERE ocr_milestone IN ('failed', 'error')) AS failed, count(*) FILTER (WHERE ocr_milestone = 'in_progress') AS active FROM pages_v GROUP BY book_id))"""


def _books(lib):
    return J.books_refreshed(lib.books_v.withColumn("ocr_milestone", F.lit(None).cast("string")), lib.pages_v)


@query("books_refreshed", "books_v pages_v", f", {_MILESTONE} SELECT b.id, m.ocr_milestone FROM books_v b LEFT JOIN m ON m.book_id = b.id")
def books_refreshed(lib):
    return _books(lib).select("id", "ocr_milestone")


@query("bulk_reset_pages", "books_v pages_v", f""", {_MILESTONE}, h AS (SELECT b.id FROM books_v b JOIN m ON m.book_id = b.id WHERE m.ocr_milestone <> 'succeeded' AND b.status NOT IN ('ready', 'error'))
SELECT id, CASE WHEN hit THEN 'idle' ELSE ocr_milestone END AS ocr_milestone, CASE WHEN hit THEN 'idle' ELSE spell_check_milestone END AS spell_check_milestone, CAST(CASE WHEN hit THEN 0 ELSE retry_count END AS INT) AS retry_count FROM (SELECT *, book_id IN (SELECT id FROM h) AS hit FROM pages_v)""")
def bulk_reset_pages(lib):
    return J.bulk_reset(_books(lib), lib.pages_v)[1].select("id", "ocr_milestone", "spell_check_milestone", "retry_count")


@query("bulk_reset_books", "books_v pages_v", f""", {_MILESTONE} SELECT b.id, CASE WHEN m.ocr_milestone <> 'succeeded' THEN 'pending' ELSE b.status END AS status FROM books_v b LEFT JOIN m ON m.book_id = b.id""")
def bulk_reset_books(lib):
    return J.bulk_reset(_books(lib), lib.pages_v, include_error=True)[0].select("id", "status")


@query("page_reset", "pages_v", "SELECT id, CASE WHEN book_id = 'src3' AND page_number = 2 THEN 'idle' ELSE ocr_milestone END AS ocr_milestone, CASE WHEN book_id = 'src3' AND page_number = 2 THEN NULL ELSE md5(text) END AS digest, CAST(CASE WHEN book_id = 'src3' AND page_number = 2 THEN 0 ELSE retry_count END AS INT) AS retry_count FROM pages_v")
def page_reset(lib):
    return J.page_reset(lib.pages_v, "src3", 2).select("id", "ocr_milestone", F.md5("text").alias("digest"), "retry_count")


@query("rules_search", "rules_v", "SELECT misspelled_word, corrected_word FROM rules_v WHERE is_active AND (misspelled_word ILIKE '%T_E%' OR corrected_word ILIKE '%T_E%')")
def rules_search(lib):
    return J.rules_matching(lib.rules_v, "T_E", auto_only=True).select("misspelled_word", "corrected_word")


@query("rule_by_word", "rules_v", "SELECT corrected_word, is_active FROM rules_v WHERE misspelled_word = (SELECT max(misspelled_word) FROM rules_v)")
def rule_by_word(lib):
    last = lib.rules_v.agg(F.max("misspelled_word")).first()[0]
    return J.rule_of(lib.rules_v, last).select("corrected_word", "is_active")


@query("rules_patched", "rules_v", "SELECT misspelled_word, corrected_word, NOT is_active AS is_active FROM rules_v")
def rules_patched(lib):
    patch = lib.rules_v.select("misspelled_word", F.lit(None).cast("string").alias("corrected_word"), (~F.col("is_active")).alias("is_active"))
    return J.rules_patched(lib.rules_v, patch)


@query("rules_saved", "rules_v", "SELECT misspelled_word, corrected_word, is_active FROM rules_v WHERE misspelled_word <> 'from' UNION ALL SELECT 'from', 'frum', true UNION ALL SELECT 'new word', 'word', true")
def rules_saved(lib):
    rows = lib.spark.range(2).select(F.when(F.col("id") == 0, "from").otherwise("new word").alias("misspelled_word"), F.when(F.col("id") == 0, "frum").otherwise("word").alias("corrected_word"))
    return J.rules_saved(lib.rules_v, rows)


@query("corrected_issues", "pages_v rules_v", f"""
, {_ISSUES}, s AS (SELECT page_id, min(id) AS first FROM i WHERE word = 'with' GROUP BY page_id),
j AS (SELECT i.id, i.page_id, i.word, CASE WHEN i.id = s.first THEN 'processing' ELSE i.status END AS status, s.first IS NOT NULL AS busy FROM i LEFT JOIN s USING (page_id))
SELECT j.id, CASE WHEN r.corrected_word IS NOT NULL AND j.status = CASE WHEN busy THEN 'processing' ELSE 'open' END THEN 'corrected' ELSE j.status END AS status
FROM j LEFT JOIN rules_v r ON r.misspelled_word = j.word AND r.is_active""")
def corrected_issues(lib):
    every = issues(lib, processing="with").withColumns({"char_offset": F.lit(0), "char_end": F.lit(0)})
    return J.corrected_pages(lib.pages_v, every, lib.rules_v)[1].select("id", "status")


@query("words_by_page", "words_v", "SELECT page_id, word, count(*) AS n FROM words_v GROUP BY page_id, word")
def words_by_page(lib):
    return X.word_frequency(lib.words_v, by_page=True)


@query("history_of_all", "history_v", """
SELECT a.conv_id, coalesce(h.history, 'No previous conversation.') AS history FROM (SELECT DISTINCT conv_id FROM history_v) a LEFT JOIN (
 SELECT conv_id, string_agg('AI: ' || trim(replace(text, chr(10), ' ')), chr(10) ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM history_v WHERE role = 'assistant') WHERE k <= 6 GROUP BY conv_id) h USING (conv_id)""")
def history_of_all(lib):
    return R.history_lines(lib.history_v.where("role = 'assistant'"), asking=lib.history_v)


_HANDLED = f"""{_QUESTIONS}), t AS (SELECT question_id, min(title) AS title FROM q JOIN (SELECT DISTINCT title FROM books_v) b ON {_IN.format('b.title')} GROUP BY 1),
a AS (SELECT t.question_id FROM t WHERE title IN (SELECT title FROM books_v WHERE author IS NOT NULL)),
w AS (SELECT DISTINCT question_id FROM q JOIN (SELECT DISTINCT author FROM books_v WHERE author IS NOT NULL) b ON {_IN.format('b.author')})"""


@query("first_handlers", "books_v", f""", q AS ({_HANDLED}
SELECT question_id, CASE WHEN question_id IN (SELECT question_id FROM a) THEN 'author_by_title' WHEN question_id IN (SELECT question_id FROM w) THEN 'books_by_author' WHEN question_id IN (SELECT question_id FROM t) THEN 'volume_info' ELSE 'catalog' END AS handler FROM q""")
def first_handlers(lib):
    """The three handlers themselves, over questions of titles and authors."""
    asked = questions(lib)
    found = [("author_by_title", R.author_of_title(asked, lib.books_v)), ("books_by_author", R.books_of_author(asked, lib.books_v)), ("volume_info", R.volumes_of_title(asked, lib.books_v))]
    return J.answered_first(asked, found)
