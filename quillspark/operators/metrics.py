"""Dashboards and limits: totals, evaluation averages, spelling statistics, windows, quotas, circuit breakers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Daily questions by role (none: no limit), and for every other role.
DAILY_LIMITS, OTHER_LIMIT = {"admin": None, "editor": 100, "reader": 20}, 10
CALLS, CALL_WINDOW = 20, "60 seconds"
BREAKS_AT, COOLING_SECONDS = 5, 30


def percentage(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in per cent with two places; 0 of nothing."""
    return F.when(whole > 0, F.round(100.0 * part / whole, 2)).otherwise(0.0)


def evaluation_summary(evaluations: DataFrame, since: Column | None = None) -> DataFrame:
    rows = evaluations if since is None else evaluations.where(F.col("ts") >= since)
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return rows.agg(F.count("*").alias("n"), *[mean(c).alias(f"avg_{c}") for c in ("latency_ms", "retrieved_count", "context_chars", "answer_chars")])


def average_latency(evaluations: DataFrame) -> DataFrame:
    return evaluations.groupBy("book_id").agg(F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 6).alias("latency_ms"))


def recent(rows: DataFrame, by: str, n: int) -> DataFrame:
    return rows.orderBy(F.col(by).desc(), "id").limit(n)


def system_totals(books: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: books, pages, pages indexed and in error, chunks, and shares of pages. One pass over each table."""
    failed = lambda s: F.col(f"{s}_milestone").isin("failed", "error")
    b = books.agg(F.count("*").alias("books"))
    p = pages.agg(F.count("*").alias("pages"), F.count_if(F.col("embedding_milestone") == "succeeded").alias("indexed"), F.count_if(failed("ocr") | failed("chunking") | failed("embedding") | failed("spell_check")).alias("failed"))
    c = chunks.agg(F.count("*").alias("chunks"), F.count_if(F.col("embedding").isNotNull()).alias("embedded"))
    one = b.join(p, F.lit(True)).join(c, F.lit(True))
    return one.withColumns({"indexed_pct": percentage(F.col("indexed"), F.col("pages")), "embedded_pct": percentage(F.col("embedded"), F.col("chunks"))})


def spelling_summary(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """(book_id, page_number, n, n_open, book_n) for every page; pages without issues have 0."""
    n = issues.groupBy("page_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "open").alias("n_open"))
    rows = pages.select(F.col("id").alias("page_id"), "book_id", "page_number").join(n, "page_id", "left").select("book_id", "page_number", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_open", F.lit(0)).alias("n_open"))
    of_book = rows.groupBy("book_id").agg(F.sum("n").alias("book_n"))
    return rows.join(of_book.select(F.col("book_id").alias("of"), "book_n"), F.col("book_id").eqNullSafe(F.col("of"))).drop("of")


def auto_correct_stats(issues: DataFrame, rules: DataFrame) -> DataFrame:
    """One row: rules, active rules, open issues, and open issues that an active rule corrects."""
    r = rules.agg(F.count("*").alias("rules"), F.count_if("is_active").alias("active_rules"))
    active = rules.where("is_active").select(F.col("misspelled_word").alias("word"))
    i = issues.where("status = 'open'").agg(F.count("*").alias("open_issues"))
    c = issues.where("status = 'open'").join(active, "word").agg(F.countDistinct("id").alias("correctable"))
    return r.join(i, F.lit(True)).join(c, F.lit(True))


def pages_with_issues(books: DataFrame, issue_pages: DataFrame) -> DataFrame:
    """(id, pages, first_page): page numbers with issues as JSON, ``[]`` and page 1 where there are none."""
    of = issue_pages.groupBy("book_id").agg(F.array_sort(F.collect_set("page_number")).alias("p"))
    both = books.select("id").join(of.withColumnRenamed("book_id", "id"), "id", "left").withColumn("p", F.coalesce("p", F.array().cast("array<int>")))
    return both.select("id", F.to_json("p").alias("pages"), F.when(F.size("p") > 0, F.col("p")[0]).otherwise(1).alias("first_page"))


def word_frequency(words: DataFrame, by_page: bool = False) -> DataFrame:
    """How often words occur, in all or on each page."""
    return words.groupBy(*(["page_id"] if by_page else []), "word").agg(F.count("*").alias("n"))


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.when(hits + misses > 0, hits / (hits + misses)).otherwise(0.0)


def correctable_claims(issues: DataFrame, rules: DataFrame, pages: int, issues_a_page: int | None = None) -> DataFrame:
    """Issues (id, page_id) to correct now: of at most ``pages`` pages in order of arrival, up to the first issue of the next page.

    An issue of a claimed page that comes after that point waits. Pages are ranked by their first issue: only those first
    arrivals, one row a page, are ordered as a whole, and no more of them than are asked for leave a task. With
    ``issues_a_page`` only so many issues for each page asked for are looked at, the first ones.
    """
    active = rules.where("is_active").select(F.col("misspelled_word").alias("word"))
    rows = issues.where("status = 'open'").join(active, "word", "left_semi").select("id", "page_id")
    rows = rows if issues_a_page is None else rows.orderBy("id").limit(pages * issues_a_page)
    first = rows.groupBy("page_id").agg(F.min("id").alias("first")).orderBy("first").limit(pages + 1)
    ranked = first.withColumn("nth", F.row_number().over(W.orderBy("first")))
    stop = ranked.where(F.col("nth") == pages + 1).agg(F.min("first").alias("stop"))
    chosen = ranked.where(F.col("nth") <= pages).select("page_id")
    return rows.join(F.broadcast(chosen), "page_id").join(F.broadcast(stop), F.lit(True)).where(F.col("stop").isNull() | (F.col("id") < F.col("stop"))).select("id", "page_id")


def minutes_to_ready(books: DataFrame, now: Column, days: int = 7, n: int = 10) -> DataFrame:
    """(id, minutes): the newest ready books of the last days, and how long they took."""
    took = (F.unix_timestamp("last_updated") - F.unix_timestamp("upload_date")) / 60.0
    fresh = books.where((F.col("status") == "ready") & (F.col("last_updated") >= now - F.expr(f"INTERVAL {days} DAYS")))
    return fresh.orderBy(F.col("last_updated").desc(), "id").limit(n).select("id", F.round(took, 4).alias("minutes"))


def rate_limited(calls: DataFrame, window: str = CALL_WINDOW, most: int = CALLS, key: str | None = None) -> DataFrame:
    """(window start, n, refused): calls of each fixed window, and how many beyond the limit it refuses."""
    of = calls.groupBy(F.window("ts", window).alias("w"), *([key] if key else [])).agg(F.count("*").alias("n"))
    return of.select(F.col("w.start").alias("window_start"), *([key] if key else []), "n", F.greatest(F.col("n") - most, F.lit(0)).alias("refused"))


def daily_quota(usage: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, usage_date, cnt, most, allowed): a day's questions against the role's limit; no limit is null."""
    most = F.lit(OTHER_LIMIT)
    for role, n in DAILY_LIMITS.items():
        most = F.when(F.col("role") == role, F.lit(n).cast("int")).otherwise(most)
    both = usage.join(users.select(F.col("id").alias("user_id"), "role"), "user_id")
    return both.select("user_id", "usage_date", "cnt", most.alias("most")).withColumn("allowed", F.col("most").isNull() | (F.col("cnt") < F.col("most")))


def breaker_states(calls: DataFrame, breaks_at: int = BREAKS_AT, cooling: int = COOLING_SECONDS) -> DataFrame:
    """(key, state, failures, n_refused) of a circuit breaker for each key after its calls (key, at seconds, id, ok), in order of time.

    Closed until ``breaks_at`` failures in a row; open for ``cooling`` seconds, refusing calls; then half open: one success
    closes it, one failure opens it again. Calls stream by in order; only a key's state is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fresh = object(), True
        name, failures, since, refused = "closed", 0, 0.0, 0
        for batch in batches:
            done: list[tuple] = []
            for key, at, ok in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if fresh or key != now:
                    if not fresh:
                        done.append((now, name, failures, refused))
                    now, fresh = key, False
                    name, failures, since, refused = "closed", 0, 0.0, 0
                if name == "open" and at < since + cooling:
                    refused += 1
                elif ok:
                    name, failures = "closed", 0
                else:
                    failures += 1
                    if name != "closed" or failures >= breaks_at:
                        name, since = "open", at
            if done:
                yield _states(done)
        if not fresh:
            yield _states([(now, name, failures, refused)])

    rows = calls.select(F.col("key").cast("long").alias("key"), F.col("at").cast("double").alias("at"), "id", F.coalesce("ok", F.lit(False)).alias("ok"))
    return rows.repartition("key").sortWithinPartitions("key", "at", "id").select("key", "at", "ok").mapInArrow(run, "key long, state string, failures int, n_refused int")


def _states(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["key", "state", "failures", "n_refused"])


def issues_before(pages: DataFrame, n: str = "n") -> DataFrame:
    """``before``: issues on earlier pages of the book."""
    order = W.partitionBy("book_id").orderBy("page_number").rowsBetween(W.unboundedPreceding, -1)
    return pages.withColumn("before", F.coalesce(F.sum(n).over(order), F.lit(0)))


def word_context(text: Column, nth: Column, around: int = 40) -> Column:
    """The words around the nth (from 0) of a text, joined."""
    words = F.split(text, r"(?U)\s+")
    start = F.greatest(nth - around, F.lit(0))
    return F.array_join(F.slice(words, start + 1, nth - start + around + 1), " ")
