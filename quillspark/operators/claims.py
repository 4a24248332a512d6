"""Claims that change tables: what pages, issues and books are after a scanner, a watchdog or the pipeline driver ran.

Each function takes tables and gives them back changed, all rows and columns. Ids that a limit bounds are found first and met
by a join, so the tables themselves are neither sorted nor gathered. ``now`` is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.merge import STEPS
from quillspark.operators.metrics import correctable_claims
from quillspark.operators.pipeline import FAILED, MOST_RETRIES, book_milestones, claimable, milestone, settled_books, spell_claims

# Minutes after which a claim of issues, or a page in progress, is given back; states of books that are through.
ISSUE_MINUTES, PAGE_MINUTES = 15, 30
THROUGH = ("ready",)


def _marked(table: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, Column]:
    """``table`` with a mark for the rows whose key is in ``ids`` (distinct keys), and the mark."""
    hit = ids.select(F.col(key).alias("__key"))
    return table.join(hit, table[key] == F.col("__key"), "left"), F.col("__key").isNotNull()


def pages_claimed(pages: DataFrame, step: str, limit: int, now: Column) -> DataFrame:
    """Pages after a scanner claimed the first ``limit`` that may start ``step``: these are in progress since ``now``."""
    return _in_progress(pages, claimable(pages, step, limit), step, now)


def spell_pages_claimed(pages: DataFrame, most_books: int, limit: int, now: Column) -> DataFrame:
    """Pages after the spelling scanner's claim: of books being checked and of new ones up to ``most_books`` in all."""
    return _in_progress(pages, spell_claims(pages, most_books, limit), "spell_check", now)


def _in_progress(pages: DataFrame, ids: DataFrame, step: str, now: Column) -> DataFrame:
    marked, hit = _marked(pages, ids)
    since = {"last_updated": F.when(hit, now).otherwise(F.col("last_updated"))} if "last_updated" in pages.columns else {}
    return marked.withColumns({f"{step}_milestone": F.when(hit, "in_progress").otherwise(milestone(step)), **since}).select(*pages.columns)


def pages_released(pages: DataFrame, books: DataFrame, now: Column, minutes: int = PAGE_MINUTES) -> tuple[DataFrame, DataFrame]:
    """(pages, books) after the watchdog: steps in progress of pages silent for longer are idle, and their books rolled up anew.

    Retries stay as they are. A page that was never updated is not silent. Books without such a page stay as they are.
    """
    silent = F.coalesce(F.col("last_updated") < now - F.expr(f"INTERVAL {minutes} MINUTES"), F.lit(False))
    stuck = {s: silent & F.coalesce(milestone(s) == "in_progress", F.lit(False)) for s in STEPS}
    hit = stuck[STEPS[0]]
    for s in STEPS[1:]:
        hit = hit | stuck[s]
    after = pages.withColumns({f"{s}_milestone": F.when(stuck[s], "idle").otherwise(milestone(s)) for s in STEPS} | {"last_updated": F.when(hit, now).otherwise(F.col("last_updated"))})
    touched = pages.where(hit).select("book_id").distinct()
    new = book_milestones(after.join(touched, "book_id", "left_semi"))
    new = new.select(F.col("book_id").alias("__book"), *[F.col(f"{s}_milestone").alias(f"__{s}") for s in STEPS])
    both = books.join(new, books["id"] == F.col("__book"), "left")
    return after, both.withColumns({f"{s}_milestone": F.coalesce(F.col(f"__{s}"), milestone(s)) for s in STEPS}).select(*books.columns)


def issues_claimed(issues: DataFrame, rules: DataFrame, pages: int, now: Column) -> DataFrame:
    """Issues after a claim of ``pages`` pages' correctable ones: open, with a rule and offsets; these are processing since ``now``.

    Ten times as many issues as pages are looked at, in order of id.
    """
    with_offsets = issues.where("char_offset IS NOT NULL AND char_end IS NOT NULL")
    marked, hit = _marked(issues, correctable_claims(with_offsets, rules, pages, issues_a_page=10))
    return marked.withColumns({"status": F.when(hit, "processing").otherwise(F.col("status")), "claimed_at": F.when(hit, now).otherwise(F.col("claimed_at"))}).select(*issues.columns)


def issues_released(issues: DataFrame, now: Column, minutes: int = ISSUE_MINUTES) -> DataFrame:
    """Issues after stale claims went back: processing for longer means open again, without a time."""
    old = F.coalesce((F.col("status") == "processing") & (F.col("claimed_at") < now - F.expr(f"INTERVAL {minutes} MINUTES")), F.lit(False))
    return issues.withColumns({"status": F.when(old, "open").otherwise(F.col("status")), "claimed_at": F.when(~old, F.col("claimed_at"))}).select(*issues.columns)


def driven(pages: DataFrame, books: DataFrame, summaries: DataFrame, limit: int = 5000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, books, jobs) after one run of the pipeline driver.

    Idle pages of books that are not through start anew: no retries used, step ``ocr`` where they have none. Failed steps of
    pages with retries left are idle again. Books whose pages are all through are ready, or failed, with their milestones
    rolled up; each book that is ready now and has no summary gets a summary job, whose id makes it unique. At most
    ``limit`` pages, by id, start anew, and as many are reset.
    """
    open_books = books.where(F.col("status").isNull() | ~F.col("status").isin(*THROUGH)).select(F.col("id").alias("book_id"))
    fresh = pages.where(milestone("ocr") == "idle").join(open_books, "book_id", "left_semi").orderBy("id").limit(limit).select("id")
    started, hit = _marked(pages, fresh)
    started = started.withColumns({"retry_count": F.when(hit, 0).otherwise(F.col("retry_count")), "pipeline_step": F.when(hit, F.coalesce("pipeline_step", F.lit("ocr"))).otherwise(F.col("pipeline_step"))}).select(*pages.columns)
    failed = milestone(STEPS[0]).isin(*FAILED)
    for s in STEPS[1:]:
        failed = failed | milestone(s).isin(*FAILED)
    again, hit = _marked(started, started.where(F.coalesce(failed, F.lit(False)) & (F.col("retry_count") < MOST_RETRIES)).orderBy("id").limit(limit).select("id"))
    after = again.withColumns({f"{s}_milestone": F.when(hit & milestone(s).isin(*FAILED), "idle").otherwise(milestone(s)) for s in STEPS}).select(*pages.columns)
    settled = settled_books(books, after)
    ends = settled.select(F.col("id").alias("__book"), F.col("outcome").alias("__outcome"))
    rolled = book_milestones(after.join(settled.select(F.col("id").alias("book_id")), "book_id", "left_semi"))
    rolled = rolled.select(F.col("book_id").alias("__rolled"), *[F.col(f"{s}_milestone").alias(f"__{s}") for s in STEPS])
    both = books.join(ends, books["id"] == F.col("__book"), "left").join(rolled, books["id"] == F.col("__rolled"), "left")
    new = {"pipeline_step": F.when(F.col("__outcome") == "ready", "ready").when(F.col("__outcome") == "error", "failed").otherwise(F.col("pipeline_step")), "status": F.coalesce("__outcome", "status")}
    new |= {f"{s}_milestone": F.coalesce(F.col(f"__{s}"), milestone(s)) for s in STEPS if f"{s}_milestone" in books.columns}
    jobs = settled.where("outcome = 'ready'").join(summaries.select(F.col("book_id").alias("id")).distinct(), "id", "left_anti")
    return after, both.withColumns(new).select(*books.columns), jobs.select(F.lit("summary_job").alias("job"), F.col("id").alias("book_id"), F.concat(F.lit("summary:"), "id").alias("job_id"))
