"""The ingestion state machine: milestones of pages, their roll-up to books, claims, retries and the outbox."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.operators.merge import STEPS

# Fixed values of the state machine.
DONE = {"ocr": "succeeded", "chunking": "succeeded", "embedding": "succeeded", "spell_check": "done"}
FAILED = ("failed", "error")
MOST_RETRIES = 3
NEXT_JOB = {"ocr_succeeded": "chunking_job", "chunking_succeeded": "embedding_job"}


def milestone(step: str) -> Column:
    return F.col(f"{step}_milestone")


def step_counts(pages: DataFrame, steps: tuple = STEPS) -> DataFrame:
    """(book_id, total, and for each step its done, failed and active pages), in one pass."""
    of = [F.count("*").alias("total")]
    for s in steps:
        of += [F.count_if(milestone(s) == DONE[s]).alias(s), F.count_if(milestone(s).isin(*FAILED)).alias(f"{s}_failed"), F.count_if(milestone(s) == "in_progress").alias(f"{s}_active")]
    return pages.groupBy("book_id").agg(*of)


def batch_stats(books: DataFrame, pages: DataFrame) -> DataFrame:
    """Step counts for each book; a ready book without pages counts as done throughout, any other as nothing; error_count sums failures."""
    known = books.select(F.col("id").alias("book_id"), "status", "total_pages").join(step_counts(pages), "book_id", "left")
    none = F.col("total").isNull()
    cols = []
    for s in STEPS:
        cols.append(F.when(none & (F.col("status") == "ready"), F.col("total_pages")).otherwise(F.coalesce(s, F.lit(0))).cast("long").alias(s))
        cols += [F.coalesce(f"{s}_{k}", F.lit(0)).alias(f"{s}_{k}") for k in ("failed", "active")]
    return known.select("book_id", *cols, reduce(Column.__add__, [F.coalesce(f"{s}_failed", F.lit(0)) for s in STEPS]).alias("error_count"))


def ready_stats(books: DataFrame, pages: DataFrame) -> DataFrame:
    """Counts with the short cut for ready books: text steps are all done; pending is what is left of each book's pages."""
    stats = batch_stats(books, pages).join(books.select(F.col("id").alias("book_id"), "status", F.col("total_pages").alias("n")), "book_id")
    for s in STEPS[:3]:
        stats = stats.withColumn(s, F.when(F.col("status") == "ready", F.col("n").cast("long")).otherwise(F.col(s)))
    return stats.select("book_id", *[c for s in STEPS for c in (s, (F.col("n") - F.col(s) - F.col(f"{s}_active") - F.col(f"{s}_failed")).cast("long").alias(f"{s}_pending"))])


def rolled_up(done: Column, failed: Column, active: Column, total: Column) -> Column:
    """A book's milestone from its pages' counts; the first rule that holds decides."""
    return (
        F.when(total == 0, "idle")
        .when(done == total, "complete")
        .when(failed == total, "failed")
        .when(done + failed == total, "partial_failure")
        .when((done > 0) | (failed > 0) | (active > 0), "in_progress")
        .otherwise("idle")
    )


def book_milestones(pages: DataFrame) -> DataFrame:
    counts = step_counts(pages)
    return counts.select("book_id", *[rolled_up(F.col(s), F.col(f"{s}_failed"), F.col(f"{s}_active"), F.col("total")).alias(f"{s}_milestone") for s in STEPS])


def _exhausted() -> Column:
    return reduce(Column.__or__, [milestone(s).isin(*FAILED) for s in STEPS[:3]]) & (F.col("retry_count") >= MOST_RETRIES)


def terminal_books(pages: DataFrame) -> DataFrame:
    """(book_id, total, succeeded, failed_exhausted) of books whose pages all are through: embedded, or failed for good."""
    through = milestone("embedding") == "succeeded"
    counts = pages.groupBy("book_id").agg(F.count("*").alias("total"), F.count_if(through | _exhausted()).alias("terminal"), F.count_if(through).alias("succeeded"), F.count_if(_exhausted()).alias("failed_exhausted"))
    return counts.where("total = terminal").drop("terminal")


def settled_books(books: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, outcome) of terminal books that change: ``ready`` where all pages came through, else ``error``.

    A book without a step may become ready but never error: unknown is not different from failed.
    """
    end = terminal_books(pages).withColumnRenamed("book_id", "id")
    both = books.select("id", "pipeline_step").join(end, "id")
    whole = F.col("failed_exhausted") == 0
    ready = whole & (F.col("pipeline_step").isNull() | (F.col("pipeline_step") != "ready"))
    error = ~whole & (F.col("pipeline_step") != "failed")
    return both.where(ready | error).select("id", F.when(ready, "ready").otherwise("error").alias("outcome"))


def reset_for_retry(pages: DataFrame) -> DataFrame:
    """Failed steps of pages with retries left are idle again, one retry used."""
    left = F.col("retry_count") < MOST_RETRIES
    hit = reduce(Column.__or__, [milestone(s).isin(*FAILED) for s in STEPS[:3]]) & left
    return pages.withColumns({f"{s}_milestone": F.when(left & milestone(s).isin(*FAILED), "idle").otherwise(milestone(s)) for s in STEPS[:3]} | {"retry_count": F.when(hit, F.col("retry_count") + 1).otherwise(F.col("retry_count"))})


def page_status() -> Column:
    """``step:milestone`` of the first step that is neither idle nor succeeded; ``idle`` where there is none."""
    label = F.lit(None).cast("string")
    for s in reversed(STEPS):
        label = F.when(~milestone(s).isin("idle", "succeeded"), F.concat(F.lit(f"{s}:"), milestone(s))).otherwise(label)
    return F.coalesce(label, F.lit("idle"))


def claimable(pages: DataFrame, step: str, limit: int) -> DataFrame:
    """Ids of the first pages whose ``step`` may start: idle, with the step before it succeeded."""
    before = STEPS[STEPS.index(step) - 1] if step != "ocr" else None
    ready = (milestone(step) == "idle") & (milestone(before) == DONE[before] if before else F.lit(True))
    return pages.where(ready).orderBy("id").limit(limit).select("id", "book_id")


def spell_claims(pages: DataFrame, most_books: int, limit: int) -> DataFrame:
    """Pages to spell-check: of books being checked already, and of new ones up to ``most_books`` in all, in order of id."""
    active = pages.where(milestone("spell_check") == "in_progress").select("book_id").distinct()
    idle = pages.where((milestone("spell_check") == "idle") & (milestone("embedding") == "succeeded"))
    fresh = idle.select("book_id").distinct().join(active, "book_id", "left_anti")
    room = active.agg(F.greatest(F.lit(0), F.lit(most_books) - F.count("*")).alias("room"))
    # The first books by id, no more than may be checked at all; these few are numbered.
    first = fresh.orderBy("book_id").limit(most_books).withColumn("nth", F.row_number().over(W.orderBy("book_id")))
    fresh = first.join(F.broadcast(room), F.col("nth") <= F.col("room"), "left_semi").select("book_id")
    return idle.join(active.unionByName(fresh), "book_id", "left_semi").orderBy("id").limit(limit).select("id", "book_id")


def failed_pages(pages: DataFrame, each: int, limit: int) -> DataFrame:
    """Ids of failed pages: at most ``each`` of every step by id, each id once."""
    legs = [pages.where(milestone(s).isin(*FAILED) & (F.col("retry_count") < MOST_RETRIES)).orderBy("id").limit(each).select("id") for s in STEPS]
    return reduce(DataFrame.unionAll, legs).distinct().orderBy("id").limit(limit)


def stale(rows: DataFrame, state: Column, since: str, now: Column, minutes: int) -> DataFrame:
    """Rows in a state since before ``minutes`` ago."""
    return rows.where(state & (F.col(since) < now - F.expr(f"INTERVAL {minutes} MINUTES")))


def dispatched(events: DataFrame, batch: int | None = None) -> DataFrame:
    """(id, page_id, event_type, job) of unprocessed events in order; events that start no job have a null job."""
    job = F.lit(None).cast("string")
    for kind, name in NEXT_JOB.items():
        job = F.when(F.col("event_type") == kind, name).otherwise(job)
    out = events.where(~F.col("processed")).select("id", "page_id", "event_type", job.alias("job"))
    return out if batch is None else out.orderBy("id").limit(batch)


def events_kept(events: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Events that retention keeps: unprocessed ones, and those of the last days."""
    return events.where(~(F.col("processed") & (F.col("created_at") < now - F.expr(f"INTERVAL {days} DAYS"))))


def remaining_work(pages: DataFrame, step: str) -> DataFrame:
    """(book_id, remaining): idle or running pages of a step; 0 lets the book go on."""
    return pages.groupBy("book_id").agg(F.count_if(milestone(step).isin("idle", "in_progress")).alias("remaining"))


def sampled_book_texts(pages: DataFrame, most: int) -> DataFrame:
    """(book_id, text): each book's pages that are no contents, joined by empty lines and cut to a sample for a summary.

    A text beyond ``most`` characters gives its first 40 %, a middle 20 % and its last 40 %, as ``text.sample_text`` does.
    Running lengths tell which characters of which pages these are: only they are gathered, ``most`` at most a book.
    """
    gap, rows = "\n\n", pages.where("NOT is_toc AND text IS NOT NULL AND text <> ''").select("book_id", "page_number", "id", "text")
    order = W.partitionBy("book_id").orderBy("page_number", "id")
    sizes = rows.select("book_id", "page_number", "id", (F.length("text") + len(gap)).alias("size"))
    placed = sizes.withColumn("start", F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    whole = sizes.groupBy("book_id").agg((F.sum("size") - len(gap)).alias("n"))
    head, mid, n = int(most * 0.4), int(most * 0.2), F.col("n")
    middle = F.floor(n / 2) - int(most * 0.1)
    stretch = lambda part, a, b: F.struct(F.lit(part).alias("part"), a.cast("long").alias("a"), b.cast("long").alias("b"))
    long = F.array(stretch(0, F.lit(0), F.lit(head)), stretch(1, middle, middle + mid), stretch(2, n - head, n))
    wanted = whole.select("book_id", F.explode(F.when(n > most, long).otherwise(F.array(stretch(0, F.lit(0), n)))).alias("w")).select("book_id", "w.*")
    hit = placed.join(wanted, "book_id").where((F.col("start") < F.col("b")) & (F.col("start") + F.col("size") > F.col("a"))).select("book_id", "id", "part", "start", F.greatest(F.col("a") - F.col("start"), F.lit(0)).alias("skip"), (F.least(F.col("b"), F.col("start") + F.col("size")) - F.greatest("a", "start")).alias("take"))
    piece = F.substring(F.concat("text", F.lit(gap)), (F.col("skip") + 1).cast("int"), F.col("take").cast("int"))
    pieces = hit.join(rows.select("book_id", "id", "text"), ["book_id", "id"]).select("book_id", "part", "start", piece.alias("piece"))
    parts = pieces.groupBy("book_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "piece"))), lambda x: x["piece"]), "").alias("text"))
    return parts.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "\n\n...\n\n").alias("text"))
