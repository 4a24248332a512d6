"""Row-store writes as DataFrame functions: each takes tables and returns what they are afterwards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = ("ocr", "chunking", "embedding", "spell_check")


def inserted(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def updated(table: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Rows where ``where`` holds get new values; a null condition changes nothing."""
    hit = F.coalesce(where, F.lit(False))
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def deleted(table: DataFrame, where: Column) -> DataFrame:
    return table.where(~F.coalesce(where, F.lit(False)))


def upserted(table: DataFrame, rows: DataFrame, keys: list[str], overwrite: list[str] | None = None) -> DataFrame:
    """``rows`` win over rows of ``table`` with equal keys, in the columns of ``overwrite`` (all that ``rows`` has by default).

    ``rows`` holds a key once. One full outer join; columns that ``rows`` lacks stay, and are null in new rows.
    """
    over = [c for c in (overwrite if overwrite is not None else rows.columns) if c not in keys]
    new = rows.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in rows.columns if c not in keys], F.lit(True).alias("__is_new"))
    both = table.withColumn("__is_old", F.lit(True)).join(new, keys, "full_outer")

    def value(c: str) -> Column:
        if c in keys or c not in rows.columns:
            return F.col(c)
        insert = F.when(F.col("__is_old").isNull(), F.col(f"__new_{c}"))
        return (insert.when(F.col("__is_new"), F.col(f"__new_{c}")) if c in over else insert).otherwise(F.col(c)).alias(c)

    return both.select(*[value(c) for c in table.columns])


def latest_only(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the one that comes last: last writer wins."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("r")).select(*keys, "r.*")


def rechunked(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks after pages were chunked again: texts of ``new`` (book_id, page_number, chunk_index, text), vectors of these pages null, higher indexes gone."""
    keys = ["book_id", "page_number", "chunk_index"]
    pages = new.select("book_id", "page_number").distinct()
    others = chunks.join(pages, ["book_id", "page_number"], "left_anti")
    of_pages = chunks.join(new.select(*keys, F.col("text").alias("__text")), keys, "right")
    kept = of_pages.select(*[F.lit(None).cast(chunks.schema[c].dataType).alias(c) if c == "embedding" else F.col("__text").alias(c) if c == "text" else F.col(c) for c in chunks.columns])
    return others.unionByName(kept)


def patched(pages: DataFrame, patch: DataFrame) -> DataFrame:
    """Pages after a patch (id, text, status; nulls leave alone): a changed text goes back to chunking."""
    new = patch.select("id", F.col("text").alias("__text"), F.col("status").alias("__status"))
    both = pages.join(new, "id", "left")
    changed = F.col("__text").isNotNull() & ~F.col("text").eqNullSafe(F.col("__text"))
    set_to = {"is_indexed": F.lit(False), "pipeline_step": F.lit("chunking"), "chunking_milestone": F.lit("idle"), "spell_check_milestone": F.lit("idle")}
    out = both.withColumns({c: F.when(changed, v).otherwise(F.col(c)) for c, v in set_to.items() if c in pages.columns})
    out = out.withColumn("text", F.coalesce("__text", "text"))
    out = out.withColumn("status", F.coalesce("__status", "status")) if "status" in pages.columns else out
    return out.select(*pages.columns)


def reprocessed(pages: DataFrame, step: str) -> DataFrame:
    """Pages set back to ``step``: it and all later steps are idle, retries start over, and, but for spelling, the index is stale."""
    back = STEPS[STEPS.index(step) :]
    values = {f"{s}_milestone": F.lit("idle") for s in back} | {"retry_count": F.lit(0)}
    if step != "spell_check":
        values["is_indexed"] = F.lit(False)
    return pages.withColumns({c: v for c, v in values.items() if c in pages.columns})


def retried(pages: DataFrame) -> DataFrame:
    """Failed milestones idle again and retries at zero, on pages that have any; ``was_reset`` tells which."""
    failed = lambda s: F.col(f"{s}_milestone").isin("failed", "error")
    hit = reduce(Column.__or__, [F.coalesce(failed(s), F.lit(False)) for s in STEPS])
    out = pages.withColumn("was_reset", hit).withColumn("retry_count", F.when(hit, 0).otherwise(F.col("retry_count")))
    return out.withColumns({f"{s}_milestone": F.when(failed(s), "idle").otherwise(F.col(f"{s}_milestone")) for s in STEPS})


def cut_over(table: DataFrame, column: str, draft: str) -> DataFrame:
    """``column`` takes its draft where there is one; the draft column goes."""
    return table.withColumn(column, F.coalesce(draft, column)).drop(draft)


def counted_up(table: DataFrame, events: DataFrame, key: str, event_key: str, column: str) -> DataFrame:
    """``column`` grown by the number of events of each key."""
    n = events.groupBy(F.col(event_key).alias(key)).agg(F.count("*").alias("__n"))
    return table.join(n, key, "left").withColumn(column, F.col(column) + F.coalesce("__n", F.lit(0))).drop("__n")


def usage_added(usage: DataFrame, events: DataFrame) -> DataFrame:
    """(user_id, usage_date, cnt) after more events (user_id, ts)."""
    more = events.groupBy("user_id", F.to_date("ts").alias("usage_date")).agg(F.count("*").alias("cnt"))
    return usage.select("user_id", "usage_date", "cnt").unionByName(more).groupBy("user_id", "usage_date").agg(F.sum("cnt").alias("cnt"))


def without_book(book_id: str, **tables: DataFrame) -> dict[str, DataFrame]:
    """All tables without a book: ``books`` by id, the others by book_id."""
    return {name: deleted(t, F.col("id" if name == "books" else "book_id") == book_id) for name, t in tables.items()}


def word_added(dictionary: DataFrame, issues: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dictionary, issues) once ``words`` are known: their open issues are ignored."""
    grown = dictionary.select("word").unionByName(words.select("word")).distinct()
    known = words.select("word", F.lit(True).alias("__known")).distinct()
    status = F.when(F.col("__known") & (F.col("status") == "open"), "ignored").otherwise(F.col("status"))
    return grown, issues.join(known, "word", "left").withColumn("status", status).select(*issues.columns)


def issues_ignored(issues: DataFrame, page_id: int, ids: list[int]) -> DataFrame:
    return updated(issues, (F.col("page_id") == page_id) & F.col("id").isin(ids), status=F.lit("ignored"))


def tokens_valid(tokens: DataFrame, now: Column) -> DataFrame:
    return tokens.where(~F.col("revoked") & (F.col("expires_at") > now))


def tokens_purged(tokens: DataFrame, now: Column) -> DataFrame:
    """Tokens that are neither revoked nor expired at ``now``."""
    return deleted(tokens, F.col("revoked") | (F.col("expires_at") < now))


def touched(table: DataFrame, now: Column) -> DataFrame:
    return table.withColumn("updated_at", now)


def config_value(configs: DataFrame, key: str, default: str) -> DataFrame:
    """One row: a setting's value, or its default."""
    return configs.where(F.col("key") == key).agg(F.coalesce(F.max("value"), F.lit(default)).alias("value"))


def violations(table: DataFrame, unique: list[list[str]] = (), checks: dict[str, Column] | None = None) -> DataFrame:
    """(constraint, n): keys that occur more than once, and rows that fail a check (nulls pass)."""
    rows = [table.groupBy(*k).count().where("count > 1").agg(F.lit("unique " + ",".join(k)).alias("constraint"), F.count("*").alias("n")) for k in unique]
    rows += [table.agg(F.lit(name).alias("constraint"), F.count_if(~c).alias("n")) for name, c in (checks or {}).items()]
    return reduce(DataFrame.unionByName, rows)
