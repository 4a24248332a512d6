"""Catalog operators: lookups, predicates, search, facets, works and volumes. All are lazy DataFrame transformations."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The sort keys that the listing accepts; all others sort by upload date.
SORT_KEYS = {"title": "title", "author": "author"}
MOST_PER_PAGE = 50


def lookup(df: DataFrame, **keys) -> DataFrame:
    """Rows equal in all given columns; names the table lacks are ignored, a null key matches nulls."""
    known = [F.col(k).isNull() if v is None else F.col(k) == v for k, v in keys.items() if k in df.columns]
    return df.where(reduce(Column.__and__, known)) if known else df


def exists(df: DataFrame, **keys) -> DataFrame:
    """One row: whether a row is equal in all given columns. No more than one row is counted."""
    return lookup(df, **keys).limit(1).agg((F.count("*") > 0).alias("found"))


def scan(df: DataFrame, order_by: str = "id", skip: int = 0, limit: int | None = 100) -> DataFrame:
    """An ordered slice; an unknown order column is skipped."""
    out = df.orderBy(F.col(order_by).asc_nulls_last()) if order_by in df.columns else df
    out = out.offset(skip) if skip else out
    return out if limit is None else out.limit(limit)


def page_of(df: DataFrame, order: list[Column], page: int, page_size: int) -> DataFrame:
    """Page ``page`` (from 1) of at most MOST_PER_PAGE rows."""
    size = min(max(page_size, 1), MOST_PER_PAGE)
    return df.orderBy(*order).offset((max(page, 1) - 1) * size).limit(size)


def listing_order(key: str, descending: bool, date: str) -> list[Column]:
    col = F.col(SORT_KEYS.get(key, date))
    return [col.desc_nulls_first() if descending else col.asc_nulls_last(), F.col("id")]


def among(col: str, values: list | None) -> Column:
    """No filter for None, no rows for an empty list."""
    return F.lit(True) if values is None else F.col(col).isin(values) if values else F.lit(False)


def overlaps(array: str, values: list[str] | None) -> Column:
    """Whether arrays share a value; a null comparison counts as no."""
    if not values:
        return F.lit(True)
    return F.coalesce(F.arrays_overlap(array, F.array(*map(F.lit, values))), F.lit(False))


def visible(staff: bool) -> Column:
    """Staff see all; others see ready books that are public or say nothing."""
    return F.lit(True) if staff else (F.col("status") == "ready") & (F.col("visibility").isNull() | (F.col("visibility") == "public"))


def split_volume(q: str) -> tuple[str, int | None]:
    """A search text and the volume that ends it: ``'history 2'`` is ``('history', 2)``."""
    m = re.search(r"\s+(\d+)\s*$", q)
    return (q[: m.start()].strip(), int(m[1])) if m else (q.strip(), None)


def spellings(word: str) -> list[str]:
    """Both ways to write U+0626: as one letter, and as U+064A with U+0654."""
    one, two = "\u0626", "\u064a\u0654"
    return list(dict.fromkeys([word, word.replace(one, two), word.replace(two, one)]))


def search(q: str, with_categories: bool = True) -> Column:
    """Every word is somewhere in title, author or (without a volume) categories, whatever the case; a volume at the end must be the book's.

    ``%`` and ``_`` in a word stand for any characters and for one.
    """
    text, volume = split_volume(q)
    fields = [F.col("title"), F.col("author")] + [F.array_join("categories", ",")] * (with_categories and volume is None)
    hit = lambda w: reduce(Column.__or__, [F.coalesce(F.ilike(f, F.lit(f"%{s}%")), F.lit(False)) for f in fields for s in spellings(w)])
    found = [hit(w) for w in text.split()] + ([F.col("volume") == volume] if volume is not None else [])
    return reduce(Column.__and__, found, F.lit(True))


def title_or_author(q: str) -> Column:
    """Substring of title or author, whatever the case; a volume at the end must match unless nothing is left before it."""
    text, volume = split_volume(q)
    text, volume = (text, volume) if text or volume is None else (q, None)
    like = F.ilike(F.col("title"), F.lit(f"%{text}%")) | F.coalesce(F.ilike(F.col("author"), F.lit(f"%{text}%")), F.lit(False))
    return like if volume is None else like & (F.col("volume") == volume)


def series_sorted(books: DataFrame, date: str, by_author: bool = True) -> DataFrame:
    """Books with the latest date of their work, sorted by it, then title, author, volume; ``nth`` numbers the books of a work.

    The sort is by ranges; a listing's page takes its slice with ``offset`` and ``limit``.
    """
    work = W.partitionBy(*["title", "author"][: 1 + by_author])
    within = [F.col("author").asc_nulls_last(), F.col("volume").asc_nulls_first(), F.col("id")]
    numbered = books.withColumns({"latest": F.max(date).over(work), "nth": F.row_number().over(work.orderBy(*within))})
    return numbered.orderBy(F.col("latest").desc_nulls_last(), "title", *within)


def latest_of_works(books: DataFrame, date: str) -> DataFrame:
    """One book of each (title, author): the latest."""
    nth = F.row_number().over(W.partitionBy("title", "author").orderBy(F.col(date).desc_nulls_last(), "id"))
    return books.withColumn("nth", nth).where("nth = 1").drop("nth")


def sister_volumes(books: DataFrame, book_id: str) -> DataFrame:
    """Other books of the same title and author (no author equals no author) that aren't in error, by volume."""
    anchor = F.broadcast(books.where(F.col("id") == book_id).select(F.col("title").alias("t"), F.col("author").alias("a")).limit(1))
    of = books.join(anchor, F.col("title").eqNullSafe(F.col("t")) & F.col("author").eqNullSafe(F.col("a")), "left_semi")
    return of.where(F.col("status") != "error").orderBy(F.col("volume").asc_nulls_first(), "id")


def clean_category(c: Column) -> Column:
    """Without white space and quotation marks at either end."""
    strip = lambda x: F.regexp_replace(x, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    return strip(F.btrim(strip(c), F.lit('"')))


def category_facets(books: DataFrame) -> DataFrame:
    """(category, n) of cleaned categories."""
    each = books.select(F.explode("categories").alias("c")).select(F.btrim("c", F.lit(' "')).alias("category"))
    return each.groupBy("category").agg(F.count("*").alias("n"))


def books_by_status(books: DataFrame) -> DataFrame:
    """(status, n) by the step a book is at: pipeline step, or else status, under today's names."""
    now = F.lower(F.coalesce("pipeline_step", "status"))
    name = F.when(now.isin("ocr_processing", "ocr_done"), "ocr").when(now == "indexing", "embedding").otherwise(now)
    return books.groupBy(name.alias("status")).agg(F.count("*").alias("n"))


def work_counts(books: DataFrame, staff: bool = True) -> DataFrame:
    """(works, ready): distinct (title, author, status, visibility), and those of them that guests see.

    For others than staff, who are given only what they see, ``ready`` is all.
    """
    works = books.where(visible(staff)).select("title", "author", "status", "visibility").distinct()
    return works.agg(F.count("*").alias("works"), (F.count_if(visible(False)) if staff else F.count("*")).alias("ready"))


def without_summary(books: DataFrame, summaries: DataFrame) -> DataFrame:
    return books.join(summaries.select(F.col("book_id").alias("id")), "id", "left_anti")


def summary_backfill(books: DataFrame, summaries: DataFrame, limit: int = 5) -> DataFrame:
    """Ready books whose summary is missing or null, in order of id."""
    have = summaries.where("summary IS NOT NULL").select(F.col("book_id").alias("id"))
    return books.where("status = 'ready'").join(have, "id", "left_anti").orderBy("id").limit(limit)


def autocomplete(dictionary: DataFrame, prefix: str, limit: int = 20) -> DataFrame:
    """Words that begin with a prefix: shorter first, then by letter."""
    return dictionary.where(F.lower("word").startswith(prefix.lower())).orderBy(F.length("word"), "word").limit(limit)


def suggestions(books: DataFrame, pattern: str, limit: int = 10) -> DataFrame:
    """(text, kind): titles, authors and categories that match, each text once, titles first.

    Patterns shorter than two characters suggest nothing. The first ``limit`` books by id are looked at, as the listing does.
    """
    if len(pattern) < 2:
        return books.limit(0).select(F.col("title").alias("text"), F.lit("title").alias("kind"))
    hit = lambda c: F.coalesce(c.rlike(f"(?iu){pattern}"), F.lit(False))
    found = books.where(hit(F.col("title")) | hit(F.col("author")) | F.exists("categories", hit)).orderBy("id").limit(limit)
    slot = lambda rank, kind, text: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), text.alias("text"))
    slots = F.concat(F.array(slot(0, "title", F.col("title")), slot(1, "author", F.col("author"))), F.transform("categories", lambda c: slot(2, "category", clean_category(c))))
    each = found.select("id", F.posexplode(slots).alias("pos", "s")).where(hit(F.col("s.text")))
    first = F.row_number().over(W.partitionBy("s.text").orderBy("id", "pos"))
    return each.withColumn("nth", first).where("nth = 1").orderBy("s.rank", "id", "pos").limit(limit).select("s.text", "s.kind")


def proverb_pool(proverbs: DataFrame, keywords: list[str], otherwise: str) -> DataFrame:
    """(id, text) of proverbs with any keyword, or one row with ``otherwise`` where none has."""
    from quillspark.functions.text import spelling_pattern

    found = proverbs.where(F.col("text").rlike("(?iu)" + "|".join(map(spelling_pattern, keywords)))).select("id", "text")
    none = found.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("long").alias("id"), F.lit(otherwise).alias("text"))
    return found.unionByName(none)


def random_pivot(rows: DataFrame, unit: float) -> DataFrame:
    """The first row whose id is at or after a pivot between the least and the greatest id; ``unit`` in [0, 1) places it."""
    ends = rows.agg((F.floor(F.min("id") + (F.max("id") - F.min("id") + 1) * F.lit(unit))).cast("long").alias("pivot"))
    return rows.join(F.broadcast(ends), F.col("id") >= F.col("pivot")).drop("pivot").orderBy("id").limit(1)


def users_matching(users: DataFrame, role: str | None = None, active: bool | None = None, q: str | None = None) -> DataFrame:
    found = lookup(users, **({"role": role} if role else {}), **({"is_active": active} if active is not None else {}))
    like = lambda c: F.coalesce(F.lower(c).contains(q.lower()), F.lit(False))
    return found.where(like("email") | like("display_name")) if q else found


def duplicate_contents(files: DataFrame, content: str = "text") -> DataFrame:
    """(hash, n, first_id) of contents that occur more than once, by SHA-256."""
    return files.groupBy(F.sha2(content, 256).alias("hash")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def unknown_files(found: DataFrame, books: DataFrame) -> DataFrame:
    """Files whose name and content no book has yet; of equal contents the first by name."""
    new = found.join(books.select("file_name"), "file_name", "left_anti").join(books.select("content_hash"), "content_hash", "left_anti")
    first = F.row_number().over(W.partitionBy("content_hash").orderBy("file_name"))
    return new.withColumn("nth", first).where("nth = 1").drop("nth")


def full_texts(pages: DataFrame) -> DataFrame:
    """(book_id, page_number, line): each book's text under ``[[PAGE n]]`` marks, one row a page, sorted within its book.

    A book's text is its lines joined by empty lines; it is never put together in one row.
    """
    line = F.concat(F.lit("[[PAGE "), F.col("page_number"), F.lit("]]\n"), F.coalesce("text", F.lit("")))
    rows = pages.select("book_id", "page_number", line.alias("line"))
    return rows.repartition("book_id").sortWithinPartitions("book_id", "page_number", "line")


def text_digests(lines: DataFrame) -> DataFrame:
    """(book_id, digest): MD5 of each book's text, without blanks at its end, as ``full_texts`` streams it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, blanks = None, None, ""
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([digest.hexdigest()], pa.string())], names=["book_id", "digest"])
        for batch in batches:
            for book, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is None or book != now:
                    if digest is not None:
                        yield row()
                    now, digest, blanks = book, hashlib.md5(), ""
                else:
                    line = f"\n\n{line}"
                text = blanks + line
                kept = text.rstrip(" ")
                digest.update(kept.encode("utf-8", "surrogatepass"))
                blanks = text[len(kept) :]
        if digest is not None:
            yield row()

    return lines.select("book_id", "line").mapInArrow(run, "book_id string, digest string")


def page_stubs(books: DataFrame) -> DataFrame:
    """(book_id, page_number) for pages 1 to total_pages."""
    return books.where("total_pages > 0").select(F.col("id").alias("book_id"), F.explode(F.sequence(F.lit(1), "total_pages")).alias("page_number"))


def dictionary_page(dictionary: DataFrame, page: int, page_size: int) -> DataFrame:
    """A page of the dictionary, the latest words (by id) first."""
    return page_of(dictionary, [F.col("id").desc()], page, page_size)
