"""Vector search: cosine similarity in native higher-order functions, with metadata filters and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.catalog import among, overlaps

# Fixed defaults of the searches.
CHUNK_K, CHUNK_THRESHOLD, SUMMARY_K, SUMMARY_THRESHOLD = 16, 0.50, 20, 0.45


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is empty or has no length."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (size == 0), 0.0).otherwise(dot(a, b) / size)


def query_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def chunk_search(
    chunks: DataFrame, books: DataFrame, pages: DataFrame, query: Column, book_ids: list | None = None, categories: list | None = None, k: int = CHUNK_K, threshold: float = CHUNK_THRESHOLD
) -> DataFrame:
    """The k most similar chunks: book_id, page_number, text's id, similarity and the book's metadata.

    Filters reach the tables before the joins: chunks without a vector or on contents pages never count, similarity is
    above the threshold (strictly), no book ids means none and None means all. Ties go to the smaller id. Similarities are
    computed once a chunk, before the joins, and only the k best rows of each task meet.
    """
    b = books.where(overlaps("categories", categories)).select(F.col("id").alias("book_id"), "title", "author", "volume")
    p = pages.where(~F.col("is_toc")).select("book_id", "page_number")
    near = chunks.where(F.col("embedding").isNotNull() & among("book_id", book_ids)).withColumn("similarity", cosine(F.col("embedding"), query)).where(F.col("similarity") > threshold).drop("embedding")
    found = near.join(p, ["book_id", "page_number"]).join(b, "book_id")
    return found.orderBy(F.col("similarity").desc(), "id").limit(k)


def summary_search(summaries: DataFrame, books: DataFrame, query: Column, categories: list | None = None, book_ids: list | None = None, k: int | None = SUMMARY_K, threshold: float = SUMMARY_THRESHOLD) -> DataFrame:
    """(book_id, similarity) of the most similar summaries; books are joined only for a category filter."""
    near = summaries.where(F.col("embedding").isNotNull() & among("book_id", book_ids)).withColumn("similarity", cosine(F.col("embedding"), query)).where(F.col("similarity") > threshold).select("book_id", "similarity")
    if categories:
        near = near.join(books.where(overlaps("categories", categories)).select(F.col("id").alias("book_id")), "book_id", "left_semi")
    near = near.orderBy(F.col("similarity").desc(), "book_id")
    return near if k is None else near.limit(k)


def hierarchical_search(summaries: DataFrame, chunks: DataFrame, books: DataFrame, pages: DataFrame, query: Column, summary_k: int, summary_threshold: float, k: int, threshold: float) -> DataFrame:
    """Chunks of those books whose summaries come first: the summary search is a semi join of the chunk search.

    ``summary_k`` bounds what is broadcast, so it must be a number.
    """
    if summary_k is None:
        raise ValueError("summary_k must be a number")
    chosen = summary_search(summaries, books, query, k=summary_k, threshold=summary_threshold).select("book_id")
    return chunk_search(chunks.join(F.broadcast(chosen), "book_id", "left_semi"), books, pages, query, k=k, threshold=threshold)


def shaped(found: DataFrame) -> DataFrame:
    """Retrieval rows: an unknown title by name, an empty author as none."""
    return found.withColumns({"title": F.coalesce("title", F.lit("Unknown")), "author": F.nullif(F.col("author"), F.lit(""))})


def cache_key(query: str, book_ids: list[str] | None, categories: list[str] | None) -> Column:
    """A search's cache key: digests of the vector, of the sorted books (or ``all``) and of the categories."""
    of = lambda xs: F.md5(F.lit(",".join(sorted(xs)))) if xs else F.lit("all")
    scope = F.lit("multi") if book_ids is None or len(book_ids) != 1 else F.lit("single")
    return F.concat_ws(":", F.lit("search"), scope, F.md5(F.lit(query)), of(book_ids), *([of(categories)] if categories else []))
