"""Recursive, overlapping chunking as a table function over Arrow batches."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import cleaned, text_column

# Fixed values of the splitter.
SIZE, OVERLAP, SEPARATORS = 500, 100, ("\n\n", "\n", ". ", " ", "")
#: Characters of chunks that are sent on at a time.
SENT = 1_000_000


def chunks(text: str | None, size: int = SIZE, overlap: int = OVERLAP, separators: tuple = SEPARATORS) -> list[str]:
    """Chunks of at most about ``size`` characters that overlap by at most ``overlap``.

    The first separator that occurs parts the text; parts shorter than ``size`` are put together again, longer ones are
    parted by the separators after it, or cut at ``size`` where none is left.
    """
    return list(_split(text, size, overlap, separators)) if text else []


def _split(text: str, size: int, overlap: int, separators: tuple) -> Iterator[str]:
    k = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    by, finer = separators[k], separators[k + 1 :]
    run: list[str] = []
    for part in text.split(by) if by else text:
        if len(part) < size:
            run.append(part)
            continue
        yield from _joined(run, by, size, overlap)
        run = []
        yield from _split(part, size, overlap, finer) if finer else (part[:size],)
    yield from _joined(run, by, size, overlap)


def _joined(parts: list[str], by: str, size: int, overlap: int) -> Iterator[str]:
    """Parts put together up to ``size``; a chunk begins with those last parts of the one before that fit the overlap."""
    held: deque[str] = deque()
    cost = lambda: sum(map(len, held)) + len(by) * max(0, len(held) - 1)
    total = 0
    for part in parts:
        needs = lambda: total + len(part) + len(by) * bool(held)  # noqa: B023, E731
        if held and needs() > size:
            if chunk := by.join(held):
                yield chunk
            while held and (total > overlap or total > 0 and needs() > size):
                held.popleft()
                total = cost()
        held.append(part)
        total = cost() if len(held) < 3 else total + len(part) + len(by)
    if held and (chunk := by.join(held)):
        yield chunk


def chunk_table(pages: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP, separators: tuple = SEPARATORS) -> DataFrame:
    """(book_id, page_number, chunk_index, text): chunks of cleaned pages; pages of contents have none.

    Pages are split one by one and chunks sent on some ``SENT`` characters at a time, so no batch of pages is held as chunks.
    """
    some = pages.where(~F.col("is_toc")).select("book_id", "page_number", F.col(text).alias("text"))
    kind = T.StructType([some.schema["book_id"], some.schema["page_number"], T.StructField("chunk_index", T.IntegerType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> pa.RecordBatch:
            at = pa.array(rows, pa.int32())
            return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(index, pa.int32()), pa.array(made, pa.string())], names=kind.names)

        for batch in batches:
            rows, index, made, held = [], [], [], 0
            for row, t in enumerate(batch.column(2)):
                if not (own := t.as_py()):
                    continue
                for i, chunk in enumerate(_split(own, size, overlap, separators)):
                    rows.append(row), index.append(i), made.append(chunk)
                    held += len(chunk)
                    if held >= SENT:
                        yield sent()
                        rows, index, made, held = [], [], [], 0
            if rows:
                yield sent()

    return some.mapInArrow(run, kind)


def page_chunks(text: Column, is_toc: Column) -> Column:
    """Chunks of one page's raw text as an array: none for contents, cleaned text split otherwise."""
    split = text_column(lambda t: chunks(cleaned(t)), "array<string>")
    return F.when(is_toc, F.array().cast("array<string>")).otherwise(split(text))
