"""Model surfaces: injectable functions, with stand-ins that need no network."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMBED_BATCH = 50


def hashed_embedding(texts: list[str], size: int = 64) -> list[list[float]]:
    """A stand-in for an embedding model: signed hashes of words, unit length, equal texts alike."""
    out = np.zeros((len(texts), size), np.float32)
    for row, text in zip(out, texts, strict=True):
        for word in (text or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            row[h % size] += 1 if h >> 63 else -1
        row /= np.linalg.norm(row) or 1
    return out.tolist()


def embed(texts: Column, model: Callable[[list[str]], list[list[float]]] = hashed_embedding, batch: int = EMBED_BATCH) -> Column:
    """Embeddings of texts, a bounded batch of them a call."""

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in frames:
            values = s.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(values), batch) for v in model(values[i : i + batch])])

    from pyspark.sql.functions import PandasUDFType

    return F.pandas_udf(run, "array<float>", PandasUDFType.SCALAR_ITER)(texts)


def embed_missing(chunks: DataFrame, model: Callable = hashed_embedding) -> DataFrame:
    """Chunks with the embeddings that were null; only those rows go to the model."""
    have = chunks.where("embedding IS NOT NULL")
    new = chunks.where("embedding IS NULL").withColumn("embedding", embed(F.col("text"), model))
    return have.unionByName(new.select(*chunks.columns))


def rewritten(question: str, rewrite: Callable[[str], str | None]) -> str:
    """A rewritten question, or the question itself where rewriting fails or gives nothing."""
    try:
        return (rewrite(question) or "").strip() or question
    except Exception:
        return question


def summarised(samples: DataFrame, summarise: Callable[[str], str], model: Callable = hashed_embedding) -> DataFrame:
    """(book_id, summary, embedding) of sampled book texts (book_id, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            summaries = [summarise(t) for t in f["text"]]
            yield pd.DataFrame({"book_id": f["book_id"], "summary": summaries, "embedding": model(summaries)})

    return samples.select("book_id", "text").mapInPandas(run, "book_id string, summary string, embedding array<float>")
