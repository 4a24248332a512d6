"""Uniform and weighted samples by keys: the rows with the least hashed keys are a sample without replacement.

A row's key is an exponential number made of a hash of its id and a seed, divided by its weight. The k least keys are found
without a sort of the table, samples of parts merge into that of the whole, and a rerun with the same seed gives the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def unit(key: Column, seed: Column | int) -> Column:
    """A number between 0 and 1 from the first 52 bits of a digest of seed and key."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    text = F.concat(seed.cast("string"), F.lit(":"), F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def sample_key(key: Column, seed: Column | int, weight: Column | None = None) -> Column:
    """The key by which rows are drawn; null for rows that are never drawn, as their weight is null, zero or less."""
    drawn = -F.log(unit(key, seed))
    return drawn if weight is None else F.when(weight > 0, drawn / weight)


def bottom_k(rows: DataFrame, k: int, seed: int = 0, key: str = "id", weight: str | None = None) -> DataFrame:
    """``rows`` that are drawn, with ``sample_key``: at most k, each task sending on no more than k. Ties go to the smaller key."""
    of = rows.withColumn("sample_key", sample_key(F.col(key), seed, F.col(weight) if weight else None))
    return of.where("sample_key IS NOT NULL").orderBy("sample_key", key).limit(k)


def merged(samples: list[DataFrame], k: int, key: str = "id") -> DataFrame:
    """The sample of all rows from samples of its parts, of at least k rows where the part has them, drawn with one seed."""
    return reduce(DataFrame.unionByName, samples).orderBy("sample_key", key).limit(k)


def bottom_k_by(rows: DataFrame, by: str, k: int, seed: Column | int = 0, key: str = "id", weight: str | None = None) -> DataFrame:
    """At most k rows of each group, with ``sample_key``; tasks cut their groups down before these meet."""
    of = rows.withColumn("sample_key", sample_key(F.col(key), seed, F.col(weight) if weight else None)).where("sample_key IS NOT NULL")
    nth = F.row_number().over(W.partitionBy(by).orderBy("sample_key", key))
    return of.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")
