"""Connected components of a link table by alternating large-star and small-star rounds.

Every round is joins and aggregations over the links; rounds end lineage in the shared folder, so a lost executor costs
one round. Hub nodes only skew joins, which adaptive execution splits. The driver sees a count and a checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``links`` (a long, b long).

    Self links and nulls are ignored; an empty table gives an empty table.
    """
    now = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct()
    now = written(now)
    mark = _mark(now)
    for _ in range(most_rounds):
        if mark[0] == 0:
            break
        now = written(_small_star(_large_star(now)))
        was, mark = mark, _mark(now)
        if mark == was:
            break
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))


def _mark(links: DataFrame) -> tuple:
    r = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 40)).alias("x")).first()
    return r["n"], r["x"]


def _large_star(links: DataFrame) -> DataFrame:
    """Every node ties its larger neighbours to the smallest of its neighbours and itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("u"), F.least("least", "a").alias("least"))
    return both.join(least, F.col("a") == F.col("u")).where(F.col("b") > F.col("u")).select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node ties itself and its smaller neighbours to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    smaller = links.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).where(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return smaller.unionByName(least.select("a", F.col("least").alias("b"))).distinct()
