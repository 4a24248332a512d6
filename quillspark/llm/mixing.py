"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations throughout.

A source that gives ``target`` words of its ``source_size`` copies each document ``target / source_size`` times on average.
The whole part of that is certain; the fractional part is a probability that pivotal rounding turns into 0 or 1: two
documents meet, mass moves from one to the other, in words, until one of them is certain, with odds that leave every
document's expected copies alone. So a pair's words stay as they are, and what is left of a block of documents is one
document with a fraction. Blocks of about ``BLOCK`` documents of a source, dealt by a hash of the id, are the leaves of a
reduction tree; their left-overs meet in blocks again until one is left of each source, which its own odds decide. Every
document with a fraction takes this way, however few there are. In a block documents meet from the largest to the smallest:
as of two that meet the larger usually stays open, the smaller ones settle it, and what is left in the end is small. The
words taken thus differ from the target by less than that last document's size.

Sources are dealt into blocks by their own row counts, so a hot source has more blocks, never larger ones. Randomness is
a hash of ids, so reruns agree.

Null sources are a source of their own, after all others. Null texts have size 0; documents of size 0 take part with
independent odds and no words. Repeated rows (same doc_id, source and size) share one entry whose copies are dealt evenly
among them. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.llm.common import WORD, whole_row, written

WEIGHTS, SHARE, MOST_COPIES = (3, 1, 2), 1.5, 2
BLOCK = 128
#: Repeated rows that are numbered together.
STRETCH = 10_000
#: With at most so many sources their table of numbers is broadcast; with more it is joined by a shuffle.
BROADCAST_SOURCES = 20_000

ITEM = "struct<doc_id:bigint,size:bigint,m:bigint,whole:bigint,p:double>"
DONE = "struct<doc_id:bigint,size:bigint,m:bigint,copies:bigint>"


def _let(value: Column, fn) -> Column:
    """fn(value), with value computed once."""
    return F.transform(F.array(value), fn)[0]


def _unit(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) from a hash of ``cols``."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)).cast("double") / float(1 << 52)


def ordinals(of: DataFrame) -> DataFrame:
    """``of`` with ``at``: each source's place in order of code points, null last, from 0. Sorted by ranges, not in one task."""
    order = F.col("source").asc_nulls_last()
    ranged = written(of.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("part").agg(F.count("*").alias("k"))  # a row for each range
    before = parts.select("part", F.coalesce(F.sum("k").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(W.partitionBy("part").orderBy(order)) - 1
    return ranged.withColumn("nth", nth).join(before, "part").withColumn("at", F.col("before") + F.col("nth")).drop("part", "before", "nth")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """(source, n, source_size, target) from (source, size): targets by water filling.

    Sources by code point, null last, weigh ``weights`` in turn; a target stops at ``most`` times its source's size and the
    excess goes to the others by weight. The level rises from sum to sum over the sources until it fills no further one.
    """
    of = sizes.groupBy("source").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    weigh = F.lit(float(weights[-1]))
    for i, w in enumerate(weights[:-1]):
        weigh = F.when(F.col("at") % len(weights) == i, F.lit(float(w))).otherwise(weigh)
    of = written(ordinals(of).select("source", "n", "source_size", weigh.alias("w"), (F.col("source_size") * float(most)).alias("most")))
    total = float(of.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * share
    level = 0.0
    while True:  # each round fills at least one further source
        full = F.col("most") <= F.col("w") * level
        filled, left = of.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("w")))).first()
        rising = (total - (filled or 0.0)) / left if left else level
        if rising <= level:
            break
        level = rising
    return of.select("source", "n", "source_size", F.least("most", F.col("w") * level).alias("target") if left else F.col("most").alias("target"))


def _pivot(items: Column) -> Column:
    """struct(done, left): the items of a block made certain two by two, and what is left with a fraction."""
    done = lambda x, bit: F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["m"].alias("m"), (x["whole"] + bit).alias("copies"))
    left = lambda x, p: F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["m"].alias("m"), x["whole"].alias("whole"), p.alias("p"))

    def meet(r: Column, x: Column) -> Column:
        s, t = r["size"].cast("double"), x["size"].cast("double")
        p, q = r["p"], x["p"]
        # Words that r can gain from x, and lose to x.
        sums = F.struct(((1 - p) * s).alias("r_up"), (q * t).alias("x_down"), (p * s).alias("r_down"), ((1 - q) * t).alias("x_up"))

        def moved(v: Column) -> Column:
            up, down = F.least(v["r_up"], v["x_down"]), F.least(v["r_down"], v["x_up"])
            gains = _unit("pivot", r["doc_id"], x["doc_id"], r["size"], x["size"]) * (up + down) < down
            both = lambda a, b: F.struct(a.alias("done"), b.alias("left"))
            return (
                F.when(gains & (v["r_up"] <= v["x_down"]), both(done(r, F.lit(1)), left(x, q - up / t)))
                .when(gains, both(done(x, F.lit(0)), left(r, p + up / s)))
                .when(v["r_down"] <= v["x_up"], both(done(r, F.lit(0)), left(x, q + down / t)))
                .otherwise(both(done(x, F.lit(1)), left(r, p - down / s)))
            )

        return _let(sums, moved)

    def step(acc: Column, x: Column) -> Column:
        return F.when(acc["left"].isNull(), F.struct(acc["done"].alias("done"), x.alias("left"))).otherwise(
            _let(meet(acc["left"], x), lambda v: F.struct(F.concat(acc["done"], F.array(v["done"])).alias("done"), v["left"].alias("left")))
        )

    zero = F.struct(F.array().cast(f"array<{DONE}>").alias("done"), F.lit(None).cast(ITEM).alias("left"))
    return F.aggregate(items, zero, step)


def _join_sources(rows: DataFrame, of: DataFrame, n: int) -> DataFrame:
    of = of.withColumnRenamed("source", "__s")
    return rows.join(F.broadcast(of) if n <= BROADCAST_SOURCES else of, rows["source"].eqNullSafe(of["__s"])).drop("__s")


def copies(sizes: DataFrame, block: int = BLOCK, of: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """From (doc_id, source, size): items (doc_id, source, size, m, copies) and the sources' numbers.

    ``m`` counts repeated rows; ``copies`` is what all of them together are copied. ``sizes`` is read more than once;
    ``of`` are the sources' targets, as ``targets`` gives them.
    """
    of = written(targets(sizes) if of is None else of)
    n, most = of.agg(F.count("*"), F.max("n")).first()
    items = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m"))
    items = _join_sources(items, of.select("source", "n", (F.col("target") / F.greatest("source_size", F.lit(1))).alias("f")), n)
    share = F.col("m") * F.col("f")
    items = items.withColumn("whole", F.floor(share + 1e-12).cast("bigint")).withColumn("p", F.greatest(share - F.col("whole"), F.lit(0.0)))
    odds = F.when(_unit("empty", F.col("doc_id"), F.col("source")) < F.col("p"), 1).otherwise(0)
    sure = (F.col("size") == 0) | (F.col("p") < 1e-12)
    items = items.select("doc_id", "source", "size", "m", "whole", "p", sure.alias("sure"), (F.col("whole") + F.when(F.col("size") == 0, odds).otherwise(0)).alias("copies"), F.ceil(F.col("n") / block).cast("bigint").alias("blocks"))
    done = [items.where("sure").select("doc_id", "source", "size", "m", "copies")]
    item = F.struct("doc_id", "size", "m", "whole", "p")
    rest = items.where(~F.col("sure")).select("source", "blocks", F.pmod(F.xxhash64(F.lit("block"), "doc_id", "size"), F.col("blocks")).alias("block"), item.alias("item"))
    order = lambda x: F.struct((-x["size"]).alias("by"), F.xxhash64(F.lit("order"), x["doc_id"], x["size"]).alias("h"), x.alias("item"))
    tree = most or 0
    while tree > 0:  # each level divides the blocks of the largest source by BLOCK
        level = rest.groupBy("source", "blocks", "block").agg(F.transform(F.array_sort(F.collect_list(order(F.col("item")))), lambda x: x["item"]).alias("items"))
        level = written(level.select("source", "blocks", "block", _pivot(F.col("items")).alias("r")))
        done.append(level.select("source", F.explode("r.done").alias("d")).select("d.doc_id", "source", "d.size", "d.m", "d.copies"))
        rest = level.where(F.col("r.left").isNotNull()).select("source", F.ceil(F.col("blocks") / block).cast("bigint").alias("blocks"), F.pmod("block", F.ceil(F.col("blocks") / block)).alias("block"), F.col("r.left").alias("item"))
        tree = 0 if tree <= block else -(-tree // block)
    last = F.when(_unit("last", F.col("item.doc_id"), F.col("item.size")) < F.col("item.p"), 1).otherwise(0)
    done.append(rest.select("item.doc_id", "source", "item.size", "item.m", (F.col("item.whole") + last).cast("bigint").alias("copies")))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out, of


def document_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words of each document's whole text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row for each document."""
    items, of = copies(written(document_sizes(docs)))
    # Rows that repeat are numbered in stretches of bounded length, dealt out anew: none is in one task or one array.
    parts = items.where(F.col("m") > STRETCH).select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / STRETCH))).alias("part"))
    parts = parts.repartition("doc_id", "source", "size", "part").unionByName(items.where(F.col("m") <= STRETCH).withColumn("part", F.lit(0).cast("long")))
    first = F.col("part") * STRETCH + 1
    each = parts.select("doc_id", "source", "size", "m", "copies", F.explode(F.sequence(first, F.least("m", first + STRETCH - 1))).alias("i"))
    each = each.select("doc_id", "source", "size", (F.floor(F.col("copies") / F.col("m")) + F.when(F.col("i") <= F.col("copies") % F.col("m"), 1).otherwise(0)).cast("long").alias("copies"))
    n = of.count()
    return _join_sources(each, of.drop("n"), n).select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def numbered(rows: DataFrame, salts: int = 64) -> DataFrame:
    """Rows with ``i``, their number from 1 among those of one (id, source, size), in order of their texts' hashes ``h``.

    Rows of one text are dealt into ``salts`` parts, which are numbered apart and put behind one another by their counts, so
    no task gets all rows that repeat one document. The parts are drawn once: rows with them are written.
    """
    keys = ["id", "source", "size", "h", "salt"]
    dealt = written(rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts))))
    upto = W.partitionBy(*keys[:3]).orderBy("h", "salt").rowsBetween(W.unboundedPreceding, -1)
    before = dealt.groupBy(*keys).agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(upto), F.lit(0)))
    before = before.select(*[F.col(c).alias(f"of_{c}") for c in keys], "before")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in keys])
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(F.lit(1)))
    return dealt.withColumn("nth", nth).join(before, same).withColumn("i", F.col("before") + F.col("nth")).drop("salt", "nth", "before", *[f"of_{c}" for c in keys])


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents, all columns, each as often as the mix copies it."""
    found = written(mix(docs))
    of_id = found.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("m")).where("copies > 0")
    of_id = of_id.withColumnsRenamed({"doc_id": "of_id", "source": "of_source", "size": "of_size"})
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("text").alias("h"))
    # Texts are shuffled at any size, so plans don't differ from small tables to large ones.
    same = F.col("id").eqNullSafe(F.col("of_id")) & F.col("source").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size"))
    joined = rows.join(of_id.hint("merge"), same).drop("of_id", "of_source", "of_size")
    times = joined.where("m = 1").select("row", F.col("copies").alias("n"))
    if of_id.where("m > 1").limit(1).count():
        share = F.floor(F.col("copies") / F.col("m")) + F.when(F.col("i") <= F.col("copies") % F.col("m"), 1).otherwise(0)
        times = times.unionByName(numbered(joined.where("m > 1")).select("row", share.cast("long").alias("n")).where("n > 0"))
    return times.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("row.*")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    from quillspark.llm.common import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
