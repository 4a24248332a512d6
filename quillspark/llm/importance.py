"""Importance resampling towards a target corpus, over postings that are partitioned by bucket.

Every document's features (runs of up to ``n`` words) fall into buckets by crc32. Documents are read in packs, and a pack's
postings (bucket, document, count), inverted to lists by bucket, are cut into parts of neighbouring buckets. All blocks of a
part are shuffled together with that part's counts in both corpora, so a bucket's gain, the logarithm of its share in the
target over its share in the documents, is computed where its postings are. A block gives each of its documents one sum of
gains, and a last shuffle by pack adds these up to the documents' weights. Gumbel noise from a hash of the id makes the
highest scores a sample without replacement.

A frequent bucket has a posting for almost every document. Its blocks are dealt into groups of about ``GROUP`` packs, each
with a copy of the part's gains, so no task gets all of them; blocks stream, one at a time. Sorting for ranks is by ranges,
repeated rows being told apart by their places.

A null text has no words. A null doc_id is hashed as an empty one, and is behind all others where scores are equal. Repeated
rows get equal scores and neighbouring ranks. An empty table gives an empty result, an empty target equal gains but for the
documents' own counts; other columns are not read. A long text is a pack of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.llm.common import written
from quillspark.llm.ngram_lm import squeezed, unsqueezed

BUCKETS, ORDER = 10_000, 1
#: Parts of neighbouring buckets, and packs whose blocks are one group of a part.
PARTS, GROUP = 64, 256
#: Words and documents of a pack, about.
PACK_WORDS, PACK_DOCS = 1_000_000, 20_000
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024

#: Bytes that are parts of words stay, A to Z in lower case; all other bytes part words.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

BLOCKS = "pack long, part int, counts array<long>, block binary"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def features(words: list[bytes], n: int) -> Iterator[bytes]:
    """All runs of 1 to n consecutive words, joined by one space."""
    yield from words
    for k in range(2, n + 1):
        for i in range(len(words) - k + 1):
            yield b" ".join(words[i : i + k])


def _packed(doc: list[np.ndarray], buckets: int, parts: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(part, counts by bucket, block) of a pack's documents, each given by the buckets of its features."""
    of = np.repeat(np.arange(len(doc)), [len(d) for d in doc])
    keys, count = np.unique(np.concatenate(doc).astype(np.int64) * len(doc) + of, return_counts=True)
    bucket, of = keys // len(doc), keys % len(doc)
    width = -(-buckets // parts)
    edges = np.searchsorted(bucket, np.arange(parts + 1) * width)
    for part in range(parts):
        a, b = edges[part], edges[part + 1]
        if a < b:
            slot = bucket[a:b] - part * width
            yield part, np.bincount(slot, count[a:b], width).astype(np.int64), squeezed(np.diff(slot, prepend=0), of[a:b], count[a:b])


def postings(docs: DataFrame, n: int = ORDER, buckets: int = BUCKETS, parts: int = PARTS) -> DataFrame:
    """Blocks of postings by pack and part; part -1 of a pack has its documents: ids, which are null, features, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pack = TaskContext.get().partitionId() << 24
        ids, words, doc = [], [], []

        def flush() -> pa.RecordBatch:
            size = [len(d) for d in doc]
            rows = [(-1, None, squeezed(*(np.array(x, np.int64) for x in ([i or 0 for i in ids], [i is None for i in ids], size, words))))]
            if sum(size):
                rows += _packed(doc, buckets, parts)
            cols = [pa.array([pack] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["pack", "part", "counts", "block"])

        total = 0
        for batch in batches:
            for i in range(batch.num_rows):
                own = words_of(batch.column(1)[i].as_py() or b"")
                ids.append(batch.column(0)[i].as_py())
                words.append(len(own))
                doc.append(np.fromiter(map(crc32, features(own, n)), np.uint32) % buckets)
                total += len(doc[-1])
                if total >= PACK_WORDS or len(doc) == PACK_DOCS:
                    yield flush()
                    pack, total = pack + 1, 0
                    ids, words, doc = [], [], []
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, BLOCKS)


def _totals(blocks: DataFrame, name: str) -> DataFrame:
    return blocks.where("part >= 0").select("part", F.posexplode("counts").alias("slot", "c")).groupBy("part", "slot").agg(F.sum("c").alias(name))


def weights(docs: DataFrame, target: DataFrame, n: int = ORDER, buckets: int = BUCKETS, parts: int = PARTS) -> DataFrame:
    """(doc_id, place, n_words, n_features, weight) for each row of ``docs``, ``place`` being a number of the row's own.

    ``target`` has a column ``text``.
    """
    blocks = written(postings(docs, n, buckets, parts))
    both = _totals(blocks, "s").join(_totals(postings(target.select(F.lit(0).alias("doc_id"), "text"), n, buckets, parts), "t"), ["part", "slot"], "full")
    both = written(both.select("part", "slot", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")))
    s, t = both.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    packs = blocks.where("part < 0").count()
    groups = max(1, -(-packs // GROUP))
    ratio = ((F.col("t") + 1).cast("double") * F.lit(float(s + buckets))) / ((F.col("s") + 1).cast("double") * F.lit(float(t + buckets)))
    gains = both.select("part", F.struct("slot", F.floor(1000 * F.log(ratio)).cast("long").alias("gain")).alias("g")).groupBy("part").agg(F.sort_array(F.collect_list("g")).alias("g"))
    gains = gains.select("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(-1).cast("long").alias("pack"), F.transform("g", lambda g: g["slot"].cast("long")).alias("slots"), F.transform("g", lambda g: g["gain"]).alias("gains"), F.lit(None).cast("binary").alias("block"))
    none = F.lit(None).cast("array<long>")
    dealt = blocks.where("part >= 0").select("part", F.pmod(F.xxhash64("pack"), F.lit(groups)).cast("int").alias("group"), "pack", none.alias("slots"), none.alias("gains"), "block")
    # A part's gains come before its blocks, as no pack has a number below 0.
    met = gains.unionByName(dealt).repartition("part", "group").sortWithinPartitions("part", "group", "pack")

    def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.zeros(-(-buckets // parts))
        for batch in batches:
            part, pack, slots, gains, block = (batch.column(batch.schema.get_field_index(c)) for c in ("part", "pack", "slots", "gains", "block"))
            for i in range(batch.num_rows):
                if pack[i].as_py() < 0:
                    gain = np.zeros(-(-buckets // parts))
                    gain[np.array(slots[i].as_py(), np.int64)] = gains[i].as_py()
                    continue
                step, of, count = (x.view(np.int64) for x in unsqueezed(block[i].as_py(), 3))
                sums = np.bincount(of, gain[np.cumsum(step)] * count)
                docs = np.flatnonzero(np.bincount(of))
                out = squeezed(np.diff(docs, prepend=0), sums[docs].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pack.slice(i, 1), part.slice(i, 1), pa.array([out], pa.binary())], names=["pack", "part", "block"])

    sums = met.mapInArrow(contribute, "pack long, part int, block binary")
    of_pack = blocks.where("part < 0").select("pack", "part", "block").unionByName(sums).repartition("pack").sortWithinPartitions("pack", "part")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, total = None, [], np.zeros(0, np.int64)

        def rows() -> pa.RecordBatch:
            ids, null, size, words = known
            cols = [pa.array(ids, pa.int64(), mask=null > 0), pa.array((now << 15) + np.arange(len(ids)), pa.int64()), pa.array(words), pa.array(size), pa.array(total // np.maximum(size, 1))]
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "place", "n_words", "n_features", "weight"])

        for batch in batches:
            for i in range(batch.num_rows):
                pack, part, block = (batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("pack", "part", "block"))
                if part < 0:
                    if now is not None:
                        yield rows()
                    now, known = pack, [x.view(np.int64) for x in unsqueezed(block, 4)]
                    total = np.zeros(len(known[0]), np.int64)
                else:
                    step, own = (x.view(np.int64) for x in unsqueezed(block, 2))
                    total[np.cumsum(step)] += own
        if now is not None:
            yield rows()

    return of_pack.mapInArrow(reduce, "doc_id long, place long, n_words long, n_features long, weight long")


def scored(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """``weighed`` with ``score``: the weight, in thousandths of a logarithm, and Gumbel noise from a hash of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise.cast("long"))


def ranked(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``rows`` with ``rank`` for the highest scores, ``percent`` in a hundred of the rows with enough words; null for the rest."""
    rows = written(rows)
    enough = F.col("n_words") >= least_words
    drawn = rows.where(enough).count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("place")]
    ranged = written(rows.where(enough).repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    of_range = ranged.groupBy("range").agg(F.count("*").alias("k"))  # a row for each range
    before = of_range.select("range", F.coalesce(F.sum("k").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(W.partitionBy("range").orderBy(*order))
    at = ranged.withColumn("nth", nth).join(before, "range").withColumn("rank", F.col("before") + F.col("nth"))
    at = at.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).drop("range", "before", "nth")
    return at.unionByName(rows.where(~enough).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, n: int = ORDER, buckets: int = BUCKETS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): a rank for each document that is drawn."""
    return ranked(scored(weights(docs, target, n, buckets), seed), percent).drop("place")


def op13_importance(spark, sf_dir: str) -> DataFrame:
    from quillspark.llm.common import table

    found = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


OP13_SQL = r"""
WITH steps AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b::UBIGINT, list_transform(range(8), lambda k: 0::UBIGINT)),
                          lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS b) x) y),
tokens AS (
  SELECT true AS own, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT false, row_number() OVER (), item_id, text FROM benchmark),
cut AS (
  SELECT own, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM tokens),
counted AS (SELECT own, r, w, count(*) AS c FROM (SELECT own, r, unnest(ws) AS w FROM cut) x GROUP BY ALL),
hashed AS (
  SELECT w, (xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(strlen(w)),
                    lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::INT, 2))::UBIGINT)),
                    lambda a, b: xor(a >> 8, t[(xor(a % 256, b) + 1)::INT])), 4294967295::UBIGINT) % 10000)::BIGINT AS bucket
  FROM (SELECT DISTINCT w FROM counted) d, steps),
posted AS (SELECT own, r, bucket, sum(c)::BIGINT AS c FROM counted JOIN hashed USING (w) GROUP BY ALL),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT bucket, coalesce(sum(c) FILTER (own), 0)::BIGINT AS s, coalesce(sum(c) FILTER (NOT own), 0)::BIGINT AS t FROM posted GROUP BY bucket) x),
weighed AS (SELECT r, floor(sum(c * gain)::DOUBLE / sum(c)::DOUBLE)::BIGINT AS weight FROM posted JOIN gains USING (bucket) WHERE own GROUP BY r),
scored AS (
  SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM cut JOIN tokens USING (own, r) LEFT JOIN weighed USING (r) WHERE own),
placed AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place,
         count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM placed
"""
