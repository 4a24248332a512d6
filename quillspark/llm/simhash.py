"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Two fingerprints at distance d meet if each emits all variants within d / 2 flips: some variant is common to both. For
radius 4 a whole fingerprint would emit 1 + 64 + 2016 = 2081 variants. Of two fingerprints at most 4 bits apart, though,
one 32-bit half is at most 2 bits apart, so balls of half that radius around each half meet: 2 x 33 variants, shuffled on
(half, variant), and pairs that collide are verified on all 64 bits. This is one plan for every size of table.

A bucket that more than ``DENSE`` distinct fingerprints share is not compared pair by pair, which would take the square of
their number: its members emit the 2081 variants of the whole word. Fingerprints that share one of these are at most 4 bits
apart, so they need no verification and are linked to the smallest in one pass. The components are the same.

Null texts and texts without a word have fingerprint zero and link like any other. Equal fingerprints are one node, so
groups of copies cost one row, and fingerprints of many documents are joined apart. Repeated rows get equal results; a null
doc_id never becomes a component's id unless the component has no other (then it is null). Only ``doc_id`` and ``text`` are
read; ``drop_near_duplicates`` passes all columns on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import map_batches, sorted_runs, whole_row, written
from quillspark.llm.components import components

SHINGLE, BITS, RADIUS = 4, 64, 4
DENSE = 512
#: Fingerprints with more than one in so many rows are joined by broadcast: there are fewer than so many of them.
HOT = 1000
#: Shingles hashed at a time, which bounds memory for very long texts.
BLOCK = 200_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a whole text, unsigned."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], spaces + 1]).tolist()
    ends = [*spaces.tolist(), len(joined)]
    n = max(1, len(words) - shingle + 1)
    ends = ends[-n:]
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, BLOCK):
        h = np.array([xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts[i : min(n, i + BLOCK)], ends[i : i + BLOCK], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * ones > n).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "fp": np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def _flips(bits: int, most: int) -> np.ndarray:
    one = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    masks = [np.zeros(1, np.uint64), one]
    if most == 2:
        i, j = np.triu_indices(bits, 1)
        masks.append(one[i] | one[j])
    return np.concatenate(masks)


def half_variants(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, fps) of all variants within one flip of either half; bit 32 of a key tells the half."""
    flips = _flips(32, 1)
    keys = [((fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF))[:, None] ^ flips | np.uint64(half << 32) for half in (0, 1)]
    return np.concatenate([k.ravel() for k in keys]), np.tile(np.repeat(fp, len(flips)), 2)


def whole_variants(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, fps) of all variants within two flips of the whole fingerprint."""
    flips = _flips(BITS, 2)
    return (fp[:, None] ^ flips).ravel(), np.repeat(fp, len(flips))


def _emit(fps: DataFrame, variants, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fp), rows):
                k, f = variants(fp[i : i + rows])
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(f.view(np.int64))], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def linked_in_bucket(fp: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (member, smallest of its group in this bucket) that hold the verified pairs of a bucket together."""
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
    root = np.arange(len(fp))
    while True:  # smallest label among neighbours until nothing changes
        new = np.where(near, root[None, :], len(fp)).min(axis=1)
        if (new == root).all():
            break
        root = new
    return [(int(fp[i]), int(fp[r])) for i, r in enumerate(root) if i != r]


def _links(emitted: DataFrame, verify: bool) -> DataFrame:
    """(a, b) links of each bucket; with ``verify``, members of dense buckets come back as (fp, null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, starts, ends, (fps,) in sorted_runs(batches, "key", ["fp"]):
            fps = fps.view(np.uint64)
            a, b = [], []
            for i in np.flatnonzero(ends - starts > 1):
                fp = np.unique(fps[starts[i] : ends[i]])
                if verify and len(fp) > DENSE:
                    a += fp.tolist()
                    b += [None] * len(fp)
                else:
                    pairs = linked_in_bucket(fp) if verify else [(int(x), int(fp[0])) for x in fp[1:]]
                    a += [x for x, _ in pairs]
                    b += [x for _, x in pairs]
            if a:
                signed = lambda xs: pa.array([x if x is None or x < 1 << 63 else x - (1 << 64) for x in xs], pa.int64())
                yield pa.RecordBatch.from_arrays([signed(a), signed(b)], names=["a", "b"])

    return emitted.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long").distinct()


def fingerprint_components(fps: DataFrame) -> DataFrame:
    """(fp, root) for every distinct fingerprint of ``fps`` (fp long) that has a link."""
    found = written(_links(_emit(fps, half_variants, 4000), verify=True))
    dense = found.where(F.col("b").isNull()).select(F.col("a").alias("fp")).distinct()
    links = found.where(F.col("b").isNotNull())
    if dense.limit(1).count():
        links = links.unionByName(_links(_emit(dense, whole_variants, 200), verify=False))
    return components(links).withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, root, component_id) for each row of ``docs``; ``root`` is one fingerprint of the component's."""
    thin = written(fingerprints(docs))
    nodes = written(thin.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = written(fingerprint_components(nodes.select("fp")))
    rooted = nodes.join(roots, "fp")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = rooted.select("fp", "root").join(least, "root").select("fp", "root", "component_id")
    of_fp = nodes.join(linked, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    of_fp = written(of_fp)
    hot = F.broadcast(of_fp.where(F.col("n") * HOT > thin.count()).drop("n"))
    found = thin.join(hot, "fp").unionByName(thin.join(hot.select("fp"), "fp", "left_anti").join(of_fp.drop("n"), "fp"))
    return found.select("doc_id", "fp", "root", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group: the one whose doc_id is the component's.

    Where rows repeat that doc_id, or a component has null ids alone, the one with the least fingerprint stays, and of equal
    ones that with the least digest of all its columns.
    """
    found = written(near_duplicates(docs))
    stay = written(found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "doc_id").agg(F.min("fp").alias("fp")))
    again = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg((F.count("*") > 1).alias("again")).where("again")
    ids = stay.where("doc_id IS NOT NULL").select("doc_id").distinct().join(again, "doc_id", "left").select(F.col("doc_id").alias("id"), F.coalesce("again", F.lit(False)).alias("again"))
    ids = written(ids)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_row(docs).alias("row"))
    # Texts are shuffled at any size, so plans don't differ from small tables to large ones.
    joined = rows.join(ids.hint("merge"), F.col("doc_id") == F.col("id"))
    kept = joined.where("NOT again").select("row")
    odd = joined.where("again").select("doc_id", "row").unionByName(rows.where("doc_id IS NULL"))
    if ids.where("again").limit(1).count() or stay.where("doc_id IS NULL").limit(1).count():

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fp = np.array([fingerprint(t) for t in batch.column(0).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(fp)], names=["doc_id", "row", "fp"])

        schema = T.StructType().add("doc_id", T.LongType()).add("row", odd.schema["row"].dataType).add("fp", T.LongType())
        each = odd.select(F.col("row.text").alias("text"), "doc_id", "row").mapInArrow(run, schema)
        mine = stay.select(F.col("doc_id").alias("id"), F.col("fp").alias("own"))
        each = each.join(mine, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("fp") == F.col("own")))
        one = each.groupBy("doc_id", "fp").agg(F.min_by("row", F.md5(F.to_json("row", {"ignoreNullFields": "false"}))).alias("row"))
        kept = kept.unionByName(one.select("row"))
    return kept.select("row.*")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    from quillspark.llm.common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
