"""Helpers shared by the training-data operators: tables, shared folders, streamed Arrow batches."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in every contract of this subpackage.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it, or a ``scratch`` folder in it.

    Only in local mode, where all run on one machine, may a session name none: then a temporary folder is set.
    """
    if found := _scratch.get():
        return found
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/quillspark-shared-{os.getuid()}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Within it, intermediate tables go to a folder of their own, which is removed at the end: results must be written by then."""
    folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    token = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(token)
        remove(spark, folder)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store, if it is there."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def written(df: DataFrame) -> DataFrame:
    """``df``, written as a Parquet table in the shared folder and read again: lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct: inside it no name of theirs meets one of an operator."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def crc_mod_of(doc_id: int | None, n: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, set_up: Callable | None = None) -> DataFrame:
    """Apply ``fn`` to each Arrow batch; it returns a dict of columns. ``set_up()`` runs once a task, its result is fn's second argument."""
    from pyspark.sql.types import _parse_datatype_string

    out = _arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = set_up() if set_up else None
        for batch in batches:
            if batch.num_rows:
                cols = fn(batch, state) if set_up else fn(batch)
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def _arrow_schema(struct) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(struct)


def sorted_runs(batches: Iterator[pa.RecordBatch], key: str, values: list[str]) -> Iterator[tuple]:
    """From batches sorted by ``key``: (keys, starts, ends, value arrays), where every run of equal keys is whole.

    Memory: one batch and the longest run.
    """
    import numpy as np

    kept: list | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in (key, *values)]
        if kept is not None:
            now = [np.concatenate([a, b]) for a, b in zip(kept, now, strict=True)]
        k = now[0]
        last = int(np.searchsorted(k, k[-1], "left"))
        kept = [x[last:] for x in now]
        if last:
            yield _runs([x[:last] for x in now])
    if kept is not None:
        yield _runs(kept)


def _runs(cols: list) -> tuple:
    import numpy as np

    k = cols[0]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k, starts, np.append(starts[1:], len(k)), cols[1:]
