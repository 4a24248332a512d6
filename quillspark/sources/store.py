"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; in local mode, where a session may name none, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/quillspark-shared-{os.getuid()}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh(spark: SparkSession) -> str:
    """A path of its own in that folder."""
    return f"{folder(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame, *by: str) -> DataFrame:
    """``df`` written as a Parquet table, partitioned ``by`` columns, and read again: lineage ends there."""
    path = fresh(df.sparkSession)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
