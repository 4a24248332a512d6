"""Discovery as a stream: new files of a folder become books, each content once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions.text import title_of_file

_FILES = "path string, modificationTime timestamp, length long, content binary"
BOOKS = "id string, content_hash string, file_name string, title string, length long"


def arriving(spark: SparkSession, folder: str, pattern: str = "*", files_per_batch: int = 1000) -> DataFrame:
    """``BOOKS`` of the files that arrive below a folder, each content once: digests seen before are state."""
    found = spark.readStream.schema(_FILES).format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    digest = F.sha2("content", 256)
    rows = found.select(digest.alias("content_hash"), F.element_at(F.split("path", "/"), -1).alias("file_name"), "length")
    first = rows.dropDuplicates(["content_hash"])
    return first.select(F.substring("content_hash", 1, 12).alias("id"), "content_hash", "file_name", title_of_file(F.col("file_name")).alias("title"), "length").where("length > 0")


def registered(spark: SparkSession, table: str) -> DataFrame:
    """The books of a table that ``discover`` fills; none before its first batch."""
    try:
        return spark.read.schema(BOOKS).option("recursiveFileLookup", "true").parquet(table)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], BOOKS)


def discover(spark: SparkSession, folder: str, table: str, checkpoint: str, known: DataFrame | None = None, pattern: str = "*", files_per_batch: int = 1000, trigger: dict | None = None) -> StreamingQuery:
    """Register the files of a folder as books in ``table``: those whose name and content neither it nor ``known`` has.

    ``known`` (file_name, content_hash) is read anew with each batch, so books that others add count at once. Each batch has
    a folder of its own in ``table``, which a second try replaces: a restart from the checkpoint registers nothing twice.
    Empty files are left out. Of files with one content in one batch either may give the name.
    """

    def each(batch: DataFrame, number: int) -> None:
        new = batch
        earlier = registered(spark, table).where(~F.input_file_name().contains(f"/batch={number}/"))
        for have in [earlier, *([known] if known is not None else [])]:
            for column in ("file_name", "content_hash"):
                new = new.join(have.select(column).where(f"{column} IS NOT NULL").distinct(), column, "left_anti")
        new.select("id", "content_hash", "file_name", "title", "length").write.mode("overwrite").parquet(f"{table}/batch={number}")

    return arriving(spark, folder, pattern, files_per_batch).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
