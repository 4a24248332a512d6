"""Binary sources: file listings with content hashes, DOCX pages and covers, page counts of PDF files, pluggable recognition.

Folders are any that Spark can read. Parsing happens a file at a time in tasks; a file that can't be parsed gives an error
row rather than a failed job.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the DOCX reader.
BLOCK_CHARS, HEADING_CHARS, NOT_NOTES = 3000, 200, ("separator", "continuationSeparator", "continuationNotice")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, file_name, length, modified, content) of files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", F.col("modificationTime").alias("modified"), "content")


def with_hash(found: DataFrame) -> DataFrame:
    return found.withColumn("content_hash", F.sha2("content", 256))


def pdf_page_count(content: Column) -> Column:
    """Pages of a PDF: the largest count its page trees give; null where none is in plain sight (compressed objects)."""

    def batch(data: pd.Series) -> pd.Series:
        counts = data.map(lambda d: [int(n) for n in re.findall(rb"/Type\s*/Pages\b[^>]*?/Count\s+(\d+)|/Count\s+(\d+)[^>]*?/Type\s*/Pages\b", d or b"") for n in n if n])
        return counts.map(lambda c: max(c) if c else None).astype("Int64")

    return F.pandas_udf(batch, "long")(content)


def docx_pages(data: bytes) -> list[str]:
    """Texts of a DOCX file's pages.

    Pages end where the last rendering broke them, also inside a paragraph. A short paragraph that is bold throughout is a
    heading; notes cited on a page follow it under a rule. A file that comes to one page is cut into blocks of 3,000
    characters; blank pages are left out.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        notes = _footnotes(z)
    pages: list[tuple[list[str], list[str]]] = [([], [])]
    for p in body.findall(f"{_W}p"):
        runs = p.findall(f"{_W}r")
        whole = "".join(t.text or "" for r in runs for t in r.findall(f"{_W}t")).strip()
        heading = 0 < len(whole) < HEADING_CHARS and all(r.find(f".//{_W}b") is not None for r in runs)
        stretch = ""
        for run in [*runs, None]:
            ends = run is None or run.find(f"{_W}lastRenderedPageBreak") is not None
            if ends:
                if text := stretch.strip():
                    pages[-1][0].append(f"## {text}" if heading else text)
                stretch = ""
            if run is not None:
                if ends:
                    pages.append(([], []))
                stretch += run.findtext(f"{_W}t") or ""
                note = run.find(f"{_W}footnoteReference")
                if note is not None and notes.get(note.get(f"{_W}id")):
                    pages[-1][1].append(notes[note.get(f"{_W}id")])
    out = ["\n".join([*lines, *(["---", *cited] if cited else [])]) for lines, cited in pages]
    if len(out) <= 1:
        out = [out[0][i : i + BLOCK_CHARS] for i in range(0, len(out[0]), BLOCK_CHARS)]
    return [p.strip() for p in out if p.strip()]


def _footnotes(z: zipfile.ZipFile) -> dict[str, str]:
    if "word/footnotes.xml" not in z.namelist():
        return {}
    own = [n for n in ElementTree.fromstring(z.read("word/footnotes.xml")).iter(f"{_W}footnote") if n.get(f"{_W}type", "normal") not in NOT_NOTES]
    return {n.get(f"{_W}id"): "".join(t.text or "" for t in n.iter(f"{_W}t")).strip() for n in own}


def docx_cover(data: bytes) -> bytes | None:
    """The first image that a DOCX file relates to."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if "word/_rels/document.xml.rels" not in z.namelist():
            return None
        for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels")).iter(_REL):
            if r.get("Type", "").endswith("/image") and r.get("TargetMode") != "External":
                return z.read("word/" + r.get("Target").removeprefix("/word/"))
    return None


def docx_table(found: DataFrame) -> DataFrame:
    """(path, page_number, text, error) of DOCX files with content."""

    def read(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows += [(path, i, t, None) for i, t in enumerate(docx_pages(bytes(content)), 1)]
                except Exception as e:  # a broken file is a row, not a failed job
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["path", "page_number", "text", "error"]).astype({"page_number": "Int64"})

    return found.select("path", "content").mapInPandas(read, "path string, page_number long, text string, error string")


def docx_covers(found: DataFrame) -> DataFrame:
    def cover(data: pd.Series) -> pd.Series:
        return data.map(docx_cover)

    return found.select("path", F.pandas_udf(cover, "binary")("content").alias("cover"))


def recognised(images: DataFrame, read_page: Callable[[bytes], str], tries: int = 4) -> DataFrame:
    """(id, text, error): pages read by a recognition function, each tried a few times."""

    def run(frames):
        for frame in frames:
            rows = []
            for key, content in zip(frame["id"], frame["content"], strict=True):
                text, error = None, None
                for _ in range(tries):
                    try:
                        text, error = read_page(bytes(content)), None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"[:500]
                rows.append((key, text, error))
            yield pd.DataFrame(rows, columns=["id", "text", "error"])

    return images.select("id", "content").mapInPandas(run, "id long, text string, error string")
