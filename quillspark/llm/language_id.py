"""Language identification by compression.

Each label gets a zstandard raw-content dictionary cut from a bounded sample of its labelled training rows. A text is cut
into blocks of letters and their marks (case folded, all else one space), every block is compressed once under each dictionary, and the
label with the fewest bytes in all wins. The score is the winner's margin, ``1 - best / second``; a row whose margin is
below a threshold is ``rejected``.

Null texts and texts without a letter are ``und`` with score 0. A table without labelled training rows predicts ``und``
throughout. Rows with equal id and text are sampled together or not at all; ties between labels go to the first in
code-point order.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.llm.common import crc_mod, map_batches

#: Bounds of the fit: sampled rows for each label (expected), bytes of a label's dictionary, labels.
SAMPLE_ROWS, DICTIONARY_BYTES, MOST_LABELS = 400, 96_000, 1000
#: Bytes of a piece of a sampled document, pieces that a document may give; code points of a block.
PIECE, PIECES, BLOCK = 600, 4, 4000
#: Margins below this are too narrow to trust.
NARROW = 0.01
LEVEL = 6
#: What is neither letter nor mark tells languages little: it becomes one space, and case is folded. Marks are parts of words
#: in many scripts.
_OTHER, _OTHER_ASCII = regex.compile(r"[^\p{L}\p{M}]+"), re.compile(r"[^a-z]+")


def letters(text: str) -> str:
    text = text.lower()
    return (_OTHER_ASCII if text.isascii() else _OTHER).sub(" ", text)


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionaries by label, from labelled rows whose crc32(doc_id) mod 3 is not 1.

    About ``sample_rows`` rows of each label are drawn by a hash; the counts that set the rates are taken over the whole
    table. A drawn text is cut whole into pieces, of which those with the smallest digests stand for it, and of each
    label's distinct pieces those with the smallest digests fill its dictionary: the driver gets these alone.
    """
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), 3) != 1)).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    if not counts:
        return {}
    rate = F.lit(0.0)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, sample_rows / n))).otherwise(rate)
    unit = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)

    def cut(batches):
        for batch in batches:
            langs, pieces = [], []
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = letters(text).encode("utf-8", "surrogatepass")
                some = sorted((data[i : i + PIECE] for i in range(0, len(data), PIECE)), key=_digest)[:PIECES]
                langs += [lang] * len(some)
                pieces += some
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([_digest(x) for x in pieces], pa.string()), pa.array(pieces, pa.binary())], names=["lang", "digest", "piece"])

    pieces = train.where(unit < rate).select("text", "lang").mapInArrow(cut, "lang string, digest string, piece binary").distinct()
    nth = F.row_number().over(W.partitionBy("lang").orderBy("digest", "piece"))
    rows = pieces.withColumn("nth", nth).where(F.col("nth") <= max(1, dictionary_bytes // PIECE)).collect()
    return {lang: b" ".join(bytes(r["piece"]) for r in sorted(rows, key=lambda r: r["nth"]) if r["lang"] == lang) for lang in counts}


def _digest(piece: bytes) -> str:
    return hashlib.md5(piece).hexdigest()


@lru_cache(4)
def _coders(model: tuple) -> list:
    import zstandard

    coders = []
    for _, data in model:
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return coders


def predict(text: str | None, model: tuple, block: int = BLOCK) -> tuple[str, float]:
    """(label, margin) of a whole text under dictionaries ((label, bytes), ...)."""
    if not text or not model or not any(map(str.isalpha, text)):
        return "und", 0.0
    text = letters(text)
    blocks = [text[i : i + block].encode("utf-8", "surrogatepass") for i in range(0, len(text), block)]
    empty = len(blocks) * 9
    sizes = [max(1, sum(len(z.compress(b)) for b in blocks) - empty) for z in _coders(model)]
    best = min(range(len(sizes)), key=sizes.__getitem__)
    rest = [s for i, s in enumerate(sizes) if i != best]
    return model[best][0], (1.0 - sizes[best] / min(rest)) if rest else 1.0


def classify(docs: DataFrame, model: dict[str, bytes], narrow: float = NARROW) -> DataFrame:
    """doc_id, lang_pred, score, rejected for each document."""
    fixed = tuple(sorted(model.items()))

    def run(batch: pa.RecordBatch) -> dict:
        found = [predict(t, fixed) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "lang_pred": [x for x, _ in found], "score": [s for _, s in found], "rejected": [x == "und" or s < narrow for x, s in found]}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: dict[str, bytes], narrow: float = NARROW) -> DataFrame:
    """The documents, all columns, that are not rejected."""
    fixed, at = tuple(sorted(model.items())), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            found = (predict(t, fixed) for t in batch.column(at).to_pylist())
            yield batch.filter(pa.array([x != "und" and s >= narrow for x, s in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    from quillspark.llm.common import table

    docs = table(spark, sf_dir, "documents")
    found = classify(docs, fit(docs))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")
