"""Quality rules: fixed counts, then divergence from language references.

Every document has two histograms: of character classes over its whole text, and of a language's most common words (with
one bin for all other words). Both are compared with references, one for each language, by Jensen-Shannon distance; the
language that is nearest in both counts, the first of equally near ones. A document fails if either distance is beyond its limit, unless it is too short for a histogram
to mean anything: below the guards only the fixed rules decide.

References are fitted on all labelled rows, and every document is judged whole. Null texts
have no words and fail the fixed rules. Without a labelled row there is no reference and the fixed rules decide alone.
Rows are independent of one another otherwise, so repeated rows get equal results. Columns other than doc_id, text and
lang are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.llm.common import map_batches

#: Languages, words of each that have bins, and counts that a task adds up before it sends them on.
MOST_LABELS, COMMON_WORDS, HELD = 1000, 150, 500_000
#: Limits of the distances (0 to 1), and the least characters and words from which they count.
CHAR_LIMIT, WORD_LIMIT = 0.3, 0.5
LEAST_CHARS, LEAST_WORDS = 200, 50
LEAST, REPEATED_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
_SPACES = "\x20\t\n\x0b\x0c\r"
CLASSES = ("space", "lower", "upper", "digit", "sentence", "symbol", "other", "beyond ASCII")


def _class(b: int) -> int:
    c = chr(b)
    if b > 127:
        return 7 if b >= 192 else -1  # one for each code point: continuation bytes don't count
    if c in _SPACES:
        return 0
    return 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c in ".,;:!?'\"()-" else 5 if c in SYMBOLS else 6


_TABLE = np.array([_class(b) for b in range(256)], np.int8)


def class_counts(texts: list[bytes]) -> np.ndarray:
    """A row of counts by character class for each text."""
    out = np.zeros((len(texts), len(CLASSES)), np.int64)
    for i, t in enumerate(texts):
        if t:
            out[i] = np.bincount(_TABLE[np.frombuffer(t, np.uint8)] + 1, minlength=len(CLASSES) + 1)[1:]
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, so 0 to 1) of rows of p from rows of q; rows are made to sum to 1."""
    p = p / np.maximum(p.sum(axis=-1, keepdims=True), 1e-300)
    q = q / np.maximum(q.sum(axis=-1, keepdims=True), 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda a: np.where(a > 0, a * np.log2(a / m), 0).sum(axis=-1)
        return np.sqrt(np.clip((kl(p) + kl(q)) / 2, 0, 1))


def fit(docs: DataFrame, common: int = COMMON_WORDS) -> dict[str, tuple[np.ndarray, dict[bytes, int], np.ndarray]]:
    """By language: reference of character classes, bins of the common words, reference of these (last bin: all others).

    All rows with a language and a text count. Only the common words and the classes come to the driver.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")

    def tally(batches):
        # Every document's shares, not its counts, so that long documents weigh no more than others; classes have no word.
        for batch in batches:
            shares: dict = {}
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                words, classes = Counter(data.lower().split()), class_counts([data])[0]
                own = shares.setdefault(lang, {})
                own[None, -1] = own.get((None, -1), 0.0) + 1
                for k, n in enumerate(classes.tolist()):
                    own[None, k] = own.get((None, k), 0.0) + n / max(1, int(classes.sum()))
                total = words.total()
                for w, n in words.items():
                    own[w, 0] = own.get((w, 0), 0.0) + n / total
                if sum(map(len, shares.values())) > HELD:
                    yield sent(shares)
                    shares = {}
            yield sent(shares)

    def sent(shares: dict) -> pa.RecordBatch:
        rows = [(lang, w, k, v) for lang, own in shares.items() for (w, k), v in own.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.binary(), pa.int64(), pa.float64()))], names=["lang", "word", "class", "share"])

    summed = labelled.mapInArrow(tally, "lang string, word binary, class long, share double")
    # Decimals add up alike in any order, so reruns agree.
    summed = summed.groupBy("lang", "word", "class").agg(F.sum(F.col("share").cast("decimal(28,12)")).cast("double").alias("share"))
    nth = F.row_number().over(W.partitionBy("lang", F.col("word").isNull()).orderBy(F.col("share").desc(), "word", "class"))
    # A limit alone, so that tasks send on their own first rows only, not a language's whole vocabulary.
    rows = summed.withColumn("nth", nth).where(F.col("nth") <= max(common, len(CLASSES) + 1)).collect()
    model = {}
    for lang in counts:
        own = sorted((r for r in rows if r["lang"] == lang), key=lambda r: r["nth"])
        classes = {r["class"]: r["share"] for r in own if r["word"] is None}
        if not classes:
            continue
        n = classes[-1]
        top = [(bytes(r["word"]), r["share"] / n) for r in own if r["word"] is not None][:common]
        words = np.array([s for _, s in top])
        model[lang] = (np.array([classes[k] / n for k in range(len(CLASSES))]), {w: i for i, (w, _) in enumerate(top)}, np.append(words, max(0.0, 1 - words.sum())))
    return model


def repeated_words(words: list[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """For each document, its words that lie in windows found twice or more in it. Exact: windows are ranked, not hashed."""
    size = np.array([len(w) for w in words], np.int64)
    out = np.zeros(len(words), np.int64)
    n = int(size.sum())
    if n < window:
        return out
    doc = np.repeat(np.arange(len(words)), size)
    flat = np.empty(n, object)
    flat[:] = [w for ws in words for w in ws]
    ids = pd.factorize(flat)[0].astype(np.int64)
    ranked = lambda a, b: pd.factorize(a * (int(b.max()) + 1) + b)[0].astype(np.int64)
    two = ranked(ids[:-1], ids[1:])
    four = ranked(two[:-2], two[2:])
    five = ranked(four[:-1], ids[4:])
    inside = doc[:-4] == doc[4:]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return out
    keys = pd.factorize(five[starts] * len(words) + doc[starts])[0]
    again = starts[np.bincount(keys)[keys] > 1]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + window, -1)
    return np.bincount(doc[np.cumsum(edge)[:n] > 0], minlength=len(words))


def judge(texts: list[str | None], model: dict) -> dict:
    """Counts and verdicts for whole texts."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    words = [d.split() for d in data]
    n_words = np.array([len(w) for w in words], np.int64)
    classes = class_counts(data)
    word_chars = classes[:, 1:].sum(axis=1)
    dup = []
    for t in texts:
        seen, again = set(), 0
        for line in (t or "").split("\n"):
            if line.strip(_SPACES):
                again += line in seen
                seen.add(line)
        dup.append(again)
    repeat = np.zeros(len(texts), np.int64)
    start, total = 0, 0
    for i, n in enumerate([*n_words.tolist(), -1]):  # some half million words at a time
        if n < 0 or total + n > 500_000 and i > start:
            repeat[start:i] = repeated_words(words[start:i])
            start, total = i, 0
        total += n
    base_failed = (n_words < LEAST) | (100 * repeat > REPEATED_PERCENT * n_words)
    char_js, word_js = np.full(len(texts), np.inf), np.full(len(texts), np.inf)
    counted = [Counter(d.lower().split()) for d in data]
    for reference, bins, shares in model.values():
        hist = np.zeros((len(texts), len(shares)))
        for i, c in enumerate(counted):
            common = c.keys() & bins.keys()
            for w in common:
                hist[i, bins[w]] = c[w]
            hist[i, -1] = n_words[i] - hist[i].sum()
        by_char, by_word = js_distance(classes, reference), js_distance(hist, shares)
        # One language counts for both: that whose greater distance, each against its limit, is least.
        nearer = np.maximum(by_char / CHAR_LIMIT, by_word / WORD_LIMIT) < np.maximum(char_js / CHAR_LIMIT, word_js / WORD_LIMIT)
        char_js, word_js = np.where(nearer, by_char, char_js), np.where(nearer, by_word, word_js)
    if not model:
        char_js[:] = word_js[:] = 0
    guarded = (classes.sum(axis=1) < LEAST_CHARS) | (n_words < LEAST_WORDS)
    diverges = ~guarded & ((char_js > CHAR_LIMIT) | (word_js > WORD_LIMIT))
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": classes[:, 5],
        "n_dup_lines": dup,
        "n_repeat_words": repeat,
        "base_failed": base_failed,
        "kept": ~base_failed & ~diverges,
        "char_distance": char_js,
        "word_distance": word_js,
    }


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def assess(docs: DataFrame, model: dict) -> DataFrame:
    """Counts, distances to the nearest reference and the verdict for each document."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {}
        texts = batch.column("text").to_pylist()
        for i in range(0, len(texts), 1000):
            for k, v in judge(texts[i : i + 1000], model).items():
                out.setdefault(k, []).append(np.asarray(v))
        return {"doc_id": batch.column("doc_id"), **{k: np.concatenate(v) for k, v in out.items()}}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, RESULT)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    from quillspark.llm.common import table

    docs = table(spark, sf_dir, "documents")
    return assess(docs, fit(docs))
