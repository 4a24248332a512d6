"""A quality classifier: a generalised additive model with pairwise interactions.

A document's features, counted over its whole text, fall into bins. The model's log-odds are a base, a number from each
feature's table by its bin, and a number from each chosen pair's table by two bins, so every score can be read off its
tables. Tables are learned by cyclic boosting: round by round each feature in turn gets a shallow tree over its bins, fitted
to what is still unexplained, whose leaves are added to its table in small steps. Then the pairs whose four-way cuts explain
most of the rest are chosen, and their tables are learned the same way. Scoring adds looked-up numbers, a batch at a time.

The fit takes ``FIT_ROWS`` labelled documents at most, those with the least hashes of their ids; Spark draws them, counts
their features and gives the driver these numbers alone. Of labels that share an id the mean counts, and of documents that
share one that with the least hash of its text. Every document is scored.

Null and empty texts have features of zero and a score like any other. Labels without an id or a mark are not learned from;
with none at all every score is 0.5. Repeated rows get equal scores, an empty table gives an empty result, and columns other
than doc_id, text and the labels' quality are not read. Long texts are counted one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import crc_mod, map_batches
from quillspark.llm.quality import class_counts, repeated_words

FIT_ROWS = 20_000
BINS, PAIRS = 32, 8
ROUNDS, RATE, LEAVES, LEAST_WEIGHT = 150, 0.1, 4, 8.0
PREDICT = 0.3
#: Words of a batch that are counted together.
TOGETHER = 300_000

FEATURES = (
    "words",
    "characters in a word",
    "capitals among letters",
    "digits",
    "sentence marks",
    "symbols",
    "other marks",
    "beyond ASCII",
    "words that repeat the one before",
    "words in repeated windows",
    "distinct words",
    "share of the commonest word",
    "repeated lines",
    "words in a line",
    "words without letters or digits",
)


def features(texts: list[bytes]) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    words = [t.split() for t in texts]
    size = np.array([len(w) for w in words], np.int64)
    some = np.maximum(size, 1)
    classes = class_counts(texts).astype(float)
    chars = np.maximum(classes.sum(axis=1), 1)
    out = np.zeros((len(texts), len(FEATURES)))
    out[:, 0] = np.log1p(size)
    out[:, 1] = classes[:, 1:].sum(axis=1) / some
    out[:, 2] = classes[:, 2] / np.maximum(classes[:, 1] + classes[:, 2], 1)
    for k, c in enumerate((3, 4, 5, 6, 7)):
        out[:, 3 + k] = classes[:, c] / chars
    flat = np.empty(int(size.sum()), object)
    flat[:] = [w for ws in words for w in ws]
    if len(flat):
        ids, known = pd.factorize(flat)
        of = np.repeat(np.arange(len(texts)), size)
        same = np.zeros(len(ids), bool)
        same[1:] = (ids[1:] == ids[:-1]) & (of[1:] == of[:-1])
        out[:, 8] = np.bincount(of[same], minlength=len(texts)) / some
        out[:, 9] = repeated_words(words) / some
        keys, n = np.unique(of * len(known) + ids, return_counts=True)
        owner = keys // len(known)
        out[:, 10] = np.bincount(owner, minlength=len(texts)) / some
        most = np.zeros(len(texts))
        np.maximum.at(most, owner, n)
        out[:, 11] = most / some
        bare = np.array([not any(b > 127 or chr(b).isalnum() for b in w) for w in known])
        out[:, 14] = np.bincount(of[bare[ids]], minlength=len(texts)) / some
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x.strip()]
        out[i, 12] = 1 - len(set(lines)) / max(1, len(lines))
        out[i, 13] = np.log1p(size[i] / max(1, len(lines)))
    return out


@dataclass
class Model:
    """``edges`` and ``tables`` by feature, and (first, second, table) by pair."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1) if len(self.edges) else np.zeros((len(x), 0), np.int64)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            out += table[b[:, k]]
        for i, j, table in self.pairs:
            out += table[b[:, i], b[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return _odds(self.log_odds(x))

    def terms(self) -> list[tuple[str, np.ndarray]]:
        """What the model adds: by name of feature, or of two, its table."""
        own = [(FEATURES[k], t) for k, t in enumerate(self.tables)]
        return own + [(f"{FEATURES[i]} x {FEATURES[j]}", t) for i, j, t in self.pairs]


def _odds(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def tree(g: np.ndarray, h: np.ndarray, w: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """What a tree of so many leaves over bins in a row says for each bin; g, h, w: gradients, curvatures and weights by bin."""
    cuts = [0, len(g)]
    sums = [np.concatenate([[0.0], np.cumsum(v)]) for v in (g, h, w)]
    while len(cuts) <= leaves:
        best = (1e-9, 0)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a < 2:
                continue
            at = np.arange(a + 1, b)
            (gl, hl, wl), (gr, hr, wr) = ([s[at] - s[a] for s in sums], [s[b] - s[at] for s in sums])
            gain = np.where((wl >= least) & (wr >= least), _gain(gl, hl) + _gain(gr, hr) - _gain(gl + gr, hl + hr), 0)
            k = int(gain.argmax())
            best = max(best, (float(gain[k]), a + 1 + k))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (sums[0][b] - sums[0][a]) / (sums[1][b] - sums[1][a] + 1.0)
    return out


def crossed(g: np.ndarray, h: np.ndarray, w: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """The best cut of both axes of a table of sums: its gain, and what its four leaves say for each cell."""
    corner = [np.pad(np.cumsum(np.cumsum(v, 0), 1), ((1, 0), (1, 0))) for v in (g, h, w)]

    def four(c: np.ndarray) -> list[np.ndarray]:
        a, top, left, all_ = c[1:-1, 1:-1], c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        return [a, top - a, left - a, all_ - top - left + a]

    gs, hs, ws = (four(c) for c in corner)
    if not gs[0].size:
        return 0.0, np.zeros(g.shape)
    gain = sum(_gain(a, b) for a, b in zip(gs, hs, strict=True)) - _gain(g.sum(), h.sum())
    gain = np.where(np.minimum.reduce([w_ + np.where(w_ == 0, least, 0) for w_ in ws]) >= least, gain, 0)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros(g.shape)
    say = [float(a[i, j] / (b[i, j] + 1.0)) for a, b in zip(gs, hs, strict=True)]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = say
    return float(gain[i, j]), out


def learn(x: np.ndarray, y: np.ndarray, bins: int = BINS, pairs: int = PAIRS, rounds: int = ROUNDS, rate: float = RATE, leaves: int = LEAVES, least: float = LEAST_WEIGHT) -> Model:
    """A model of marks ``y`` (0 to 1) by features ``x``."""
    if not len(x):
        return Model(0.0, [], [], [])
    edges = [np.unique(np.quantile(x[:, k], np.arange(1, bins) / bins, method="lower")) for k in range(x.shape[1])]
    edges = [e[e > x[:, k].min()] for k, e in enumerate(edges)]
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    model = Model(base, edges, [np.zeros(len(e) + 1) for e in edges], [])
    b = model.bins(x)
    now = np.full(len(x), base)
    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            p, own, n = _odds(now), b[:, k], len(table)
            step = rate * tree(np.bincount(own, y - p, n), np.bincount(own, p * (1 - p), n), np.bincount(own, minlength=n), leaves, least)
            table += step
            now += step[own]

    def sums(i: int, j: int) -> list[np.ndarray]:
        p, n, m = _odds(now), len(edges[i]) + 1, len(edges[j]) + 1
        cell = b[:, i] * m + b[:, j]
        return [np.bincount(cell, v, n * m).reshape(n, m) for v in (y - p, p * (1 - p), np.ones(len(y)))]

    ranked = sorted(((-crossed(*sums(i, j), least)[0], i, j) for i in range(len(edges)) for j in range(i + 1, len(edges))))
    model.pairs = [(i, j, np.zeros((len(edges[i]) + 1, len(edges[j]) + 1))) for gain, i, j in ranked[:pairs] if gain < 0]
    for _ in range(rounds // 2):
        for i, j, table in model.pairs:
            step = rate * crossed(*sums(i, j), least)[1]
            table += step
            now += step[b[:, i], b[:, j]]
    return model


def counted(docs: DataFrame, others: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, x) and ``others`` (names and types of columns that are passed on) for each row of ``docs``: its features."""
    others = others or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in pieces(batch.column(1)):
                kept = [batch.column(0), *(batch.column(2 + k) for k in range(len(others)))]
                x = features(texts)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                cols = [c.slice(first, len(texts)) for c in kept]
                yield pa.RecordBatch.from_arrays([cols[0], rows, *cols[1:]], names=["doc_id", "x", *others])

    schema = ", ".join(["doc_id long, x array<double>", *(f"{k} {v}" for k, v in others.items())])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *others).mapInArrow(run, schema)


def pieces(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """A column's texts, so many in a row that they are worth counting together: (place of the first, texts)."""
    first, texts, n = 0, [], 0
    for i in range(len(column)):
        texts.append(column[i].as_py() or b"")
        n += len(texts[-1])
        if n > 6 * TOGETHER:
            yield first, texts
            first, texts, n = i + 1, [], 0
    if texts:
        yield first, texts


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, rows: int = FIT_ROWS) -> Model:
    """The model of ``labels`` (doc_id, quality); ``learn_from`` is a condition on their doc_id."""
    of = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL")
    of = of.where(learn_from) if learn_from is not None else of
    of = of.groupBy("doc_id").agg(F.avg((F.col("quality") == 1).cast("double")).alias("y"))
    of = of.orderBy(F.xxhash64(F.lit("quality labels"), "doc_id"), "doc_id").limit(rows)
    drawn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(of), "doc_id").withColumn("h", F.xxhash64("text"))
    one = counted(drawn, {"y": "double", "h": "long"}).groupBy("doc_id", "y").agg(F.min_by("x", "h").alias("x"))
    found = sorted(one.collect(), key=lambda r: r["doc_id"])
    return learn(np.array([r["x"] for r in found]).reshape(len(found), len(FEATURES)), np.array([r["y"] for r in found]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of ``docs``."""

    def run(batch: pa.RecordBatch) -> dict:
        scores = [model.score(features(texts)) for _, texts in pieces(batch.column(1))]
        return {"doc_id": batch.column(0), "score": np.concatenate(scores)}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), run, "doc_id long, score double")


def op11_quality_gam(spark, sf_dir: str) -> DataFrame:
    from quillspark.llm.common import table

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0)
    found = score(docs, model)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))
