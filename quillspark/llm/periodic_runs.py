"""Periodic runs of words in every document, by Kolpakov and Kucherov's way, and texts without their repeats.

A run is a stretch of consecutive words with smallest period q and length of ``max(least_length, exponent * q)`` words at
least that no neighbouring word extends. They are found in three steps:

* The words' suffix automaton, with the first end of every state, gives the Lempel-Ziv factors: each is the longest
  stretch that also begins earlier, or a word that is new.
* Main's algorithm finds the runs that touch a border of factors. A run that ends in factor u begins less than ``|u'| + q``
  words before it, u' being the factor before (else u' would be longer), so ``(exponent - 1) * q < |u'| + |u|``: each
  border has a window in proportion to its two factors, in which longest common prefixes and suffixes, from two Z-arrays,
  tell for every period how far it holds.
* All other runs lie strictly inside a factor, and are copied, from left to right, from where the factor occurred before.

A word of a run occurs ``exponent`` times in it. So whole batches are cut first at words that are rarer than that in their
document, then in what is left between cuts, until little changes; only the stretches that remain have to be searched.
This loses no run.

A null text has no words. Each row is judged alone, so repeated rows get equal results; an empty table gives an empty one;
other columns are not read. Time grows as the words of a text, not as their square, and memory as those of its longest
stretch of repeating words (some 500 bytes a word), beside about half a million words of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPONENT, LEAST_LENGTH = 4, 6
#: Words of a batch that are looked at together.
TOGETHER = 500_000

Run = tuple[int, int, int]  # start, length, period


def automaton(s: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """Transitions of the suffix automaton of ``s``, and where each state's stretches first end."""
    moves: list[dict[int, int]] = [{}]
    link, length, ends = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(s):
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        ends.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(moves[q].copy())
                length.append(length[p] + 1)
                ends.append(ends[q])
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves, ends


def factors(s: list[int]) -> list[tuple[int, int, int]]:
    """Lempel-Ziv factors of ``s``: (start, end, start of the first occurrence, or -1 for a new word)."""
    moves, ends = automaton(s)
    out, i, n = [], 0, len(s)
    while i < n:
        state, j = 0, i
        while j < n and ends[after := moves[state][s[j]]] < j:
            state = after
            j += 1
        out.append((i, j, ends[state] - (j - i) + 1) if j > i else (i, i + 1, -1))
        i = out[-1][1]
    return out


def z_array(s: list[int], upto: int) -> list[int]:
    """For each of the first ``upto`` places of ``s`` the length of its longest common prefix with ``s``."""
    n = len(s)
    z = [0] * upto
    z[0] = n
    left = right = 0
    for i in range(1, upto):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def touching(s: list[int], a: int, b: int, e: int, exponent: int, least: int) -> Iterator[tuple[int, int, int]]:
    """Runs (start, end, period) that touch the border ``b`` of the factors [a, b) and [b, e) and don't reach beyond ``e``."""
    n, most = len(s), (b - a + e - b - 1) // (exponent - 1)
    if e == b:
        most = (b - a) // exponent
    if most < 1:
        return
    low = max(0, b - (b - a) - most)
    x, y = s[low:b], s[b:e]
    left, right = min(most, len(x)), min(most, len(y))

    def whole(start: int, end: int, p: int) -> bool:
        if end - start < max(least, exponent * p):
            return False
        return not (start == low > 0 and s[low - 1] == s[low - 1 + p]) and not (end == e < n and s[e] == s[e - p])

    # Of periods that hold before the border: how far back, and how far on. -1 is no word.
    back = z_array(x[::-1] + [-1] + s[low : b + right][::-1], len(x) + 1 + right)
    on = z_array(y + [-1] + s[b - left : e], len(y) + 1 + left)
    for p in range(1, left + 1):
        start, end = b - p - (back[p] if p < len(x) else 0), b + on[len(y) + 1 + left - p]
        if whole(start, end, p):
            yield start, end, p
    # And of those that hold behind it.
    for p in range(1, right + 1):
        start, end = b - back[len(x) + 1 + right - p], b + p + (on[p] if p < len(y) else 0)
        if whole(start, end, p):
            yield start, end, p


def runs_of(s: list[int], exponent: int = EXPONENT, least: int = LEAST_LENGTH) -> list[Run]:
    """All runs of a sequence of numbers from 0, by start and period."""
    if exponent < 2:
        raise ValueError("a run has its period twice at least")
    if len(s) < max(least, exponent):
        return []
    parts = factors(s)
    found: dict[int, dict[int, int]] = {}  # by start and end the smallest period

    def add(start: int, end: int, p: int) -> None:
        own = found.setdefault(start, {})
        own[end] = min(p, own.get(end, p))

    for (a, b, _), (_, e, _) in zip(parts, [*parts[1:], (len(s), len(s), -1)], strict=True):
        for run in touching(s, a, b, e, exponent, least):
            add(*run)
    for b, e, source in parts:
        if source >= 0 and e - b > max(least, exponent) and found:
            by = b - source
            for start in range(b + 1, e - least):
                for end, p in list(found.get(start - by, {}).items()):
                    if end + by < e:
                        add(start, end + by, p)
    return sorted((start, end - start, p) for start, ends in found.items() for end, p in ends.items())


def stretches(ids: np.ndarray, text: np.ndarray, exponent: int, least: int) -> list[tuple[int, int]]:
    """(start, end) of stretches of ``ids`` that may hold runs; ``text`` tells which text each word is of."""
    at, part = np.arange(len(ids)), text
    while len(at):
        pair = part.astype(np.int64) * (int(ids.max()) + 1) + ids[at]
        _, place, count = np.unique(pair, return_inverse=True, return_counts=True)
        stay = count[place] >= exponent
        before = len(at)
        at, part = at[stay], part[stay]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (np.diff(part) != 0)
        part = np.cumsum(new) - 1
        stay = np.bincount(part)[part] >= max(least, exponent) if len(at) else new
        at, part = at[stay], part[stay]
        if len(at) > 0.98 * before:
            break
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    return [] if not len(at) else [(int(at[i]), int(at[j - 1]) + 1) for i, j in zip(starts, np.append(starts[1:], len(at)), strict=True)]


def runs_of_texts(texts: list[list[bytes]], exponent: int = EXPONENT, least: int = LEAST_LENGTH) -> list[list[Run]]:
    """The runs of each text's words."""
    out: list[list[Run]] = [[] for _ in texts]
    size = np.array([len(t) for t in texts], np.int64)
    if not size.sum():
        return out
    flat = np.empty(int(size.sum()), object)
    flat[:] = [w for t in texts for w in t]
    ids = pd.factorize(flat)[0]
    first = np.cumsum(size) - size
    text = np.repeat(np.arange(len(texts)), size)
    for start, end in stretches(ids, text, exponent, least):
        own = pd.factorize(ids[start:end])[0].tolist()
        of = int(text[start])
        out[of] += [(start - int(first[of]) + s, n, p) for s, n, p in runs_of(own, exponent, least)]
    return out


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run repeats: of each run its first period stays."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, n, p in runs:
        edge[start + p] += 1
        edge[start + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
COLLAPSED = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text binary"


def collapsed(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST_LENGTH) -> DataFrame:
    """(doc_id, n_words, runs, text): each document's runs by start and period, and its kept words joined by one space."""

    def rows(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of_texts(texts, exponent, least)
        names = ("start", "length", "period")
        cols = [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([[dict(zip(names, r, strict=True)) for r in own] for own in found], _RUNS),
            pa.array([b" ".join(kept_words(t, own)) for t, own in zip(texts, found, strict=True)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "runs", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, n = [], [], 0
            for i in range(batch.num_rows):
                ids.append(batch.column(0)[i].as_py())
                texts.append((batch.column(1)[i].as_py() or b"").split())
                n += len(texts[-1])
                if n > TOGETHER:
                    yield rows(ids, texts)
                    ids, texts, n = [], [], 0
            if ids:
                yield rows(ids, texts)

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return thin.mapInArrow(run, COLLAPSED).withColumn("text", F.col("text").cast("string"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where about a tenth of the documents, by crc32 of their ids, end in a repeated stretch of their words."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def tail(ws: Column) -> Column:
        g, n = F.floor(h / 10), F.size(ws)
        return F.transform(F.array(F.struct((g % n).alias("a"), (1 + F.floor((n - g % n) / (3 + g % 8))).alias("p"))), lambda v: F.concat_ws(" ", F.transform(ws, lambda w, i: F.when(i >= v["a"], F.get(ws, (v["a"] + (i - v["a"]) % v["p"]).cast("int"))).otherwise(w))))[0]

    replaced = F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, tail(ws)).otherwise(F.lit("")))[0]
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), replaced).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    from quillspark.llm.common import table

    found = collapsed(with_periodic_tails(table(spark, sf_dir, "documents")))
    runs = F.col("runs")

    def greater(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        tie = F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["period"] - b["period"]))
        return F.when(x > y, -1).when(x < y, 1).otherwise(tie).cast("int")

    best = F.get(F.array_sort(runs, greater), 0)
    lines = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    of = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"), "n_words")
    exact = F.expr("best.length * 1000 div best.period")
    return of.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exact.alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")
