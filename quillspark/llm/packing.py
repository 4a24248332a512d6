"""Packing documents into sequences by cutting-stock column generation.

A document's ids are its tokens, then one end id. Documents of up to ``SHORT`` ids are pieces as they are. Longer ones are
cut: as many whole sequences as fit, one multiple of ``GRID``, and one rest below ``GRID``. So a corpus of any size has a
histogram of at most ``SHORT + capacity / GRID`` lengths, which is all the driver sees. Over it a linear program chooses how
often to use each pattern (a multiset of lengths that fits a sequence): columns are generated by an unbounded-knapsack
dynamic program over the duals until the program is within ``GAP`` of its bound, the solution is rounded down and what
remains is packed longest piece first, each sequence filled by a subset sum. Pieces are ranked within their length, task by
task, and a piece's rank gives its pattern, sequence and offset by arithmetic.

A null text is an empty one, whose document is the end id alone. Whole texts are tokenised. Repeated rows are documents of
their own. An empty table gives no pieces. Ties between pieces of one length go by their place in the
tasks, so another partitioning gives other, equally full sequences. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quillspark.llm.common import WORD, written

CAPACITY, GRID, SHORT, END = 4096, 64, 256, 2
#: Share of sequences by which the linear program may exceed its least.
GAP = 0.003
#: Lengths of tasks whose table is broadcast; with more rows it is joined by a shuffle.
BROADCAST = 200_000
#: Bytes of ids that a task sends on at a time.
SENT = 2_000_000
#: Entries of a worker's word caches.
CACHED = 250_000

#: Only ASCII white space parts words here; the tokenizer sees to any other inside a word.
_WORDS = re.compile(WORD).findall
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SIMPLE = re.compile(rf'([.,!?;:|*#$%&"()=-]*)([{_LETTERS}]*)([.,!?;:|*#$%&"()=-]*)')


# How a tokenizer is defined whose texts may be encoded word by word.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
}


class Encoder:
    """Ids of whole texts.

    A tokenizer that is defined as ``BY_WORDS`` says goes word by word: its pre-tokens never span white space, so a text's ids
    are its words' ids. There a word of Latin letters with punctuation around it falls into up to three pre-tokens, which go
    to the tokenizer's model as they are, in its byte alphabet; other words are encoded as they stand. Any other tokenizer
    encodes texts whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        options = {k: v for k, v in made["model"].items() if k not in ("vocab", "merges")}
        self.by_words = {"normalizer": made["normalizer"], "pre_tokenizer": made["pre_tokenizer"], "model": options} == BY_WORDS
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}
        # The byte alphabet: printable Latin-1 characters stand for themselves, the others follow from 256 on.
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in own]
        self.letters = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def __call__(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids."""
        if not self.by_words:
            return np.array(self.tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()
        words = _WORDS(text) if text else []
        known = self.words
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = self._word(w)
            out = b"".join([known[w] for w in words])
            for cache in (self.words, self.parts):
                if len(cache) > CACHED:
                    cache.clear()
            return out

    def _word(self, word: str) -> bytes:
        if not (m := _SIMPLE.fullmatch(word)):
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        return self._part(m[1]) + self._part(m[2].lower()) + self._part(m[3])

    def _part(self, part: str) -> bytes:
        if not part:
            return b""
        if (ids := self.parts.get(part)) is None:
            mapped = part if part.isascii() else "".join(self.letters[b] for b in part.encode())
            tokens = self.model.tokenize(mapped)
            ids = self.parts[part] = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        return ids


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(n: int, capacity: int = CAPACITY, grid: int = GRID, short: int = SHORT) -> list[int]:
    """Lengths of the pieces of a document of n ids, in order."""
    if n <= short:
        return [n] if n else []
    full, rest = divmod(n, capacity)
    return [capacity] * full + [x for x in (rest - rest % grid, rest % grid) if x]


def pieces(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, task, nth[, ids]) for each piece of each document.

    ``nth`` numbers the pieces of one length that one task makes; ``ids`` are little-endian 32-bit numbers.
    """
    end = np.array([END], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth"]

    def run(batches):
        from pyspark import TaskContext

        encode, task, seen = _encoder(path), TaskContext.get().partitionId(), {}

        def rows(out: list[tuple], ids: list[bytes]) -> pa.RecordBatch:
            cols = [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * len(names))]
            return pa.RecordBatch.from_arrays([*cols, *([pa.array(ids, pa.binary())] if with_ids else [])], names=[*names, *(["ids"] if with_ids else [])])

        for batch in batches:
            out, ids, size = [], [], 0
            for i in range(batch.num_rows):
                doc_id = batch.column(0)[i].as_py()
                data, at = encode(batch.column(1)[i].as_py()) + end, 0
                for n in cuts(len(data) // 4):
                    part = data[4 * at : 4 * (at + n)]
                    seen[n] = nth = seen.get(n, -1) + 1
                    out.append((doc_id, at, n, zlib.crc32(part), len(data) // 4, task, nth))
                    if with_ids:
                        ids.append(part)
                        size += len(part)
                    at += n
                if size > SENT:
                    yield rows(out, ids)
                    out, ids, size = [], [], 0
            if out:
                yield rows(out, ids)

    schema = ", ".join(f"{c} long" for c in names) + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def best_pattern(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """Counts of each length that fit the capacity and are worth most: unbounded knapsack by dynamic programming."""
    value = np.zeros(capacity + 1)
    for n, w in zip(lengths.tolist(), worth.tolist(), strict=True):
        if w > 0:  # for each remainder modulo n a running maximum
            rows = -(-(capacity + 1) // n)
            grid = np.full(rows * n, -np.inf)
            grid[: capacity + 1] = value
            paid = (np.arange(rows) * w)[:, None]
            value = (np.maximum.accumulate(grid.reshape(rows, n) - paid, axis=0) + paid).ravel()[: capacity + 1]
    counts, at = np.zeros(len(lengths), np.int64), capacity
    while value[at] > 1e-12:
        fits = np.flatnonzero((lengths <= at) & (worth > 0))
        gain = value[at - lengths[fits]] + worth[fits]
        i = fits[int(np.argmax(gain))]
        if gain.max() < value[at] - 1e-9:  # unused room
            at -= 1
            continue
        counts[i] += 1
        at -= int(lengths[i])
    return counts


def _inverse(a: np.ndarray) -> np.ndarray:
    """By Gauss-Jordan with row pivots, in element-wise steps: the driver stays off threaded linear algebra."""
    n = len(a)
    both = np.hstack([a, np.eye(n)])
    for k in range(n):
        p = k + int(np.argmax(np.abs(both[k:, k])))
        both[[k, p]] = both[[p, k]]
        both[k] /= both[k, k]
        factors = both[:, k].copy()
        factors[k] = 0
        both -= factors[:, None] * both[k]
    return both[:, n:]


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Column generation: (patterns by column, how often each) of the linear program that covers the demand exactly.

    It ends once no pattern is worth more than one sequence, or once it is within ``gap`` of a bound. One bound is the sum of
    all lengths; another are the duals, which, divided by the best pattern's worth, are a feasible dual solution.
    """
    m = len(lengths)
    basis = np.diag(capacity // lengths).astype(float)
    x = demand / np.diag(basis)
    inverse = np.diag(1 / np.diag(basis))
    k, least = 0, (lengths * demand).sum() / capacity
    while x.sum() > (1 + gap) * least:
        dual = inverse.sum(axis=0)  # each pattern costs one sequence
        column = best_pattern(lengths, dual, capacity).astype(float)
        if (dual * column).sum() <= 1 + gap:
            break
        into = (inverse * column).sum(axis=1)
        ratio = np.where(into > 1e-9, x / np.where(into > 1e-9, into, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        inverse[out] /= into[out]
        others = np.arange(m) != out
        inverse[others] -= into[others, None] * inverse[out]
        k += 1
        if k % 250 == 0:
            inverse = _inverse(basis)
        x = np.maximum((inverse * demand).sum(axis=1), 0)
    return basis.astype(np.int64), x


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """[(pattern, how often)]: patterns {length: count} that use up the histogram exactly."""
    out = [({n: 1}, c) for n, c in histogram.items() if n == capacity and c]
    lengths = np.array(sorted((n for n, c in histogram.items() if n < capacity and c), reverse=True), np.int64)
    if not len(lengths):
        return out
    left = np.array([histogram[int(n)] for n in lengths], np.int64)
    basis, x = solve(lengths, left.astype(float), capacity)
    for j in np.argsort(-x, kind="stable"):
        column = basis[:, j]
        often = min(int(x[j] + 1e-9), int((left[column > 0] // column[column > 0]).min()))
        if often > 0:
            out.append(({int(lengths[i]): int(column[i]) for i in np.flatnonzero(column)}, often))
            left -= column * often
    while left.sum():  # what rounding left: the longest piece, then what fills its sequence best
        column, often = _fill(lengths, left, capacity), 1
        out.append(({int(lengths[i]): int(column[i]) for i in np.flatnonzero(column)}, often))
        left -= column
    return out


def _fill(lengths: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """Counts, the longest length among them, that fill a sequence as far as ``left`` allows: a subset-sum over bit sets."""
    column = np.zeros(len(lengths), np.int64)
    first = int(np.flatnonzero(left)[0])
    column[first] = 1
    room = capacity - int(lengths[first])
    there, whole = [1], (1 << (room + 1)) - 1
    order = [i for i in range(len(lengths) - 1, -1, -1) if left[i] - column[i] > 0 and lengths[i] <= room]
    for i in order:  # shorter ones first, so the longest are used as far as they go
        n, count, reach, step = int(lengths[i]), min(int(left[i] - column[i]), room // int(lengths[i])), there[-1], 1
        while count > 0:
            step = min(step, count)
            reach |= reach << (n * step) & whole
            count -= step
            step *= 2
        there.append(reach)
    at = there[-1].bit_length() - 1
    for k in range(len(order) - 1, -1, -1):
        i = order[k]
        used = min(int(left[i] - column[i]), at // int(lengths[i]))
        while not there[k] >> (at - used * int(lengths[i])) & 1:
            used -= 1
        column[i] += used
        at -= used * int(lengths[i])
    return column


def slots(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, count in the pattern, first sequence, first offset), ascending by rank."""
    of: dict[int, list] = {}
    sequence, ranked = 0, {}
    for pattern, often in patterns:
        offset = 0
        for n, count in sorted(pattern.items(), reverse=True):
            first = ranked.get(n, 0)
            of.setdefault(n, []).append((first, count, sequence, offset))
            ranked[n] = first + count * often
            offset += n * count
        sequence += often
    return {n: np.array(rows, np.int64) for n, rows in of.items()}


def assign(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (as ``pieces`` makes them, written: they are read more than once) with sequence_id and offset.

    A piece's rank within its length is its number in its task and what the tasks before it have of that length. So ranking
    is a sum over tasks: pieces are neither sorted nor gathered by length, however many one length has.
    """
    counts = written(parts.groupBy("length", "task").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    of = slots(plan(histogram, capacity))
    upto = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("length", "task", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    ranked = parts.join(F.broadcast(before) if counts.count() <= BROADCAST else before.hint("merge"), ["length", "task"])
    ranked = ranked.select(*[c for c in parts.columns if c not in ("task", "nth")], (F.col("before") + F.col("nth")).alias("rank"))
    schema = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())) if f.name == "ids" else f for f in ranked.schema if f.name != "rank"])
    schema = schema.add("sequence_id", T.LongType()).add("offset", T.LongType())

    def run(batches):
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                first, count, base, at = of[int(n)][np.searchsorted(of[int(n)][:, 0], rank[rows], "right") - 1].T
                sequence[rows] = base + (rank[rows] - first) // count
                offset[rows] = at + (rank[rows] - first) % count * n
            kept = [_numbers(c) if f.name == "ids" else c for c, f in zip(batch.columns, batch.schema, strict=True) if f.name != "rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(run, schema)


def _numbers(ids: pa.Array) -> pa.Array:
    """Lists of numbers from their bytes, which stay where they are."""
    _, offsets, data = ids.buffers()
    at = np.frombuffer(offsets, np.int32)[ids.offset : ids.offset + len(ids) + 1] // 4
    values = np.frombuffer(data, "<i4") if data is not None and data.size else np.zeros(0, "<i4")
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values[: int(at[-1])]))


def pack(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Each piece with its sequence and offset; with ``with_ids`` also its ids, an array of numbers."""
    return assign(written(pieces(docs, path, with_ids)))


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad: int = 0) -> DataFrame:
    """(sequence_id, ids, used) from pieces with ids: each padded to the capacity, except where its length is a power of two."""
    order = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    ids = packed.groupBy("sequence_id").agg(F.flatten(order).alias("ids"))
    used = F.size("ids")
    whole = F.bit_count(used) == 1
    return ids.select("sequence_id", F.when(whole, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad), capacity - used))).alias("ids"), used.alias("used"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    from quillspark.llm.common import table

    packed = pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
