"""Scoring by an interpolated modified Kneser-Ney n-gram model, counted in Spark, in sorted hash arrays that workers map.

Documents are put into packs of about ``PACK`` characters, written once. An n-gram is a 64-bit hash of its words' hashes
(XXH64), so a k-gram's key follows from that of its first k - 1 words and its last word. From the longest n-grams down,
each level is one round over the packs:

1. Every pack sends its distinct keys, sorted, to their shards (by leading bits), each with what the pack adds to it: the
   longest n-grams their counts; shorter ones how many distinct n-grams one word longer end in them (continuation counts)
   and, as contexts, the counts and the numbers of once, twice and more often seen n-grams that begin with them.
2. A shard sums what packs sent into one sorted hash array with its values, writes it, maps it into memory, and looks up
   each pack's keys in it. Of the packs that have an n-gram one is told that it owns it, so it is passed on to the next
   level once.
3. Answers meet by pack, in one file.

In the end each pack scores its documents from its own answers. A worker thus maps one shard at a time and reads one pack's
answers: neither a whole model nor a shard for each document goes anywhere, and what is shuffled grows with the documents. A
frequent n-gram is one key a pack. Files are written whole under fixed names with contents that a repeated task makes
again. The driver sees a few numbers a shard.

Null texts are empty: one end token. Repeated rows count as often as they occur. With nothing to learn from, every token has
probability 1 / (V + 1). Only doc_id and text are read.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import crc_mod, shared_folder, written

#: Words of an n-gram; characters of a pack and keys of a shard, about.
ORDER, PACK, SHARD = 2, 3_000_000, 700_000
_MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))
_NEXT = np.uint64(0x9E3779B97F4A7C15)


class Files:
    """Whole arrays and bytes in the shared folder: mapped in place where it is mounted, else copied to the worker and mapped."""

    def __init__(self, url: str):
        parsed = urlparse(url)
        self.local = parsed.path if parsed.scheme in ("", "file") else None
        self.url = url

    def _remote(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.url)

    def put(self, name: str, data: bytes) -> None:
        """Write a file whole. One that is there already came from the same task and holds the same."""
        if self.local:
            os.makedirs(self.local, exist_ok=True)
            part = f"{self.local}/.{name}.{uuid.uuid4().hex}"
            with open(part, "wb") as out:
                out.write(data)
            os.replace(part, f"{self.local}/{name}")
            return
        from pyarrow import fs

        store, root = self._remote()
        store.create_dir(root, recursive=True)
        part = f"{root}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(data)
        there = lambda: store.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound
        try:
            if not there():
                store.move(part, f"{root}/{name}")
                return
        except OSError:
            if not there():
                raise
        store.delete_file(part)

    def put_array(self, name: str, array: np.ndarray) -> None:
        self.put(name, np.ascontiguousarray(array).tobytes())

    def get(self, name: str) -> bytes:
        if self.local:
            with open(f"{self.local}/{name}", "rb") as source:
                return source.read()
        store, root = self._remote()
        with store.open_input_stream(f"{root}/{name}") as source:
            return source.read()

    def map(self, name: str, kind: str) -> np.ndarray:
        if self.local:
            path = f"{self.local}/{name}"
            return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
        with tempfile.NamedTemporaryFile() as copy:
            copy.write(self.get(name))
            copy.flush()  # the file is unlinked at once; the mapping keeps it
            return np.memmap(copy.name, kind, "r") if copy.tell() else np.zeros(0, kind)


def mixed(keys: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit keys."""
    for shift, by in _MIX:
        keys = (keys ^ (keys >> np.uint64(shift))) * np.uint64(by)
    return keys ^ (keys >> np.uint64(31))


def packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length, the first one ascending, compressed: differences, bytes of equal rank together."""
    import zstandard

    first = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    raw = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in (first, *columns[1:]))
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(raw) // sum(sizes), [], 0
    for k, s in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * s].reshape(s, n).T).view(k).ravel())
        at += n * s
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


def squeezed(*columns: np.ndarray) -> bytes:
    """64-bit columns of equal length in any order, compressed."""
    import zstandard

    raw = b"".join(np.ascontiguousarray(c.astype(np.uint64).view(np.uint8).reshape(len(c), 8).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unsqueezed(data: bytes, n: int) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = len(raw) // n
    return [np.ascontiguousarray(raw[i * size : (i + 1) * size].reshape(8, size // 8).T).view(np.uint64).ravel() for i in range(n)]


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words and ends, tokens of each text). An end's hash is of a line feed, which no word is."""
    from xxhash import xxh64_intdigest as h

    end, out, sizes = h(b"\n"), [], []
    for t in texts:
        words = t.encode("utf-8", "surrogatepass").lower().split() if t else ()
        out += [h(w) for w in words]
        out.append(end)
        sizes.append(len(words) + 1)
    return np.array(out, np.uint64), np.array(sizes, np.int64)


def starts(order: int) -> list[np.ndarray]:
    """Keys of 1, 2, .. starts of a text in a row. No word has the hash of the first."""
    from xxhash import xxh64_intdigest as h

    out = [np.array([h(b"\n\n")], np.uint64)]
    for _ in range(order - 1):
        out.append(mixed(out[-1] * _NEXT + out[0]))
    return out


class Grams:
    """The n-grams of a pack's documents: by level k (from 1) the key of the k words that end at each token."""

    def __init__(self, texts: list[str | None], order: int):
        words, self.sizes = tokens(texts)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.start = starts(order)
        self.keys = [words]
        for k in range(1, order):
            self.keys.append(mixed(self.before(k) * _NEXT + words))

    def before(self, k: int) -> np.ndarray:
        """The keys of the k words before each token."""
        out = np.empty_like(self.keys[k - 1])
        out[1:] = self.keys[k - 1][:-1]
        out[self.first] = self.start[k - 1]
        return out

    def ranked(self, k: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(distinct keys of level k, ascending; each token's place among them; a token at which each one ends, or -1; the starts' place).

        Below the top the key of starts is among them, as they are contexts. By one sort.
        """
        own = self.keys[k - 1]
        by = np.argsort(own)
        keys = own[by]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        place = np.empty(len(own), np.int32)
        place[by] = np.cumsum(new, dtype=np.int32) - 1
        keys, at = keys[new], by[new]
        if k == order:
            return keys, place, at, -1
        start = int(np.searchsorted(keys, self.start[k - 1][0]))
        place[place >= start] += 1
        return np.insert(keys, start, self.start[k - 1][0]), place, np.insert(at, start, -1), start

    def shifted(self, place: np.ndarray, start: int) -> np.ndarray:
        """Each token's context's place, from the places of the tokens before."""
        out = np.empty_like(place)
        out[1:] = place[:-1]
        out[self.first] = start
        return out


def _value_columns(k: int, order: int) -> int:
    """Values of a key at level k: its count; below the top also what it counts as a context; for words, their raw counts too."""
    return 1 if k == order else 5 if k > 1 else 6


def packs(docs: DataFrame, learn: Column, chars: int = PACK) -> DataFrame:
    """(pack, doc_id, learn, text): documents in packs of about so many characters, a list a column; written, as pack ids are drawn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [[], [], []], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n and n + len(row[2] or "") > chars:
                    yield _pack(held)
                    held, n = [[], [], []], 0
                for h, v in zip(held, row, strict=True):
                    h.append(v)
                n += len(row[2] or "") + 1
        if n:
            yield _pack(held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), "text")
    return written(rows.mapInArrow(run, "pack long, doc_id array<long>, learn array<boolean>, text array<string>"))


def _pack(held: list[list]) -> pa.RecordBatch:
    cols = [pa.array([uuid.uuid4().int >> 65], pa.int64())] + [pa.array([h], pa.list_(t)) for h, t in zip(held, (pa.int64(), pa.bool_(), pa.string()), strict=True)]
    return pa.RecordBatch.from_arrays(cols, names=["pack", "doc_id", "learn", "text"])


def _bits(entries: float, each: int) -> int:
    return max(2, int(np.ceil(np.log2(max(1.0, entries / each)))))


def _emitted(grams: Grams, learn: np.ndarray, k: int, order: int, above: list[np.ndarray] | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """A pack's distinct keys of level k and what it adds to their values; ``above`` are the answers of level k + 1."""
    keys, place, _, start = grams.ranked(k, order)
    tally = lambda of, weights=None: np.bincount(of, weights, len(keys)).astype(np.uint64)
    raw = tally(place[np.repeat(learn, grams.sizes)]) if k in (1, order) else None
    if k == order:
        return keys, [raw]
    at = grams.ranked(k + 1, order)[2]
    mine = (above[-1] > 0) & (at >= 0)
    own, seen = at[mine], above[0][mine]
    context = grams.shifted(place, start)[own]
    columns = [tally(place[own]), tally(context, seen.astype(np.float64)), *(tally(context[x]) for x in (seen == 1, seen == 2, seen > 2))]
    return keys, [*columns, raw] if k == 1 else columns


def _answers(files: Files, pack: int, k: int, order: int) -> list[np.ndarray]:
    return unsqueezed(files.get(f"answer-{k}-{pack}"), _value_columns(k, order) + 1)


def level(of: DataFrame, files: Files, k: int, order: int, bits: int) -> np.ndarray:
    """One round: sends level k's keys to their shards, sums and answers them. Returns tallies over all shards.

    These are: keys with a count, their counts' sum, keys with a count of 1, 2, 3, 4 and above 2, words learned, their tokens.
    """
    columns = _value_columns(k, order)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pack, learn, texts = (batch.column(c)[i].as_py() for c in range(3))
                above = _answers(files, pack, k + 1, order) if k < order else None
                keys, values = _emitted(Grams(texts, order), np.array(learn, bool), k, order, above)
                shard = (keys >> np.uint64(64 - bits)).astype(np.int64)
                first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
                data = [packed(keys[a:b], *(v[a:b] for v in values)) for a, b in zip(first, [*first[1:], len(keys)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard[first]), pa.array([pack] * len(first), pa.int64()), pa.array(data, pa.binary())], names=["shard", "pack", "data"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _groups(batches):
            asked = [unpacked(r[2], "u8", *["u8"] * columns) for r in rows]
            every = [np.concatenate(c) for c in zip(*asked, strict=True)]
            asked = [x[:1] for x in asked]
            order_ = np.argsort(every[0], kind="stable")
            keys = every[0][order_]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sums = [np.add.reduceat(v[order_], first) for v in every[1:]]
            # The first pack that adds to an n-gram's count owns it.
            place = np.where(every[1][order_] > 0, np.arange(len(keys)), len(keys))
            owner = np.minimum.reduceat(place, first)
            own = np.zeros(len(keys), np.uint64)
            own[order_[owner[owner < len(keys)]]] = 1
            known = np.any([x > 0 for x in sums], axis=0)
            files.put_array(f"keys-{k}-{shard}", keys[first][known])
            kinds = []
            for j, x in enumerate(sums):
                kinds.append(np.min_scalar_type(int(x.max(initial=0))).str.lstrip("<|"))
                files.put_array(f"values-{k}-{j}-{shard}.{kinds[-1]}", x[known].astype(kinds[-1]))
            model = files.map(f"keys-{k}-{shard}", "u8"), [files.map(f"values-{k}-{j}-{shard}.{t}", t) for j, t in enumerate(kinds)]
            at, data = 0, []
            for (wanted,) in asked:
                data.append(squeezed(*looked_up(wanted, *model), own[at : at + len(wanted)]))
                at += len(wanted)
            c = sums[0]
            tally = [(c > 0).sum(), c.sum(), *((c == n).sum() for n in (1, 2, 3, 4)), (c > 2).sum(), *([(sums[5] > 0).sum(), sums[5].sum()] if k == 1 else [])]
            yield _answer([r[1] for r in rows] + [-1], shard, [*data, None], [None] * len(rows) + [[int(x) for x in tally]])

    sent = of.select("pack", "learn", "text").mapInArrow(emit, "shard long, pack long, data binary")
    found = written(sent.repartition("shard").sortWithinPartitions("shard", "pack").mapInArrow(merge, "pack long, shard long, data binary, tally array<bigint>"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, rows in _groups(batches):
            parts = [unsqueezed(r[2], columns + 1) for r in rows]
            files.put(f"answer-{k}-{pack}", squeezed(*map(np.concatenate, zip(*parts, strict=True))))
            yield pa.RecordBatch.from_arrays([pa.array([pack], pa.int64())], names=["pack"])

    found.where("pack >= 0").select("pack", "shard", "data").repartition("pack").sortWithinPartitions("pack", "shard").mapInArrow(store, "pack long").agg(F.count("*")).collect()
    sums = found.where("pack < 0").select(F.posexplode("tally")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    out = np.zeros(9, np.int64)
    for r in sums:
        out[r["pos"]] = r["n"]
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(key, its rows) from batches sorted by their first column."""
    now, rows = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = tuple(c[i].as_py() for c in batch.columns)
            if row[0] != now:
                if rows:
                    yield now, rows
                now, rows = row[0], []
            rows.append(row)
    if rows:
        yield now, rows


def _answer(packs: list[int], shard: int, data: list[bytes | None], tally: list[list | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(packs, pa.int64()), pa.array([shard] * len(packs), pa.int64()), pa.array(data, pa.binary()), pa.array(tally, pa.list_(pa.int64()))], names=["pack", "shard", "data", "tally"])


def looked_up(wanted: np.ndarray, keys: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    """The values of ascending keys in a sorted hash array; 0 for those it lacks."""
    out = [np.zeros(len(wanted), np.uint64) for _ in values]
    if len(keys):
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        hit = keys[at] == wanted
        for o, v in zip(out, values, strict=True):
            o[hit] = v[at[hit]]
    return out


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and above; each kept between 0 and its count where counts are few."""
    if not n1:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d1 = min(max(1 - 2 * y * n2 / n1, 0.05), 0.95)
    d2 = min(max(2 - 3 * y * n3 / n2, 0.05), 1.95) if n2 else d1
    d3 = min(max(3 - 4 * y * n4 / n3, 0.05), 2.95) if n3 else d2
    return d1, d2, d3


def _discounted(c: np.ndarray, cut: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(c - np.array([0.0, *cut])[np.minimum(c, 3).astype(np.int64)], 0)


def score_pack(texts: list[str | None], answers: list[list[np.ndarray]], cuts: list[tuple], tallies: np.ndarray) -> dict[str, np.ndarray]:
    """Counts and log10 probabilities of a pack's whole texts; ``answers``, ``cuts`` and ``tallies`` by level from 1."""
    order = len(answers)
    grams = Grams(texts, order)
    n, v = int(tallies[0][8]), int(tallies[0][7])
    _, place, _, start = grams.ranked(1, order)
    raw = answers[0][5][place].astype(np.float64)
    base = np.log10((raw + 1) / (n + 1 * (v + 1)))
    total = int(tallies[0][1])
    left = sum(c * m for c, m in zip(cuts[0], (tallies[0][2], tallies[0][3], tallies[0][6]), strict=True)) / total if total else 1.0
    p = _discounted(answers[0][0][place].astype(np.float64), cuts[0]) / max(1, total) + left / (v + 1)
    for k in range(1, order):
        context = grams.shifted(place, start)
        whole, *seen = (x[context].astype(np.float64) for x in answers[k - 1][1:5])
        free = sum(c * x for c, x in zip(cuts[k], seen, strict=True)) / np.maximum(whole, 1)
        _, place, _, start = grams.ranked(k + 1, order)
        p = np.where(whole > 0, _discounted(answers[k][0][place].astype(np.float64), cuts[k]) / np.maximum(whole, 1) + free * p, p)
    sums = lambda x: np.add.reduceat(x, grams.first)
    return {"n_tokens": grams.sizes, "n_known": sums((raw > 0).astype(np.int64)), "base_score": sums(base), "score": sums(np.log10(p))}


SCORES = "doc_id long, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def score(docs: DataFrame, learn: Column | bool = True, order: int = ORDER) -> DataFrame:
    """Scores of all ``docs`` under the model of those for which ``learn`` holds, in one go.

    Gives doc_id, learned, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score (log10) and perplexity. The
    model's arrays stay in the shared folder: ``keys-k-shard`` and ``values-k-column-shard``.
    """
    if order < 2:
        raise ValueError("an n-gram has two words at least")
    of = packs(docs, learn if isinstance(learn, Column) else F.lit(learn))
    files = Files(f"{shared_folder(docs.sparkSession)}/ngrams-{uuid.uuid4().hex}")
    words = of.agg(F.coalesce(F.sum(F.aggregate("text", F.lit(0).cast("long"), lambda a, t: a + F.coalesce(F.length(t), F.lit(0)))), F.lit(0))).first()[0] / 6
    tallies = np.zeros((order, 9), np.int64)
    for k in range(order, 0, -1):
        # Keys that packs send, about, by how many values they carry: of words a pack has a third of its tokens at most.
        sent = words * (1 if k == order else _value_columns(k, order) / 2) * (0.3 if k == 1 else 1)
        tallies[k - 1] = level(of, files, k, order, _bits(sent, SHARD))
    cuts = [discounts(*t[2:6].tolist()) for t in tallies]
    tokens_learned = int(tallies[0][8])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pack, ids, learned, texts = (batch.column(c)[i].as_py() for c in range(4))
                out = score_pack(texts, [_answers(files, pack, k, order) for k in range(1, order + 1)], cuts, tallies)
                with np.errstate(over="ignore"):
                    perplexity = 10 ** (-out["score"] / out["n_tokens"])
                cols = [pa.array(ids, pa.int64()), pa.array(learned, pa.bool_()), *map(pa.array, (out["n_tokens"], out["n_known"])), pa.array([tokens_learned] * len(ids), pa.int64())]
                cols += [pa.array(x, pa.float64()) for x in (out["base_score"], out["score"], perplexity)]
                yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in SCORES.split(", ")])

    return of.select("pack", "doc_id", "learn", "text").mapInArrow(run, SCORES)


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    from quillspark.llm.common import table

    docs = table(spark, sf_dir, "documents")
    found = score(docs, crc_mod(F.col("doc_id"), 7) != 2)
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
