import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import packing as P


def check(rows, capacity=P.CAPACITY):
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    used = [sum(n for _, n in own) for own in by.values()]
    return sum(capacity - u for u in used if u & (u - 1))


def test_ids_and_layout(spark, docs):
    tokenizer = P.Encoder(P.tokenizer_path()).tokenizer
    rows = P.pack(docs, P.tokenizer_path()).collect()
    assert check(rows) < 3 * P.CAPACITY
    pieces: dict = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    for d in docs.collect():
        ids = np.array([*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, P.END], "<u4")
        own = sorted(pieces[d["doc_id"]], key=lambda r: r["start"])
        assert [r["start"] for r in own] == list(np.cumsum([0, *(r["length"] for r in own)])[:-1])
        assert sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own)


@pytest.mark.parametrize("text", ["a\x1cb \x85 c\xa0d", "it's <|endoftext|> (hello) x--y", "ΑΣ İ ﬁ é 日本 12ab", "µm ß ÀÉ×÷ don't", "é ́x", ""])
def test_encoder_on_odd_texts(text):
    e = P.Encoder(P.tokenizer_path())
    assert np.frombuffer(e(text), "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_encode_whole_texts(tmp_path):
    """A definition that is not the known one is never taken word by word."""
    import public_tokenizers

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = P.Encoder(public_tokenizers.path(name))
        assert e.by_words == (name == "word_bpe_49k.json")
        for text in ("two words  and\nmore", "it's HERE", ""):
            assert np.frombuffer(e(text), "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_short_documents_are_whole():
    assert P.cuts(0) == [] and P.cuts(1) == [1] and P.cuts(256) == [256] and P.cuts(257) == [256, 1]
    assert P.cuts(513) == [512, 1] and P.cuts(4096) == [4096] and P.cuts(4097) == [4096, 1] and P.cuts(9000) == [4096, 4096, 768, 40]


def test_plan_uses_the_histogram_up():
    rng = random.Random(3)
    for capacity, lengths in ((64, range(1, 64)), (512, [*range(1, 33), *range(64, 512, 32)]), (4096, [*range(64, 4096, 64)])):
        histogram = {n: rng.randrange(40) for n in lengths} | {capacity: 3}
        used: dict = {}
        n = 0
        for pattern, often in P.plan(histogram, capacity):
            assert sum(k * c for k, c in pattern.items()) <= capacity
            n += often
            for k, c in pattern.items():
                used[k] = used.get(k, 0) + c * often
        assert used == {k: c for k, c in histogram.items() if c}
        assert n <= 1.05 * sum(k * c for k, c in histogram.items()) / capacity + 2


def test_knapsack_is_optimal():
    rng = random.Random(1)
    for _ in range(50):
        lengths = np.array(sorted(rng.sample(range(1, 30), 5), reverse=True))
        worth = np.array([rng.random() for _ in lengths])
        best = [0.0] * 41
        for c in range(1, 41):
            best[c] = max([best[c - 1], *(best[c - n] + w for n, w in zip(lengths, worth, strict=True) if n <= c)])
        counts = P.best_pattern(lengths, worth, 40)
        assert (counts * lengths).sum() <= 40 and abs((counts * worth).sum() - best[40]) < 1e-9


def test_odd_rows(spark, odd_docs, no_docs):
    rows = P.pack(odd_docs, P.tokenizer_path()).collect()
    check(rows)
    assert sum(r["length"] for r in rows if r["doc_id"] in (2, 3, 5)) == 3
    assert sum(r["start"] == 0 for r in rows) == odd_docs.count()
    assert P.pack(no_docs, P.tokenizer_path()).collect() == []


def test_sequences_hold_every_id(spark, docs):
    packed = P.pack(docs.limit(30), P.tokenizer_path(), with_ids=True)
    whole = P.sequences(packed)
    assert whole.where((F.size("ids") != P.CAPACITY) & (F.bit_count(F.size("ids")) != 1)).count() == 0
    assert whole.agg(F.sum("used")).first()[0] == packed.agg(F.sum("length")).first()[0]
    pieces = packed.collect()
    found = {r["sequence_id"]: r["ids"] for r in P.sequences(spark.createDataFrame(pieces, packed.schema)).collect()}
    for r in pieces:
        assert found[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    assert {r["sequence_id"] for r in pieces} == set(found)


def test_rows_that_repeat_and_ids_that_are_null(spark):
    """However many pieces have one length and one id, sequences are gapless and none is too long."""
    docs = spark.range(30_000, numPartitions=6).selectExpr("CASE WHEN id % 3 = 0 THEN 5L END AS doc_id", "CASE WHEN id % 2 = 0 THEN 'some words here' END AS text")
    packed = P.pack(docs, P.tokenizer_path())
    rows = packed.collect()
    assert len(rows) == 30_000
    spans = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    for (a, at, n), (b, start, _) in zip(spans, spans[1:], strict=False):
        assert start == (at + n if a == b else 0)
    assert max(o + n for _, o, n in spans) <= P.CAPACITY
