import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import ngram_lm as L
from quillspark.llm.common import crc_mod, crc_mod_of


class Plain:
    """The same model by counting n-grams of words in dictionaries."""

    def __init__(self, train, order):
        self.order, self.words = order, Counter(w for s in train for w in s)
        pad = lambda s: ["<s>"] * (order - 1) + s
        self.count = {order: Counter(tuple(pad(s)[i : i + order]) for s in train for i in range(len(s)))}
        for k in range(order - 1, 0, -1):  # distinct n-grams one word longer
            self.count[k] = Counter(g[1:] for g in self.count[k + 1])
        self.context = {k: defaultdict(lambda: [0, 0, 0, 0]) for k in self.count}
        for k, counts in self.count.items():
            for g, n in counts.items():
                self.context[k][g[:-1]][0] += n
                self.context[k][g[:-1]][min(n, 3)] += 1
        self.cut = {k: L.discounts(*[sum(n == i for n in c.values()) for i in (1, 2, 3, 4)]) for k, c in self.count.items()}

    def p(self, gram):
        if not gram:
            return 1 / (len(self.words) + 1)
        k = len(gram)
        whole, *seen = self.context[k].get(gram[:-1], [0, 0, 0, 0])
        if not whole:
            return self.p(gram[1:])
        n, cut = self.count[k][gram], self.cut[k]
        return max(n - [0, *cut][min(n, 3)], 0) / whole + sum(c * x for c, x in zip(cut, seen, strict=True)) / whole * self.p(gram[1:])

    def score(self, s):
        padded = ["<s>"] * (self.order - 1) + s
        return sum(math.log10(self.p(tuple(padded[i : i + self.order]))) for i in range(len(s)))


def tokens(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()), "</s>"]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_against_counting(spark, data, docs, order, monkeypatch):
    monkeypatch.setattr(L, "PACK", 150_000)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    if order == 2:
        rows = [r.asDict() for r in L.op7_lm_scoring(spark, data).collect()]
    else:
        rows = [{**r.asDict(), "held_out": not r["learned"]} for r in L.score(docs, crc_mod(F.col("doc_id"), 7) != 2, order).collect()]
    model = Plain([tokens(t) for i, t in texts.items() if crc_mod_of(i, 7) != 2], order)
    n, v = sum(model.words.values()), len(model.words)
    for context in [("<s>",) * (order - 1), next(iter(model.context[order])), ("no such word",) * (order - 1)]:
        assert abs(sum(model.p((*context, w)) for w in model.words) + model.p((*context, "unseen")) - 1) < 1e-9
    assert len(rows) == len(texts)
    for r in rows:
        s = tokens(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(s), sum(model.words[w] > 0 for w in s), n, crc_mod_of(r["doc_id"], 7) == 2)
        assert r["base_score"] == pytest.approx(sum(math.log10((model.words[w] + 1) / (n + v + 1)) for w in s))
        assert r["score"] == pytest.approx(model.score(s))
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_packing_does_not_matter(spark, docs):
    """One document a pack, or all in few: the same scores; so are those of the rows dealt otherwise."""
    want = sorted(map(tuple, L.score(docs.limit(60), F.col("doc_id") % 3 > 0, 3).collect()))
    keep, L.PACK = L.PACK, 1
    try:
        got = sorted(map(tuple, L.score(docs.limit(60).repartition(5), F.col("doc_id") % 3 > 0, 3).collect()))
    finally:
        L.PACK = keep
    assert len(got) == len(want) and all(a[:5] == b[:5] and np.allclose(a[5:], b[5:]) for a, b in zip(got, want, strict=True))


def test_mix_is_one_to_one():
    x = np.random.default_rng(1).integers(0, 1 << 63, 100_000, dtype=np.uint64)
    assert len(np.unique(L.mixed(x))) == len(np.unique(x))


def test_columns_come_back():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64))
    n = np.arange(1000, dtype=np.int64)
    assert all((a == b).all() for a, b in zip(L.unpacked(L.packed(keys, n), "u8", "i8"), (keys, n), strict=True))
    assert [len(x) for x in L.unpacked(L.packed(keys[:0], n[:0]), "u8", "i8")] == [0, 0]
    assert all((a == b).all() for a, b in zip(L.unsqueezed(L.squeezed(keys[::-1], n), 2), (keys[::-1], n), strict=True))


def test_odd_rows(spark, odd_docs, no_docs):
    rows = L.score(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 5)} == {1}
    assert L.score(no_docs).collect() == []
    rows = L.score(odd_docs, False).collect()
    assert all(r["n_known"] == 0 == r["train_tokens"] and r["score"] == 0 == r["base_score"] for r in rows)
    with pytest.raises(ValueError):
        L.score(odd_docs, order=1)


def test_files_are_whole(tmp_path):
    files = L.Files(f"file://{tmp_path}/m")
    files.put_array("a", np.arange(5, dtype=np.uint64))
    files.put_array("a", np.arange(7, dtype=np.uint64))
    files.put_array("none", np.zeros(0, np.uint64))
    assert files.map("a", "u8").tolist() == list(range(7)) and len(files.map("none", "u8")) == 0
    assert sorted(p.name for p in (tmp_path / "m").iterdir()) == ["a", "none"]


def test_files_of_a_store_that_is_not_mounted(tmp_path, monkeypatch):
    from pyarrow import fs

    files = L.Files(f"far://{tmp_path}/m")
    monkeypatch.setattr(L.Files, "_remote", lambda self: (fs.LocalFileSystem(), f"{tmp_path}/m"))
    for _ in range(2):  # a repeated task
        files.put_array("a", np.arange(7, dtype=np.uint64))
    assert files.map("a", "u8").tolist() == list(range(7))
    assert sorted(p.name for p in (tmp_path / "m").iterdir()) == ["a"]
