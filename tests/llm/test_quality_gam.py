import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import quality_gam as G


def plain(text):
    """The features of one text, counted simply."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = max(1, len(words))
    of = lambda pattern: len(re.findall(pattern, text))
    chars = max(1, len(text))
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    again = {k for k, c in Counter(windows).items() if c > 1}
    covered = {j for i, w in enumerate(windows) if w in again for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return [
        np.log1p(len(words)),
        sum(map(len, words)) / n,
        of("[A-Z]") / max(1, of("[A-Za-z]")),
        of("[0-9]") / chars,
        of("[.,;:!?'\"()-]") / chars,
        of(r"[#*$%&|<>]") / chars,
        sum(ord(c) < 128 and not c.isalnum() and c not in ".,;:!?'\"()-#*$%&|<> \t\n\x0b\x0c\r" for c in text) / chars,
        sum(ord(c) > 127 for c in text) / chars,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        len(covered) / n,
        len(set(words)) / n,
        max(Counter(words).values(), default=0) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(len(words) / max(1, len(lines))),
        sum(not re.search(r"[A-Za-z0-9\u0080-\U0010ffff]", w) for w in words) / n,
    ]


def test_features_are_counts(docs):
    texts = [r["text"] or "" for r in docs.collect()] + ["", " \n ", "a", "é | é | é", "A A A\nA A A\n\nb"]
    got = G.features([t.encode() for t in texts])
    assert got.shape == (len(texts), len(G.FEATURES))
    np.testing.assert_allclose(got, [plain(t) for t in texts], atol=1e-12)
    # A text's features don't depend on its neighbours.
    np.testing.assert_array_equal(got[5:9], np.concatenate([G.features([t.encode()]) for t in texts[5:9]]))


def brute_tree(g, h, w, leaves, least):
    """Cuts found by trying every cut of every leaf."""
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        tried = [(gain(a, c) + gain(c, b) - gain(a, b), c) for a, b in zip(cuts, cuts[1:], strict=False) for c in range(a + 1, b) if w[a:c].sum() >= least and w[c:b].sum() >= least]
        best = max(tried, default=(0, 0))
        if best[0] <= 1e-9:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def test_trees_and_crosses_are_the_best_ones():
    rng = np.random.default_rng(5)
    for _ in range(50):
        n = int(rng.integers(1, 12))
        g, h, w = rng.normal(size=n), rng.random(n), rng.integers(0, 9, n).astype(float)
        np.testing.assert_allclose(G.tree(g, h, w, 4, 5.0), brute_tree(g, h, w, 4, 5.0), atol=1e-9)
        g, h, w = rng.normal(size=(n, 5)), rng.random((n, 5)), rng.integers(1, 9, (n, 5)).astype(float)
        best = 0.0
        for i in range(1, n):
            for j in range(1, 5):
                four = [(slice(None, i), slice(None, j)), (slice(None, i), slice(j, None)), (slice(i, None), slice(None, j)), (slice(i, None), slice(j, None))]
                if min(w[q].sum() for q in four) >= 5:
                    best = max(best, sum(g[q].sum() ** 2 / (h[q].sum() + 1) for q in four) - g.sum() ** 2 / (h.sum() + 1))
        assert G.crossed(g, h, w, 5.0)[0] == pytest.approx(best)


def test_pairs_explain_what_features_alone_cannot():
    rng = np.random.default_rng(6)
    x = rng.random((4000, 4))
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    alone, both = G.learn(x, y, pairs=0), G.learn(x, y, pairs=1)
    assert [(i, j) for i, j, _ in both.pairs] == [(1, 3)]
    right = lambda m: ((m.score(x) > 0.5) == (y > 0.5)).mean()
    assert right(alone) < 0.7 and right(both) > 0.95
    # A score is the sum of what its tables say.
    b = both.bins(x[:5])
    odds = [both.base + sum(t[b[r, k]] for k, t in enumerate(both.tables)) + sum(t[b[r, i], b[r, j]] for i, j, t in both.pairs) for r in range(5)]
    np.testing.assert_allclose(both.log_odds(x[:5]), odds)
    assert [n for n, _ in both.terms()][-1] == f"{G.FEATURES[1]} x {G.FEATURES[3]}"


def test_held_out_labels_are_met(spark):
    folder = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in G.op11_quality_gam(spark, folder).collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    labels = [r for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    good, bad = ([rows[r["doc_id"]]["predicted"] for r in labels if r["quality"] == q] for q in (1, 0))
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.03, (np.mean(good), np.mean(bad))
    again = {r["doc_id"]: r["score"] for r in G.op11_quality_gam(spark, folder).collect()}
    assert again == {i: r["score"] for i, r in rows.items()}


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (2, 0, None), (3, None, "b"), (None, 1, "c"), (99, 0, "d"), (4, 1, "e"), (6, 0, "f")], "doc_id long, quality int, text string")
    model = G.fit(odd_docs, labels)
    rows = G.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
    assert len({r["score"] for r in rows if r["doc_id"] in (2, 3)}) == 1
    assert G.score(no_docs, model).count() == 0
    for none in (G.fit(no_docs, labels), G.fit(odd_docs, labels.limit(0))):
        assert {r["score"] for r in G.score(odd_docs, none).collect()} == {0.5}


def test_the_fit_is_bounded(spark):
    docs = spark.range(4000).selectExpr("id % 50 AS doc_id", "concat('w', id) AS text")
    labels = spark.range(4000).selectExpr("id % 50 AS doc_id", "CAST(id % 2 AS INT) AS quality")
    seen = []
    old, G.learn = G.learn, lambda x, y: seen.append((x.shape, y.shape)) or old(x, y)
    try:
        G.fit(docs, labels, rows=20)
    finally:
        G.learn = old
    assert seen == [((20, len(G.FEATURES)), (20,))]
