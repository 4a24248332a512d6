import re
from collections import Counter

import numpy as np

from quillspark.llm import quality as Q


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    again = {k for k, n in Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in again for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_counts_and_verdicts(spark, data, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = Q.op8_quality(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = counts(texts[r["doc_id"]])
        assert tuple(r[n] for n in NAMES) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_verdicts_follow_labels(spark):
    folder = "/root/testdata/sf0.01"
    kept = {r["doc_id"]: r["kept"] for r in Q.op8_quality(spark, folder).collect()}
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert sum(kept[i] for i, q in good.items() if q) / sum(map(bool, good.values())) > 0.95
    assert sum(not kept[i] for i, q in good.items() if not q) / sum(not q for q in good.values()) > 0.9


def test_distance():
    p, q = np.array([[1.0, 0.0], [1, 1]]), np.array([0.0, 1.0])
    assert np.allclose(Q.js_distance(p, q), [1.0, np.sqrt(2 - 0.75 * np.log2(3) - 0.5)])  # the entropy of the mean less the mean of the entropies
    assert Q.js_distance(np.array([3.0, 1.0]), np.array([0.75, 0.25])) < 1e-6


def test_repeats_stay_inside_documents():
    a = [b"a", b"b", b"c", b"d", b"e"]
    assert Q.repeated_words([a, a, a + a, [], [b"x"] * 7]).tolist() == [0, 0, 10, 0, 7]


def test_odd_rows(spark, odd_docs, no_docs):
    model = Q.fit(odd_docs)
    rows = Q.assess(odd_docs, model).collect()
    texts = [r["text"] for r in odd_docs.collect()]
    assert sorted(tuple(r[n] for n in NAMES) for r in rows) == sorted(map(counts, texts))
    assert not any(r["kept"] for r in rows if r["doc_id"] in (2, 3, 5, 7))
    assert Q.assess(no_docs, model).collect() == [] and Q.fit(no_docs) == {}
    assert all(r["kept"] != r["base_failed"] for r in Q.assess(odd_docs, {}).collect())


def plain_distance(p, q):
    p, q = np.array(p, float) / sum(p), np.array(q, float) / sum(q)
    m = (p + q) / 2
    part = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    return np.sqrt(max(0.0, (part(p) + part(q)) / 2))


def test_one_language_counts_for_both_distances():
    """The verdict against a plain reading of it: some language must be near in characters and in words."""
    import random

    rng = random.Random(3)
    classes = lambda *c: np.array(c, float)
    model = {
        "a": (classes(0.15, 0.8, 0.02, 0.01, 0.02, 0, 0, 0), {b"the": 0, b"of": 1}, np.array([0.3, 0.2, 0.5])),
        "b": (classes(0.15, 0.05, 0.77, 0.01, 0.02, 0, 0, 0), {b"und": 0, b"der": 1}, np.array([0.3, 0.2, 0.5])),
    }
    texts = []
    for _ in range(60):
        words = rng.choices(["the", "of", "und", "der", "house", "water"], [rng.random() ** 3 for _ in range(6)], k=80)
        texts.append(" ".join(w + str(i) * (w in ("house", "water")) for i, w in enumerate(words)))
    texts += [t.upper() for t in texts]
    got = Q.judge(texts, model)
    seen = set()
    for i, t in enumerate(texts):
        own, counts = Q.class_counts([t.encode()])[0], Counter(t.lower().split())
        both = []
        for reference, bins, shares in model.values():
            hist = [counts[w.decode()] for w in bins]
            both.append((plain_distance(own, reference), plain_distance([*hist, sum(counts.values()) - sum(hist)], shares)))
        near = any(c <= Q.CHAR_LIMIT and w <= Q.WORD_LIMIT for c, w in both)
        assert got["kept"][i] == (near and not got["base_failed"][i])
        apart = min(c for c, _ in both) <= Q.CHAR_LIMIT and min(w for _, w in both) <= Q.WORD_LIMIT
        seen.add((bool(near), bool(apart)))
    assert {(True, True), (False, True), (False, False)} <= seen


def test_references_are_of_all_rows(spark, monkeypatch):
    """Beyond any sample's size, and sent on in parts: the references are those of a plain count."""
    monkeypatch.setattr(Q, "HELD", 50)
    texts = [f"the w{i} of w{i % 7} " + "end. " * (i % 5) for i in range(1500)]
    model = Q.fit(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string"), common=5)
    shares = Counter()
    for t in texts:
        words = t.split()
        for w in words:
            shares[w.encode()] += 1 / len(words) / len(texts)
    reference, bins, words = model["en"]
    want = sorted(shares.items(), key=lambda r: (-round(r[1], 9), r[0]))[:5]
    assert list(bins) == [w for w, _ in want] and np.allclose(words[:-1], [v for _, v in want], atol=1e-9)
    assert np.allclose(reference, np.mean([Q.class_counts([t.encode()])[0] / len(t) for t in texts], axis=0), atol=1e-9)
