import hashlib
import random
import re
import zlib

import pytest

from quillspark.llm import periodic_runs as P


def brute(s, exponent, least):
    """All runs by trying every period."""
    found = {}
    for p in range(1, len(s) // exponent + 1):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, exponent * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((a, b - a, p) for (a, b), p in found.items())


def some(rng):
    n, k = rng.randint(0, 60), rng.choice([1, 2, 2, 3, 4])
    s = [rng.randrange(k) for _ in range(n)]
    if n > 4 and rng.random() < 0.6:
        a, p = rng.randrange(n), 1 + rng.randrange(8)
        s = [x if i < a else s[a + (i - a) % p] for i, x in enumerate(s)]
        if rng.random() < 0.5:
            s = s + s[: rng.randrange(n)]
    return s


@pytest.mark.parametrize("exponent, least", [(2, 1), (2, 6), (3, 2), (4, 6), (5, 1)])
def test_runs_are_those_of_every_period(exponent, least):
    rng = random.Random(exponent * 10 + least)
    for _ in range(1500):
        s = some(rng)
        assert P.runs_of(s, exponent, least) == brute(s, exponent, least), s


def test_cuts_lose_no_run():
    rng = random.Random(3)
    for _ in range(300):
        texts = [[b"%d" % x for x in some(rng)] + [b"u%d" % rng.randrange(9)] * rng.randrange(2) + [b"%d" % x for x in some(rng)] for _ in range(rng.randrange(1, 6))]
        assert P.runs_of_texts(texts) == [brute(t, 4, 6) for t in texts]


def test_factors_are_longest_earlier_stretches():
    rng = random.Random(4)
    for _ in range(300):
        s = some(rng)
        at = 0
        for start, end, source in P.factors(s):
            assert start == at
            earlier = [n for n in range(len(s) - start + 1) if any(s[i : i + n] == s[start : start + n] for i in range(start))]
            assert end - start == max(1, max(earlier, default=0))
            assert source == -1 or (source < start and s[source : source + end - start] == s[start:end])
            at = end
        assert at == len(s)


def test_exponent_is_two_at_least():
    with pytest.raises(ValueError):
        P.runs_of([0, 0, 0], 1, 1)


def want(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words, 4, 6)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    start, length, period = best or (None, None, None)
    return (len(runs), start, length, period, best and 1000 * length // period, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


NAMES = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_is_brute_force(spark, data, docs):
    rows = P.op12_periodic_runs(spark, data).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == len(texts)
    assert sum(r["n_runs"] > 0 for r in rows) > 10
    for r in rows:
        # Texts of many words take long by brute force: the tests of random sequences stand for them.
        if r["n_words"] < 3000:
            assert tuple(r[n] for n in NAMES) == want(r["doc_id"], texts[r["doc_id"]]), r["doc_id"]


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    loop = " ".join(["a b c"] * 5 + ["d"] * 7 + ["é"])
    more = spark.createDataFrame([(20, loop, "en", "a", 1, "x", 5, [1]), (None, None, None, None, None, None, None, None), (None, loop, None, None, None, None, None, None)], odd_docs.schema)
    folder = str(tmp_path)
    odd_docs.unionByName(more).write.parquet(f"{folder}/documents.parquet")
    rows = P.op12_periodic_runs(spark, folder).collect()
    source = odd_docs.unionByName(more).select("doc_id", "text").collect()
    short = [(r["doc_id"], r["text"]) for r in source if r["doc_id"] != 4]
    got = sorted((repr((r["doc_id"], *(r[n] for n in NAMES))) for r in rows if r["doc_id"] != 4))
    assert got == sorted(repr((i, *want(i, t))) for i, t in short)
    assert next(r for r in rows if r["doc_id"] == 4)["n_words"] == 120_000
    whole = {r["doc_id"]: r for r in P.collapsed(more.where("doc_id = 20")).collect()}[20]
    assert whole["text"] == "a b c d é"
    assert [tuple(r) for r in whole["runs"]] == [(0, 15, 3), (15, 7, 1)]
    assert P.collapsed(no_docs).count() == 0
