import hashlib
import math
import re
from collections import Counter
from zlib import crc32

from quillspark.llm import importance as I


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, target, n=1, buckets=10_000, percent=10):
    """Rows of (doc_id, n_features, weight, score, rank) by counting; ids are distinct."""
    words = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    runs = lambda ws: [" ".join(ws[i : i + k]) for k in range(1, n + 1) for i in range(len(ws) - k + 1)]
    buckets_of = lambda text: [crc32(x.encode()) % buckets for x in runs(words(text))]
    own = [buckets_of(t) for _, t in docs]
    s, t = Counter(b for x in own for b in x), Counter(b for x in target for b in buckets_of(x))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    out = []
    for (i, text), x in zip(docs, own, strict=True):
        weight = sum(gain[b] for b in x) // len(x) if x else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))))
    enough = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {r[0]: k + 1 for k, r in enumerate(enough[: len(enough) * percent // 100])}
    return [(*r[:4], rank.get(r[0])) for r in out]


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()]


def by(rows):
    return sorted(rows, key=repr)


def test_query_is_counting(spark, data, docs):
    target = [r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert by(rows_of(I.op13_importance(spark, data))) == by(brute([(r["doc_id"], r["text"]) for r in docs.collect()], target))


def test_query_is_its_sql(spark, data, compare):
    compare(I.op13_importance(spark, data), I.OP13_SQL)


def test_longer_features_small_packs_and_groups(spark, docs, data, monkeypatch):
    monkeypatch.setattr(I, "PACK_WORDS", 3000)
    monkeypatch.setattr(I, "GROUP", 2)
    target = spark.read.parquet(f"{data}/benchmark.parquet").select("text")
    got = I.resampled(docs.repartition(7), target, n=3, buckets=997, percent=25)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], 3, 997, 25)
    assert by(rows_of(got)) == by(want)


def test_odd_rows(spark, odd_docs, no_docs):
    target = spark.createDataFrame([("the lazy dog",), (None,), ("",)], "text string")
    source = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = rows_of(I.resampled(odd_docs, target, percent=100))
    want = brute(source, ["the lazy dog"], percent=100)
    assert by(r[:4] for r in got) == by(r[:4] for r in want)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, sum(r[4] is not None for r in want) + 1))
    empty = I.resampled(odd_docs, target.limit(0))
    assert by(r[:4] for r in rows_of(empty)) == by(r[:4] for r in brute(source, []))
    assert I.resampled(no_docs, target).count() == 0


def test_rows_that_repeat_have_neighbouring_ranks(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN NULL ELSE id END AS doc_id", f"'{text}' AS text")
    got = I.resampled(docs, spark.createDataFrame([("w1 w2",)], "text string"), percent=100).collect()
    ranks = sorted(r["rank"] for r in got)
    assert ranks == list(range(1, 3001))
    for own in (7, None):
        held = sorted(r["rank"] for r in got if r["doc_id"] == own)
        assert len(held) == 1000 and len({r["score"] for r in got if r["doc_id"] == own}) == 1
        assert held == list(range(held[0], held[0] + 1000))
    order = [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in sorted(got, key=lambda r: r["rank"])]
    assert order == sorted(order)
