import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import simhash as H
from quillspark.llm.components import components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, fps, radius=4):
    """Smallest id reachable, by comparing all pairs."""
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i, a in zip(ids, fps, strict=True):
            for j, b in zip(ids, fps, strict=True):
                if (a ^ b).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprints(docs):
    for d in docs.limit(80).collect():
        assert H.fingerprint(d["text"]) == slow_fingerprint(d["text"])
    assert H.fingerprint("A B") == slow_fingerprint("a b") != 0
    assert H.fingerprint("one\x1ctwo é Í") == slow_fingerprint("one\x1ctwo é Í")


def test_groups_of_documents(spark, docs):
    found = {r["doc_id"]: r for r in H.near_duplicates(docs).collect()}
    ids = sorted(found)
    label = groups(ids, [found[i]["fp"] & (1 << 64) - 1 for i in ids])
    assert all(found[i]["component_id"] == label[i] for i in ids)


@pytest.mark.parametrize("dense", [512, 3, 1])
def test_dense_buckets_agree(spark, monkeypatch, dense):
    """Compared in buckets, or by whole-word balls for some or nearly all of them."""
    monkeypatch.setattr(H, "DENSE", dense)
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = set(seeds.tolist())
    for s in seeds.tolist():
        for _ in range(12):
            fps.add(s ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 8), replace=False)))
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {r["fp"]: r["root"] for r in H.fingerprint_components(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    label = groups(signed, fps)
    assert all(got.get(x, x) == label[x] for x in signed)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 102)}, **{i: 200 for i in range(200, 230)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_odd_rows(spark, odd_docs, no_docs):
    rows = H.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r["component_id"] for r in rows if r["doc_id"] in (2, 3, 5)} == {2}
    kept = H.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 2, 4, 6, 7]
    nulls = odd_docs.where("doc_id IS NULL")
    assert H.drop_near_duplicates(nulls.unionByName(nulls)).count() == 1
    assert kept.where("doc_id IS NULL").count() == 1
    assert H.near_duplicates(no_docs).collect() == [] == H.drop_near_duplicates(no_docs).collect()


def test_ids_with_several_texts(spark, monkeypatch):
    """A row stays for its own text, whatever other rows have its id; reruns keep the same rows."""
    a, b = ("".join(f"{w}{i} " for i in range(30)) for w in ("alpha", "beta"))
    rows = [(2, b, "x"), (5, a, "y"), (5, b, "z"), (5, a, "a"), (None, b, "n"), (None, "only here " * 20, "m")]
    for hot in (1, 1000):
        monkeypatch.setattr(H, "HOT", hot)
        got = [sorted(map(tuple, H.drop_near_duplicates(spark.createDataFrame(r, "doc_id long, text string, source string")).collect()), key=str) for r in (rows, rows[::-1])]
        assert got[0] == got[1]
        assert [r[:2] for r in got[0]] == sorted([(2, b), (5, a), (None, "only here " * 20)], key=str)


def test_copies_keep_one(spark, docs):
    copies = docs.withColumn("doc_id", F.col("doc_id") + 1_000_000)
    kept = {r["doc_id"] for r in H.drop_near_duplicates(docs.unionByName(copies)).collect()}
    assert kept == {r["component_id"] for r in H.near_duplicates(docs).collect()}


def test_names_of_the_caller_stay(spark):
    names = "id again row own fp root component_id least n __id __again __fp".split()
    docs = spark.createDataFrame([(i % 5 if i % 5 else None, f"text {i % 3} of some words {i % 3}", *[f"{c}-{i % 5}-{i % 3}" for c in names]) for i in range(30)], ["doc_id", "text", *names])
    kept = H.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    source = {tuple(r) for r in docs.collect()}
    assert rows and all(tuple(r) in source for r in rows)
    assert len(rows) == H.near_duplicates(docs).select("root").distinct().count()
