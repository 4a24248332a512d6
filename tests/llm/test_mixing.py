import pytest
from pyspark.sql import functions as F

from quillspark.llm import mixing as M


def water(sizes, share=1.5, most=2):
    """Targets by filling until no source is above its most."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, full = share * sum(sizes.values()), set()
    while True:
        rest = {s: left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s, t in rest.items() if t > most * sizes[s] + 1e-9}
        if not over:
            return {**{s: most * sizes[s] for s in full}, **rest}
        full |= over
        left -= sum(most * sizes[s] for s in over)


def test_targets_and_words(spark, docs):
    rows = M.mix(docs).collect()
    assert len(rows) == docs.count()
    sizes, taken, longest = {}, {}, {}
    for r in rows:
        longest[r["source"]] = max(longest.get(r["source"], 0), r["size"])
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = water(sizes)
    assert all(abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) and r["source_size"] == sizes[r["source"]] for r in rows)
    assert all(abs(taken[s] - want[s]) < longest[s] for s in sizes)
    assert abs(sum(taken.values()) - sum(want.values())) <= 0.05 * sum(want.values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.mix(docs.repartition(7)).collect()))


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, None: 10}, {"a": 1000, "b": 1, "c": 1}, {"a": 0, "b": 5}, {"é": 3, "z": 3, "Z": 3, "b": 90}])
def test_water_filling(spark, sizes):
    got = {r["source"]: r["target"] for r in M.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    want = water(sizes)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_tree_keeps_words_and_odds(spark):
    """Many documents through several levels of small blocks: words stay near the target and expected copies are right."""
    n = 6000
    sizes = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), (F.col("id") % 50 + 1).alias("size"))
    items, of = M.copies(M.written(sizes), block=8)
    rows = items.collect()
    assert len(rows) == n and {r["copies"] for r in rows} <= {0, 1, 2}
    target = {r["source"]: (r["target"], r["source_size"]) for r in of.collect()}
    for s, (t, whole) in target.items():
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["copies"] * r["size"] for r in own) - t) <= 60
        for low, high in ((1, 17), (18, 34), (35, 50)):  # no size is favoured
            part = [r for r in own if low <= r["size"] <= high]
            assert abs(sum(r["copies"] for r in part) / len(part) - t / whole) < 0.08


def meet(items, rng):
    """Pivotal rounding of [(size, probability)] two by two, in plain Python: copies by place."""
    out, left = {}, None
    for k, (size, p) in sorted(enumerate(items), key=lambda x: -x[1][0]):
        if left is None:
            left = [k, size, p]
            continue
        j, s, q = left
        up, down = min((1 - q) * s, p * size), min(q * s, (1 - p) * size)
        move = up if rng.random() * (up + down) < down else -down
        q, p = q + move / s, p - move / size
        sure = lambda v: abs(v - round(v)) < 1e-12
        assert sure(q) or sure(p)
        if sure(q):
            out[j], left = round(q), [k, size, p]
        else:
            out[k] = round(p)
            left = [j, s, q]
    if left:
        out[left[0]] = int(rng.random() < left[2])
    return out


@pytest.mark.parametrize("n", [5, 50, 500])
def test_expected_copies(spark, n):
    """Many sources alike of 5, 50 or 500 documents, half of each to be taken: every size has its share, words are within a document's of the target, and both are as good as those of a plain version."""
    import random

    many = max(8, 4000 // n)
    size = F.col("k") % 10 * 10 + 1
    sizes = spark.range(many * n).select(F.col("id").alias("doc_id"), F.format_string("s%05d", F.floor(F.col("id") / n)).alias("source"), (F.col("id") % n).alias("k")).select("doc_id", "source", size.alias("size"))
    sizes = M.written(sizes)
    of = M.targets(sizes, weights=(1,), share=0.5)
    by = {r["source"]: r for r in of.collect()}
    assert len(by) == many and all(abs(r["target"] / r["source_size"] - 0.5) < 1e-9 for r in by.values())
    items = M.copies(sizes, of=of)[0].collect()
    mean = {z: sum(r["copies"] for r in items if r["size"] == z) / sum(r["size"] == z for r in items) for z in {r["size"] for r in items}}
    spread = 4 * 0.5 / (len(items) / len(mean)) ** 0.5
    assert all(abs(x - 0.5) < spread for x in mean.values()), mean
    off = [sum(r["copies"] * r["size"] for r in items if r["source"] == s) - t["target"] for s, t in by.items()]
    assert max(map(abs, off)) < 91
    rng = random.Random(1)
    plain = []
    for _ in range(many):
        own = [(k % 10 * 10 + 1, 0.5) for k in range(n)]
        got = meet(own, rng)
        plain.append(sum(own[k][0] * c for k, c in got.items()) - sum(a * b for a, b in own))
    root = lambda xs: (sum(x * x for x in xs) / len(xs)) ** 0.5
    assert root(off) < 2 * root(plain) + 10


def test_odd_rows(spark, odd_docs, no_docs):
    rows = M.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] for r in rows)
    assert M.mix(no_docs).collect() == [] == M.mixed_documents(no_docs).collect()
    out = M.mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns
    assert out.count() == sum(r["copies"] for r in rows)


def test_repeated_rows_share(spark):
    docs = spark.createDataFrame([(1, "a b c", "s")] * 5 + [(i, "x y z", "s") for i in range(2, 9)] + [(i, "q " * 40, "t") for i in range(10, 13)], "doc_id long, text string, source string")
    rows = M.mix(docs).collect()
    assert len(rows) == 15 and all(r["copies"] <= 2 for r in rows)
    from collections import Counter

    odd = docs.unionByName(spark.createDataFrame([(1, "d e f", "s"), (None, "n n", None), (None, "n n", None), (None, "m m", None)], docs.schema))
    want = Counter()
    for r in M.mix(odd).collect():
        want[r["doc_id"], r["size"]] += r["copies"]
    got = Counter((r["doc_id"], len(r["text"].split())) for r in M.mixed_documents(odd).collect())
    assert got == +want


def test_no_python_in_the_plan(spark, docs, capsys):
    M.mix(docs).explain("formatted")
    plan = capsys.readouterr().out
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


CLASHING = "id of_id of_source of_size m copies n i h salt c before nth row part block blocks at again fp own __id __n __k __i __m __source __size __h".split()


def test_names_of_the_caller_stay(spark):
    """Columns under every internal name keep their values, repeated rows included."""
    base = [(i % 7, f"w{i % 7} x y z", f"s{i % 2}") for i in range(40)]
    docs = spark.createDataFrame([(*b, *[f"{c}-{b[0]}" for c in CLASHING]) for b in base], ["doc_id", "text", "source", *CLASHING])
    rows = M.mixed_documents(docs).collect()
    assert rows and M.mixed_documents(docs).columns == docs.columns
    assert all(r[c] == f"{c}-{r['doc_id']}" for r in rows for c in CLASHING)
    assert len(rows) == sum(r["copies"] for r in M.mix(docs).collect())


def test_many_repeated_rows_are_numbered_in_stretches(spark, monkeypatch):
    docs = spark.range(100_003).selectExpr("CASE WHEN id < 50000 THEN 1L END AS doc_id", "'a b c' AS text", "'s' AS source")
    rows = M.mix(docs).groupBy("doc_id", "copies").count().collect()
    assert sum(r["count"] for r in rows) == 100_003
    assert {r["copies"] for r in rows} <= {1, 2}
    assert abs(sum(r["copies"] * r["count"] for r in rows) - 150_004.5) < 2
    monkeypatch.setattr(M, "STRETCH", 7)
    again = M.mix(docs.limit(1000)).groupBy("doc_id", "copies").count().collect()
    monkeypatch.setattr(M, "STRETCH", 10_000)
    assert sorted(map(repr, again)) == sorted(map(repr, M.mix(docs.limit(1000)).groupBy("doc_id", "copies").count().collect()))
