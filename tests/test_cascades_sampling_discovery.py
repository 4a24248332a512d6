import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import sampling as S
from quillspark.operators.cascades import Key, without
from quillspark.sources import discovery


def brute(tables, roots, keys):
    gone = {t: {r["id"] for r in rows if r["id"] in roots.get(t, ())} for t, rows in tables.items()}
    changed = True
    while changed:
        changed = False
        for k in keys:
            if k.then == "cascade":
                for r in tables[k.child]:
                    if r[k.column] in gone[k.parent] and r["id"] not in gone[k.child]:
                        gone[k.child].add(r["id"])
                        changed = True
    out = {}
    for t, rows in tables.items():
        own = [dict(r) for r in rows if r["id"] not in gone[t]]
        for r in own:
            for k in keys:
                if k.child == t and k.then == "set null" and r[k.column] in gone[k.parent]:
                    r[k.column] = None
        out[t] = own
    return out


def test_cascades_chains_cycles_and_nulls(spark):
    rng = random.Random(1)
    ref = lambda n: rng.choice([None, *range(n)])
    tables = {
        "books": [{"id": i, "next": ref(12), "owner": ref(6)} for i in range(12)],
        "pages": [{"id": i, "book": ref(12), "note": ref(30)} for i in range(30)],
        "notes": [{"id": i, "page": ref(30), "by": ref(6)} for i in range(30)],
        "users": [{"id": i, "favourite": ref(12)} for i in range(6)],
    }
    keys = (
        Key("books", "next", "books"),
        Key("pages", "book", "books"),
        Key("pages", "note", "notes", then="set null"),
        Key("notes", "page", "pages"),
        Key("notes", "by", "users", then="set null"),
        Key("users", "favourite", "books", then="set null"),
        Key("books", "owner", "users"),
        Key("elsewhere", "x", "books"),
    )
    frames = {t: spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} long" for c in rows[0])) for t, rows in tables.items()}
    for roots in ({"books": {3}}, {"users": {0, 5}}):
        got = without(frames, {t: spark.createDataFrame([(i,) for i in [*ids, *ids, 999]], "id long") for t, ids in roots.items()}, keys)
        want = brute(tables, roots, keys[:-1])
        for t in tables:
            assert sorted((tuple(r) for r in got[t].collect()), key=repr) == sorted((tuple(r.values()) for r in want[t]), key=repr), (t, roots)
        assert sum(len(rows) for rows in want.values()) < 78
    with pytest.raises(ValueError):
        without(frames, {}, (Key("pages", "book", "books", then="restrict"),))


def test_samples_are_uniform_and_follow_weights(spark):
    seeds = spark.range(4000).select(F.col("id").alias("seed"))
    rows = seeds.select("seed", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("id"))
    counts = S.bottom_k_by(rows, "seed", 1, F.col("seed")).groupBy("id").count().collect()
    chi = sum((r["count"] - 200) ** 2 / 200 for r in counts)
    assert len(counts) == 20 and chi < 50  # 19 degrees of freedom: 43.8 at one in a thousand
    weighted = rows.where("id < 4").withColumn("w", F.col("id"))
    counts = {r["id"]: r["count"] for r in S.bottom_k_by(weighted, "seed", 1, F.col("seed"), weight="w").groupBy("id").count().collect()}
    assert 0 not in counts and sum((counts[i] - 4000 * i / 6) ** 2 / (4000 * i / 6) for i in (1, 2, 3)) < 14
    two = S.bottom_k_by(rows.where("id < 5"), "seed", 2, F.col("seed"))
    assert two.groupBy("seed").agg(F.countDistinct("id").alias("n")).where("n <> 2").count() == 0


def test_samples_merge_and_rerun(spark):
    rows = spark.range(1000).withColumn("x", F.lit("kept"))
    whole = [tuple(r) for r in S.bottom_k(rows, 20, 5).collect()]
    parts = [S.bottom_k(rows.where(f"id % 3 = {i}"), 20, 5) for i in range(3)]
    assert [tuple(r) for r in S.merged(parts, 20).collect()] == whole
    assert [tuple(r) for r in S.bottom_k(rows.repartition(7), 20, 5).collect()] == whole
    assert {r["id"] for r in S.bottom_k(rows, 20, 6).collect()} != {r[0] for r in whole}
    assert S.bottom_k(rows, 2000, 5).count() == 1000 and S.bottom_k(rows.limit(0), 3).count() == 0
    assert "TakeOrderedAndProject" in S.bottom_k(rows, 20, 5)._jdf.queryExecution().executedPlan().toString()


def test_a_file_is_registered_once(spark, tmp_path):
    folder, table, state = tmp_path / "in", f"file://{tmp_path}/books", f"file://{tmp_path}/state"
    folder.mkdir()
    known = tmp_path / "known"
    spark.createDataFrame([("known.pdf", "x"), (None, None)], "file_name string, content_hash string").write.parquet(str(known))

    def run():
        discovery.discover(spark, f"file://{folder}", table, state, spark.read.parquet(str(known)), "*.pdf", files_per_batch=2).awaitTermination(120)
        return sorted((r["file_name"], r["title"], r["length"]) for r in discovery.registered(spark, table).collect())

    assert discovery.registered(spark, table).count() == 0
    for name, data in (("a.pdf", b"one"), ("b.pdf", b"two"), ("known.pdf", b"three"), ("c.txt", b"four"), ("empty.pdf", b"")):
        (folder / name).write_bytes(data)
    assert run() == [("a.pdf", "a", 3), ("b.pdf", "b", 3)]
    # The same content under other names, in this batch and in one before; a name that is taken; something new.
    (folder / "sub").mkdir()
    for name, data in (("again.pdf", b"one"), ("sub/a.pdf", b"other"), ("new.pdf", b"new"), ("sub/twin.pdf", b"new"), ("sub/last.pdf", b"last")):
        (folder / name).write_bytes(data)
    got = run()
    assert [r for r in got if r[0] in ("a.pdf", "b.pdf", "last.pdf")] == [("a.pdf", "a", 3), ("b.pdf", "b", 3), ("last.pdf", "last", 4)]
    assert len(got) == 4 and sum(r[0] in ("new.pdf", "twin.pdf") for r in got) == 1
    assert run() == got
