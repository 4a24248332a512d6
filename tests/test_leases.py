"""Leases and retractions as streams of files, against plain simulations."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators.merge import STEPS
from quillspark.operators.pipeline import step_counts
from quillspark.streaming import leases as L

T0 = dt.datetime(2024, 1, 1)
ASKED = "book_id string, page_id long, claimant string, at timestamp, released boolean"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, L.ROCKSDB)
    yield spark
    spark.conf.unset(key)


def minute(m):
    return T0 + dt.timedelta(minutes=m)


def streamed(spark, batches, schema, folder, name, fn, mode):
    """Rows that ``fn`` of a stream gives, a file a batch; the batches are read in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{i:03}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    q = fn(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.sql(f"SELECT * FROM {name}")


def test_two_claimants_never_share_a_page(rocks, tmp_path):
    rng = random.Random(1)
    at, batches = 0, []
    for _ in range(4):
        rows = []
        for _ in range(30):
            at += rng.randint(0, 2)
            rows.append((f"b{rng.randrange(2)}", rng.randrange(6), rng.choice("xy"), minute(at), rng.random() < 0.2))
        batches.append(rows)
    batches.append([("b9", 1, "z", minute(at + 100), False)])
    got = streamed(rocks, batches, ASKED, tmp_path, "leases_random", lambda s: L.leases(s, pages_a_book=3), "append").collect()

    held, grants = {}, []
    for batch in batches:
        for b, page, who, t, released in sorted(batch, key=lambda r: (r[3], r[1], r[2], r[4])):
            held = {k: v for k, v in held.items() if v[1] + dt.timedelta(minutes=15) > t or k[0] != b}
            if released:
                if held.get((b, page), (None,))[0] == who:
                    del held[b, page]
            elif (b, page) not in held and sum(k[0] == b for k in held) < 3:
                held[b, page] = (who, t)
                grants.append((b, page, who, t))
    found = [(r["book_id"], r["page_id"], r["claimant"], r["at"]) for r in got if r["outcome"] == "granted"]
    assert sorted(found) == sorted(grants) and len(grants) > 20
    # Between two grants of a page the first one ended.
    ends = {}
    for r in got:
        if r["outcome"] in ("expired", "released"):
            ends.setdefault((r["book_id"], r["page_id"], r["claimant"]), []).append(r["at"])
    for b, page, who, t in grants:
        later = [x[3] for x in grants if x[:2] == (b, page) and x[3] > t]
        assert not later or any(t <= e <= min(later) for e in ends[b, page, who])


def test_leases_expire_by_the_watermark_and_start_from_a_table(rocks, tmp_path):
    before = rocks.createDataFrame([("a", 1, "old", minute(-5))], L.LEASES)
    batches = [
        [("a", 1, "x", minute(0), False), ("a", 2, "x", minute(0), False), (None, 3, "x", minute(0), False), ("a", None, "x", minute(0), False)],
        [("z", 7, "x", minute(30), False)],
        [("z", 8, "x", minute(31), False)],
        [("a", 1, "y", minute(32), None)],
    ]
    out = streamed(rocks, batches, ASKED, tmp_path, "leases_expire", lambda s: L.leases(s, before), "append")
    got = {(r["book_id"], r["page_id"], r["claimant"], r["outcome"]): r["at"] for r in out.collect()}
    assert got == {
        ("a", 1, "x", "refused"): minute(0),
        ("a", 2, "x", "granted"): minute(0),
        ("a", 1, "old", "expired"): minute(10),
        ("a", 2, "x", "expired"): minute(15),
        ("z", 7, "x", "granted"): minute(30),
        ("z", 8, "x", "granted"): minute(31),
        ("a", 1, "y", "granted"): minute(32),
    }
    held = {(r["book_id"], r["page_id"], r["claimant"]) for r in L.held_now(out).collect()}
    assert held == {("z", 7, "x"), ("z", 8, "x"), ("a", 1, "y")}


def test_books_are_kept_by_retraction(rocks, tmp_path):
    rng = random.Random(2)
    schema = "book_id string, page_id long, version long, deleted boolean, " + ", ".join(f"{s}_milestone string" for s in STEPS)
    states = ["idle", "in_progress", "succeeded", "failed", "error", "done", None]
    changes, last = [], {}
    for version in range(160):
        page = rng.randrange(25)
        row = (f"b{page % 3}", page, version, rng.random() < 0.15, *(rng.choice(states) for _ in STEPS))
        changes.append(row)
        last[page] = row
    rng.shuffle(changes)
    changes += rng.sample(changes, 20)
    out = streamed(rocks, [changes[i : i + 45] for i in range(0, len(changes), 45)], schema, tmp_path, "book_counts", L.book_counts, "update")
    names = [c for c in out.columns if c != "book_id"]
    # The memory sink keeps every update: a book's last one has all its pages' greatest versions.
    pages = rocks.createDataFrame([r for r in last.values() if not r[3]], schema)
    want = {r["book_id"]: tuple(r[n] for n in names) for r in step_counts(pages).select("book_id", *names).collect()}
    rows = out.collect()
    final = {}
    for r in rows:
        final[r["book_id"]] = tuple(r[n] for n in names)
    assert final == want
    ladder = {r["book_id"]: r["ocr_milestone"] for r in L.book_states(step_counts(pages)).collect()}
    assert set(ladder) == set(want)
    assert out.where(F.col("total") < 0).count() == 0
