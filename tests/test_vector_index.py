import math

import numpy as np
import pytest

from quillspark.operators import vector_index
from quillspark.operators.vector_index import VectorIndex


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").withColumnRenamed("vec_id", "id")


@pytest.fixture(scope="module")
def index(vectors):
    return VectorIndex.build(vectors)


def brute(rows, queries, k):
    ids = np.array([r["id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        v = np.array(q["embedding"], float)
        near = x @ (v / np.linalg.norm(v))
        out[q["id"]] = [int(i) for i in ids[np.lexsort((ids, -near))[:k]]]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def test_every_twentieth_vector_finds_its_neighbours(vectors, index):
    rows = vectors.collect()
    want = brute(rows, [r for r in rows if r["id"] % 20 == 0], 16)
    queries = vectors.where("id % 20 = 0").selectExpr("id AS query_id", "embedding")
    assert by_query(index.search(queries, 16, exact=True).collect()) == want
    tuned = index.tuned(16)
    got = by_query(tuned.search(queries, 16).collect())
    recall = sum(len(set(got[q]) & set(ids)) for q, ids in want.items()) / sum(map(len, want.values()))
    print(f"recall at 16 with {tuned.probes} of {len(index.cells)} cells: {recall:.3f}")
    assert recall >= 0.9 and tuned.probes < len(index.cells)


def test_all_rows_are_indexed_once(vectors, index):
    assert sorted(r["id"] for r in index.rows.select("id").collect()) == sorted(r["id"] for r in vectors.select("id").collect())
    assert index.rows.columns == [*vectors.columns, "cell"]


def test_partitions_are_pruned(vectors, index):
    query = vectors.where("id = 7").first()["embedding"]
    near = index.near(query, 3)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    assert near.select("cell").distinct().count() == 3
    assert 0 < near.count() < vectors.count() / 4


def test_single_searches_are_exact(vectors, index):
    rows = vectors.collect()
    query = next(r for r in rows if r["id"] == 7)
    want = brute(rows, [query], 20)[7]
    assert set(want) <= {r["id"] for r in index.exact(query["embedding"], 20).collect()}
    near = {r["id"]: np.dot(r["embedding"], query["embedding"]) / np.linalg.norm(r["embedding"]) / np.linalg.norm(query["embedding"]) for r in rows}
    assert {i for i, s in near.items() if s > 0.3} <= {r["id"] for r in index.above(query["embedding"], 0.3).collect()}


def test_clusters_are_told_apart_and_few_cells_are_read(spark):
    rng = np.random.default_rng(1)
    around = rng.normal(size=(12, 16))
    rows = [(i, (around[i % 12] + rng.normal(size=16) * 0.05).tolist()) for i in range(1200)]
    index = VectorIndex.build(spark.createDataFrame(rows, "id long, embedding array<double>"), cells=12, rounds=12)
    query = rows[5][1]
    found = index.exact(query, 10)
    assert found.select("cell").distinct().count() <= 4
    want = sorted(rows, key=lambda r: -np.dot(r[1], query) / np.linalg.norm(r[1]))[:10]
    assert {r[0] for r in want} <= {r["id"] for r in found.collect()}
    assert index.tuned(10).probes <= 3


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], "x"), (2, [0.0, 2.0], None), (3, None, "n"), (4, [0.0, 0.0], "z"), (5, [], "e"), (6, [3.0, 0.0], "x"), (6, [3.0, 0.0], "x"), (None, [-1.0, 0.0], "x")]
    index = VectorIndex.build(spark.createDataFrame(rows, "id long, embedding array<double>, __file string"), file_rows=2)
    assert sorted((r["id"] or 0) for r in index.rows.collect()) == [0, 1, 2, 4, 6, 6]
    queries = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 0.0]), (12, None)], "query_id int, embedding array<double>")
    got = {}
    for r in index.search(queries, 10, exact=True).collect():
        got.setdefault(r["query_id"], []).append((r["id"], round(r["similarity"], 9)))
    assert sorted(got) == [10, 11]
    assert sorted(got[10], key=repr) == sorted([(1, 1.0), (6, 1.0), (6, 1.0), (2, 0.0), (4, 0.0), (None, -1.0)], key=repr)
    assert all(s == 0 for _, s in got[11])
    empty = VectorIndex.build(spark.createDataFrame([(1, None)], "id long, embedding array<double>"))
    assert empty.search(queries, 3).count() == 0 and empty.near([1.0, 0.0]).count() == 0 and empty.tuned(3).probes == empty.probes


def test_an_index_is_kept(spark, vectors, index, tmp_path):
    path = f"file://{tmp_path}/index"
    built = VectorIndex.build(vectors.where("id < 300"), path=path, cells=5)
    again = VectorIndex.load(spark, path)
    assert again.rows.count() == 300 and np.array_equal(again.centres, built.centres) and math.isclose(again.radii.sum(), built.radii.sum())


def test_many_copies_and_blocks(spark, monkeypatch):
    """Cells and queries of several blocks, copies in numbers beyond k, ties to the smaller id."""
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 100)
    monkeypatch.setattr(vector_index, "BLOCK_QUERIES", 40)
    rng = np.random.default_rng(3)
    few = rng.normal(size=(30, 8)).astype(np.float32).tolist()
    rows = [{"id": i, "embedding": few[0] if i % 3 else few[i % 30]} for i in rng.permutation(900).tolist()]
    index = VectorIndex.build(spark.createDataFrame(rows, "id long, embedding array<float>"), cells=6)
    asked = [{"id": i, "embedding": few[i % 30]} for i in range(90)]
    queries = spark.createDataFrame([(r["id"], r["embedding"]) for r in asked], "query_id long, embedding array<float>")
    assert by_query(index.search(queries, 7, exact=True).collect()) == brute(sorted(rows, key=lambda r: r["id"]), asked, 7)


def test_twenty_thousand_vectors_are_searched_in_time(spark):
    import time

    from pyspark.sql import functions as F

    rows = spark.range(20_000).select("id", F.array(*[F.randn(i) for i in range(64)]).alias("embedding")).cache()
    began = time.time()
    found = VectorIndex.build(rows).search(rows.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 16, exact=True)
    assert found.count() == 16_000
    assert time.time() - began < 60
