"""An inverted-file index of vectors: cells around centres, a table partitioned by cell, probes that prune it.

Centres come from Lloyd rounds on the unit sphere over a sample of bounded size; every row is assigned, sample or not. The
rows lie in a table that is partitioned by cell, with a file of its own for every ``FILE_ROWS`` rows of a cell, so a large
cell is many tasks. Of each cell the index knows its centre and the largest angle of its rows.

A search looks into the cells whose centres are nearest and compares their rows exactly. As an angle obeys the triangle
inequality, a row of a cell is never nearer than the centre's angle less the cell's radius: an exact search goes on to the
cells that by this bound may still hold something better than what was found, and to no others.

Rows without a vector are not indexed. Vectors without length have cosine 0 to everything; they have cell -1, which every
search takes in. Rows that repeat are rows. An empty table is an index without cells, in which nothing is found.

Searches of many queries compare blocks: some thousand queries with some thousand rows of a cell, or of several cells, at a
time. A matrix product tells which pairs may be among the best, and these are computed as ``cosine`` does, sum by sum. So a
task's memory is bounded by the blocks' sizes, and what is sent on are a block's k best of each query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quillspark.operators.vectors import cosine, norm
from quillspark.sources.store import fresh, stored

#: Most cells; sampled rows a cell (expected); Lloyd rounds; rows of a file.
MOST_CELLS, SAMPLE, ROUNDS, FILE_ROWS = 4096, 64, 8, 1_000_000
#: Cells that a search looks into where nothing was measured; queries that ``tuned`` measures, and the recall it asks for.
PROBES, MEASURED, RECALL = 8, 200, 0.95
#: What rounding may cost a bound, and a similarity.
SLACK, ROUNDING = 1e-6, 1e-9
#: Rows and queries of a block, and pairs of them at a time.
BLOCK_ROWS, BLOCK_QUERIES, PAIRS = 16_384, 4096, 4_000_000


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows; nulls in them are NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def assigned(rows: DataFrame, centres: np.ndarray, vector: str = "embedding") -> DataFrame:
    """``rows`` with ``cell``, that of the nearest centre, and ``angle`` to it; the first of equally near centres."""
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    at = rows.columns.index(vector)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(at))
            near = np.clip(_units(x) @ centres.T, -1, 1)
            cell = near.argmax(axis=1)
            angle = np.arccos(near[np.arange(len(x)), cell])
            none = np.linalg.norm(x, axis=1) == 0
            cols = [*batch.columns, pa.array(np.where(none, -1, cell), pa.int32()), pa.array(np.where(none, 0.0, angle))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(run, schema)


def centres_of(rows: DataFrame, key: str, vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres, by Lloyd rounds over about ``sample`` rows a cell, drawn by a hash of ``key``.

    By default as many cells as the root of the rows. The first centres are the drawn vectors with the least hashes. A
    round is one aggregation by cell; a centre that loses all its rows stays where it is.
    """
    some = rows.where(norm(F.col(vector)) > 0)
    n = some.count()
    k = min(n, cells or min(MOST_CELLS, max(1, round(n**0.5))))
    if not k:
        return np.zeros((0, 0))
    unit = F.pmod(F.xxhash64(F.lit("cells"), F.col(key)), F.lit(1 << 30))
    drawn = stored(some.select(F.col(vector).alias("v"), unit.alias("u"), F.col(key).alias("key")).where(F.col("u") < min(1.0, (sample * k + 100) / n) * (1 << 30)).withColumn("length", norm(F.col("v"))).select(F.transform("v", lambda x: x.cast("double") / F.col("length")).alias("v"), "u", "key"))
    centres = np.array([r["v"] for r in drawn.orderBy("u", "key").limit(k).collect()])
    for _ in range(rounds):
        sums = assigned(drawn.select("v"), centres, "v").select("cell", F.posexplode("v").alias("i", "x")).groupBy("cell", "i").agg(F.sum("x").alias("x"))
        new = np.zeros_like(centres)
        for r in sums.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("x")).collect():
            new[r["cell"]] = [x["x"] for x in r["x"]]
        size = np.linalg.norm(new, axis=1)
        centres = np.where((size > 1e-12)[:, None], _units(new), centres)
    return centres


def nearest_cells(cells: np.ndarray, centres: np.ndarray, radii: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector all cells by nearness of their centres, and in that order the most that a cell's rows may be like it."""
    if not len(cells):
        return np.zeros((len(x), 0), int), np.zeros((len(x), 0))
    near = np.clip(_units(x) @ centres.T, -1, 1)
    order = np.argsort(-near, axis=1, kind="stable")
    bound = np.cos(np.clip(np.arccos(near) - radii, 0, np.pi)) + SLACK
    return cells[order], np.take_along_axis(bound, order, axis=1)


@dataclass
class VectorIndex:
    rows: DataFrame
    cells: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    key: str = "id"
    vector: str = "embedding"
    probes: int = PROBES

    @staticmethod
    def build(rows: DataFrame, key: str = "id", vector: str = "embedding", path: str | None = None, cells: int | None = None, file_rows: int = FILE_ROWS, **fit) -> VectorIndex:
        """Index ``rows``, all columns, below ``path`` (by default a path of its own in the shared folder)."""
        if {"cell", "angle"} & set(rows.columns):
            raise ValueError("cell and angle are columns of the index")
        spark, path = rows.sparkSession, path or fresh(rows.sparkSession)
        known = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0))
        placed = stored(assigned(known, centres := centres_of(known, key, vector, cells, **fit), vector)) if known.limit(1).count() else None
        if placed is None:
            placed, centres = known.withColumn("cell", F.lit(0)).withColumn("angle", F.lit(0.0)), np.zeros((0, 0))
        of = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}
        files = F.lit(1)
        for c, r in of.items():
            if r["n"] > file_rows:
                files = F.when(F.col("cell") == c, -(-r["n"] // file_rows)).otherwise(files)
        placed.drop("angle").repartition("cell", F.pmod(F.xxhash64(key, vector), files)).write.partitionBy("cell").parquet(f"{path}/rows")
        about = [(int(c), float(r["radius"]), [float(v) for v in centres[c]] if c >= 0 else None) for c, r in sorted(of.items())]
        spark.createDataFrame(about, "cell int, radius double, centre array<double>").coalesce(1).write.parquet(f"{path}/cells")
        placed.drop("cell", "angle").limit(0).write.parquet(f"{path}/schema")
        return VectorIndex.load(spark, path, key, vector)

    @staticmethod
    def load(spark: SparkSession, path: str, key: str = "id", vector: str = "embedding") -> VectorIndex:
        own = spark.read.parquet(f"{path}/schema").schema
        rows = spark.read.schema(T.StructType([*own.fields, T.StructField("cell", T.IntegerType())])).parquet(f"{path}/rows")
        about = [r for r in spark.read.parquet(f"{path}/cells").orderBy("cell").collect() if r["centre"]]
        return VectorIndex(rows, np.array([r["cell"] for r in about], int), np.array([r["centre"] for r in about]).reshape(len(about), -1 if about else 0), np.array([r["radius"] for r in about]), key, vector)

    def _near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return nearest_cells(self.cells, self.centres, self.radii, x)

    def near(self, query: list[float], probes: int | None = None) -> DataFrame:
        """The rows of the ``probes`` (the index's own by default) cells nearest to one vector: other partitions are not read."""
        found, _ = self._near(np.array([query], np.float64))
        return self._of([-1, *found[0, : probes or self.probes].tolist()])

    def exact(self, query: list[float], k: int) -> DataFrame:
        """The rows of all cells that may hold one of the k most similar to one vector."""
        found, bound = self._near(np.array([query], np.float64))
        of = F.array(*[F.lit(float(v)) for v in query])
        best = self.near(query).select(cosine(F.col(self.vector), of).alias("s")).orderBy(F.col("s").desc()).limit(k).agg(F.count("*"), F.min("s")).first()
        least = best[1] if best[0] == k else -2.0
        return self._of([-1, *found[0][bound[0] >= least].tolist()])

    def above(self, query: list[float], threshold: float) -> DataFrame:
        """The rows of all cells that may hold one that is more similar to one vector than ``threshold``."""
        found, bound = self._near(np.array([query], np.float64))
        return self._of([*([-1] if threshold < 0 else []), *found[0][bound[0] > threshold].tolist()])

    def tuned(self, k: int, recall: float = RECALL, queries: int = MEASURED) -> VectorIndex:
        """The index with the least number of probes that finds ``recall`` of the k most similar rows of about so many rows.

        Which rows these are an exact search tells; where their cells stand among those of the query tells how many probes
        each one takes.
        """
        n = self.rows.count()
        drawn = self.rows.where(F.pmod(F.xxhash64(F.lit("measured"), self.key), F.lit(1 << 30)) < min(1.0, queries / max(1, n)) * (1 << 30))
        asked = stored(drawn.groupBy(F.col(self.key).alias("query_id")).agg(F.first(self.vector).alias("embedding")))
        found = self.search(asked, k, exact=True).join(self.rows.select(F.col(self.key).alias("id"), "cell"), "id").join(asked, "query_id")
        cells, centres, radii = self.cells, self.centres, self.radii

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                order, _ = nearest_cells(cells, centres, radii, _matrix(batch.column(1)))
                own = np.array(batch.column(0).to_pylist())
                place = np.where(own < 0, 0, (order == own[:, None]).argmax(axis=1)) if len(cells) else own
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64())], names=["place"])

        taken = sorted(found.select("cell", "embedding").mapInArrow(run, "place long").groupBy("place").count().collect())
        total, so_far = sum(r["count"] for r in taken), 0
        for place, n in taken:
            so_far += n
            if so_far >= recall * total:
                return replace(self, probes=place + 1)
        return self

    def _of(self, cells: list[int]) -> DataFrame:
        return self.rows.where(F.col("cell").isin(cells))

    def search(self, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False, key: str = "query_id", vector: str = "embedding") -> DataFrame:
        """(``key``, id, similarity, rank) of the k most similar rows of each query, ties to the smaller id.

        Queries, whose keys are distinct, meet the rows of their cells in blocks. An exact search takes from the probed cells
        how similar a row must be at least, and then sends queries to all blocks of rows that may hold such a one.
        """
        asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("v"), F.lit(-2.0).alias("least"))
        asked = stored(asked)
        parts = max(1, -(-asked.count() // BLOCK_QUERIES))
        sizes = {r["cell"]: r["count"] for r in self.rows.groupBy("cell").count().collect()}
        found = self._met(asked, _groups(sizes, 1), parts, k, probes or self.probes)
        if exact:
            worst = found.groupBy("key").agg(F.when(F.count("similarity") >= k, F.min("similarity")).alias("worst"))
            known = asked.join(worst, "key", "left").select("key", "v", F.coalesce("worst", "least").alias("least"))
            found = self._met(known, _groups(sizes, BLOCK_ROWS), parts, k, None)
        return found.select(F.col("key").alias(key), "id", "similarity", "rank")

    def _met(self, asked: DataFrame, groups: dict[int, list[int]], parts: int, k: int, probes: int | None) -> DataFrame:
        """The k best rows of each query in ``probes`` cells, or in all that may hold one as similar as ``least``.

        ``groups`` has the groups that a cell's rows are dealt to. Each of them is compared with the queries in ``parts`` blocks.
        """
        sent = self._sent(asked, groups, probes).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
        of = self.rows.sparkSession.createDataFrame([(c, g[0], len(g)) for c, g in groups.items()], "cell int, first int, n int")
        at = F.col("first") + F.pmod(F.xxhash64(self.key, self.vector), F.col("n")).cast("int")
        rows = self.rows.select("cell", self.key, self.vector).join(F.broadcast(of), "cell")
        rows = rows.select(at.alias("group"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.col(self.key).alias("id"), F.col(self.vector).alias("own"))
        kind = T.StructType([asked.schema["key"], rows.schema["id"], T.StructField("similarity", T.DoubleType())])

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return _block(left.combine_chunks(), right.combine_chunks(), k)

        return _best(sent.groupBy("group", "part").cogroup(rows.groupBy("group", "part")).applyInArrow(run, kind), k)

    def _sent(self, asked: DataFrame, groups: dict[int, list[int]], probes: int | None) -> DataFrame:
        """(key, v, least, group): queries by the groups that they are sent to."""
        cells, centres, radii = self.cells, self.centres, self.radii
        member = np.zeros((len(cells), 1 + max((g for own in groups.values() for g in own), default=0)), np.float32)
        for i, c in enumerate(cells.tolist()):
            member[i, groups.get(c, [])] = 1
        always = groups.get(-1, [])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    hit = np.zeros((batch.num_rows, member.shape[1]), bool)
                    if len(cells):
                        near = np.clip(_units(_matrix(batch.column(1))) @ centres.T, -1, 1)
                        if probes:
                            meets = np.zeros(near.shape, bool)
                            np.put_along_axis(meets, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, axis=1)
                        else:
                            meets = ~(np.cos(np.clip(np.arccos(near) - radii, 0, np.pi)) + SLACK < batch.column(2).to_numpy()[:, None])
                        hit = meets.astype(np.float32) @ member > 0
                    hit[:, always] = True
                    q, g = np.nonzero(hit)
                    for i in range(0, len(q), 10_000):
                        some = batch.take(pa.array(q[i : i + 10_000]))
                        yield pa.RecordBatch.from_arrays([*some.columns, pa.array(g[i : i + 10_000], pa.int32())], names=["key", "v", "least", "group"])

        return asked.mapInArrow(run, T.StructType([*asked.schema.fields, T.StructField("group", T.IntegerType())]))


def _groups(sizes: dict[int, int], least: int) -> dict[int, list[int]]:
    """Groups of each cell: cells are put together up to ``least`` rows, and parted above ``BLOCK_ROWS``."""
    groups, group, held = {}, 0, 0
    for c, n in sorted(sizes.items()):
        if held and held + n > least:
            group, held = group + 1, 0
        own = -(-n // BLOCK_ROWS)
        groups[c] = list(range(group, group + own))
        group, held = group + own - 1, held + n
    return groups


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, added up in the order of ``dot``: the same for the same vectors, wherever they stand."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _unlike(x: np.ndarray, most: int) -> np.ndarray:
    """Places of rows, the first ``most`` of equal ones."""
    order = np.lexsort(x.T[::-1])
    new = np.append(True, (x[order[1:]] != x[order[:-1]]).any(axis=1))
    first = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
    return np.sort(order[np.arange(len(x)) - first < most])


def _block(asked: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """(key, id, similarity): the k best of ``rows`` (group, part, id, own) for each query (key, v, least)."""
    names = ["key", "id", "similarity"]
    kinds = [asked.schema.field("key").type, rows.schema.field("id").type, pa.float64()]
    if not asked.num_rows or not rows.num_rows:
        return pa.table([pa.array([], t) for t in kinds], names=names)
    flat = lambda table, c: table[c].combine_chunks() if isinstance(table[c], pa.ChunkedArray) else table[c]
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("id", "ascending")], null_placement="at_start"))
    x = _matrix(flat(rows, "own"))
    kept = _unlike(x, k)  # of equal vectors no more than the k smallest ids can be among the best
    x, ids = x[kept], flat(rows, "id").take(pa.array(kept))
    q, least = _matrix(flat(asked, "v")), flat(asked, "least").to_numpy()
    ux, long_x, long_q = _units(x), np.sqrt(_summed(x, x)), np.sqrt(_summed(q, q))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, PAIRS // len(x))
    for at in range(0, len(q), step):
        near, cut = _units(q[at : at + step]) @ ux.T, least[at : at + step] - ROUNDING
        many = np.flatnonzero((~(near < cut[:, None])).sum(axis=1) > k)
        if len(many):
            kth = -np.partition(np.where(np.isnan(near[many]), -np.inf, -near[many]), k - 1, axis=1)[:, k - 1]
            cut[many] = np.maximum(cut[many], kth - ROUNDING)
        qi, xi = np.nonzero(~(near < cut[:, None]))
        size = long_q[at + qi] * long_x[xi]
        dots = np.concatenate([_summed(q[at + qi[i : i + 100_000]], x[xi[i : i + 100_000]]) for i in range(0, len(qi), 100_000)] or [np.zeros(0)])
        same = np.where(size == 0, 0.0, dots / np.where(size == 0, 1.0, size))
        order = np.lexsort((xi, np.where(np.isnan(same), -np.inf, -same), qi))
        qi, xi, same = qi[order], xi[order], same[order]
        nth = np.arange(len(qi)) - np.searchsorted(qi, qi)
        out.append((at + qi[nth < k], xi[nth < k], same[nth < k]))
    qi, xi, same = (np.concatenate(c) for c in zip(*out, strict=True))
    return pa.table([flat(asked, "key").take(pa.array(qi)), ids.take(pa.array(xi)), pa.array(same, from_pandas=False)], names=names)


def _best(found: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(W.partitionBy("key").orderBy(F.col("similarity").desc(), "id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k)
