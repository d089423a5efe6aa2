"""A stored vector table: inverted lists over coarse centroids, as partitions by source and cell.

Centroids are fitted by Spark's k-means (cosine) on a bounded sample; every vector is in the list of its nearest one, and each cell knows the greatest angle
of its members from its centroid. A query takes cells in the order of the least distance that a member can have (the triangle inequality of
angles), in waves of growing size, and stops as soon as its k-th distance is below what any cell left can hold. So the answer is exact, and
a filter by source only makes a query take more cells until k rows survive. Cells reach the scan as partition filters while the query runs,
sources as a broadcast join that prunes partitions. Members of a cell and the queries that take it meet in blocks of bounded size, as matrix products; these
only choose the candidates, whose distances are then added up component by component, as cosine_distance() does.

Null vectors and ids, vectors with null or non-finite components and zero vectors aren't indexed; a query of that kind finds nothing. Vectors must
be of one length: others than the most frequent aren't indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shipping import fresh_path, materialised

#: Vectors that centroids are fitted on at most, and cells at most.
SAMPLE, CELLS = 20_000, 256
#: Cells that a query has taken after each wave; after the last, all that can matter.
WAVES = (4, 16, 64)
#: Rows of sources that are broadcast at most.
SOURCES = 100_000
#: Members and queries of a block, about, and queries that are multiplied at a time.
ROW_BLOCK, QUERY_BLOCK, SLICE = 4096, 8192, 512
#: More than angles, bounds and products of matrices are off by rounding: acos() near 1 loses half of the digits.
ANGLE_SLACK, BOUND_SLACK, PRODUCT_SLACK = 1e-7, 1e-12, 1e-9


def doubles(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, in double precision."""
    x, y = doubles(a), doubles(b)
    return 1 - dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def _angle(distance: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - distance)))


def _sound(c: str) -> Column:
    """Whether a vector has no null, no component that isn't finite, and one that isn't zero."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(c).isNotNull() & ~bad & F.exists(c, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    """The rows of a column of vectors of one length."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([p.flatten().to_numpy(zero_copy_only=False) for p in parts]).reshape(rows, -1)


def _sums(x: np.ndarray, y: np.ndarray, at: tuple = (slice(None), slice(None))) -> np.ndarray:
    """dot() of rows of x and y, with its order of additions. x and y have a row for each component, at tells which columns meet."""
    total = np.zeros(len(x[0][at[0]]))
    for a, b in zip(x, y, strict=True):
        total += a[at[0]] * b[at[1]]
    return total


def _lengths(x: np.ndarray) -> np.ndarray:
    parts = np.ascontiguousarray(x.T)
    return np.sqrt(_sums(parts, parts))


def _firsts(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the k nearest of some query: of equal vectors those of the k smallest ids."""
    by_id = np.argsort(ids, kind="stable")
    _, group = np.unique(np.ascontiguousarray(x[by_id]).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_inverse=True)
    return np.sort(by_id[_at_most(group, k)])


def _at_most(group: np.ndarray, k: int) -> np.ndarray:
    """The places of the first k members of each group, in the order of groups."""
    order = np.argsort(group, kind="stable")
    told = group[order]
    begin = np.flatnonzero(np.r_[True, told[1:] != told[:-1]][: len(told)])
    return order[np.arange(len(told)) - np.repeat(begin, np.diff(np.r_[begin, len(told)])) < k]


def _candidates(x: np.ndarray, ids: np.ndarray, q: np.ndarray, limits: np.ndarray, k: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in q, places in x, distances): for each query, of the rows not beyond its limit, the k nearest, ties by id; all if k is None. Some beyond the limit by rounding may be among them."""
    with np.errstate(all="ignore"):
        x_parts, x_length = np.ascontiguousarray(x.T), _lengths(x)
        for begin in range(0, len(q), SLICE):
            some, limit = q[begin : begin + SLICE], limits[begin : begin + SLICE].copy()
            length, parts = _lengths(some), np.ascontiguousarray(some.T)
            near = 1 - (some @ x_parts) / (length[:, None] * x_length)
            odd = ~np.isfinite(near)
            near[odd] = np.inf
            if k is not None:
                full = np.count_nonzero(near <= limit[:, None], axis=1) > k
                limit[full] = np.partition(near[full], k - 1, axis=1)[:, k - 1] if full.any() else 0
            i, j = np.nonzero((near <= limit[:, None] + PRODUCT_SLACK) | odd)
            distance = 1 - _sums(x_parts, parts, (j, i)) / (x_length[j] * length[i])
            if k is not None:
                order = np.lexsort((ids[j], distance, i))
                kept = order[_at_most(i[order], k)]
                i, j, distance = i[kept], j[kept], distance[kept]
            yield begin + i, j, distance


class VectorIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._lists = spark, root, None

    def build(self, vectors: DataFrame) -> VectorIndex:
        """Write the lists of vectors (id, source, vector)."""
        rows = vectors.select(F.col("id").cast("bigint").alias("id"), F.col("source").cast("string").alias("source"), doubles("vector").alias("vector")).filter(F.col("id").isNotNull() & _sound("vector"))
        usual = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
        if usual is None:
            rows.withColumn("cell", F.lit(0)).write.parquet(f"{self.root}/lists")
            self.spark.createDataFrame([], "cell int, centre array<double>, radius double, n bigint").write.parquet(f"{self.root}/cells")
            return self
        rows = rows.filter(F.size("vector") == usual["dims"])
        k = max(1, min(CELLS, int(math.sqrt(usual["count"]) / 2)))
        sample = materialised(rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select(array_to_vector("vector").alias("features")), "vector-sample")
        model = KMeans(k=k, seed=7, maxIter=8, initSteps=1, distanceMeasure="cosine", featuresCol="features", predictionCol="cell").fit(sample)
        centres = self.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, centre array<double>")
        placed = model.transform(rows.withColumn("features", array_to_vector("vector"))).drop("features")
        placed.repartition("source", "cell").write.partitionBy("source", "cell").option("compression", "zstd").parquet(f"{self.root}/lists")
        seen = self.lists().join(F.broadcast(centres), "cell")  # CELLS rows
        told = seen.groupBy("cell").agg(F.any_value("centre").alias("centre"), F.max(_angle(cosine_distance(F.col("vector"), F.col("centre")))).alias("radius"), F.count("*").alias("n"))
        told.coalesce(1).write.parquet(f"{self.root}/cells")
        return self

    def lists(self) -> DataFrame:
        """(id, vector, source, cell) of all indexed vectors; source and cell are partitions."""
        if self._lists is None:  # files are listed once
            self._lists = self.spark.read.option("basePath", f"{self.root}/lists").schema("id bigint, vector array<double>, source string, cell int").parquet(f"{self.root}/lists")
        return self._lists

    def _bounds(self, queries: DataFrame) -> DataFrame:
        """(qid, q, at): all cells with the least distance (bound) that a member of each can have from a query, by rising bound."""
        kind = "qid bigint, q array<double>, at array<struct<cell: int, bound: double>>"
        cells = self.spark.read.parquet(f"{self.root}/cells").orderBy("cell").collect()  # CELLS rows
        if not cells:
            return self.spark.createDataFrame([], kind)
        numbers, radius, centres = np.array([c["cell"] for c in cells], np.int32), np.array([c["radius"] for c in cells]), np.array([c["centre"] for c in cells])
        asked = queries.select(F.col("qid").cast("bigint").alias("qid"), doubles("q").alias("q")).filter(F.col("qid").isNotNull() & _sound("q") & (F.size("q") == centres.shape[1]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q = _matrix(b.column("q"), b.num_rows)
                with np.errstate(all="ignore"):
                    angle = np.arccos(np.clip(q @ centres.T / (_lengths(q)[:, None] * _lengths(centres)), -1, 1))
                nearest = np.maximum(0, np.nan_to_num(angle) - radius - ANGLE_SLACK)
                bound = 1 - np.cos(nearest) - BOUND_SLACK
                order = np.argsort(bound, axis=1, kind="stable")
                each = pa.StructArray.from_arrays([pa.array(numbers[order].ravel()), pa.array(np.take_along_axis(bound, order, 1).ravel())], ["cell", "bound"])
                at = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(numbers)), each)
                yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("q"), at], ["qid", "q", "at"])

        return asked.mapInArrow(run, kind)

    def _members(self, probes: DataFrame, sources: DataFrame | None, k: int | None) -> DataFrame:
        """(qid, id, source, distance) of members of the probed cells (qid, q, cells, floor), from some sources (source) only: k of each block and query at most, if k is told.

        What is farther than a query's floor may be left out. A cell's members and its queries are dealt to blocks, and each two blocks are a group.
        """
        kind = "qid bigint, id bigint, source string, distance double"
        asked = {r["cell"]: r["count"] for r in probes.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect()}  # CELLS at most
        rows = self.lists().filter(F.col("cell").isin(list(asked)))
        if sources is not None:
            own = sources.select(F.col("source").cast("string").alias("source")).distinct()
            rows = rows.join(F.broadcast(own) if own.count() <= SOURCES else own, "source", "left_semi")
        held = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}  # CELLS at most
        if not held:
            return self.spark.createDataFrame([], kind)
        parts = F.broadcast(self.spark.createDataFrame([(c, -(-n // ROW_BLOCK), -(-asked[c] // QUERY_BLOCK)) for c, n in held.items()], "cell int, parts int, asks int"))
        placed = rows.join(parts, "cell").select("cell", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("ask"), "id", "source", "vector")
        sent = probes.select("qid", "q", "floor", F.explode("cells").alias("cell")).join(parts, "cell")
        sent = sent.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("qid"), "asks").cast("int").alias("ask"), "qid", "q", "floor")

        def run(members: pa.Table, queries: pa.Table) -> pa.Table:
            qid, at, distance = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            if members.num_rows and queries.num_rows:
                x, ids, q = _matrix(members["vector"], members.num_rows), members["id"].to_numpy(), _matrix(queries["q"], queries.num_rows)
                first = np.arange(len(x)) if k is None else _firsts(x, ids, k)
                floor = queries["floor"].to_numpy().astype(np.float64)
                for i, j, d in _candidates(x[first], ids[first], q, np.where(np.isnan(floor), np.inf, floor), k):
                    qid.append(queries["qid"].to_numpy()[i])
                    at.append(first[j])
                    distance.append(d)
            found = members.select(["id", "source"]).take(pa.array(np.concatenate(at)))
            return pa.table([pa.array(np.concatenate(qid)), found["id"], found["source"], pa.array(np.concatenate(distance))], ["qid", "id", "source", "distance"])

        # few bytes, but much work: adaptive execution would put it all in few tasks
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 4 * self.spark.sparkContext.defaultParallelism)
        key = ("cell", "part", "ask")
        return placed.repartition(tasks, *key).groupBy(*key).cogroup(sent.repartition(tasks, *key).groupBy(*key)).applyInArrow(run, kind)

    def nearest(self, queries: DataFrame, k: int, sources: DataFrame | None = None) -> DataFrame:
        """(qid, id, source, distance): the k nearest vectors of each query (qid, q), ties by id, of some sources only."""
        bounds = materialised(self._bounds(queries), "vector-bounds")
        best = self.spark.createDataFrame([], "qid bigint, id bigint, source string, distance double")
        rank = Window.partitionBy("qid").orderBy("distance", "id")
        for begin, end in zip((0, *WAVES), (*WAVES, CELLS), strict=True):
            floors = best.groupBy("qid").agg(F.when(F.count("*") >= k, F.max("distance")).alias("floor"))
            wave = F.slice("at", begin + 1, end - begin)
            near = F.filter(wave, lambda x: F.col("floor").isNull() | (x["bound"] <= F.col("floor")))
            due = bounds.join(floors, "qid", "left").select("qid", "q", "floor", F.transform(near, lambda x: x["cell"]).alias("cells")).filter(F.size("cells") > 0)
            due = materialised(due, "vector-probes")
            if due.isEmpty():
                break
            both = best.unionByName(self._members(due, sources, k))
            best = materialised(both.withColumn("_at", F.row_number().over(rank)).filter(F.col("_at") <= k).drop("_at"), "vector-best")
        return best

    def within(self, queries: DataFrame, most: float, sources: DataFrame | None = None) -> DataFrame:
        """(qid, id, source, distance): all vectors at most so far from each query."""
        near = F.transform(F.filter("at", lambda x: x["bound"] <= most), lambda x: x["cell"])
        probes = self._bounds(queries).select("qid", "q", F.lit(float(most)).alias("floor"), near.alias("cells")).filter(F.size("cells") > 0)
        return self._members(materialised(probes, "vector-probes"), sources, None).filter(F.col("distance") <= most)


_built: dict[tuple[str, str], VectorIndex] = {}


def built(spark: SparkSession, sf_dir: str, vectors) -> VectorIndex:
    """The vector table of a data folder, made at first use in this application; vectors() gives (id, source, vector)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        _built[key] = VectorIndex(spark, fresh_path(spark, "vectors")).build(vectors())
    return _built[key]
