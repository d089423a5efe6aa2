"""Exact top-k inner-product search through a pivot-distance index.

Vectors are scaled to whole numbers and given one more component that brings all to the greatest norm M, so that the inner
product falls as the distance of a query (whose own extra component is 0) grows: d^2 = |q|^2 + M^2 - 2 q.x. Each vector is
keyed by its nearest pivot and its distance from it; a pivot's distances are cut into sorted annuli, and more rows get more pivots and
annuli. The triangle inequality | d(q, p) - d(x, p) | <= d(q, x) bounds what an annulus can hold for a query. A query takes the
annuli in the order of these bounds, in WAVES of growing size; after each wave its k-th score so far is the floor, and it stops as soon
as no bound reaches it. Queries are routed first; a block of an annulus goes only to the blocks of queries that ask for it, and
each pair of blocks is a matrix product in one task. Blocks have a bounded size and are dealt by row, so a vector that a third of
all rows repeat is no hot group, and no pair is ever a row.

Only a bounded sample (PIVOT_SAMPLE rows, those of the smallest hashes of the id) serves to choose pivots and annuli; all rows
are indexed, and the result is exact. Vectors that are null, or hold null or non-finite components, take no part, nor do rows
without an id; vectors of another length than the query's don't meet it, empty ones score 0. Components of REGULAR or more after scaling are
kept as doubles in annuli without a bound and multiplied as whole numbers of any size; a score beyond a long is the nearest long.
Equal scores go to the smaller id, and each of several rows under one id is a candidate of its own. Of several queries under one id the one
whose scaled vector sorts first is asked. A row with the query's own id is no candidate. Columns but id and vector are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Pivots and rings at least and at most; their numbers grow with the rows.
PIVOTS, RINGS = (16, 256), (6, 64)
PIVOT_SAMPLE = 8192
BLOCK_ROWS, QUERY_ROWS = 8192, 2048
#: Annuli that a query has taken after each wave; after the last one, all that can matter.
WAVES = (1, 6, 24)
REGULAR = 1 << 24
#: Classes of the annuli without a bound, by length.
OTHERS = 64


def _quantised(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, q, dims, wide, norm2): q has whole numbers of 4 bytes, or doubles where a component is too large (wide)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            keep, rows, wide, norms = [], [], [], []
            values, offsets = column.values, column.offsets.to_numpy()
            flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
            finite = np.isfinite(flat)
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.clip(np.floor(flat * scale), -np.finfo(np.float64).max, np.finfo(np.float64).max)
            good, plain = (np.concatenate([[0], np.cumsum(x)]) for x in (finite, np.abs(flat) < REGULAR))
            null = column.is_null().to_numpy(zero_copy_only=False) | ids.is_null().to_numpy(zero_copy_only=False)
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                if not null[i] and good[b] - good[a] == b - a:
                    large = bool(plain[b] - plain[a] < b - a)
                    keep.append(i)
                    wide.append(large)
                    rows.append(flat[a:b].astype("<f8" if large else "<i4").tobytes())
                    norms.append(0 if large else int((flat[a:b] ** 2).sum()))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())).cast(pa.int64()), pa.array(rows, pa.binary()), pa.array([len(r) // (8 if w else 4) for r, w in zip(rows, wide, strict=True)], pa.int32()), pa.array(wide, pa.bool_()), pa.array(norms, pa.int64())], ["id", "q", "dims", "wide", "norm2"])

    return vectors.select(F.col(id_col).cast("bigint").alias("id"), vector_col).mapInArrow(run, "id bigint, q binary, dims int, wide boolean, norm2 bigint")


def matrix(rows: list[bytes], dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<i4").reshape(len(rows), dims)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _numbers(q: bytes, wide: bool) -> np.ndarray:
    return np.array([int(x) for x in np.frombuffer(q, "<f8" if wide else "<i4")], object)


def scores(queries: pa.Table, rows: pa.Table, dims: int) -> np.ndarray:
    """Inner products of all queries with all rows of one length; those with large components by whole numbers of any size."""
    (qs, qw), (xs, xw) = ((t.column("q").to_pylist(), np.array(t.column("wide").to_pylist(), bool)) for t in (queries, rows))
    out = np.zeros((len(qs), len(xs)), np.int64)
    a, b = np.flatnonzero(~qw), np.flatnonzero(~xw)
    out[a[:, None], b] = products(matrix([qs[i] for i in a], dims), matrix([xs[j] for j in b], dims))
    if qw.any() or xw.any():
        low, high = -(1 << 63), (1 << 63) - 1
        left, right = [_numbers(q, w) for q, w in zip(qs, qw, strict=True)], [_numbers(x, w) for x, w in zip(xs, xw, strict=True)]
        for i, j in np.argwhere(qw[:, None] | xw).tolist():
            out[i, j] = min(high, max(low, int((left[i] * right[j]).sum())))
    return out


class Index:
    """Pivots and annuli of the most frequent vector length; others have annuli of their own, which nothing rules out."""

    def __init__(self, sample: np.ndarray, dims: int, most2: int, rows: int):
        self.dims, self.most2 = dims, most2
        pivots = int(np.clip(rows**0.5 / 8, *PIVOTS))
        self.rings = int(np.clip(rows // (pivots * BLOCK_ROWS), *RINGS))
        lifted = self.lift(sample)
        chosen, far = [0], np.full(len(sample), np.inf)
        while len(chosen) < min(pivots, len(sample)):  # farthest first
            far = np.minimum(far, ((lifted - lifted[chosen[-1]]) ** 2).sum(1))
            if far.max() <= 0:
                break
            chosen.append(int(far.argmax()))
        self.pivots = lifted[chosen]
        distance = self.distances(lifted)
        near = distance.argmin(1)
        at = [np.sort(distance[near == p, p]) for p in range(len(chosen))]
        self.cuts = [np.quantile(x, np.arange(1, self.rings) / self.rings) for x in at]

    def lift(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        x = vectors.astype(np.float64)
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.most2 - (x * x).sum(1), 0))
        return np.column_stack([x, extra])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        square = (lifted**2).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * lifted @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Annulus and pivot distance of each vector."""
        distance = self.distances(self.lift(vectors))
        near = distance.argmin(1)
        own = distance[np.arange(len(near)), near]
        ring = np.zeros(len(near), np.int64)
        for p in np.unique(near):
            ring[near == p] = np.searchsorted(self.cuts[p], own[near == p], "right")
        return near * self.rings + ring, own

    def bounds(self, queries: np.ndarray, annuli: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """No vector of an annulus has a greater inner product with a query."""
        distance = self.distances(self.lift(queries, True))[:, annuli // self.rings]
        least = np.maximum(np.maximum(low - distance, distance - high), 0)
        square = (queries.astype(np.float64) ** 2).sum(1)[:, None] + self.most2
        return (square - least**2) / 2 + 1 + 1e-9 * square  # the last terms cover rounding


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k greatest inner products with all vectors but its own."""
    spark = vectors.sparkSession
    rows, _ = written(_quantised(vectors, scale, id_col, vector_col), "topk-vectors")
    first = F.min(F.struct("q", "dims", "wide")).alias("_one")
    asked, _ = written(_quantised(queries, scale, id_col, vector_col).groupBy("id").agg(first).select("id", "_one.*"), "topk-queries")
    usual = rows.filter("NOT wide").groupBy("dims").agg(F.count("*").alias("n"), F.max("norm2").alias("most2")).orderBy(F.desc("n"), "dims").first()
    dims = usual["dims"] if usual else 0
    like = rows.filter((F.col("dims") == dims) & ~F.col("wide"))
    sample = [bytes(r["q"]) for r in like.orderBy(F.xxhash64("id"), "id", "q").limit(PIVOT_SAMPLE).select("q").collect()] if dims else []
    index = Index(matrix(sample, dims), dims, usual["most2"], usual["n"]) if sample else None
    other = PIVOTS[1] * RINGS[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, wide = batch.column("dims").to_numpy(), batch.column("wide").to_numpy(zero_copy_only=False)
            annulus, distance = other + size.astype(np.int64) % OTHERS, np.zeros(len(size))
            own = np.flatnonzero((size == dims) & ~wide) if index else np.empty(0, np.int64)
            if len(own):
                annulus[own], distance[own] = index.place(matrix(batch.column("q").take(pa.array(own)).to_pylist(), dims))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "q", "dims", "wide")), pa.array(annulus), pa.array(distance)], ["id", "q", "dims", "wide", "annulus", "distance"])

    placed = rows.select("id", "q", "dims", "wide").mapInArrow(place, "id bigint, q binary, dims int, wide boolean, annulus bigint, distance double")
    placed, _ = written(placed.withColumn("_spread", F.monotonically_increasing_id()), "topk-index")
    # a row for each annulus: PIVOTS * RINGS + OTHERS at most
    found = placed.groupBy("annulus").agg(F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high")).collect()
    found.sort(key=lambda r: r["annulus"])
    annuli, low, high = (np.array([r[c] for r in found]) for c in ("annulus", "low", "high"))
    parts = {r["annulus"]: -(-r["n"] // BLOCK_ROWS) for r in found}
    groups = max(1, -(-asked.count() // QUERY_ROWS))
    main = annuli < other if len(found) else np.zeros(0, bool)
    sizes = spark.createDataFrame([(int(a), int(n)) for a, n in parts.items()], "annulus bigint, parts int")
    stored = placed.join(F.broadcast(sizes), "annulus").select("annulus", F.pmod(F.xxhash64("_spread"), F.col("parts")).cast("int").alias("part"), "id", "q", "dims", "wide")

    def route(begin: int, end: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size, wide, held = batch.column("dims").to_numpy(), batch.column("wide").to_numpy(zero_copy_only=False), batch.column("q").to_pylist()
                floor = batch.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
                own: list[list[int]] = [[] for _ in held]
                usual = (size == dims) & (index is not None)
                bounded = np.flatnonzero(usual & ~wide)
                if len(bounded) and main.any():
                    limit = index.bounds(matrix([held[i] for i in bounded], dims), annuli[main], low[main], high[main])
                    order = np.argsort(-limit, axis=1, kind="stable")[:, begin:end]
                    for i, bound, at in zip(bounded.tolist(), limit, order, strict=True):
                        at = at[np.isnan(floor[i]) | (bound[at] >= floor[i])]
                        own[i] = annuli[main][at].tolist()
                if not begin:
                    for i in np.flatnonzero(usual & wide).tolist():
                        own[i] = annuli[main].tolist()
                    for i, n in enumerate(size.tolist()):
                        own[i] += [other + n % OTHERS] if other + n % OTHERS in parts else []
                at = [(i, a, p) for i, x in enumerate(own) for a in x for p in range(parts[a])]
                take = pa.array([i for i, *_ in at], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([a for _, a, _ in at], pa.int64()), pa.array([p for *_, p in at], pa.int32()), *(batch.column(c).take(take) for c in ("group", "id", "q", "dims", "wide", "floor"))], ["annulus", "part", "group", "id", "q", "dims", "wide", "floor"])

        return run

    def meet(_, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        sizes = [t.column("dims").to_numpy() for t in (left, right)]
        for n in np.intersect1d(*sizes).tolist():
            rows, asks = (t.take(pa.array(np.flatnonzero(x == n))) for t, x in zip((left, right), sizes, strict=True))
            ids, score = rows.column("id").to_numpy(), scores(asks, rows, n)
            query, floor = asks.column("id").to_numpy(), asks.column("floor").to_numpy().astype(np.float64)
            by_id = np.argsort(ids, kind="stable")
            ids, score = ids[by_id], score[:, by_id]
            for i, row in enumerate(score):
                good = ids != query[i]
                if not np.isnan(floor[i]):
                    good &= row >= floor[i]
                good = np.flatnonzero(good)
                if len(good) > k:
                    least = np.partition(row[good], len(good) - k)[len(good) - k]
                    good = good[row[good] >= least]
                    good = good[np.argsort(-row[good].astype(np.float64) if abs(float(row[good].min())) < 2**52 else np.array([-int(x) for x in row[good]], object), kind="stable")[:k]]
                for x, y in zip(out, (np.full(len(good), query[i]), ids[good], row[good]), strict=True):
                    x.append(y)
        return pa.table([pa.array(np.concatenate(x).astype(np.int64)) for x in out], ["query_id", "vec_id", "score"])

    keys = ["annulus", "part", "group"]
    kinds = "annulus bigint, part int, group int, id bigint, q binary, dims int, wide boolean, floor bigint"
    grouped = asked.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("group"), "id", "q", "dims", "wide")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = spark.createDataFrame([], "query_id bigint, vec_id bigint, score bigint, rank int")
    for begin, end in zip((0, *WAVES), (*WAVES, None), strict=True):
        floors = best.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
        routed, _ = written(grouped.join(floors, "id", "left").select("group", "id", "q", "dims", "wide", "floor").mapInArrow(route(begin, end), kinds), "topk-routed")
        wanted = routed.select(*(F.col(c).alias(c) for c in keys)).distinct()
        sent = stored.join(wanted, ["annulus", "part"])
        near = sent.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInArrow(meet, "query_id bigint, vec_id bigint, score bigint")
        best = best.drop("rank").unionByName(near).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        best, _ = written(best, "topk-best")
    return best.select("query_id", "rank", "vec_id", "score")
