"""Hard negatives of anchors by a two-dimensional block matrix product.

Rows become whole numbers, floor(scale * x), and are dealt into blocks of ROW_BLOCK rows and into chunks of dimensions; so are anchors, in
blocks of ANCHOR_BLOCK. A task multiplies each chunk of an anchor block with the same chunk of a row block, which gives a partial tile of
scores; the partial tiles of a pair of blocks are added as 8-byte whole numbers in the task, and the tile is reduced to the
best few rows of each anchor before anything leaves it. A first product meets blocks of the anchor's label and gives the
positives; a second meets the other blocks and takes the best rows of each window that a positive opens. Blocks are cut by label
(CLASSES hash classes of labels), so the two products together are one. No pair is ever a row of a table.

Blocks are numbered by row, so a label or a vector that a third of all rows share is no hot group. What is shuffled are blocks, an anchor
block once for each block that it meets, never tiles. Nothing is sampled, and all rows are candidates.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Vectors of different lengths don't meet;
empty ones score 0. Components of a size that 8-byte sums can't hold are multiplied as whole numbers of any size; a score beyond a long is
the nearest long. Each of several rows under one id is a candidate of its own (its id is then returned as often), but none is its own id's positive or
negative; of several anchors under one id the one whose bytes sort first is asked. Labels of any type are compared as text. Columns
but id, vector and label are not read, so further ones may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import products, unpack

ANCHOR_BLOCK, ROW_BLOCK = 512, 2048
#: Dimensions of a chunk; longer vectors have CHUNKS longer chunks.
CHUNK, CHUNKS = 32, 8
#: Hash classes of labels.
CLASSES = 64
#: Components below this are held in 4 bytes.
REGULAR = 1 << 24
LONG = (-(1 << 63), (1 << 63) - 1)


def _quantised(rows: DataFrame, scale: int) -> DataFrame:
    """(id, label, anchor, q, dims, wide): q has whole numbers of 4 bytes, or doubles where one is too large (wide)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets, whole = unpack(batch.column("vector"))
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.clip(np.floor(flat * scale), -np.finfo(np.float64).max, np.finfo(np.float64).max)
            at = np.flatnonzero(whole & batch.column("id").is_valid().to_numpy(zero_copy_only=False) & batch.column("label").is_valid().to_numpy(zero_copy_only=False))
            q, dims, wide = [], [], []
            for a, b in zip(offsets[at].tolist(), offsets[at + 1].tolist(), strict=True):
                x = flat[a:b]
                large = bool(len(x)) and float(np.abs(x).max()) >= min(REGULAR, (2.0**62 / len(x)) ** 0.5)
                q.append(x.astype("<f8" if large else "<i4").tobytes())
                dims.append(len(x))
                wide.append(large)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("id", "label", "anchor")), pa.array(q, pa.binary()), pa.array(dims, pa.int32()), pa.array(wide, pa.bool_())], ["id", "label", "anchor", "q", "dims", "wide"])

    return rows.mapInArrow(run, "id bigint, label string, anchor boolean, q binary, dims int, wide boolean")


def _chunks(dims: int) -> list[tuple[int, int]]:
    step = max(CHUNK, -(-dims // CHUNKS))
    return [(a, min(a + step, dims)) for a in range(0, max(dims, 1), step)]


def _numbers(q: bytes, rows: int, wide: bool) -> np.ndarray:
    flat = np.frombuffer(q, "<f8" if wide else "<i4")
    if wide:
        whole = np.empty(len(flat), object)
        whole[:] = [int(x) for x in flat]
        flat = whole
    return flat.reshape(rows, -1) if rows and len(flat) else flat.reshape(rows, 0)


def _blocks(rows: DataFrame, places: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(block, wide, the places' further columns, n, parts, ids, labels, carried lists): a row a block, parts being its chunks; a block has one length and one width of numbers."""
    more = [c for c in places.columns if c not in ("dims", "wide", "class", "start", "parts")]
    placed = rows.join(F.broadcast(places), ["dims", "wide", "class"])  # at most 2 * CLASSES rows a length
    placed = placed.withColumn("block", (F.col("start") + F.pmod(F.xxhash64("_spread"), F.col("parts"))).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        n, dims, wide = table.num_rows, table.column("dims")[0].as_py(), table.column("wide")[0].as_py()
        whole = np.frombuffer(b"".join(table.column("q").to_pylist()), "<f8" if wide else "<i4").reshape(n, dims)
        told = {c: pa.array([table.column(c).to_pylist()], pa.list_(table.schema.field(c).type)) for c in ("id", "label", *carried)}
        same = {c: pa.array([table.column(c)[0].as_py()], table.schema.field(c).type) for c in ("block", "wide", *more)}
        return pa.table(same | {"n": pa.array([n], pa.int32()), "parts": pa.array([[whole[:, a:b].tobytes() for a, b in _chunks(dims)]], pa.list_(pa.binary()))} | told).select(names)

    kinds = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    names = ["block", "wide", *more, "n", "parts", "id", "label", *carried]
    types = {"block": "int", "n": "int", "parts": "array<binary>", "wide": "boolean"} | {c: kinds[c] for c in more} | {c: f"array<{kinds[c]}>" for c in ("id", "label", *carried)}
    return placed.select("block", "dims", "wide", "q", "id", "label", *more, *carried).groupBy("block").applyInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names))


CARRIED = ["id", "label", "found_id", "found_score"]


def _met(anchors: DataFrame, rows: DataFrame, targets: str, pick, schema: str) -> DataFrame:
    """The reduced tiles of each anchor block and the row blocks of its targets. pick: (scores, anchors' lists, rows' lists) -> columns."""
    sent = anchors.select(*(F.col(c).alias(f"a_{c}") for c in ("wide", "parts", "n", *CARRIED)), F.explode(targets).alias("block"))
    found = rows.select("block", *(F.col(c).alias(f"r_{c}") for c in ("wide", "parts", "n", "id", "label")))
    both = sent.hint("merge").join(found, "block")  # anchor blocks are small and are sent to many blocks, so their size before that says nothing
    lists = [f"a_{c}" for c in CARRIED] + ["r_id", "r_label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                scores = None
                for a, r in zip(one["a_parts"], one["r_parts"], strict=True):
                    part = products(_numbers(a, one["a_n"], one["a_wide"]), _numbers(r, one["r_n"], one["r_wide"]))
                    scores = part if scores is None else scores + part
                if scores.dtype == object:
                    scores = np.array([min(LONG[1], max(LONG[0], int(x))) for x in scores.ravel()], np.int64).reshape(scores.shape)
                yield from pick(scores, {c: one[c] for c in lists}).to_batches()

    return both.mapInArrow(run, schema)


def _ranked(scores: np.ndarray, ids: np.ndarray, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's order of columns, best first, smaller ids first among equals, unusable ones last; and how many are usable."""
    by_id = np.argsort(ids, kind="stable")
    s, u = scores[:, by_id], usable[:, by_id]
    order = np.argsort(np.where(u, ~s, LONG[1]), axis=1, kind="stable")  # ~s falls as s grows and can't overflow
    late = np.take_along_axis(~u, order, 1)
    if late.any():  # a usable row of the least score stays before the unusable ones
        order = np.take_along_axis(order, np.argsort(late, axis=1, kind="stable"), 1)
    return by_id[order], usable.sum(1)


def _pairs(told: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    a_ids, r_ids = np.array(told["a_id"], np.int64), np.array(told["r_id"], np.int64)
    _, labels = np.unique(np.array(told["a_label"] + told["r_label"], object).astype(str), return_inverse=True)
    same = labels[: len(a_ids), None] == labels[len(a_ids) :]
    return a_ids, r_ids, same, a_ids[:, None] != r_ids


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A positive is one of the anchor's best rows of its own label; its negatives are the best rows of another label with
    window[0] * positive_score <= 100 * negative_score <= window[1] * positive_score.
    """
    spark = vectors.sparkSession
    source = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(vector_col).alias("vector"))
    label_class = F.pmod(F.xxhash64("label"), F.lit(CLASSES)).cast("int").alias("class")
    held, _ = written(_quantised(source, scale).select("*", label_class, F.monotonically_increasing_id().alias("_spread")), "negatives-rows")
    first = held.filter("anchor").groupBy("id").agg(F.min(F.struct("q", "dims", "wide", "label", "class")).alias("_one"))
    asked, _ = written(first.select("id", "_one.*", F.monotonically_increasing_id().alias("_spread")), "negatives-anchors")

    # at most 2 * CLASSES rows for each length of vectors
    def sizes(df: DataFrame) -> list:
        return sorted(df.groupBy("dims", "class", "wide").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).collect())

    found, wanted = sizes(held), sizes(asked)
    start, place = 0, []
    for r in found:
        place.append((r["dims"], r["wide"], r["class"], start, -(-r["n"] // ROW_BLOCK)))
        start += place[-1][-1]
    ends = [(r, p[3], p[3] + p[4]) for r, p in zip(found, place, strict=True)]
    start, asks = 0, []
    for w in wanted:
        like = [x for x in ends if x[0]["dims"] == w["dims"]]
        own = [x for x in like if x[0]["class"] == w["class"]]
        single = len({x[0][c] for x in own for c in ("low", "high")}) == 1
        near = [b for _, a, e in own for b in range(a, e)]
        far = [b for _, a, e in like for b in range(a, e)]
        spans = [(min(near), max(near) + 1)], [(min(far), min(near)), (max(near) + 1, max(far) + 1)] if single else [(min(far), max(far) + 1)]
        asks.append((w["dims"], w["wide"], w["class"], start, -(-w["n"] // ANCHOR_BLOCK), *([{"a": a, "e": e} for a, e in s if e > a] for s in spans)))
        start += asks[-1][4]
    key = "dims int, wide boolean, class int, start int, parts int"
    rows, _ = written(_blocks(held, spark.createDataFrame(place, key)), "negatives-blocks")
    spans = spark.createDataFrame(asks, key + ", near array<struct<a: int, e: int>>, far array<struct<a: int, e: int>>")

    def blocks_of(c: str) -> Column:
        return F.flatten(F.transform(c, lambda s: F.sequence(s["a"], s["e"] - 1)))

    none = F.array().cast("array<bigint>")
    bare = _blocks(asked.select("*", none.alias("found_id"), none.alias("found_score")), spans, ("found_id", "found_score"))

    def best(scores: np.ndarray, told: dict) -> pa.Table:
        a_ids, r_ids, same, other = _pairs(told)
        order, n = _ranked(scores, r_ids, same & other)
        k = min(positives, scores.shape[1])
        i, j = np.nonzero(np.arange(k) < n[:, None])
        at = order[i, j]
        return pa.table({"anchor_id": a_ids[i], "positive_id": r_ids[at], "positive_score": scores[i, at]})

    near = _met(bare.withColumn("near", blocks_of("near")), rows, "near", best, "anchor_id bigint, positive_id bigint, positive_score bigint")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= positives)
    lists = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("_at", "positive_id", "positive_score"))).alias("_found"))  # positives entries at most
    given, _ = written(asked.join(lists.withColumnRenamed("anchor_id", "id"), "id").select("*", F.col("_found.positive_id").alias("found_id"), F.col("_found.positive_score").alias("found_score")).drop("_found"), "negatives-positives")

    def within(scores: np.ndarray, told: dict) -> pa.Table:
        a_ids, r_ids, same, _ = _pairs(told)
        order, n = _ranked(scores, r_ids, ~same)
        fallen = ~np.take_along_axis(scores, order, 1)  # rises along a row
        out: list[tuple] = []
        for i, (ps, values) in enumerate(zip(told["a_found_id"], told["a_found_score"], strict=True)):
            for at, (p, value) in enumerate(zip(ps, values, strict=True)):
                low, high = -(-window[0] * value // 100), window[1] * value // 100
                if low > high or high < LONG[0]:
                    continue
                begin = int(np.searchsorted(fallen[i, : n[i]], ~min(high, LONG[1]), "left"))
                for j in range(begin, min(begin + negatives, int(n[i]))):
                    if (score := int(scores[i, order[i, j]])) < low:
                        break
                    out.append((a_ids[i], at + 1, p, int(r_ids[order[i, j]]), value, score))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 6, (pa.int64(), pa.int32(), *[pa.int64()] * 4), strict=True)], ["anchor_id", "at", "positive_id", "negative_id", "positive_score", "negative_score"])

    far = _met(_blocks(given, spans, ("found_id", "found_score")).withColumn("far", blocks_of("far")), rows, "far", within, "anchor_id bigint, at int, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint")
    order = Window.partitionBy("anchor_id", "at").orderBy(F.desc("negative_score"), "negative_id")
    return far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
