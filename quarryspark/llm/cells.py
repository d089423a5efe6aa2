"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside them, one representative of each group.

Equal vectors of a label are one node with a number of copies. Centroids are fitted on a bounded sample of nodes (SAMPLE nodes of the smallest
hashes, or as many as hold SAMPLE_NUMBERS components); their number grows with the nodes, up to CELLS[1]. Every node belongs to the
cell of its nearest centroid, and is a guest in each lower cell whose border it is so close to that a vector of that cell could reach the
similarity: the border of cells c and d is the plane through 0 normal to d - c, and a vector further from it than the angle of the
similarity has no near duplicate behind it. So the cells lose no pair, whatever the sample. Members of one label and cell are cut into
blocks of BLOCK nodes; own blocks meet own and guest blocks as matrix products in double precision. A product leaves one row for each
node that has a link in it: how many rows it links to, and the least node of its part of the tile's links, which makes components. No pair
is ever a row, and the blocks of a hot cell or label are dealt over all tasks.

Rows with a null label or vector, a vector of length 0 or of zeros, or with null or non-finite components link with nothing: n_links
0, their own component. Vectors of different lengths don't link; those of another length than the most frequent one have a cell for
each length. Each of several rows under one id is a row of the result, and counts as a link of its copies; component_id is the
smallest id of the component. A row with a null id counts as a link, has the component's smallest id (null if there is none) and isn't kept. Columns
but id, vector and label are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .common import join_spread, written
from .vectors import unpack

#: Nodes that centroids are fitted on at most, and components of them.
SAMPLE, SAMPLE_NUMBERS = 16_384, 1 << 24
#: Fewest and most cells, and nodes a cell should have.
CELLS, CELL_NODES = (1, 512), 1024
ROUNDS = 8
#: Rows of a block, fewer where vectors are long: a block holds BLOCK_BYTES at most, or one vector.
BLOCK, BLOCK_BYTES = 1024, 4 << 20


def _valid(rows: DataFrame) -> DataFrame:
    """(id, label, q, dims, kind): q has the vector's bytes, null where the row takes no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            kind = "<f4" if pa.types.is_float32(vectors.type.value_type) else "<f8"
            flat, offsets, whole = unpack(vectors)
            filled = np.concatenate([[0], np.cumsum(flat != 0)])
            whole &= (filled[offsets[1:]] > filled[offsets[:-1]]) & batch.column("label").is_valid().to_numpy(zero_copy_only=False)
            flat = (flat + 0.0).astype(kind)  # no negative zeros
            q = [flat[a:b].tobytes() if w else None for a, b, w in zip(offsets[:-1].tolist(), offsets[1:].tolist(), whole.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(q, pa.binary()), pa.array(np.diff(offsets), pa.int32()), pa.array([kind] * batch.num_rows)], ["id", "label", "q", "dims", "kind"])

    return rows.mapInArrow(run, "id bigint, label string, q binary, dims int, kind string")


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the greatest component first, so that no square is lost or too large."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means: unit centroids of unit rows; starts from rows far from each other, drops cells that empty."""
    chosen, near = [0], np.full(len(sample), -np.inf)
    while len(chosen) < min(cells, len(sample)):
        near = np.maximum(near, sample @ sample[chosen[-1]])
        if near.min() >= 1 - 1e-12:
            break
        chosen.append(int(near.argmin()))
    held = sample[chosen]
    for _ in range(ROUNDS):
        own = (sample @ held.T).argmax(1)
        sums = np.zeros_like(held)
        np.add.at(sums, own, sample)
        length = np.sqrt((sums * sums).sum(1))
        held = sums[length > 1e-9] / length[length > 1e-9, None]
    return held


def places(x: np.ndarray, cells: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, own): each unit row's own cell, and the lower cells that it is a guest of."""
    sine = (max(0.0, 1 - similarity**2)) ** 0.5 if similarity > 0 else 1.0
    apart = np.sqrt(np.maximum(2 - 2 * cells @ cells.T, 0))
    to = x @ cells.T
    own = to.argmax(1)
    far = to[np.arange(len(x)), own][:, None] - to > sine * apart[own] + 1e-9
    rows, guests = np.nonzero(~far & (np.arange(len(cells)) < own[:, None]))
    return np.concatenate([np.arange(len(x)), rows]), np.concatenate([own, guests]), np.repeat([True, False], [len(x), len(rows)])


def least_roots(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least node of each row's and column's component in a table of links."""
    top = np.iinfo(np.int64).max
    while True:
        a = np.minimum(left, np.where(linked, right, top).min(1, initial=top))
        b = np.minimum(right, np.where(linked, a[:, None], top).min(0, initial=top))
        if (a == left).all() and (b == right).all():
            return a, b
        left, right = a, b


def near_duplicates(vectors: DataFrame, similarity: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vectors; links join rows of equal labels with a cosine of similarity or more."""
    spark = vectors.sparkSession
    source = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector"))
    named = F.concat_ws(":", F.length("label").cast("string"), "label", F.col("dims").cast("string"), F.sha2("q", 256))
    rows, _ = written(_valid(source).withColumn("key", F.when(F.col("q").isNotNull(), F.unhex(F.sha2(named, 256)))), "cells-rows")
    alone = rows.filter("key IS NULL").select(F.col("id").alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    once = rows.filter("key IS NOT NULL").groupBy("key").agg(F.first("q").alias("q"), F.first("label").alias("label"), F.first("dims").alias("dims"), F.first("kind").alias("kind"), F.count("*").alias("n"), F.min("id").alias("least"))
    nodes, _ = written(once.withColumn("node", F.monotonically_increasing_id()), "cells-nodes")
    usual = nodes.groupBy("dims", "kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    cells, dims = np.zeros((0, 0)), -1
    if usual:
        dims, kind = usual["dims"], usual["kind"]
        most = max(1, min(SAMPLE, SAMPLE_NUMBERS // dims))
        drawn = nodes.filter(F.col("dims") == dims).orderBy(F.xxhash64("key"), "key").limit(most).select("q").collect()
        sample = np.frombuffer(b"".join(bytes(r["q"]) for r in drawn), kind).reshape(len(drawn), dims).astype(np.float64)
        cells = centroids(unit(sample), int(np.clip(usual["n"] // CELL_NODES, *CELLS)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, q = batch.column("dims").to_numpy(), batch.column("q")
            like = np.flatnonzero(size == dims)
            row, cell, own = np.flatnonzero(size != dims), np.full((size != dims).sum(), -1), np.ones((size != dims).sum(), bool)
            if len(like):
                x = np.frombuffer(b"".join(q.take(pa.array(like)).to_pylist()), batch.column("kind")[int(like[0])].as_py()).reshape(len(like), dims).astype(np.float64)
                r, c, o = places(unit(x), cells, similarity)
                row, cell, own = np.concatenate([row, like[r]]), np.concatenate([cell, c]), np.concatenate([own, o])
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("node", "n", "label", "dims", "kind", "q")), pa.array(cell, pa.int32()), pa.array(own)], ["node", "n", "label", "dims", "kind", "q", "cell", "own"])

    placed = nodes.select("node", "n", "label", "dims", "kind", "q").mapInArrow(place, "node bigint, n bigint, label string, dims int, kind string, q binary, cell int, own boolean")
    at = F.concat_ws(":", F.col("dims").cast("string"), F.col("cell").cast("string"), "label").alias("cell")
    members, _ = written(placed.select("node", "n", "kind", "dims", "q", at, "own"), "cells-members")
    in_block = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dims")))))
    cut = members.groupBy("cell", "dims").agg(F.count_if("own").alias("owners"), F.count_if(~F.col("own")).alias("guests"))
    cut = cut.filter("owners > 0 AND owners + guests > 1").select("cell", F.ceil(F.col("owners") / in_block).cast("int").alias("first"), F.ceil(F.col("guests") / in_block).cast("int").alias("more"), (F.col("owners") + F.col("guests")).alias("_n"))
    joined = join_spread(members, cut, "cell", members.count(), "_n")
    spread = F.xxhash64("node")
    part = F.when(F.col("own"), F.pmod(spread, F.col("first"))).otherwise(F.col("first") + F.pmod(spread, F.col("more"))).cast("int").alias("part")

    def pack(table: pa.Table) -> pa.Table:
        one = {c: table.column(c)[:1].combine_chunks() for c in ("cell", "part", "first", "more", "kind", "dims")}
        return pa.table(one | {"nodes": pa.array([table.column("node").to_pylist()], pa.list_(pa.int64())), "ns": pa.array([table.column("n").to_pylist()], pa.list_(pa.int64())), "q": pa.array([b"".join(table.column("q").to_pylist())], pa.binary())})

    blocks = joined.select("cell", part, "first", "more", "kind", "dims", "node", "n", "q").groupBy("cell", "part").applyInArrow(pack, "cell string, part int, first int, more int, kind string, dims int, nodes array<bigint>, ns array<bigint>, q binary")
    blocks, _ = written(blocks, "cells-blocks")
    own = blocks.filter("part < first").withColumn("other", F.explode(F.sequence("part", F.col("first") + F.col("more") - 1)))
    pairs = own.join(blocks.select("cell", F.col("part").alias("other"), F.col("kind").alias("r_kind"), F.col("nodes").alias("r_nodes"), F.col("ns").alias("r_ns"), F.col("q").alias("r_q")), ["cell", "other"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                a_nodes, r_nodes = np.array(b["nodes"], np.int64), np.array(b["r_nodes"], np.int64)
                x, y = (unit(np.frombuffer(q, k).reshape(-1, b["dims"]).astype(np.float64)) for q, k in ((b["q"], b["kind"]), (b["r_q"], b["r_kind"])))
                linked = x @ y.T >= similarity
                if same := b["part"] == b["other"]:
                    np.fill_diagonal(linked, False)
                left, right = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
                linked = linked[np.ix_(left, right)]
                low, high = least_roots(linked, a_nodes[left], r_nodes[right])
                sides = [(a_nodes[left], linked @ np.array(b["r_ns"], np.int64)[right], low)]
                if not same:
                    sides.append((r_nodes[right], np.array(b["ns"], np.int64)[left] @ linked, high))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*sides, strict=True)], ["node", "links", "root"])

    found, _ = written(pairs.select("nodes", "ns", "q", "kind", "dims", "part", "other", "r_kind", "r_nodes", "r_ns", "r_q").mapInArrow(meet, "node bigint, links bigint, root bigint"), "cells-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = graph.components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    told = nodes.select("key", "node", "n", "least").join(roots, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    told, _ = written(told, "cells-told")
    groups = told.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("_n"))
    each = join_spread(told.select("root", "key", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), groups, "root", told.count(), "_n")
    own_rows = rows.filter("key IS NOT NULL").select("key", F.col("id").alias("vec_id"))
    linked = join_spread(own_rows, each.select("key", "n", "n_links", "component_id"), "key", rows.count(), "n").select("vec_id", "n_links", "component_id")
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
