"""Packing of token sequences into windows.

A document's ids and one end id are cut into whole windows and a rest. The histogram of piece lengths (at most one count
for each length, whatever the input's size) goes to the driver, which enumerates shallow combinations of lengths that
fill a window exactly, solves repeat counts by non-negative least squares against the histogram, rounds them down, and
packs what is left greedily, again on counts. The plan is a bounded table of slots; a piece finds its own by its rank
among the pieces of its length, so no piece is moved by the driver.

Null texts count as empty: their one piece is the end id. Repeated rows are pieces of their own. An empty table gives an
empty result. Pieces of one length are dealt over buckets by their place in the table of pieces before they are ranked, so
neither a frequent length nor a repeated or null id is a hot key. A very long text is encoded in a batch of its own. Of docs, id and
text alone are read, so columns of any other name do no harm.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Codec, codec
from .common import bucketed, shuffle_parts, text_batches, written

#: Pieces that one ranking bucket holds on average.
BUCKET_ROWS = 20_000
#: Lengths of three-part combinations are multiples of this, but for the last.
GRID = 16
#: Sweeps of the least-squares solver.
SWEEPS = 40


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer's JSON file, which are matched inside texts before these are cut into words."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in added):
        raise ValueError("added tokens that take blanks or whole words alone aren't served")
    return {x["content"]: x["id"] for x in added}


def encoded(own: Codec, texts: list[str], added: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """As own.encode(texts), with the ids of added tokens where texts have these."""
    if not any(x in t for x in added for t in texts):
        return own.encode(texts)
    split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split
    parts = [split(t) for t in texts]  # text, token, text, ...
    ids, ends = own.encode([x for p in parts for x in p[::2]])
    last = np.cumsum([len(p[::2]) for p in parts]) - 1
    tokens = np.array([added[x] for p in parts for x in p[1::2]], np.uint32)
    after = np.delete(np.arange(len(ends)), last)  # parts that a token follows
    return np.insert(ids, ends[after], tokens), ends[last] + np.cumsum([len(p[1::2]) for p in parts])


def cut(docs: DataFrame, vocabulary: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", added: dict[str, int] | None = None) -> DataFrame:
    """Pieces of each document's ids: (id_col, start, length, ids_crc32, doc_tokens)."""
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = codec(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch, texts in text_batches(batches, text_col):
            ids, until = encoded(own, texts, added or {})
            raw, ends = memoryview(ids.astype("<u4").tobytes()), until.tolist()
            rows: list[list[int]] = [[], [], [], [], []]
            for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                n = b - a + 1
                for start in range(0, n, window):
                    stop = min(start + window, n)
                    crc = zlib.crc32(raw[4 * (a + start) : 4 * min(a + stop, b)])
                    if stop == n:
                        crc = zlib.crc32(end, crc)
                    for column, value in zip(rows, (i, start, stop - start, crc, n), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(rows[0], pa.int64())), *(pa.array(x, pa.int64()) for x in rows[1:])], names)

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def combinations(window: int) -> list[tuple[int, ...]]:
    """Shallow combinations that fill a window: one, two or three lengths."""
    pairs = [(a, window - a) for a in range(window - 1, (window - 1) // 2, -1)]
    triples = [(a, b, window - a - b) for a in range(GRID, window, GRID) for b in range(GRID, a + 1, GRID) if 0 < window - a - b <= b]
    shifted = [(a, b, window - a - b) for a in range(GRID, window, GRID) for b in range(1, min(a, window - a)) if 0 < window - a - b <= b and b % GRID]
    return [(window,), *pairs, *triples, *shifted[:: max(1, len(shifted) // 20_000)]]


def repeats(histogram: np.ndarray, combos: list[tuple[int, ...]]) -> np.ndarray:
    """Non-negative least squares by coordinate descent: how often each combination is to be used."""
    left = histogram.astype(np.float64).tolist()
    used = [0.0] * len(combos)
    parts = [[(x, c.count(x)) for x in dict.fromkeys(c)] for c in combos]
    norm = [float(sum(n * n for _, n in p)) for p in parts]
    live = [j for j, p in enumerate(parts) if all(histogram[x] for x, _ in p)]
    for _ in range(SWEEPS):
        moved = 0.0
        for j in live:
            step = max(-used[j], sum(n * left[x] for x, n in parts[j]) / norm[j])
            if step:
                used[j] += step
                moved = max(moved, abs(step))
                for x, n in parts[j]:
                    left[x] -= n * step
        if moved < 0.25:
            break
    return np.array(used)


def plan(histogram: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats) that use up the histogram of lengths 0..window exactly."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def take(combo: tuple[int, ...], most: int) -> None:
        many = min([most, *(int(left[x]) // combo.count(x) for x in set(combo))])
        if many > 0:
            out.append((combo, many))
            for x in combo:
                left[x] -= many

    combos = combinations(window)
    counts = np.floor(repeats(left, combos) + 1e-9).astype(np.int64)
    for j in np.argsort(-counts, kind="stable"):
        if counts[j] <= 0:
            break
        take(combos[j], int(counts[j]))
    while (top := np.flatnonzero(left)).size:  # each round uses up a length at least
        combo = [int(top[-1])]
        left[combo[0]] -= 1
        gap = window - combo[0]
        while gap:
            have = np.flatnonzero(left[: gap + 1])
            if not have.size:
                break
            two = have[(have * 2 < gap) & (left[gap - have] > 0)] if left[gap] == 0 else have[:0]
            pick = gap if left[gap] else int(gap - two[0]) if two.size else int(have[-1])
            combo.append(pick)
            left[pick] -= 1
            gap -= pick
        for x in combo:
            left[x] += 1
        take(tuple(combo), int(left.max()))
    return out


def pack(pieces: DataFrame, window: int = 1024, id_col: str = "doc_id") -> DataFrame:
    """Place each piece (id_col, start, length, ...) in a sequence: adds sequence_id and offset."""
    spark = pieces.sparkSession
    columns = pieces.columns
    pieces, _ = written(pieces.withColumn("_spread", F.monotonically_increasing_id()), "packing-pieces")
    counted = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row a length
    histogram = np.zeros(window + 1, np.int64)
    for length, n in counted.items():
        histogram[length] = n
    slots, base, seen = [], 0, np.zeros(window + 1, np.int64)
    for combo, many in plan(histogram, window):
        at = 0
        for x in combo:
            slots.append((x, int(seen[x]), int(seen[x]) + many, base, at))
            seen[x] += many
            at += x
        base += many
    table = spark.createDataFrame(slots, "length bigint, _from bigint, _to bigint, _base bigint, offset bigint")
    buckets = max(shuffle_parts(spark), int(histogram.sum()) // BUCKET_ROWS)
    dealt = bucketed(pieces, "_spread", buckets=buckets)
    cells = dealt.groupBy("_bucket", "length").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("_bucket", "length", F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("_bucket", "length").orderBy("_spread")) - 1)
    ranked = ranked.join(cells, ["_bucket", "length"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    placed = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (ranked["_rank"] >= table["_from"]) & (ranked["_rank"] < table["_to"]))
    return placed.select(*(ranked[c] for c in columns), (F.col("_base") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, vocabulary: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", added: dict[str, int] | None = None) -> DataFrame:
    """Cut the documents' ids and pack the pieces: one row for each piece."""
    return pack(cut(docs, vocabulary, window, end_id, id_col, text_col, added), window, id_col)
