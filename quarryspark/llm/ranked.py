"""Ranked lexical search over postings in tiers of falling impact, exact.

A text's terms are the runs of letters, digits and code points beyond 7-bit ones, A-Z lower-cased. All texts are read whole, once for each
turn of items: a forward table keeps each document's length and the numbers and counts of those terms that items ask for. A posting's impact is what
it adds to a score. A histogram of impacts for each term gives cuts, so that tier 0 holds at most TIERS[0] postings of a term, those of the highest
impact, tier 1 at most TIERS[1] with those, and the forward table has all. The greatest impact below a cut is the term's residual bound.

An item is first answered from tier 0. Its k-th best sum is a floor for the k-th score. If the floor exceeds the residual bounds of all its
terms together, no document outside the tier can be among the best: the item is proved, the documents whose sum and unseen residuals
reach the floor get their whole scores from the forward table, and the best k of these are the answer. Items without a proof fall
through to tier 1 and then to the forward table, whose documents are scored in batches against all remaining items; each task keeps the best k
of an item, and scores below the item's floor never leave it.

Items are worked on in turns of about VOCABULARY terms, so what a task holds of them is bounded whatever the number of items; a single item
with more is a turn of its own. Documents' terms are never collected.

Null texts and texts without a term are no documents and ask for nothing. Equal scores are ordered by doc_id, null ids last; each of several
rows under one id is a document of its own. Of several items under one id the one whose text sorts first is asked; a null item id is an id. Very long
texts are one step of a task. Columns but id and text are not read, so further ones may have any name. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_batches, written

#: Postings of a term in the first and in the first two tiers, at most.
TIERS = (1024, 4096)
#: Terms of all items of a turn, about.
VOCABULARY = 500_000
#: Scores that a batch of the last tier holds at once, and rows a task keeps before it sorts out the best.
CELLS, KEPT = 2_000_000, 500_000
#: Bytes to bytes: A-Z lower-cased, other 7-bit characters but letters and digits as spaces.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Steps of a histogram for each doubling of an impact.
STEPS = 16


def terms(text: str) -> list[bytes]:
    """A text's terms in UTF-8, with repeats."""
    return text.encode().translate(_TABLE).split()


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0), kind))


def _split_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in text_batches(batches):
        own = [sorted(set(terms(t))) for t in texts]
        yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.array([[t.decode() for t in x] for x in own], pa.list_(pa.string()))], ["item_id", "terms"])


class Asked:
    """The items of a turn: the numbers of their terms, and which items ask for a term."""

    def __init__(self, rows: list):
        self.numbers: dict[bytes, int] = {}
        own = [[self.numbers.setdefault(t.encode(), len(self.numbers)) for t in r["terms"]] for r in rows]
        self.ids = [r["item"] for r in rows]
        at = np.repeat(np.arange(len(rows)), [len(x) for x in own])
        term = np.array([t for x in own for t in x], np.int64)
        order = np.argsort(term, kind="stable")
        self.of_item = (at, term)
        self.items, self.sizes = at[order], np.bincount(term, minlength=len(self.numbers))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def without(self, done: set[int]) -> Asked:
        """The same terms, without some items."""
        out = object.__new__(Asked)
        keep = np.array([i not in done for i in self.ids], bool)
        new = np.cumsum(keep) - 1
        left = keep[self.items]
        term = np.repeat(np.arange(len(self.sizes)), self.sizes)[left]
        out.numbers, out.ids = self.numbers, [i for i, k in zip(self.ids, keep, strict=True) if k]
        out.items, out.sizes = new[self.items[left]], np.bincount(term, minlength=len(self.sizes))
        out.starts = np.concatenate([[0], np.cumsum(out.sizes)])
        return out


def _forward(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts): each document with a term, and its counts of the terms asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches):
            ids, n, found, counts = [], [], [], []
            for i, t in enumerate(texts):
                own = terms(t)
                if own:
                    had = [(numbers[w], c) for w, c in Counter(own).items() if w in numbers]
                    ids.append(i)
                    n.append(len(own))
                    found.append(np.array([x for x, _ in had], np.int32))
                    counts.append(np.array([c for _, c in had], np.int32))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(n, pa.int64()), _lists(found, pa.int32()), _lists(counts, pa.int32())], ["doc_id", "n", "terms", "counts"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, counts array<int>")


class Weights:
    """What turns counts into impacts."""

    def __init__(self, documents: int, tokens: int, frequency: np.ndarray):
        self.documents, self.tokens = documents, tokens
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in frequency.tolist()], np.int64)

    def impacts(self, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Of the postings of documents with n terms that have sizes postings each."""
        m = np.array([50 + (50 * x * self.documents) // self.tokens for x in n.tolist()], np.int64)
        c = count.astype(np.int64)
        return self.weight[term] * ((1_000_000_000 * c) // (1000 * c + 20 * np.repeat(m, sizes)))


def _postings(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n, sizes, terms, counts) of a batch of the forward table."""
    found, counts = batch.column("terms"), batch.column("counts")
    return batch.column("n").to_numpy(), np.diff(found.offsets.to_numpy()), found.flatten().to_numpy(), counts.flatten().to_numpy()


def _bucket(impacts: np.ndarray) -> np.ndarray:
    return np.floor(STEPS * np.log2(impacts + 1.0)).astype(np.int32)


def _tiers(forward: DataFrame, w: Weights) -> tuple[DataFrame, dict[int, tuple]]:
    """Postings (term, row, impact, tier) of tiers 0 and 1, and (cut, residual bound) of each term in each."""

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sizes, term, count = _postings(batch)
            impact = w.impacts(n, sizes, term, count)
            both = term.astype(np.int64) << 16 | _bucket(impact)
            keys, at, many = np.unique(both, return_inverse=True, return_counts=True)
            most = np.zeros(len(keys), np.int64)
            np.maximum.at(most, at, impact)
            yield pa.RecordBatch.from_arrays([pa.array((keys >> 16).astype(np.int32)), pa.array((keys & 0xFFFF).astype(np.int32)), pa.array(many.astype(np.int64)), pa.array(most)], ["term", "bucket", "many", "most"])

    counted = forward.select("n", "terms", "counts").mapInArrow(histogram, "term int, bucket int, many bigint, most bigint")
    steps = counted.groupBy("term", "bucket").agg(F.sum("many").alias("many"), F.max("most").alias("most"))  # some hundred buckets a term at most
    above = F.sum("many").over(Window.partitionBy("term").orderBy(F.desc("bucket")))
    marked = steps.withColumn("above", above)
    held = [F.min(F.when(F.col("above") <= t, F.col("bucket"))).alias(f"cut{i}") for i, t in enumerate(TIERS)]
    rest = [F.coalesce(F.max(F.when(F.col("above") > t, F.col("most"))), F.lit(0)).alias(f"rest{i}") for i, t in enumerate(TIERS)]
    none = 1 << 16
    cuts = {r["term"]: ((r["cut0"] if r["cut0"] is not None else none, r["rest0"]), (r["cut1"] if r["cut1"] is not None else none, r["rest1"])) for r in marked.groupBy("term").agg(*held, *rest).collect()}  # a row for each term of a turn
    limits = np.full((len(TIERS), len(w.weight)), none, np.int32)
    for t, told in cuts.items():
        limits[:, t] = [c for c, _ in told]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sizes, term, count = _postings(batch)
            impact = w.impacts(n, sizes, term, count)
            bucket, row = _bucket(impact), np.repeat(batch.column("row").to_numpy(), sizes)
            at = np.flatnonzero(bucket >= limits[1][term])
            tier = np.where(bucket[at] >= limits[0][term[at]], 0, 1)
            yield pa.RecordBatch.from_arrays([pa.array(term[at].astype(np.int32)), pa.array(row[at]), pa.array(impact[at]), pa.array(tier.astype(np.int32))], ["term", "row", "impact", "tier"])

    return forward.select("row", "n", "terms", "counts").mapInArrow(deal, "term int, row bigint, impact bigint, tier int"), cuts


def _whole(found: DataFrame, forward: DataFrame, wants: DataFrame, w: Weights) -> DataFrame:
    """(item, doc_id, score) of pairs (item, row): whole scores from the forward table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sizes, term, count = _postings(batch)
            impact = w.impacts(n, sizes, term, count)
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("row"), batch.column("doc_id"), batch.column("terms"), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(impact))], ["item", "row", "doc_id", "terms", "impacts"])

    pairs = forward.join(found, "row").select("item", "row", "doc_id", "n", "terms", "counts").mapInArrow(run, "item bigint, row bigint, doc_id bigint, terms array<int>, impacts array<bigint>")
    each = pairs.select("item", "row", "doc_id", F.explode(F.arrays_zip("terms", "impacts")).alias("p")).select("item", "row", "doc_id", F.col("p.terms").alias("term"), F.col("p.impacts").alias("impact"))
    return each.join(F.broadcast(wants.select("item", "term")), ["item", "term"]).groupBy("item", "row", "doc_id").agg(F.sum("impact").alias("score"))


def _last(forward: DataFrame, asked: Asked, w: Weights, floors: np.ndarray, k: int) -> DataFrame:
    """(item, row, doc_id, score): each task's best k documents of each item, from all postings."""
    ids, many = np.array(asked.ids, np.int64), len(asked.ids)
    safe = int(w.weight.max(initial=0)) * 1_000_000 * max(1, int(np.bincount(asked.items, minlength=many).max(initial=1))) < 2**53

    def summed(at: np.ndarray, impact: np.ndarray, cells: int) -> np.ndarray:
        if safe:
            return np.bincount(at, impact, cells).astype(np.int64)
        return (np.bincount(at, impact >> 24, cells).astype(np.int64) << 24) + np.bincount(at, impact & 0xFFFFFF, cells).astype(np.int64)

    def best(kept: list[tuple]) -> list[tuple]:
        item, row, doc, known, score = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.lexsort((row, doc, ~known, -score, item))
        item = item[order]
        first = np.searchsorted(item, item)
        order = order[np.arange(len(item)) - first < k]
        return [tuple(x[order] for x in (np.concatenate(c) for c in zip(*kept, strict=True)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size, least = [], 0, np.maximum(floors, 1)
        step = max(1, CELLS // max(1, many))
        for whole in batches:
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                n, sizes, term, count = _postings(batch)
                impact = w.impacts(n, sizes, term, count)
                fan = asked.sizes[term]
                ends = np.cumsum(fan)
                inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - fan, fan)
                item = asked.items[np.repeat(asked.starts[term], fan) + inside]
                doc = np.repeat(np.repeat(np.arange(len(n)), sizes), fan)
                score = summed(item * len(n) + doc, np.repeat(impact, fan), many * len(n)).reshape(many, len(n))
                i, d = np.nonzero(score >= least[:, None])
                ids_known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                doc_ids = batch.column("doc_id").fill_null(0).to_numpy()
                kept.append((i, batch.column("row").to_numpy()[d], doc_ids[d], ids_known[d], score[i, d]))
                size += len(i)
                if size > KEPT:
                    kept = best(kept)
                    item, score = kept[0][0], kept[0][4]
                    size = len(item)
                    full = np.flatnonzero(np.bincount(item, minlength=many) == k)
                    least[full] = np.maximum(least[full], score[np.searchsorted(item, full, "right") - 1])
        if kept:
            item, row, doc, known, score = best(kept)[0]
            yield pa.RecordBatch.from_arrays([pa.array(ids[item]), pa.array(row), pa.array(doc, pa.int64(), mask=~known), pa.array(score)], ["item", "row", "doc_id", "score"])

    return forward.select("row", "doc_id", "n", "terms", "counts").mapInArrow(run, "item bigint, row bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score, tier): each item's k best documents with a score above 0, and the tier that its answer took (2: the forward table)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    once = items.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).filter("text IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text"))
    wanted, _ = written(once.mapInArrow(_split_items, "item_id bigint, terms array<string>").filter("size(terms) > 0").withColumn("item", F.monotonically_increasing_id()), "ranked-items")
    total = wanted.agg(F.sum(F.size("terms"))).first()[0] or 0
    turns = -(-total // VOCABULARY)
    out = spark.createDataFrame([], "item bigint, row bigint, doc_id bigint, score bigint, tier int")
    for turn in range(turns):
        mine = wanted.filter(F.pmod(F.xxhash64("item"), F.lit(turns)) == turn)
        out = out.unionByName(_turn(texts, Asked(mine.select("item", "terms").collect()), k))  # about VOCABULARY terms
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(wanted.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score", "tier")


def _turn(texts: DataFrame, asked: Asked, k: int) -> DataFrame:
    spark = texts.sparkSession
    empty = spark.createDataFrame([], "item bigint, row bigint, doc_id bigint, score bigint, tier int")
    if not asked.ids:
        return empty
    forward, _ = written(_forward(texts, asked.numbers).withColumn("row", F.monotonically_increasing_id()), "ranked-forward")
    whole = forward.agg(F.count("*"), F.sum("n")).first()
    if not whole[0]:
        return empty
    frequency = np.zeros(len(asked.numbers), np.int64)
    for r in forward.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each term of a turn
        frequency[r["term"]] = r["count"]
    w = Weights(whole[0], whole[1], frequency)
    postings, cuts = _tiers(forward, w)
    postings, _ = written(postings, "ranked-tiers")
    at, term = asked.of_item
    floors, done, results = np.zeros(len(asked.ids), np.int64), set(), []
    for tier in range(len(TIERS)):
        open_ = np.array([asked.ids[i] not in done for i in at.tolist()], bool)
        bound = np.array([cuts[t][tier][1] if t in cuts else 0 for t in term.tolist()], np.int64)
        rest = {asked.ids[i]: int(x) for i, x in enumerate(np.bincount(at, bound, len(asked.ids)))}
        rows = pa.table({"item": pa.array(np.array(asked.ids, np.int64)[at[open_]]), "term": pa.array(term[open_].astype(np.int32)), "residual": pa.array(bound[open_])})
        wants = spark.createDataFrame(rows)  # about VOCABULARY rows
        sums = postings.filter(F.col("tier") <= tier).join(F.broadcast(wants), "term").groupBy("item", "row").agg(F.sum("impact").alias("held"), F.sum("residual").alias("seen"))
        sums, _ = written(sums, "ranked-sums")
        best = sums.withColumn("at", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("held")))).filter(F.col("at") <= k)
        floor = {r["item"]: (r["n"], r["low"]) for r in best.groupBy("item").agg(F.count("*").alias("n"), F.min("held").alias("low")).collect()}  # a row an item
        proved = []
        for i, item in enumerate(asked.ids):
            n, low = floor.get(item, (0, 0))
            if n == k:
                floors[i] = max(floors[i], low)
            if item not in done and (rest[item] == 0 or n == k and low > rest[item]):
                proved.append((item, low if n == k else 0, rest[item]))
        if proved:
            told = spark.createDataFrame(proved, "item bigint, floor bigint, rest bigint")
            found = sums.join(F.broadcast(told), "item").filter("held + rest - seen >= floor").select("item", "row")
            results.append(_whole(found, forward, wants, w).withColumn("tier", F.lit(tier)))
            done |= {p[0] for p in proved}
        if len(done) == len(asked.ids):
            break
    left = asked.without(done)
    if left.ids:
        low = np.array([f for i, f in zip(asked.ids, floors, strict=True) if i not in done], np.int64)
        results.append(_last(forward, left, w, low, k).withColumn("tier", F.lit(len(TIERS))))
    out = empty
    for r in results:
        out = out.unionByName(r)
    return written(out, "ranked-found")[0]
