"""Toxicity by the nearest labelled examples.

Terms are words and their beginnings, lower-cased, and one that every word counts for, which keeps an occurrence in a long
text apart from one in a short text. A bounded sample of labelled rows (EXAMPLES of each label, those of the
smallest hashes of the id) chooses the terms that tell the labels apart and gives the examples; inverse document frequencies
count every document. The score of a text comes from the examples of the greatest TF-IDF cosine, found exactly through a
block-max inverted index: examples lie in blocks, each term has its greatest weight in every block, the sums of these bound
a block's cosines, and blocks are scanned from the highest bound on until it falls below the k-th cosine found. Neighbours
vote with weights that fall with distance; the votes' share is calibrated, without decreasing, on each example's own
neighbours, with the labels' shares among all labelled rows.

A label that is null or missing teaches nothing; an id with two labels is toxic, and one with several texts gives one example, the
text that sorts first. A very long text is worked on whole, in a batch of its own. An empty table gives an empty result. Texts without a chosen term, null and empty ones among them, get the share
of toxic examples of that kind. Without examples of both labels every score is the share of toxic ones (0 if none are known).
Repeated rows get equal scores. All examples whose cosine equals the last neighbour's vote, so ids decide the order of the evidence alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shield, text_batches, written

#: Labelled rows of each label that are examples.
EXAMPLES = 2048
#: Lengths of the word beginnings among the terms.
BEGINNINGS = (4, 5, 6, 7, 8)
#: A term tells the labels apart if its chi-square statistic reaches this.
APART = 30.0
NEIGHBOURS, BLOCK = 15, 32
#: Blocks that give a text its first cosines, and texts that meet the blocks together.
FIRST, STEP = 2, 256
#: Word forms whose terms a worker remembers.
CACHE_WORDS = 150_000

#: The term of all words.
ALL = "*"

WORD = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> list[str]:
    """The word itself, and its beginnings, marked as such."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n)]


def words(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


class Vocabulary:
    """Numbers of the chosen terms."""

    def __init__(self, terms: list[str]):
        self.number = {t: i for i, t in enumerate(terms)}
        self.known: dict[str, list[int]] = {}

    def counts(self, text: str) -> dict[int, int]:
        """How often each chosen term occurs."""
        out: dict[int, int] = {}
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        seen = words(text)
        if seen:
            out[self.number[ALL]] = seen.total()
        for word, n in seen.items():
            own = known.get(word)
            if own is None:
                own = known[word] = [self.number[t] for t in terms_of(word) if t in self.number]
            for t in own:
                out[t] = out.get(t, 0) + n
        return out


class Examples:
    """Labelled examples in a block-max inverted index."""

    def __init__(self, terms: list[str], idf: np.ndarray, ids: list, labels: list[int], counts: list[dict[int, int]], shares: tuple[float, float]):
        self.terms, self.idf = terms, idf
        order = sorted(range(len(ids)), key=lambda i: ids[i])  # equal cosines: the smaller id first
        self.ids, self.labels = [ids[i] for i in order], np.array([labels[i] for i in order], np.int64)
        self.vectors = [self.weights(counts[i]) for i in order]
        alike = sorted(range(len(ids)), key=lambda i: (min(self.vectors[i], key=lambda t: (-self.vectors[i][t], t), default=-1), i))
        self.members = [np.array(alike[at : at + BLOCK]) for at in range(0, len(ids), BLOCK)]
        self.most = np.zeros((len(terms), len(self.members)))
        self.columns: list[np.ndarray] = []  # the terms of a block
        self.dense: list[np.ndarray] = []  # their weights, a row a term
        for b, members in enumerate(self.members):
            column = np.array(sorted({t for i in members for t in self.vectors[i]}), np.int64)
            dense = self.matrix([self.vectors[i] for i in members])[:, column].T
            if len(column):
                self.most[column, b] = dense.max(1)
            self.columns.append(column)
            self.dense.append(np.ascontiguousarray(dense))
        self.plain: tuple[float, list] | None = None
        self.class_weight = np.array([s / max(1, int((self.labels == y).sum())) for y, s in enumerate(shares)])
        self.calibrate()

    def weights(self, counts: dict[int, int]) -> dict[int, float]:
        """The unit TF-IDF vector of term counts."""
        raw = {t: (1 + math.log(n)) * self.idf[t] for t, n in counts.items()}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        return {t: float(w / norm) for t, w in raw.items()} if norm else {}

    def matrix(self, vectors: list[dict[int, float]]) -> np.ndarray:
        """The vectors as dense rows."""
        out = np.zeros((len(vectors), len(self.terms)))
        sizes = [len(v) for v in vectors]
        out[np.repeat(np.arange(len(vectors)), sizes), [t for v in vectors for t in v]] = [w for v in vectors for w in v.values()]
        return out

    def nearest(self, queries: list[dict[int, float]], k: int, but: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the k greatest cosines above zero and all that equal the k-th, as (cosines, examples); equal ones by id.

        The blocks of the best bounds give each query a k-th cosine; after them only blocks whose bound reaches it are scanned.
        """
        dense = self.matrix(queries)
        bound, n, blocks = dense @ self.most, len(queries), len(self.members)
        scores = np.zeros((n, len(self.ids)))
        if not blocks:
            return [(np.empty(0), np.empty(0, np.int64)) for _ in queries]

        def scan(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(0)).tolist():
                rows = np.flatnonzero(wanted[:, b])
                scores[rows[:, None], self.members[b]] = np.round(dense[rows[:, None], self.columns[b]] @ self.dense[b], 12)
            if but is not None:
                scores[np.arange(n), but] = 0

        first = np.zeros((n, blocks), bool)
        first[np.arange(n)[:, None], np.argpartition(-bound, min(FIRST, blocks) - 1, 1)[:, :FIRST]] = True
        scan(first & (bound > 0))
        at = max(0, len(self.ids) - k)
        floor = np.maximum(np.partition(scores, at, 1)[:, at], 0)
        scan(~first & (bound > 0) & (bound >= floor[:, None] - 1e-9))
        floor = np.partition(scores, at, 1)[:, at]
        out = []
        for row, least in zip(scores, floor, strict=True):
            found = np.flatnonzero((row >= least) & (row > 0))
            found = found[np.argsort(-row[found], kind="stable")]
            out.append((row[found], found))
        return out

    def votes(self, score: np.ndarray, at: np.ndarray) -> float:
        """The toxic share of the neighbours' weights."""
        weight = self.class_weight[self.labels[at]] / (1.02 - score)
        return float(weight @ self.labels[at] / weight.sum())

    def calibrate(self) -> None:
        """Fit the share of toxic examples as a function of votes that doesn't decrease (pool adjacent violators)."""
        points, empty = [], [0.0, 0.0]
        others = [x for at in range(0, len(self.ids), STEP) for x in self.nearest(self.vectors[at : at + STEP], NEIGHBOURS, list(range(at, min(at + STEP, len(self.ids)))))]
        for i, found in enumerate(others):
            weight = self.class_weight[self.labels[i]]
            if len(found[0]):
                points.append((self.votes(*found), weight * self.labels[i], weight))
            else:
                empty[self.labels[i]] += weight
        total = sum(self.class_weight[y] for y in self.labels) or 1.0
        prior = self.class_weight[1] * int(self.labels.sum()) / total
        soft = 0.5 * min((w for w in self.class_weight if w), default=1.0)
        self.empty = (empty[1] + soft * prior) / (sum(empty) + soft)
        pools: list[list[float]] = []  # [lowest votes, toxic weight, weight]
        equal: dict[float, list[float]] = {}
        for x, y, w in points:
            own = equal.setdefault(round(x, 6), [0.0, 0.0])
            own[0] += y
            own[1] += w
        for x, (y, w) in sorted(equal.items()):
            pools.append([x - 1e-6, y, w])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                _, y2, w2 = pools.pop()
                pools[-1][1] += y2
                pools[-1][2] += w2
        self.steps = np.array([p[0] for p in pools])
        smooth = np.array([(y + soft * prior) / (w + soft) for _, y, w in pools])
        self.values = np.maximum.accumulate(smooth) if len(smooth) else smooth  # smoothing moves light pools most, so it could turn two of them round

    def score(self, texts: list[dict[int, int]]) -> list[tuple[float, list]]:
        """Score between 0 and 1, and the ids of the nearest examples, of each text's term counts. Equal counts are worked on once."""
        known: dict[tuple, tuple[float, list] | None] = {}
        keys = [tuple(c.items()) if len(c) > 1 else (len(c),) for c in texts]  # the term of all words alone: one direction
        fresh = []
        for key, counts in zip(keys, texts, strict=True):
            if key not in known:
                known[key] = None
                fresh.append((key, self.weights(counts)))
        for at in range(0, len(fresh), STEP):
            part = fresh[at : at + STEP]
            for (key, _), found in zip(part, self.nearest([v for _, v in part], NEIGHBOURS), strict=True):
                if not len(found[0]) or not len(self.steps):
                    known[key] = self.empty, []
                    continue
                step = max(0, int(np.searchsorted(self.steps, self.votes(*found), "right")) - 1)
                known[key] = float(np.clip(self.values[step], 0.0, 1.0)), [self.ids[i] for i in found[1][:5].tolist()]
        return [known[k] for k in keys]


def _chosen(sample: DataFrame, text_col: str) -> list[str]:
    """Terms whose document frequencies differ most between the labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch, texts in text_batches(batches, text_col):
            for t, y in zip(texts, batch.column("toxic").to_pylist(), strict=True):
                seen[y].update({x for w in words(t) for x in terms_of(w)})
        terms = list(seen[0] | seen[1])
        for at in range(0, len(terms), 50_000):
            part = terms[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([c[x] for x in part], pa.int64()) for c in seen)], ["term", "clean", "toxic"])

    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = float(size.get(0, 0)), float(size.get(1, 0))
    if not n0 or not n1:
        return [ALL]
    tables = sample.select(text_col, "toxic").mapInArrow(run, "term string, clean bigint, toxic bigint").groupBy("term").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    hit = a + b
    chi = (n0 + n1) * (a * (n1 - b) - b * (n0 - a)) ** 2 / (n0 * n1 * hit * F.greatest(F.lit(n0 + n1) - hit, F.lit(0.5)))
    chosen = tables.withColumn("chi", chi).filter(F.col("chi") >= APART)  # a bounded sample's terms
    return sorted({ALL, *(r["term"] for r in chosen.select("term").collect())})


@lru_cache(2)
def _vocabulary(terms: tuple[str, ...]) -> Vocabulary:
    return Vocabulary(list(terms))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> Examples:
    """Learn from the labels (id_col, toxic 0 or 1) of docs. Ids and texts alone are read of docs."""
    known = labels.select(id_col, F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull())
    known = known.groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(EXAMPLES) for y in (0, 1)]
    rows = {r[id_col]: r["toxic"] for p in picked for r in p.collect()}  # at most 2 * EXAMPLES
    spark = docs.sparkSession
    chosen = spark.createDataFrame(list(rows.items()), labels.select(id_col).withColumn("toxic", F.lit(0)).schema)
    labelled = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)
    sample, _ = written(labelled.groupBy(id_col).agg(F.min(F.struct("toxic", text_col)).alias("_one")).select(id_col, "_one.*"), "toxicity-sample")  # an id is one example
    terms = tuple(_chosen(sample, text_col))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, text_col):
            found = [sorted(_vocabulary(terms).counts(t).items()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("toxic"), *(pa.array([[x[k] for x in f] for f in found], pa.list_(pa.int32())) for k in (0, 1))], [id_col, "toxic", "terms", "counts"])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(len(terms), np.int64), 0
        for _, texts in text_batches(batches, text_col):
            n += len(texts)
            for t in texts:
                seen[list(_vocabulary(terms).counts(t))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(terms)).astype(np.int32)), pa.array(np.concatenate([[n], seen]))], ["term", "n"])

    kind = dict(docs.dtypes)[id_col]
    examples = sample.select(id_col, "toxic", text_col).mapInArrow(vectors, f"{id_col} {kind}, toxic int, terms array<int>, counts array<int>").collect()
    examples.sort(key=lambda r: (r[id_col], r["terms"]))
    seen = {r["term"]: r["n"] for r in docs.select(text_col).mapInArrow(frequencies, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # one row a term
    total = seen.get(-1, 0)
    idf = np.array([np.log((total + 1) / (seen.get(t, 0) + 1)) + 1 for t in range(len(terms))])
    return Examples(list(terms), idf, [r[id_col] for r in examples], [r["toxic"] for r in examples], [dict(zip(r["terms"], r["counts"], strict=True)) for r in examples], (shares.get(0, 0), shares.get(1, 0)))


def score(docs: DataFrame, examples: Examples, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1), predicted (1 from threshold on) and evidence (ids of the nearest examples).

    Columns of docs of these three names are replaced; all others stay as they are.
    """
    kind = dict(docs.dtypes)[id_col]
    held = docs.sparkSession.sparkContext.broadcast(examples)  # at most 2 * EXAMPLES sparse vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        vocabulary = _vocabulary(tuple(own.terms))
        for batch, texts in text_batches(batches, text_col):
            found = own.score([vocabulary.counts(t) for t in texts])
            ids = pa.array([e for _, e in found], pa.list_(batch.column(id_col).type))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s for s, _ in found], pa.float64()), pa.array([int(s >= threshold) for s, _ in found], pa.int32()), ids], [*batch.schema.names, "score", "predicted", "evidence"])

    clean = docs.drop(*(c for c in docs.columns if c.lower() in ("score", "predicted", "evidence")))
    schema = clean.withColumns({"score": F.lit(0.0), "predicted": F.lit(0), "evidence": F.array(F.lit(None).cast(kind))}).schema
    return clean.mapInArrow(run, schema)


def accepted(docs: DataFrame, examples: Examples, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't predicted to be toxic, with docs' columns as they were, whatever their names."""
    held, restore = shield(docs, id_col, text_col)
    return restore(score(held, examples, threshold, id_col, text_col).filter("predicted = 0"))


def learnable(labels: DataFrame, remainder: int = 1, of: int = 3, id_col: str = "doc_id") -> DataFrame:
    """Labels of rows that are not held out; one without an id is not, though it is no document's."""
    return labels.filter(F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % of != remainder, F.lit(True)))
