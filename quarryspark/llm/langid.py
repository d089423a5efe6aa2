"""Language identification by error-correcting output codes.

Every learned language has a codeword of +1 and -1. For each bit a binary classifier over hashed letter n-grams (one to three
letters, words bounded by a space) weighs the languages with +1 against those with -1 by naive Bayes log odds, each language
counting alike. A text's bits are the means of these over its n-grams; decoding adds up a logistic loss for each codeword,
bits weighted by how well the languages' own n-gram profiles keep them apart, and takes the codeword of the least loss. A
narrow lead over the second one marks the text as ambiguous.

Counts come from all rows that may be learned from, whole texts. A text that is null or has no letter is `und`, score 0; so is
every text where nothing was learned. With one learned language every other text is of that language. Rows with a null
language teach nothing. Repeated rows get equal results; equal losses go to the language that sorts first. Very long texts are worked
off in chunks of CHUNK code points. Columns lang_pred, score and ambiguous of the input are replaced; others stay. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, text_batches, written

BUCKETS = 1 << 15
ORDERS = 3
SMOOTH = 0.5
#: Codewords of up to this many languages have every possible bit; those of more are drawn at random.
EXHAUSTIVE = 5
#: Steepness of the logistic loss, and of the score as a function of the lead.
STEEP = 6.0
#: Leads below this share of the mean loss are ambiguous.
AMBIGUOUS = 0.15
UNKNOWN = "und"
#: Code points, and losses of texts by languages and bits, that are held at once.
CHUNK, LOSSES = 200_000, 4_000_000
#: Codewords of up to this many languages are the best of several draws.
DRAWN = 512


@lru_cache(1)
def letter_table() -> np.ndarray:
    """Lower case of every letter or mark; a space for any other code point."""

    def of(c: int) -> int:
        ch = chr(c)
        return ord(ch.lower()[0]) if unicodedata.category(ch)[0] in "LM" else 32

    return np.fromiter((of(c) for c in range(0x110000)), np.uint32, 0x110000)


@lru_cache(1)
def is_letter() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ORDERS rows of buckets, which columns count, sizes, whether each text has a letter)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = letter_table()[points]
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    before, two = np.full_like(at, 32), np.full_like(at, 32)
    before[1:] = at[:-1]
    before[starts] = 32
    two[1:] = before[:-1]
    two[starts] = 32
    counts = (at != 32) | (before != 32)
    h1 = at * np.uint32(0x9E3779B1)
    h2 = (h1 ^ (before + np.uint32(0x51ED27)) * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35)
    h3 = (h2 ^ (two + np.uint32(0x27D4EB)) * np.uint32(0x165667B1)) * np.uint32(0x27D4EB2F)
    letters = np.zeros(len(texts), bool)
    if len(points):
        letters[sizes > 0] = np.logical_or.reduceat(is_letter()[points], starts)
    return np.stack([h1, h2, h3]) >> np.uint32(17), counts, sizes, letters


def count_grams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, bucket, n): how often the texts of each language have the n-grams of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch, texts in text_batches(batches, text_col):
            by: dict[str, list[str]] = {}
            for t, lang in zip(texts, batch.column(lang_col).to_pylist(), strict=True):
                by.setdefault(lang, []).append(t)
            for lang, own in by.items():
                buckets, counts, *_ = grams(own)
                n = np.bincount(buckets[:, counts].ravel(), minlength=BUCKETS)
                seen[lang] = seen[lang] + n if lang in seen else n
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])

    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    return known.select(F.col(lang_col).cast("string").alias(lang_col), text_col).mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n rows of +1 and -1, far from each other; no column is constant."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= EXHAUSTIVE:
        columns = [[1] + [1 if k >> i & 1 else -1 for i in range(n - 1)] for k in range((1 << (n - 1)) - 1)]
        return np.array(columns, np.float64).T
    random, bits, best = np.random.Generator(np.random.PCG64(seed)), max(15, math.ceil(8 * math.log2(n))), None
    for _ in range(60 if n <= DRAWN else 1):
        m = random.choice([-1.0, 1.0], (n, bits))
        m[0, np.abs(m.sum(0)) == n] *= -1
        apart = ((bits - m @ m.T) / 2 + np.eye(n) * bits).min() if n <= DRAWN else 0
        if best is None or apart > best[0]:
            best = apart, m
    return best[1]


class Codes:
    """Codewords, bit classifiers and bit weights of the learned languages."""

    def __init__(self, langs: list[str], words: np.ndarray, odds: np.ndarray, scale: np.ndarray, weight: np.ndarray):
        self.langs, self.words, self.odds = langs, words, odds.astype(np.float32)
        self.scale, self.weight = scale, weight / weight.sum() if weight.size else weight

    def bits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean margins of each text's bits, and whether it has a letter. Works on CHUNK code points at a time."""
        buckets, counts, sizes, letters = grams(texts)
        out = np.zeros((len(texts), self.odds.shape[1]))
        if not out.shape[1]:
            return out, letters
        owner = np.repeat(np.arange(len(texts)), sizes)
        for at in range(0, len(owner), CHUNK):
            part = slice(at, at + CHUNK)
            total = self.odds[buckets[0, part]]
            for row in buckets[1:]:
                total += self.odds[row[part]]
            total[~counts[part]] = 0
            starts = np.flatnonzero(np.diff(owner[part], prepend=-1))
            out[owner[part][starts]] += np.add.reduceat(total, starts, axis=0, dtype=np.float64)
        n = np.bincount(owner[counts], minlength=len(texts)) * ORDERS
        return out / np.maximum(n, 1)[:, None], letters

    def decode(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each text."""
        bits, letters = self.bits(texts)
        n, m = len(texts), len(self.langs)
        if not m:
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
        step = max(1, LOSSES // max(1, m * self.words.shape[1]))
        parts = [(np.logaddexp(0, -STEEP * (bits[at : at + step] / self.scale)[:, None, :] * self.words) * self.weight).sum(2) for at in range(0, n, step)]
        loss = np.concatenate(parts) if parts else np.zeros((0, m))
        best = loss.argmin(1)
        chance = np.exp(-2 * (loss - loss.min(1, keepdims=True)))
        score = 1 / chance.sum(1)
        two = np.partition(loss, 1, 1) if m > 1 else loss
        narrow = two[:, 1] - two[:, 0] < AMBIGUOUS * loss.mean(1) if m > 1 else np.zeros(n, bool)
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0), narrow & letters


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Codes:
    """Learn from all rows of docs that have a language.

    Counts stay in Spark: the driver gets the languages' names, BUCKETS rows of one weight a bit, and one row of means and minima
    over the languages, so what it holds doesn't grow with a profile for each language.
    """
    spark = docs.sparkSession
    counts, path = written(count_grams(docs, text_col, lang_col), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).orderBy("lang").collect()  # one row a language
    langs = [r["lang"] for r in totals]
    words = codewords(len(langs))
    n_bits = words.shape[1]
    if not n_bits:
        return Codes(langs, words, np.zeros((BUCKETS, 0)), np.ones(0), np.ones(0))
    mass = np.array([r["total"] + SMOOTH * BUCKETS for r in totals])
    coded = F.broadcast(spark.createDataFrame([(x, float(m), w) for x, m, w in zip(langs, mass, words.tolist(), strict=True)], "lang string, mass double, word array<double>"))  # a codeword a language
    own = counts.join(coded, "lang").withColumn("p", F.col("n") / F.col("mass"))
    sides = own.groupBy("bucket").agg(F.sum("p").alias("all"), *(F.sum(F.when(F.col("word")[b] > 0, F.col("p")).otherwise(0.0)).alias(f"b{b}") for b in range(n_bits))).toPandas()  # BUCKETS rows at most
    floor = SMOOTH / mass
    plus, every = np.zeros((BUCKETS, n_bits)), np.zeros(BUCKETS)
    at = sides["bucket"].to_numpy(np.int64)
    plus[at], every[at] = sides[[f"b{b}" for b in range(n_bits)]].to_numpy(), sides["all"].to_numpy()
    positive = words > 0
    minus = every[:, None] - plus
    odds = np.log((plus + floor @ positive) / positive.sum(0)) - np.log((np.maximum(minus, 0) + floor @ ~positive) / (~positive).sum(0))
    weights = F.broadcast(spark.createDataFrame([(i, x) for i, x in enumerate(odds.tolist())], "bucket int, odds array<double>"))
    rest = odds.sum(0)  # every bucket's share of the smoothing
    margin = [(F.sum(F.col("p") * F.col("odds")[b]) + F.lit(SMOOTH * float(rest[b])) / F.first("mass")) * F.first(F.col("word")[b]) for b in range(n_bits)]
    profiles = own.join(weights, "bucket").groupBy("lang").agg(*(x.alias(f"m{b}") for b, x in enumerate(margin)))
    row = profiles.agg(*(F.avg(F.abs(f"m{b}")).alias(f"a{b}") for b in range(n_bits)), *(F.min(f"m{b}").alias(f"l{b}") for b in range(n_bits))).first()
    drop_path(spark, path)
    scale = np.maximum([row[f"a{b}"] for b in range(n_bits)], 1e-6)
    return Codes(langs, words, odds, scale, np.maximum([row[f"l{b}"] for b in range(n_bits)], 1e-3 * scale))


def predict(docs: DataFrame, codes: Codes, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous; of the columns, only the text is looked at."""
    held = docs.sparkSession.sparkContext.broadcast(codes)  # BUCKETS weights a bit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, text_col, 400_000):
            lang, score, narrow = held.value.decode(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(narrow)], [*batch.schema.names, "lang_pred", "score", "ambiguous"])

    clean = docs.drop("lang_pred", "score", "ambiguous")
    schema = clean.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "ambiguous": F.lit(False)}).schema
    return clean.mapInArrow(run, schema)
