"""Document quality by an n-gram language model of trusted text.

Texts become symbols of a fixed alphabet: the letters a to z, upper case as one symbol, other letters in four classes, digits,
white space, and classes of punctuation, so that shouting, symbol noise and broken layout are improbable sequences. Two counts
of all trusted documents, per language and over all languages, make the model, by interpolated modified Kneser-Ney throughout:
counts of words (runs of symbols up to white space), which grow with the trusted text, and below them trigrams of symbols, which
spell words that no trusted text has. A word's probability is the discounted share of its count, plus the weight of the
discounts times the probability of its spelling and of the space after it. White space beyond that space is spelled.

Words are counted by 64-bit hashes, and shards of these meet the counts: a batch of documents sends each shard one packed row of
its words there, a task reads a shard's counts and then streams the rows of the batches, and each answers with what the known words
save against their spelling. Shards grow in number with the text, so the counts of one stay small. The answers meet again by
batch, which gives each document's perplexity. Words that hold HOT_SHARE of a language's, at most 1 / HOT_SHARE of them, are
broadcast instead. A trusted document's own occurrences are taken from the counts that it is scored with, so that trusted and
other documents compare. Perplexities are compared to quantiles of the
trusted documents of the language and length class (of the class alone, or the language alone, if these are too few); documents
beyond the upper quantile by a margin, or below the lower one by it, are rejected. So are those whose perplexity by the trigrams of symbols alone
is beyond the same quantiles of it: known words in an order or layout that trusted text doesn't have look fine by words alone.

The trigrams of symbols are at most ALPHABET**3 numbers for each of at most MODELS languages, and are broadcast; with more languages
there is a pass for each MODELS of them. A language without trusted text, or null, uses the model of all languages. Null and
empty texts have perplexity 1 and are rejected. Labels that are null or missing are no trust; without trusted text nothing is
rejected but empty texts. Repeated rows get equal results, and a very long text is scored in a batch of its own. Columns of docs
of any name come back as they were, but for score()'s perplexity and accepted, which it replaces. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, shield, shuffle_parts, text_batches, written

ALPHABET = 44
#: Languages whose models are held at once; more are worked off in turns.
MODELS = 64
#: Quantiles of trusted documents' cross-entropies (bits a symbol), and the margins beyond them.
UPPER, LOWER, MARGIN = 0.995, 0.002, 0.12
#: Trusted documents that a length class of a language needs for quantiles of its own.
LEAST_TRUSTED = 50
#: The model of all languages.
POOL = ""
#: Trusted ids up to this number are broadcast to the documents; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: The symbols of a space and of other white space.
SPACE, WHITE = 33, 34
#: Documents of a batch at most: their numbers take two bytes.
BATCH_DOCS = 1 << 16
#: Characters of documents for a shard of words.
SHARD_CHARS = 8_000_000
#: Multipliers of the hash of words.
STEP, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


@lru_cache(1)
def symbol_table() -> np.ndarray:
    """Symbol of every code point."""

    def of(c: int) -> int:
        ch = chr(c)
        kind = unicodedata.category(ch)
        if "a" <= ch <= "z":
            return c - 96
        if kind == "Lu":
            return 27
        if kind[0] in "LM":
            return 28 + c % 4
        if kind[0] == "N":
            return 32
        if ch == " ":
            return 33
        if ch.isspace():
            return 34
        for group, number in ((".", 35), (",", 36), ("!?¡¿", 37), (":;", 38), ("'\"-’‘“”–—", 39), ("()[]{}", 40), ("|/\\_", 41), ("*#$%&@^~+=<>", 42)):
            if ch in group:
                return number
        return 43

    return np.fromiter((of(c) for c in range(0x110000)), np.uint8, 0x110000)


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbol of every code point of all texts, and the texts' lengths."""
    sizes = np.array([len(t) for t in texts], np.int64)
    return symbol_table()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32), sizes


def words_of(s: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first symbol, length, hash, text) of every word of texts, given as symbols and lengths."""
    white = (s == SPACE) | (s == WHITE)
    begin = np.ones(len(s), bool)
    begin[1:] = white[:-1]
    begin[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    begin &= ~white
    at, chars = np.flatnonzero(begin), np.flatnonzero(~white)
    if not len(at):
        return at, at, at.astype(np.uint64), at
    number = (np.cumsum(begin) - 1)[chars]
    length = np.bincount(number, minlength=len(at))
    power = np.full(int(length.max()), STEP)
    power = np.multiply.accumulate(power)
    value = (s[chars].astype(np.uint64) + np.uint64(1)) * SPREAD
    value ^= value >> np.uint64(29)
    h = np.add.reduceat(value * power[chars - at[number]], np.cumsum(length) - length) + length.astype(np.uint64)
    h ^= h >> np.uint64(31)
    h *= SPREAD
    return at, length, h ^ (h >> np.uint64(32)), np.searchsorted(np.cumsum(sizes), at, "right")


def language_key(lang: str) -> np.uint64:
    """What sets a word of a language apart from the same word of others; Spark's xxhash64 of the language."""
    return np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 42))


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram code at every code point of all texts, and the texts' lengths. Symbol 0 stands before a text."""
    s, sizes = symbols(texts)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    one, two = np.zeros_like(s), np.zeros_like(s)
    one[1:] = s[:-1]
    one[starts] = 0
    two[1:] = one[:-1]
    two[starts] = 0
    return (two * ALPHABET + one) * ALPHABET + s, sizes


def count_trigrams(trusted: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, a, b, c, n): how often the trusted texts of each language, and all of them (POOL), have each trigram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch, texts in text_batches(batches, text_col):
            by: dict[str, list[str]] = {}
            for t, lang in zip(texts, batch.column(lang_col).to_pylist(), strict=True):
                by.setdefault(lang or POOL, []).append(t)
            for lang, own in by.items():
                n = np.bincount(codes(own)[0], minlength=ALPHABET**3)
                for x in {lang, POOL}:
                    seen[x] = seen[x] + n if x in seen else n
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "code", "n"])

    parts = trusted.select(F.col(lang_col).cast("string").alias(lang_col), text_col).mapInArrow(run, "lang string, code int, n bigint")
    whole = parts.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    a = F.lit(ALPHABET)
    return whole.select("lang", (F.col("code") / (a * a)).cast("int").alias("a"), ((F.col("code") / a).cast("int") % a).alias("b"), (F.col("code") % a).alias("c"), "n")


def _discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): modified Kneser-Ney discounts of each language's counts n."""
    n = [F.count_if(F.col("n") == k).cast("double") for k in (1, 2, 3, 4)]
    of = counts.groupBy("lang").agg(*(x.alias(f"n{k}") for k, x in enumerate(n, 1)))
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))

    def d(k: int, low: str, high: str):
        return F.greatest(F.lit(0.05 * k), F.least(F.lit(k - 0.05), F.lit(float(k)) - (k + 1) * y * F.col(high) / F.greatest(F.col(low), F.lit(1.0)))).alias(f"d{k}")

    return of.select("lang", d(1, "n1", "n2"), d(2, "n2", "n3"), d(3, "n3", "n4"))


def _order(counts: DataFrame, context: list[str]) -> DataFrame:
    """counts (lang, *context, c, n) with own, the discounted share of each, and back, its context's weight for the lower order."""
    taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    less = counts.join(F.broadcast(_discounts(counts)), "lang").withColumn("taken", taken)  # one row a language
    totals = less.groupBy("lang", *context).agg(F.sum("n").alias("total"), F.sum("taken").alias("freed"))
    joined = less.join(totals, ["lang", *context])
    return joined.select("lang", *context, "c", ((F.col("n") - F.col("taken")) / F.col("total")).alias("own"), (F.col("freed") / F.col("total")).alias("back"))


class Model:
    """Bits of every trigram for each language."""

    def __init__(self, langs: list[str], bits: np.ndarray):
        self.langs = {lang: i for i, lang in enumerate(langs)}
        self.bits = bits

    def spelled(self, s: np.ndarray, at: np.ndarray, length: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Bits of the words that begin at symbols at, each with the space before and after it, under the models numbered own."""
        if not len(at):
            return np.zeros(0)
        many = length + 1
        first = np.cumsum(many) - many
        place = np.arange(int(many.sum())) - np.repeat(first, many)
        here = np.repeat(at, many) + place
        c = np.where(place < np.repeat(length, many), s[np.minimum(here, len(s) - 1)], SPACE)
        one = np.where(place > 0, s[here - 1], SPACE)
        two = np.where(place > 1, s[here - 2], np.where(place == 1, SPACE, 0))
        code = (two * ALPHABET + one) * ALPHABET + c
        return np.add.reduceat(self.bits.ravel()[code + np.repeat(own * ALPHABET**3, many)], first, dtype=np.float64)


def train(tri: DataFrame, part: list[str]) -> Model:
    """The model of all languages and of the part's, from trigram counts: bits of each by interpolated modified Kneser-Ney."""
    langs = [POOL, *part]
    tri = tri.filter(F.col("lang").isin(langs))
    bi = tri.groupBy("lang", "b", "c").agg(F.count("*").alias("n"))  # continuations
    uni = bi.groupBy("lang", "c").agg(F.count("*").alias("n"))
    number = {lang: i for i, lang in enumerate(langs)}
    n, shape = ALPHABET, (len(langs), ALPHABET)
    p = np.full((*shape,), 1.0 / n)
    for table, context in ((uni, []), (bi, ["b"]), (tri, ["a", "b"])):
        rows = _order(table, context).toPandas()  # at most ALPHABET**3 rows a language
        lower = p if not context else np.repeat(p[:, None], n, 1)
        own, back = np.zeros((len(langs), n ** (len(context) + 1))), np.ones((len(langs), n ** len(context)))
        lang = rows["lang"].map(number).to_numpy(np.int64)
        at = np.zeros(len(rows), np.int64)
        for c in context:
            at = at * n + rows[c].to_numpy(np.int64)
        own[lang, at * n + rows["c"].to_numpy(np.int64)] = rows["own"].to_numpy()
        back[lang, at] = rows["back"].to_numpy()
        p = (own.reshape(len(langs), -1, n) + back[:, :, None] * lower.reshape(len(langs), -1, n)).reshape((len(langs), *([n] * (len(context) + 1))))
    return Model(langs, (-np.log2(p)).astype(np.float32).reshape(len(langs), -1))


def count_words(trusted: DataFrame, models: list[Model], pooled: bool, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, word, n, spelled): how often the trusted texts of each language have each word, and the bits of its spelling.

    A word is a hash, with the language's. If pooled, the counts over all languages (POOL) are there as well.
    """
    held = trusted.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {lang: m for m in held.value[::-1] for lang in m.langs}
        for batch, texts in text_batches(batches, text_col):
            by: dict[str, list[str]] = {}
            for t, lang in zip(texts, batch.column(lang_col).to_pylist(), strict=True):
                by.setdefault(lang or POOL, []).append(t)
            for lang, own in by.items():
                s, sizes = symbols(own)
                at, length, word, _ = words_of(s, sizes)
                word, lead, n = np.unique(word, return_index=True, return_counts=True)
                at, length = at[lead], length[lead]
                for x in (lang, POOL) if pooled and lang != POOL else (lang,):
                    spelled = of[x].spelled(s, at, length, np.full(len(at), of[x].langs[x]))
                    yield pa.RecordBatch.from_arrays([pa.array([x] * len(word), pa.string()), pa.array((word ^ language_key(x)).view(np.int64)), pa.array(n), pa.array(spelled.astype(np.float32))], ["lang", "word", "n", "spelled"])

    parts = trusted.select(F.col(lang_col).cast("string").alias(lang_col), text_col).mapInArrow(run, "lang string, word bigint, n bigint, spelled float")
    return written(parts.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.max("spelled").alias("spelled")), "trusted-words")[0]


def word_weights(counts: DataFrame) -> dict[str, tuple[float, list[float], float]]:
    """(total, discounts of counts 1, 2 and more, weight of the spelling) of each language's counts; one row a language."""
    of = counts.groupBy("lang").agg(F.sum("n").alias("total"), *(F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2)), F.count_if(F.col("n") > 2).alias("n3"))
    out = {}
    for r in of.join(F.broadcast(_discounts(counts)), "lang").collect():  # one row a language
        d = [r["d1"], r["d2"], r["d3"]]
        out[r["lang"]] = float(r["total"]), d, sum(x * r[f"n{k}"] for k, x in enumerate(d, 1)) / r["total"]
    return out


def savings(n: np.ndarray, spelled: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Bits that words with counts n take less than by their spelling alone; rows of weights have total, discounts 0 to 3, weight of the spelling."""
    own = np.where(n > 0, n - weights[np.arange(len(n)), 1 + np.clip(n, 0, 3)], 0.0) / weights[:, 0]
    with np.errstate(divide="ignore"):
        return np.logaddexp2(np.log2(own), np.log2(weights[:, 5]) - spelled) - (np.log2(weights[:, 5]) - spelled)


def _saved(known: tuple[np.ndarray, ...], table: np.ndarray, word: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which words are known, bits that they save) by known (words in order, n, spelled, language); k < 0 has a trusted document's occurrences."""
    words, n, spelled, of = known
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0)
    at = np.minimum(np.searchsorted(words, word), len(words) - 1)
    here = np.flatnonzero(words[at] == word)
    at, k = at[here], k[here]
    return here, np.abs(k) * savings(np.maximum(n[at] + np.minimum(k, 0), 0), spelled[at].astype(float), table[of[at]])


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, each by byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns))


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n, out, at = len(raw) // sum(np.dtype(k).itemsize for k in kinds), [], 0
    for k in kinds:
        size = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(k).ravel())
        at += n * size
    return out


LISTS = ("ids", "ties", "langs", "trusted", "bits", "sizes", "shapes")


def _schema(kind: str) -> str:
    return f"shard int, batch bigint, word bigint, n bigint, spelled float, of int, packed binary, ids array<{kind}>, ties array<bigint>, langs array<string>, trusted array<boolean>, bits array<double>, sizes array<bigint>, shapes array<double>"


def _wanted(docs: DataFrame, model: Model, turn: int, shards: int, hot: tuple[np.ndarray, ...], weights: dict[str, tuple[float, list[float], float]], id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Rows of batches of docs (id, text, lang, _tie, _trusted): one has the documents, with their bits by spelling and hot words, one for each shard its words."""
    kind = dict(docs.dtypes)[id_col]
    held = docs.sparkSession.sparkContext.broadcast((model, hot, _table(weights)))
    back = {lang: -math.log2(w[2]) for lang, w in weights.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (own, often, table), task, seen = held.value, TaskContext.get().partitionId(), 0
        for whole in batches:
            for begin in range(0, whole.num_rows, BATCH_DOCS):
                part, first, found, bits, lengths, shapes = whole.slice(begin, BATCH_DOCS), 0, [], [], [], []
                for batch, texts in text_batches(iter([part]), text_col):
                    names = [x if x in own.langs else POOL for x in (y or POOL for y in batch.column(lang_col).to_pylist())]
                    number, spare = np.array([own.langs[x] for x in names], np.int64), np.array([back.get(x, 0.0) for x in names])
                    s, sizes = symbols(texts)
                    at, length, word, text = words_of(s, sizes)
                    white = (s == SPACE) | (s == WHITE)
                    ends = at + length
                    ends = ends[ends < np.cumsum(sizes)[text]]
                    white[ends[s[ends] == SPACE]] = False  # these belong to the words before them
                    gaps = np.flatnonzero(white)
                    of = np.searchsorted(np.cumsum(sizes), gaps, "right")
                    owner = np.repeat(np.arange(len(texts)), sizes)
                    each = own.bits.ravel()[codes(texts)[0] + number[owner] * ALPHABET**3]
                    shapes.append(np.bincount(owner, each, len(texts)).astype(float))
                    plain = np.bincount(of, each[gaps], len(texts)).astype(float)
                    plain += np.bincount(text, own.spelled(s, at, length, number[text]) + spare[text], len(texts)).astype(float)
                    keys = {x: language_key(x) for x in set(names)}
                    word = word ^ np.array([keys[x] for x in names], np.uint64)[text]
                    order = np.lexsort((text, word))
                    word, text = word[order], text[order]
                    new = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (text[1:] != text[:-1])][: len(word)])
                    k = np.diff(np.r_[new, len(word)])
                    word, text = word[new], text[new]
                    k = np.where(np.array(batch.column("_trusted").to_pylist(), bool)[text], -k, k)
                    here, less = _saved(often, table, word, k)
                    bits.append(plain - np.bincount(text[here], less, len(texts)).astype(float))
                    lengths.append(sizes)
                    left = np.ones(len(word), bool)
                    left[here] = False
                    found.append((word[left], text[left] + first, k[left]))
                    first += len(texts)
                word, text, k = (np.concatenate(x) for x in zip(*found, strict=True))
                shard = (word % np.uint64(shards)).astype(np.int64)
                order = np.lexsort((word, shard))
                word, text, k, shard = word[order], text[order], k[order], shard[order]
                new = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]][: len(word)])
                packed = [_pack(np.diff(word[a:b], prepend=np.uint64(0)), text[a:b].astype("<u2"), k[a:b].astype("<i4")) for a, b in pairwise([*new, len(word)])]
                name, n = (turn << 52) + (task << 26) + seen, len(new) + 1
                seen += 1
                listed = [pa.ListArray.from_arrays(pa.array([0] + [part.num_rows] * n, pa.int32()), x) for x in (part.column(id_col), part.column("_tie"), part.column(lang_col), part.column("_trusted"), pa.array(np.concatenate(bits)), pa.array(np.concatenate(lengths)), pa.array(np.concatenate(shapes)))]
                columns = [pa.array(np.r_[name % shards, shard[new]].astype(np.int32)), pa.array(np.full(n, name)), *(pa.nulls(n, x) for x in (pa.int64(), pa.int64(), pa.float32(), pa.int32())), pa.array([None, *packed], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *listed], ["shard", "batch", "word", "n", "spelled", "of", "packed", *LISTS])

    return docs.select(id_col, text_col, F.col(lang_col).cast("string").alias(lang_col), "_tie", "_trusted").mapInArrow(run, _schema(kind))


def _table(weights: dict[str, tuple[float, list[float], float]]) -> np.ndarray:
    """Rows total, discounts 0 to 3, weight of the spelling, of the languages in order."""
    return np.array([[t, 0.0, *d, b] for t, d, b in (weights[x] for x in sorted(weights))]).reshape(-1, 6)


def _entropies(wanted: DataFrame, counts: DataFrame, shards: int, weights: dict[str, tuple[float, list[float], float]], id_col: str, lang_col: str) -> DataFrame:
    """(id, lang, _tie, _trusted, symbols, entropy, shape) of the documents of _wanted's rows: bits a symbol, by words and by trigrams of symbols alone, 0 for an empty text."""
    kind = dict(wanted.dtypes)["ids"][6:-1]
    number = F.array_position(F.array(*map(F.lit, sorted(weights))), F.col("lang")) - 1 if weights else F.lit(0)
    rest = F.conv(F.hex("word"), 16, 10).cast("decimal(20,0)") % shards  # the hash is unsigned
    own = counts.select(rest.cast("int").alias("shard"), F.lit(-1).cast("bigint").alias("batch"), "word", "n", "spelled", number.cast("int").alias("of"))
    table = _table(weights)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, known = None, [], None
        for rows in batches:
            here = rows.column("shard").to_numpy()
            counted = rows.column("batch").to_numpy() < 0
            cuts = np.flatnonzero(np.r_[True, (here[1:] != here[:-1]) | (counted[1:] != counted[:-1])])
            for a, b in zip(cuts, [*cuts[1:], len(here)], strict=True):
                if here[a] != shard:
                    shard, parts, known = here[a], [], None
                some = rows.slice(a, b - a)
                if counted[a]:
                    parts.append((some.column("word").to_numpy().view(np.uint64), *(some.column(c).to_numpy() for c in ("n", "spelled", "of"))))
                    continue
                if known is None:
                    known = tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64),) * 4
                    order = np.argsort(known[0])
                    known = tuple(x[order] for x in known)
                out = []
                for data in some.column("packed").to_pylist():
                    if data is None:
                        out.append(None)
                        continue
                    word, text, k = _unpack(data, "<u8", "<u2", "<i4")
                    at, less = _saved(known, table, np.cumsum(word, dtype=np.uint64), k.astype(np.int64))
                    total = np.bincount(text[at], less)
                    of = np.flatnonzero(total)
                    out.append(_pack(of.astype("<u2"), total[of].astype("<f4")) if len(of) else b"")
                yield pa.RecordBatch.from_arrays([some.column("batch"), pa.array(out, pa.binary()), *(some.column(c) for c in LISTS)], ["batch", "packed", *LISTS])

    def run(rows: pa.Table) -> pa.Table:
        one = rows.filter(rows.column("packed").is_null())
        ids, ties, langs, trusted, bits, sizes, shapes = (one.column(c).combine_chunks().flatten() for c in LISTS)
        bits, sizes = bits.to_numpy().copy(), sizes.to_numpy()
        for data in rows.column("packed").to_pylist():
            if data:
                of, less = _unpack(data, "<u2", "<f4")
                bits[of] -= less
        entropy, shape = (np.divide(x, sizes, out=np.zeros(len(bits)), where=sizes > 0) for x in (bits, shapes.to_numpy()))
        return pa.table([ids, langs, ties, trusted, pa.array(sizes), pa.array(entropy), pa.array(shape)], names=[id_col, lang_col, "_tie", "_trusted", "symbols", "entropy", "shape"])

    sent = F.col("packed").isNotNull()
    lists = [F.when(~sent, F.col(c)).alias(c) for c in LISTS]  # these are in one row of a batch alone
    both = wanted.select("shard", "batch", "word", "n", "spelled", "of", "packed", *lists).unionByName(own, allowMissingColumns=True)
    met = both.repartition(shards, "shard").sortWithinPartitions("shard", "batch").mapInArrow(answered, "batch bigint, packed binary" + _schema(kind).split("packed binary")[1])
    return met.filter("packed IS NULL OR length(packed) > 0").groupBy("batch").applyInArrow(run, f"{id_col} {kind}, {lang_col} string, _tie bigint, _trusted boolean, symbols bigint, entropy double, shape double")


def length_class(length: Column) -> Column:
    """Texts of up to 63, 255, 1023, ... characters."""
    return F.greatest(F.lit(3), F.floor(F.log2(F.greatest(length, F.lit(1)) + F.lit(0.5)) / 2)).cast("int")


def with_trust(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with _trusted: whether labels (id_col, quality) call them good."""
    good = labels.filter(F.col("quality") == 1).select(F.col(id_col).alias("_good")).distinct()
    small = good.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(good) if small else good, docs[id_col] == good["_good"], "left").withColumn("_trusted", F.col("_good").isNotNull()).drop("_good")


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with perplexity, and accepted (boolean); columns of these two names are replaced, all others stay as they are."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("perplexity", "accepted")))
    held, restore = shield(docs, id_col, text_col, lang_col)
    judged = _judged(held, labels, id_col, text_col, lang_col)
    both = [F.pow(F.lit(2.0), "entropy").alias("perplexity"), F.col("_accepted").alias("accepted")]
    own = restore(held).schema  # names and order of docs
    return judged.select(*(F.col(h).alias(c) for h, c in zip(held.columns, own.names, strict=True)), *both)


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that are accepted, with docs' columns as they were, whatever their names."""
    held, restore = shield(docs, id_col, text_col, lang_col)
    return restore(_judged(held, labels, id_col, text_col, lang_col).filter("_accepted"))


def _judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """docs with entropy and _accepted. Languages are taken MODELS at a time, so the table that a worker holds is bounded."""
    lang = F.col(lang_col).cast("string")
    rows = with_trust(docs.select(id_col, text_col, lang.alias(lang_col), F.xxhash64(text_col).alias("_tie")), labels, id_col)
    trusted = rows.filter("_trusted").select(text_col, lang_col)  # read twice; a copy of these texts would take more disk than the counts
    tri, _ = written(count_trigrams(trusted, text_col, lang_col), "trigrams")
    langs = sorted(r["lang"] for r in tri.select("lang").distinct().collect() if r["lang"] != POOL)  # names alone
    parts = [langs[at : at + MODELS] for at in range(0, len(langs), MODELS)] or [[]]
    models = [train(tri, part) for part in parts]  # ALPHABET**3 numbers a language on the driver
    foreign = ~F.coalesce(lang.isin(langs), F.lit(False))
    size = docs.agg(F.sum(F.length(text_col)).alias("chars"), F.count_if(foreign).alias("others")).first()
    shards = max(shuffle_parts(docs.sparkSession), (size["chars"] or 0) // SHARD_CHARS)
    counts = count_words(trusted, models, size["others"] > 0, text_col, lang_col)
    weights = word_weights(counts)
    limit = F.create_map(*(F.lit(x) for k, w in weights.items() for x in (k, max(2.0, w[0] * HOT_SHARE))))[F.col("lang")] if weights else F.lit(math.inf)
    few = counts.filter(F.col("n") >= limit).collect()  # 1 / HOT_SHARE rows a language at most
    place = {x: i for i, x in enumerate(sorted(weights))}
    wanted = None
    for turn, part in enumerate(parts):
        mine = F.coalesce(lang.isin(part), F.lit(False)) if turn else ~F.coalesce(lang.isin(langs[MODELS:]), F.lit(False))  # the first turn takes those without a model, too
        top = sorted((r["word"] % 2**64, r["n"], r["spelled"], place[r["lang"]]) for r in few if r["lang"] in models[turn].langs)
        hot = tuple(np.array(x, t) for x, t in zip(zip(*top, strict=True) if top else [()] * 4, (np.uint64, np.int64, float, np.int64), strict=True))
        some = _wanted(rows if len(parts) == 1 else rows.filter(mine), models[turn], turn, shards, hot, weights, id_col, text_col, lang_col)
        wanted = some if wanted is None else wanted.unionByName(some)
    cold = counts.filter(F.col("n") < limit)
    seen, _ = written(_entropies(wanted, cold, shards, weights, id_col, lang_col), "entropies")
    own = F.when(F.col(lang_col).isin(langs), F.col(lang_col)).otherwise(F.lit(POOL)) if langs else F.lit(POOL)
    seen = seen.withColumns({"_lang": own, "_class": length_class(F.col("symbols"))})
    grades = seen.filter("_trusted AND symbols > 0").withColumn("_lang", F.explode(F.array_distinct(F.array("_lang", F.lit(POOL))))).withColumn("_class", F.explode(F.array("_class", F.lit(-1))))
    limits = grades.groupBy("_lang", "_class").agg(F.count("*").alias("n"), *(F.percentile_approx(x, F.array(F.lit(LOWER), F.lit(UPPER)), 10_000).alias(x) for x in ("entropy", "shape"))).filter((F.col("n") >= LEAST_TRUSTED) | ((F.col("_class") == -1) & (F.col("_lang") == POOL))).collect()  # a few rows a language
    held = {(r["_lang"], r["_class"]): tuple(b for x in ("entropy", "shape") for b in (r[x][0] - MARGIN, r[x][1] + MARGIN)) for r in limits}
    bounds = docs.sparkSession.createDataFrame([(x, c, *next((held[k] for k in ((x, c), (POOL, c), (x, -1), (POOL, -1)) if k in held), (-math.inf, math.inf) * 2)) for x in [POOL, *langs] for c in range(3, 17)], "_lang string, _class int, low double, high double, flat double, steep double")
    good = (F.col("symbols") > 0) & F.col("entropy").between(F.col("low"), F.col("high")) & F.col("shape").between(F.col("flat"), F.col("steep"))
    judged = seen.join(F.broadcast(bounds), ["_lang", "_class"]).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_of"), F.col("_tie").alias("_same"), "entropy", good.alias("_accepted"))  # a few rows a language
    once = judged.dropDuplicates(["_id", "_of", "_same"])  # repeated rows have equal results
    tied = docs.withColumn("_tie", F.xxhash64(text_col))
    same = tied[id_col].eqNullSafe(once["_id"]) & lang.eqNullSafe(once["_of"]) & (tied["_tie"] == once["_same"])
    return tied.join(once, same).drop("_tie", "_id", "_of", "_same")
