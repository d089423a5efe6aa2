"""A stored positional inverted index: immutable segments, tombstones, and manifests that name them.

A segment's postings have a row for each term and block of documents (about BLOCK tokens of a task's scan): document numbers, lengths, frequencies
and positions as arrays, and the block's greatest frequency and least length, which bound what a document of it can score.
Blocks are inverted in the scan's tasks, so what is shuffled is one packed row a term and block; rows are rebalanced by bucket: adaptive execution splits a large
bucket into as many tasks as its bytes ask for, so that neither a word that all documents have nor a larger input makes a hot task. Buckets are hashes of a term's first letters, so words and prefixes of PREFIX letters or more read one
folder; rows are sorted by term, so the scan skips row groups. Parquet's second version packs the arrays' numbers as differences.

A change writes a segment or a table of tombstones and then a new manifest: documents are replaced by owner (a case), and a tombstone hides
a document in the segments that existed then. Statistics are those of the live documents, so scores are the same as a scan's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shipping import fresh_path
from ..sources.versions import Versions

K1, B, FLOOR = 1.2, 0.75, 1e-6
#: Letters that decide a term's bucket, and buckets.
PREFIX, BUCKETS = 3, 64
#: Rows that are broadcast at most.
BROADCAST_ROWS = 500_000
#: Blocks that a ranked search looks at first.
FIRST_BLOCKS = 16

#: How rows cross the shuffle: all numbers of a row packed (see _packed), a fraction of the bytes of arrays.
SENT = "term string, block bigint, n int, max_freq int, min_len int, packed binary"
POSTINGS = "term string, block bigint, docs array<bigint>, lens array<int>, freqs array<int>, positions array<array<int>>, n int, max_freq int, min_len int"


@dataclass(frozen=True)
class Phrase:
    """Words in a row; star: the last one is a prefix."""

    words: tuple[str, ...]
    star: bool = False

    @classmethod
    def of(cls, text: str, star: bool = False) -> Phrase:
        """A phrase by the index' own words: runs of letters and digits, without marks."""
        return cls(tuple(T.plain_tokens(text)), star)

    def slots(self) -> list[tuple[str, bool]]:
        return [(w, self.star and i == len(self.words) - 1) for i, w in enumerate(self.words)]


#: What stands for a null id among packed numbers; numbers that are packed together, and packed bytes that are unpacked together.
NO_ID, PACK, UNPACK = np.iinfo(np.int64).min, 1 << 18, 1 << 18
#: Tokens of a block, about: what a task sorts at once. A longer document is a block of its own.
BLOCK = 1 << 20


def _lists(counts: np.ndarray, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... anew for each count."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _steps(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences to the value before; where a run begins, the value itself."""
    out = np.diff(values, prepend=values[:1])
    out[first] = values[first]
    return out


def _summed(steps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values of _steps, from the lengths of the runs (none is empty)."""
    total, first = np.cumsum(steps), np.cumsum(counts) - counts
    return total - np.repeat(total[first] - steps[first], counts)


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes a value): seven bits a byte, the least first; all but a value's last byte are marked."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 10):
        sizes += values >= np.uint64(1 << 7 * k)
    out, begin = np.empty(sizes.sum(), np.uint8), np.cumsum(sizes) - sizes
    for k in range(sizes.max(initial=0)):
        some = np.flatnonzero(sizes > k)
        low = (values[some] >> np.uint64(7 * k)).astype(np.uint8) & 127
        out[begin[some] + k] = low | np.where(sizes[some] > k + 1, 128, 0).astype(np.uint8)
    return out, sizes


def _values(data: np.ndarray) -> np.ndarray:
    """The values of _varints' bytes."""
    ends = np.flatnonzero(data < 128)
    sizes = np.diff(ends, prepend=-1)
    shifted = (data & 127).astype(np.uint64) << (7 * _within(sizes)).astype(np.uint64)
    return np.add.reduceat(shifted, ends + 1 - sizes)


def _packed(docs: np.ndarray, ids: np.ndarray, lens: np.ndarray, freqs: np.ndarray, steps: np.ndarray) -> pa.BinaryArray:
    """A row's numbers as bytes: steps between its ids (with their sign in the lowest bit), lengths, frequencies, steps between positions.

    docs: documents of each row; ids to freqs: a value a document; steps: those of each document's positions.
    """
    first = np.cumsum(docs) - docs
    places = np.add.reduceat(freqs, first)
    counts = 3 * docs + places
    base, n, at = np.cumsum(counts) - counts, np.repeat(docs, docs), _within(docs)
    values = np.empty(counts.sum(), np.uint64)
    step = _steps(ids, first)
    own = np.repeat(base, docs) + at
    values[own] = ((step << 1) ^ (step >> 63)).view(np.uint64)
    values[own + n], values[own + 2 * n] = lens, freqs
    values[np.repeat(base + 3 * docs, places) + _within(places)] = steps
    data, sizes = _varints(values)
    offsets = np.concatenate([[0], np.cumsum(np.add.reduceat(sizes, base))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(docs), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of batches (id, tokens) of BLOCK tokens at most; a longer document is a slice of its own."""
    for batch in batches:
        ends = batch.column("tokens").offsets.to_numpy()
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + BLOCK, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting rows of each block of batches (id, tokens), packed some terms at a time."""
    part = TaskContext.get().partitionId() << 32
    for number, batch in enumerate(_blocks(batches)):
        tokens = batch.column("tokens")
        lens = np.diff(tokens.offsets.to_numpy())
        coded = tokens.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        if not len(codes):
            continue
        doc = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
        pos = _within(lens).astype(np.int32)
        order = np.argsort(codes, kind="stable")  # by term, then document, then position
        codes, doc, pos = codes[order], doc[order], pos[order]
        del order
        new = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1])]))
        freq, code, own = np.diff(np.append(new, len(codes))), codes[new], doc[new]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        ids = batch.column("id").fill_null(NO_ID).to_numpy()
        ends = np.append(first, len(code))  # documents of each term, and their positions
        places = np.append(new, len(codes))[ends]
        cuts = np.unique([*np.searchsorted(places + 3 * ends, np.arange(0, places[-1] + 3 * ends[-1], PACK)), len(first)]).tolist()
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            held = slice(ends[i], ends[j])
            docs, freqs, size, own_first = np.diff(ends[i : j + 1]), freq[held], lens[own[held]], ends[i:j] - ends[i]
            steps = _steps(pos[places[i] : places[j]].astype(np.int64), new[held] - places[i])
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary.take(pa.array(code[first[i:j]])), pa.array(np.full(j - i, part + number)), pa.array(docs.astype(np.int32)), pa.array(np.maximum.reduceat(freqs, own_first).astype(np.int32)), pa.array(np.minimum.reduceat(size, own_first).astype(np.int32)), _packed(docs, ids[own[held]], size, freqs, steps)],
                [c.split(" ")[0] for c in SENT.split(", ")],
            )


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of SENT and their bucket as rows of POSTINGS and their bucket, some bytes at a time."""
    for whole in batches:
        bounds = np.concatenate([[0], np.cumsum(pc.binary_length(whole.column("packed")).to_numpy())])
        cuts = np.unique([*np.searchsorted(bounds, np.arange(0, bounds[-1], UNPACK)), len(whole)]).tolist()
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            rows = whole.slice(begin, end - begin)
            data = np.frombuffer(b"".join(rows.column("packed").to_pylist()), np.uint8)
            docs, values = rows.column("n").to_numpy().astype(np.int64), _values(data)
            rest = np.add.accumulate(data < 128)[bounds[begin + 1 : end + 1] - bounds[begin] - 1]  # values up to each row's end
            base = np.concatenate([[0], rest[:-1]])
            own, n = np.repeat(base, docs) + _within(docs), np.repeat(docs, docs)
            step, lens, freqs = values[own], values[own + n].astype(np.int32), values[own + 2 * n].astype(np.int64)
            ids = _summed((step >> np.uint64(1)).view(np.int64) ^ -(step & np.uint64(1)).view(np.int64), docs)
            places = rest - base - 3 * docs
            flat = _summed(values[np.repeat(base + 3 * docs, places) + _within(places)].astype(np.int64), freqs)
            held = {"docs": _lists(docs, pa.array(ids, mask=ids == NO_ID)), "lens": _lists(docs, pa.array(lens)), "freqs": _lists(docs, pa.array(freqs.astype(np.int32))), "positions": _lists(docs, _lists(freqs, pa.array(flat.astype(np.int32))))}
            names = [*(c.split(" ")[0] for c in POSTINGS.split(", ")), "bucket"]
            yield pa.RecordBatch.from_arrays([held[c] if c in held else rows.column(c) for c in names], names)


def _counter(phrases: list[Phrase], slots: list[tuple[str, bool]]) -> Callable[[pa.Table], pa.Table]:
    """A function from a block's posting rows to (segment, id, len, f0, f1, ...) of its documents that have one of the phrases.

    A document's postings are all in its block, so what phrases need meets there: places are numbered by document and position, and a phrase
    begins where its words' places, each moved back by the word's place in it, meet.
    """
    number = {s: i for i, s in enumerate(slots)}
    told = [[number[s] for s in p.slots()] for p in phrases]

    def run(table: pa.Table) -> pa.Table:
        rows = table.combine_chunks()
        flat = {c: pc.list_flatten(rows.column(c)) for c in ("docs", "lens", "freqs")}
        docs = flat["docs"].fill_null(NO_ID).to_numpy()
        ids, first, at = np.unique(docs, return_index=True, return_inverse=True)
        freqs, sizes = flat["freqs"].to_numpy(), pc.list_value_length(rows.column("docs")).to_numpy()
        slotted = rows.column("slots").to_pylist()
        has = [np.repeat(np.array([k in own for own in slotted], bool), sizes) for k in range(len(slots))]
        counts = np.zeros((len(phrases), len(ids)), np.int64)
        if any(len(own) > 1 for own in told):
            inner = pc.list_flatten(rows.column("positions"))
            lengths = pc.list_value_length(inner).to_numpy()
            place = (np.repeat(at, lengths) << 32) + pc.list_flatten(inner).to_numpy().astype(np.int64) + (1 << 16)
            places = {k: np.unique(place[np.repeat(has[k], lengths)]) for own in told if len(own) > 1 for k in own}
        for i, own in enumerate(told):
            if len(own) == 1:
                counts[i] = np.bincount(at[has[own[0]]], weights=freqs[has[own[0]]], minlength=len(ids))
            elif own:
                met = places[own[0]]
                for j, k in enumerate(own[1:], 1):
                    met = np.intersect1d(met, places[k] - j, assume_unique=True)
                counts[i] = np.bincount(met >> 32, minlength=len(ids))
        found = np.flatnonzero(counts.any(0))
        segment = np.full(len(found), rows.column("segment")[0].as_py(), np.int32)
        held = [pa.array(segment), pa.array(ids[found], mask=ids[found] == NO_ID), pa.array(flat["lens"].to_numpy()[first[found]].astype(np.int32)), *(pa.array(c[found]) for c in counts)]
        return pa.table(held, names=["segment", "id", "len", *(f"f{i}" for i in range(len(phrases)))])

    return run


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.left(term, F.lit(PREFIX))), F.lit(BUCKETS)).cast("int")


class TextIndex:
    """An index in a folder; each method sees the newest version, and each change makes the next one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.versions = spark, Versions(spark, root)

    def state(self, number: int | None = None) -> dict:
        """The manifest of a version, the newest one if none is named."""
        return self.versions.read(number) or {"segments": [], "tombs": []}

    # --- changes

    def _segment(self, docs: DataFrame) -> dict:
        """Write a segment of docs (id, owner, text) and describe it."""
        path = self.versions.fresh("segment")
        kept = docs.select(F.col("id").cast("bigint").alias("id"), F.col("owner").cast("string").alias("owner"), F.coalesce("text", F.lit("")).alias("text"))
        told = kept.select("id", "owner", F.greatest(F.lit(1), F.size(T.tokens(F.col("text")))).alias("len"), "text")
        told.write.option("compression", "zstd").parquet(f"{path}/docs")
        stored = self.spark.read.schema("id bigint, owner string, len int, text string").parquet(f"{path}/docs")  # what docs joins isn't done again
        rows = stored.select("id", T.tokens(F.col("text")).alias("tokens")).mapInArrow(_inverted, SENT).withColumn("bucket", bucket(F.col("term")))
        dealt = rows.hint("rebalance", "bucket").mapInArrow(_unpacked, POSTINGS + ", bucket int")
        dealt.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").option("compression", "zstd").option("parquet.writer.version", "v2").option("parquet.block.size", 16 << 20).parquet(f"{path}/postings")
        whole = self.spark.read.parquet(f"{path}/docs").agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")).first()
        return {"path": path, "n": whole["n"], "total": whole["total"], "words": whole["n"] > 0 and self._has_files(f"{path}/postings")}

    def _has_files(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return any(s.isDirectory() for s in target.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(target))

    def _tombs(self, state: dict, wanted: DataFrame, key: str) -> list[dict]:
        """Write the live documents whose key (id or owner) is wanted as tombstones; nothing to hide: no table."""
        docs = self.docs(state)
        if docs is None:
            return []
        path = self.versions.fresh("tombs")
        docs.join(wanted.select(F.col(wanted.columns[0]).alias(key)).distinct(), key, "left_semi").select("segment", "id", "len").write.parquet(path)
        whole = self.spark.read.parquet(path).agg(F.count("*").alias("n"), F.sum("len").alias("total")).first()
        return [{"path": path, "n": whole["n"], "total": whole["total"]}] if whole["n"] else []

    def change(self, add: DataFrame | None = None, owners: DataFrame | None = None, ids: DataFrame | None = None) -> int:
        """One version further: documents of owners or of ids go, those of add (id, owner, text) come."""
        number = self.versions.latest()
        state = self.state(number)
        tombs = list(state["tombs"])
        for wanted, key in ((owners, "owner"), (ids, "id")):
            if wanted is not None:
                tombs += self._tombs(state | {"tombs": tombs}, wanted, key)
        segments = state["segments"] + ([self._segment(add)] if add is not None else [])
        return self.versions.commit({"segments": segments, "tombs": tombs}, number)

    def add(self, docs: DataFrame) -> int:
        """Append documents (id, owner, text) of new ids."""
        return self.change(add=docs)

    def replace(self, docs: DataFrame) -> int:
        """The documents of docs' owners are those of docs from now on."""
        return self.change(add=docs, owners=docs.select("owner"))

    def delete(self, owners: DataFrame) -> int:
        return self.change(owners=owners)

    def compact(self) -> int:
        """All live documents as one segment without tombstones; the texts are in the store."""
        number = self.versions.latest()
        docs = self.docs(self.state(number))
        made = [self._segment(docs)] if docs is not None else []
        return self.versions.commit({"segments": made, "tombs": []}, number)

    # --- reading

    def _dead(self, state: dict) -> DataFrame | None:
        tables = [self.spark.read.parquet(t["path"]).select("segment", "id") for t in state["tombs"]]
        if not tables:
            return None
        dead = reduce(DataFrame.unionByName, tables)
        return F.broadcast(dead) if sum(t["n"] for t in state["tombs"]) <= BROADCAST_ROWS else dead

    def _live(self, rows: DataFrame, state: dict) -> DataFrame:
        dead = self._dead(state)
        return rows if dead is None else rows.join(dead, ["segment", "id"], "left_anti")

    def docs(self, state: dict | None = None) -> DataFrame | None:
        """(segment, id, owner, len, text) of the live documents; None without a segment."""
        state = state or self.state()
        tables = [self.spark.read.parquet(f"{s['path']}/docs").withColumn("segment", F.lit(i)) for i, s in enumerate(state["segments"])]
        return self._live(reduce(DataFrame.unionByName, tables), state) if tables else None

    def statistics(self, state: dict | None = None) -> tuple[int, int]:
        """Live documents, and their lengths together."""
        state = state or self.state()
        return tuple(sum(s[c] for s in state["segments"]) - sum(t[c] for t in state["tombs"]) for c in ("n", "total"))

    def postings(self, slots: Iterable[tuple[str, bool]], state: dict | None = None) -> DataFrame:
        """(segment, slots, and the stored columns) of the rows whose term is one of the words, or begins with one that is marked."""
        state, slots = state or self.state(), list(slots)
        term = F.col("term")
        own = [term.startswith(w) if star else term == w for w, star in slots]
        words = sorted({w for w, star in slots if not star})
        wanted = term.isin(words) if words else F.lit(False)
        for w, star in slots:
            wanted = wanted | term.startswith(w) if star else wanted
        some = all(len(w) >= PREFIX or not star for w, star in slots)
        tables = []
        for i, s in enumerate(state["segments"]):
            if s["words"]:
                rows = self.spark.read.schema(POSTINGS + ", bucket int").parquet(f"{s['path']}/postings")
                rows = rows.filter(F.col("bucket").isin(sorted(self._buckets(w for w, _ in slots)))) if some else rows
                tables.append(rows.filter(wanted).withColumn("segment", F.lit(i)))
        rows = reduce(DataFrame.unionByName, tables) if tables else self.spark.createDataFrame([], POSTINGS + ", bucket int, segment int")
        return rows.withColumn("slots", F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in enumerate(own)))))

    def _buckets(self, words: Iterable[str]) -> set[int]:
        given = sorted({w[:PREFIX] for w in words})
        if not given:
            return set()
        hashed = self.spark.range(1).select(*(bucket(F.lit(w)).alias(f"b{i}") for i, w in enumerate(given))).first()  # a local projection
        return set(hashed)

    def hits(self, phrases: list[Phrase], state: dict | None = None, blocks: DataFrame | None = None) -> DataFrame:
        """(id, len, f0, f1, ...): how often each phrase occurs in the live documents that have one; of some blocks (segment, block) only."""
        state = state or self.state()
        slots = list(dict.fromkeys(s for p in phrases for s in p.slots()))
        if not slots:
            none = ", ".join(f"f{i} bigint" for i in range(len(phrases)))
            return self.spark.createDataFrame([], f"id bigint, len int, {none}")
        rows = self.postings(slots, state)
        if blocks is not None:
            rows = rows.join(F.broadcast(blocks), ["segment", "block"], "left_semi")  # FIRST_BLOCKS, or counted by the caller
        arrays = ["docs", "lens", "freqs", *(["positions"] if any(len(p.words) > 1 for p in phrases) else [])]
        counted = rows.select("segment", "block", "slots", *arrays).groupBy("segment", "block").applyInArrow(_counter(phrases, slots), "segment int, id bigint, len int, " + ", ".join(f"f{i} bigint" for i in range(len(phrases))))
        return self._live(counted, state).drop("segment")

    def _idf(self, d: Column, n: int) -> Column:
        idf = F.log((F.lit(n) - d + 0.5) / (d + 0.5))
        return F.when(idf <= 0, FLOOR).otherwise(idf)

    def _part(self, idf: Column, f: Column, size: Column, mean: float) -> Column:
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean))

    def scored(self, phrases: list[Phrase], state: dict | None = None) -> DataFrame:
        """hits() with s0, s1, ...: each phrase's part of a BM25 score, the greater the better."""
        state = state or self.state()
        n, total = self.statistics(state)
        found, many = self.hits(phrases, state), range(len(phrases))
        df = found.agg(*(F.count_if(F.col(f"f{i}") > 0).alias(f"_d{i}") for i in many))
        parts = [self._part(self._idf(F.col(f"_d{i}"), n), F.col(f"f{i}"), F.col("len"), total / max(n, 1)).alias(f"s{i}") for i in many]
        return found.crossJoin(F.broadcast(df)).select("id", "len", *(f"f{i}" for i in many), *parts)  # df is one row

    def top(self, words: list[str], k: int) -> DataFrame:
        """(id, score): the k best documents for words by BM25, ties by id; blocks whose bound can't reach the k-th score are not read.

        First the frequencies, the bounds of the blocks and the FIRST_BLOCKS of the greatest bounds; then those that can still matter.
        """
        state = self.state()
        n, total = self.statistics(state)
        mean, phrases = total / max(n, 1), [Phrase((w,)) for w in dict.fromkeys(words)]
        slots = [p.slots()[0] for p in phrases]
        heads = self.postings(slots, state)
        if state["tombs"]:
            live = self._live(heads.select("segment", "slots", F.explode("docs").alias("id")), state)
            counted = live.groupBy(F.col("slots")[0].alias("slot")).count()
        else:
            counted = heads.groupBy(F.col("slots")[0].alias("slot")).agg(F.sum("n").alias("count"))
        df = {r["slot"]: r["count"] for r in counted.collect()}  # a row a word
        weight = [self._idf(F.lit(df.get(i, 0)), n) for i in range(len(phrases))]
        idf = F.element_at(F.array(*weight), F.col("slots")[0] + 1)
        bound = heads.select("segment", "block", self._part(idf, F.col("max_freq"), F.col("min_len"), mean).alias("b")).groupBy("segment", "block").agg(F.sum("b").alias("bound"))
        def score(rows: DataFrame) -> DataFrame:
            parts = [self._part(w, F.col(f"f{i}"), F.col("len"), mean) for i, w in enumerate(weight)]
            return rows.select("id", reduce(lambda a, b: a + b, parts).alias("score"))

        seen = bound.orderBy(F.desc("bound"), "segment", "block").limit(FIRST_BLOCKS).collect()
        if not seen:
            return self.spark.createDataFrame([], "id bigint, score double")
        looked = self.spark.createDataFrame([(r["segment"], r["block"]) for r in seen], "segment int, block bigint")
        best = score(self.hits(phrases, state, looked)).orderBy(F.desc("score"), "id").limit(k)
        floor = best.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        least = floor["least"] if floor["n"] == k else 0.0
        if len(seen) < FIRST_BLOCKS or seen[-1]["bound"] < least:
            return best
        rest = bound.filter(F.col("bound") >= least * (1 - 1e-12)).join(F.broadcast(looked), ["segment", "block"], "left_anti").select("segment", "block")
        more = rest.count()
        if not more:
            return best
        others = score(self.hits(phrases, state, rest if more <= BROADCAST_ROWS else None))
        others = others if more <= BROADCAST_ROWS else others.join(best.select("id"), "id", "left_anti")
        return best.unionByName(others).orderBy(F.desc("score"), "id").limit(k)


_built: dict[tuple[str, str, str], TextIndex] = {}


def built(spark: SparkSession, sf_dir: str, name: str, docs) -> TextIndex:
    """The index of a data folder's documents, made at first use in this application; docs() gives (id, owner, text)."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built:
        index = TextIndex(spark, fresh_path(spark, f"index-{name}"))
        index.add(docs())
        _built[key] = index
    return _built[key]


