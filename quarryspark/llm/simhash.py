"""SimHash near-duplicate groups.

A text's fingerprint has a bit where more than half of its word shingles' hashes have it. Fingerprints that differ in at
most a given number of bits are linked. Pigeonhole blocks find them: with d differing bits allowed and d + 3 blocks, close
fingerprints agree on three blocks at least, so they meet under one of the keys made of three blocks. Members of a key
differ in the key's free bits alone. They are not paired with each other: each goes to the centres that lie within half
the allowed distance in those bits, close ones share a centre, and a centre links its members to the least of them after
a check of their Hamming distance. A group of copies thus gives links in proportion to its size.

similar_groups() serves a similarity of word shingle sets instead (0.8, say), where 64 bits differ in too many places to share
a block. There a text's shingles are dealt by hash into classes of 3 to 6, each class has a 64-bit fingerprint of its own, and
these are the blocks of a long fingerprint: texts that differ in few places have several classes without a difference. Only texts that
share a block with another, and short ones, which have few classes, go on. Of these a second join decides who meets whom without losing a pair: with a
text's shingles in the order of rarity, two texts of the similarity share one of the first n - ceil(similarity * n) + 1 (the prefix filter), and shingles
that one text alone has make no key. A passage that unlike texts share is not rare, so it makes no key of theirs. Members of a key of up to SMALL texts
are paired; the Hamming distance of fixed-length fingerprints of 16 classes sorts out pairs that are far off, its limit lying SIGMAS standard
deviations above what the similarity gives, and the exact Jaccard similarity of the shingle sets decides. Texts of larger keys are families: connected
by these keys, cut into blocks, and compared block by block as matrix products of shingle sets, exactly; a pair of blocks leaves a spanning star of its links alone, so no
pair of a large family is ever a row. There are no rounds: the number of jobs doesn't grow with a key's size.

Null and empty texts have fingerprint zero and are linked like any other. Repeated rows get the same component. A very long
text is hashed in a batch of its own; its shingle set is a row as long as the text. Other columns are neither read nor kept by
groups(); without_near_duplicates() keeps them, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cells import least_roots
from .common import join_spread, shield, text_batches, written
from .graph import components

LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
BITS = 64
#: Blocks that a key is made of.
KEY_BLOCKS = 3
#: Shingles of a class at least (twice as many at most), and the classes of a text whose fingerprints are keys.
CLASS_SHINGLES, CLASS_KEYS = 3, 32
#: Classes, as a power of two, of the fingerprints whose distance is taken.
WIDE_LEVEL = 4
#: Standard deviations by which the distance of a pair may exceed what is expected at the similarity.
SIGMAS = 6
#: Members of a key that are paired at most; those of larger keys are families.
SMALL = 12
#: Shingles up to which a text is short.
SHORT = 64
#: Texts of a block of a family, and the shingles of its texts together (one text may have more).
FAMILY_TEXTS, FAMILY_SHINGLES = 512, 400_000
#: Shingles that a matrix product takes at once.
PRODUCT_SHINGLES = 8192
#: Rows that are broadcast at most.
BROADCAST_ROWS = 50_000
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str, size: int, seed: int = 42) -> list[int]:
    """XXH64 of every run of size words, repeats included; of the whole sequence if it is shorter."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()  # bytes split at 0x20 and 0x09-0x0D
    if not words:
        return []
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= size:
        return [digest(joined, seed)]
    begin = [0]
    for w in words:
        begin.append(begin[-1] + len(w) + 1)
    return [digest(joined[a : b - 1], seed) for a, b in zip(begin, begin[size:], strict=False)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of counts[i] hashes (uint64): the bits that over half of the run have."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = (np.cumsum(counts) - counts)[full]
        most = np.add.reduceat(bits, first, axis=0, dtype=np.int32) * 2 > counts[full, None]
        out[full] = np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp): the 64-bit fingerprint of each whole text, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, text_col):
            hashes = [shingle_hashes(t, shingle) for t in texts]
            counts = np.array([len(x) for x in hashes], np.int64)
            flat = np.fromiter((h for x in hashes for h in x), np.uint64, int(counts.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(majority(flat, counts).view(np.int64))], [id_col, "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp that connect all pairs of at most distance (2) differing bits."""
    if distance != 2:
        raise ValueError("centres one bit away serve a distance of 2 alone")
    n = distance + KEY_BLOCKS
    edge = [round(i * BITS / n) for i in range(n + 1)]
    block = [sum(1 << b for b in range(edge[i], edge[i + 1])) for i in range(n)]
    masks = [sum(block[i] for i in c) for c in combinations(range(n), KEY_BLOCKS)]
    free = [[1 << b for b in range(BITS) if not m >> b & 1] for m in masks]
    keyed = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks))).alias("combo", "key"))
    shared = keyed.groupBy("combo", "key").agg(F.count("*").alias("n")).filter("n > 1").select("combo", "key")
    members = keyed.join(shared, ["combo", "key"])
    flips = F.array(*(F.array(*(F.lit(_signed(x)) for x in [0, *bits])) for bits in free))
    centres = members.select("fp", F.explode(F.element_at(flips, F.col("combo") + 1)).alias("flip"))
    balls = centres.select(F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"), "fp").groupBy("centre").agg(F.collect_set("fp").alias("fps"))  # 65 at most
    pairs = balls.filter(F.size("fps") > 1).select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).distinct()


def groups(docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp, component_id): component_id is the smallest id whose fingerprint can be reached over links."""
    marked, _ = written(fingerprints(docs, shingle, id_col, text_col), "simhash")
    fps, _ = written(marked.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")), "simhash-distinct")
    linked = components(links(fps, distance)).withColumnRenamed("node", "fp")
    rooted, _ = written(fps.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "n"), "simhash-rooted")
    named, _ = written(_named(rooted, "fp"), "simhash-components")
    return join_spread(marked, named, "fp", marked.count()).select(id_col, "fp", "component_id")


def _named(rooted: DataFrame, node: str) -> DataFrame:
    """(node, component_id, n) of rows (node, root, least, n): component_id is the smallest least under the root."""
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("_members"))
    return join_spread(rooted.select(node, "root", "n"), ids, "root", rooted.count(), "_members").select(node, "component_id", "n")


def long_fingerprint(hashes: list[int] | np.ndarray) -> tuple[int, list[int], list[tuple[int, int]]]:
    """(hash of the shingle set, fingerprints of 2**WIDE_LEVEL classes, (class number, fingerprint) keys) of a text."""
    own = np.unique(np.array(hashes, np.uint64))
    n = len(own)
    whole = xxhash.xxh64_intdigest(own.astype("<u8").tobytes(), 42)
    if not n:
        return whole, [0] * (1 << WIDE_LEVEL), [(0, 0)]
    mixed = own * SPREAD
    order = np.argsort(mixed)
    own, mixed = own[order], mixed[order]  # the classes of every level are now runs
    bits = np.unpackbits(own.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.zeros((n + 1, BITS), np.int32)
    np.cumsum(bits, axis=0, out=total[1:])

    def of(level: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
        edges = np.searchsorted(mixed >> np.uint64(64 - level), np.arange(classes + 1, dtype=np.uint64)) if level else np.array([0, n])
        size = np.diff(edges)
        most = (total[edges[1:]] - total[edges[:-1]]) * 2 > size[:, None]
        return np.packbits(most, axis=1, bitorder="little").view("<u8").ravel(), size

    wide, _ = of(WIDE_LEVEL, 1 << WIDE_LEVEL)
    level = max(0, int(math.log2(n / CLASS_SHINGLES))) if n >= CLASS_SHINGLES else 0
    levels, full = {level}, n / (CLASS_SHINGLES << level)
    if full > 1.75:
        levels.add(level + 1)  # a similar text of a little more shingles has that level
    if full < 1.125 and level:
        levels.add(level - 1)
    keys = []
    for x in sorted(levels):
        fp, size = of(x, min(1 << x, CLASS_KEYS))
        keys += [(x * CLASS_KEYS + i, f) for i, (f, k) in enumerate(zip(fp.tolist(), size.tolist(), strict=True)) if k]
    return whole, wide.tolist(), keys


def differing_share(similarity: float) -> float:
    """The share of differing fingerprint bits that sets of a Jaccard similarity and of equal size give."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def distance_limit(similarity: float, n: int = BITS << WIDE_LEVEL) -> float:
    """Differing bits of n that a pair of the similarity hardly ever exceeds."""
    p = differing_share(similarity)
    return n * p + SIGMAS * math.sqrt(n * p * (1 - p))


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (whole, lead) whose shingle sets (whole, shingles) have the Jaccard similarity."""
    own, other = sets.select("whole", F.col("shingles").alias("own")), sets.select(F.col("whole").alias("lead"), F.col("shingles").alias("other"))
    common = F.size(F.array_intersect("own", "other"))
    either = F.size("own") + F.size("other") - common
    return pairs.join(own, "whole").join(other, "lead").filter(common >= similarity * either - 1e-9 * either).select("whole", "lead")


def _some(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among the wanted ones; these are broadcast up to a checked number, else a shuffle joins them."""
    return rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, key, "left_semi")


def _sharing(texts: DataFrame) -> DataFrame:
    """(whole): the texts (whole, keys) that share a key with another."""
    keyed, _ = written(texts.select("whole", F.explode("keys").alias("key")).select("whole", F.xxhash64("key.number", "key.fp").alias("key")), "similar-keys")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("_met", F.lit(1))
    return join_spread(keyed, shared, "key", keyed.count()).select("whole").distinct()


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(fp, whole, n): the rarest shingles of each set (whole, shingles) that another set has, too; sets of the similarity share one at least."""
    each = sets.select("whole", F.size("shingles").alias("size"), F.explode("shingles").alias("fp"))
    counted = each.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").withColumn("texts", F.col("n"))
    total = sets.agg(F.sum(F.size("shingles"))).first()[0] or 0
    common = join_spread(each, counted, "fp", total)
    least = F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1  # the length of the prefix; shingles of this text alone come first in it
    ranked = common.groupBy("whole", "size").agg(F.count("*").alias("common"), F.array_sort(F.collect_list(F.struct("texts", "fp"))).alias("all"))
    first = F.slice("all", F.lit(1), F.greatest(F.lit(0), (least - (F.col("size") - F.col("common"))).cast("int")))
    return ranked.select(F.explode(F.transform(first, lambda x: x["fp"])).alias("fp"), "whole", F.col("size").alias("n"))


def _found(texts: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """Links (whole, lead) that connect the texts (whole, n, wide, keys) of the similarity. sets_of gives the sets (whole, shingles) of some texts (whole)."""
    long = texts.filter(F.col("n") > SHORT)
    few = texts.filter(F.col("n") <= SHORT / similarity).select("whole")  # short ones, and those that can be like a short one
    due, _ = written(_sharing(long).union(few).distinct(), "similar-due")
    sets, _ = written(sets_of(due), "similar-sets")
    keys, _ = written(_prefixes(sets, similarity), "similar-prefixes")
    sizes, _ = written(keys.groupBy("fp").agg(F.count("*").alias("n"), F.min("whole").alias("least")).filter("n > 1"), "similar-sizes")
    some = keys.join(sizes.filter(F.col("n") <= SMALL).select("fp"), "fp").groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("whole", "n"))).alias("all"))  # SMALL at most
    paired = some.select("all", F.posexplode("all").alias("k", "one")).select("one", F.explode(F.slice("all", F.lit(1), F.col("k"))).alias("other"))
    sized = F.least("one.n", "other.n") >= F.greatest("one.n", "other.n") * (similarity - 1e-9)
    pairs, _ = written(paired.filter(sized).select(F.col("one.whole").alias("whole"), F.col("other.whole").alias("lead")).distinct(), "similar-pairs")
    wide = texts.select("whole", "wide")
    apart = F.aggregate(F.zip_with("wide", "other", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    near = pairs.join(wide, "whole").join(wide.select(F.col("whole").alias("lead"), F.col("wide").alias("other")), "lead").filter(apart <= distance_limit(similarity))
    known, _ = written(_alike(near.select("whole", "lead"), sets, similarity), "similar-links")
    large = sizes.filter(F.col("n") > SMALL)
    total = keys.count()
    family = components(join_spread(keys.select("fp", "whole"), large, "fp", total).select(F.col("whole").alias("a"), F.col("least").alias("b")))
    return known.union(_within(sets.join(family.withColumnRenamed("node", "whole"), "whole"), similarity))


def _within(members: DataFrame, similarity: float) -> DataFrame:
    """Links (whole, lead) that connect the like texts of each family, from members (whole, shingles, root)."""
    members, _ = written(members, "similar-members")
    count = members.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.size("shingles")).alias("shingles"))
    parts = F.greatest(F.ceil(F.col("n") / FAMILY_TEXTS), F.ceil(F.col("shingles") / FAMILY_SHINGLES)).cast("int")
    each = join_spread(members, count.filter("n > 1").select("root", "n", parts.alias("parts")), "root", members.count())
    placed = each.select("root", "parts", F.pmod(F.xxhash64("whole"), F.col("parts")).cast("int").alias("part"), "whole", "shingles")

    def pack(table: pa.Table) -> pa.Table:
        one = {c: table.column(c)[:1].combine_chunks() for c in ("root", "parts", "part")}
        lists = table.column("shingles").combine_chunks()
        return pa.table(one | {"texts": pa.array([table.column("whole").to_pylist()], pa.list_(pa.int64())), "sizes": pa.array([np.diff(lists.offsets.to_numpy())], pa.list_(pa.int32())), "all": pa.array([lists.flatten().to_numpy().tobytes()], pa.binary())})

    blocks, _ = written(placed.groupBy("root", "part").applyInArrow(pack, "root bigint, parts int, part int, texts array<bigint>, sizes array<int>, all binary"), "similar-blocks")
    ahead = blocks.withColumn("other", F.explode(F.sequence("part", F.col("parts") - 1)))
    met = ahead.join(blocks.select("root", F.col("part").alias("other"), F.col("texts").alias("r_texts"), F.col("sizes").alias("r_sizes"), F.col("all").alias("r_all")), ["root", "other"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                sides = [(np.array(one[p + "texts"], np.int64), np.array(one[p + "sizes"], np.int64), np.frombuffer(one[p + "all"], np.int64)) for p in ("", "r_")]
                linked = like(sides[0][1:], sides[1][1:], similarity)
                if one["part"] == one["other"]:
                    np.fill_diagonal(linked, False)
                left, right = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
                a, b = sides[0][0][left], sides[1][0][right]
                low, high = least_roots(linked[np.ix_(left, right)], a, b)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, b])), pa.array(np.concatenate([low, high]))], ["whole", "lead"])

    stars = met.select("part", "other", "texts", "sizes", "all", "r_texts", "r_sizes", "r_all").mapInArrow(compare, "whole bigint, lead bigint")
    return written(stars.filter("whole <> lead").distinct(), "similar-stars")[0]


def like(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """Which sets of left and right (their sizes, their members one after the other) have the Jaccard similarity."""
    (n, x), (m, y) = left, right
    both, inverse, counts = np.unique(np.concatenate([x, y]), return_inverse=True, return_counts=True)
    kept = counts > 1  # others are in one set alone
    column = (np.cumsum(kept) - 1)[inverse]
    inside = kept[inverse]
    common = np.zeros((len(n), len(m)), np.float32)
    rows, columns = np.repeat(np.arange(len(n)), n)[inside[: len(x)]], column[: len(x)][inside[: len(x)]]
    others, theirs = np.repeat(np.arange(len(m)), m)[inside[len(x) :]], column[len(x) :][inside[len(x) :]]
    for begin in range(0, int(kept.sum()), PRODUCT_SHINGLES):
        width = min(PRODUCT_SHINGLES, int(kept.sum()) - begin)
        a, b = np.zeros((len(n), width), np.float32), np.zeros((len(m), width), np.float32)
        for into, r, c in ((a, rows, columns), (b, others, theirs)):
            now = (c >= begin) & (c < begin + width)
            into[r[now], c[now] - begin] = 1
        common += a @ b.T
    either = n[:, None] + m - common.astype(np.float64)
    return common >= similarity * either - 1e-9 * either


def _similar(docs: DataFrame, shingle: int, similarity: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id_col, _tie, whole), _tie being a hash of the text, and (whole, root, least, n) of the distinct shingle sets.

    least has the smallest id of a set's rows, a row without one coming last, and the smallest hash of these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, text_col):
            sets = [np.unique(np.array(shingle_hashes(t, shingle), np.uint64)) for t in texts]
            rows = [long_fingerprint(x) for x in sets]
            whole, wide = (pa.array(np.array([r[k] for r in rows], np.uint64).ravel().view(np.int64)) for k in (0, 1))
            ends = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])]).astype(np.int32)
            keys = pa.StructArray.from_arrays([pa.array(np.array([k for r in rows for k, _ in r[2]], np.int32)), pa.array(np.array([f for r in rows for _, f in r[2]], np.uint64).view(np.int64))], ["number", "fp"])
            wides = pa.ListArray.from_arrays(pa.array((np.arange(len(rows) + 1) << WIDE_LEVEL).astype(np.int32)), wide)
            few = pa.array([x.view(np.int64) if 0 < len(x) <= SHORT else None for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("_tie"), whole, wides, pa.ListArray.from_arrays(pa.array(ends), keys), few, pa.array([len(x) for x in sets], pa.int32())], [id_col, "_tie", "whole", "wide", "keys", "shingles", "n"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, text_col):
            sets = [np.unique(np.array(shingle_hashes(t, shingle), np.uint64)) for t in texts]
            shingles = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("whole"), shingles], ["whole", "shingles"])

    kind = dict(docs.dtypes)[id_col]
    tied = docs.select(id_col, F.xxhash64(text_col).alias("_tie"), text_col)
    marked, _ = written(tied.mapInArrow(run, f"{id_col} {kind}, _tie bigint, whole bigint, wide array<bigint>, keys array<struct<number int, fp bigint>>, shingles array<bigint>, n int"), "similar")
    least = F.min(F.struct(F.col(id_col).isNull().alias("_none"), F.col(id_col), F.col("_tie"))).alias("least")
    texts, _ = written(marked.groupBy("whole").agg(least, F.count("*").alias("rows"), F.any_value("n").alias("n"), F.any_value("wide").alias("wide"), F.any_value("keys").alias("keys")), "similar-texts")
    short, _ = written(marked.filter("shingles IS NOT NULL").select("whole", "shingles").dropDuplicates(["whole"]), "similar-short")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """The shingle sets of some texts, from one row of each: most texts have no near candidate, so their sets are never stored."""
        one, _ = written(_some(texts, wanted, "whole").select("whole", F.col("least")[id_col].alias("_id"), F.col("least._tie").alias("_own")), "similar-rows")
        met = tied.join(F.broadcast(one) if one.count() <= BROADCAST_ROWS else one, tied[id_col].eqNullSafe(one["_id"]) & (tied["_tie"] == one["_own"]))
        return met.select("whole", text_col).mapInArrow(again, "whole bigint, shingles array<bigint>").dropDuplicates(["whole"])

    def sets(wanted: DataFrame) -> DataFrame:
        long = wanted.join(short.select("whole"), "whole", "left_anti")
        return short.unionByName(sets_of(long))

    links_found = _found(texts.select("whole", "n", "wide", "keys"), sets, similarity)
    linked = components(links_found.select(F.col("whole").alias("a"), F.col("lead").alias("b"))).withColumnRenamed("node", "whole")
    rooted = texts.select("whole", "least", F.col("rows").alias("n")).join(linked, "whole", "left").select("whole", F.coalesce("root", "whole").alias("root"), "least", "n")
    return marked.select(id_col, "_tie", "whole"), written(rooted, "similar-rooted")[0]


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, component_id), a row for each document, by links between texts whose shingle sets are that similar."""
    marked, rooted = _similar(docs, shingle, similarity, id_col, text_col)
    named, _ = written(_named(rooted.withColumn("least", F.col("least")[id_col]), "whole"), "similar-components")
    return join_spread(marked.select(id_col, "whole"), named, "whole", marked.count()).select(id_col, "component_id")


def without_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of similar texts: that of the smallest id, a row without id only if the group has no other.

    Rows under one id with unlike texts are of different groups, so each stays. Of rows that repeat id and text, one stays. docs'
    columns come back as they were, whatever their names.
    """
    held, restore = shield(docs, id_col, text_col)
    _, rooted = _similar(held, shingle, similarity, id_col, text_col)
    kept, _ = written(rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least")[id_col].alias("_id"), F.col("least._tie").alias("_kept")), "similar-kept")
    plain = [c for c, t in held.dtypes if "map<" not in t and "variant" not in t]
    own = held.withColumn("_tie", F.xxhash64(text_col))
    first = F.row_number().over(Window.partitionBy(id_col, "_tie").orderBy(F.xxhash64(*plain)))  # repeats end before the shuffle
    one = own.withColumn("_row", first).filter("_row = 1").drop("_row")
    return restore(one.join(kept, (one[id_col].eqNullSafe(kept["_id"])) & (one["_tie"] == kept["_kept"]), "left_semi"))
