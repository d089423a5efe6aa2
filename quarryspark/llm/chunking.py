"""Document fingerprints from content-defined chunks.

A gear hash rolls over the UTF-8 bytes of a text; a chunk ends where bits of it are zero. Before a chunk's normal size more
bits must be zero than beyond it, so that sizes gather around that size, and there are a least and a greatest size. Only the
bytes near a boundary decide on it, so that an insertion moves no later boundary for long. A fingerprint is the set of
(chunk digest, chunk length); the likeness of two is containment: the length of the chunks that both have over the length of
the first one's.

Null texts count as empty. An empty text has an empty fingerprint: likeness 1 to an empty one, 0 to any other, and any
other's likeness to it is 0. Equal texts have equal fingerprints. Of rows with one id the order is that of a hash of the text,
and repeated rows are each a row of the result. A very long text is cut whole, in a step of its own. Columns but id and text are neither
read nor kept, so further ones may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_CHARS, shuffle_parts, text_batches, written

LEAST, NORMAL, MOST = 16, 32, 128
#: Bytes that a gear hash sees; not over LEAST, so that no text's boundaries depend on what lies before it.
WINDOW_DOUBLINGS = 4
LOOSE, STRICT = np.uint32(0b1111 << 28), np.uint32(0b111111 << 26)
GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 32, 256, np.uint32)
MIX = np.random.Generator(np.random.PCG64(20240301)).integers(0, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
ODD = np.uint64(0xD1342543DE82EF95)
INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
RECORD = 6
#: Packed texts that are opened at a time.
UNPACK_ROWS = 500


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte: the sum of the table's values, each shifted left by its distance."""
    h = GEAR[data]
    for k in range(WINDOW_DOUBLINGS):
        step = 1 << k
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def boundaries(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Begins of all chunks of texts that lie at starts..ends of data, in order."""
    h = gear_hashes(data)
    never = np.array([len(data) + MOST])
    loose = np.concatenate([np.flatnonzero((h & LOOSE) == 0) + 1, never])  # a chunk ends behind the byte
    strict = np.concatenate([np.flatnonzero((h & STRICT) == 0) + 1, never])
    at, until = starts[ends > starts].astype(np.int64), ends[ends > starts].astype(np.int64)
    out = [at]
    while len(at):
        first = strict[np.searchsorted(strict, at + LEAST)]
        then = loose[np.searchsorted(loose, at + NORMAL)]
        at = np.where(first < at + NORMAL, first, np.minimum(then, at + MOST))
        more = at < until
        at, until = at[more], until[more]
        out.append(at)
    return np.sort(np.concatenate(out))


_powers = np.ones((2, 1), np.uint64)


def _power(n: int) -> np.ndarray:
    """Powers of ODD and of its inverse; a worker keeps those that an ordinary step needs."""
    global _powers
    if _powers.shape[1] >= n:
        return _powers
    made = np.stack([np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x)]), dtype=np.uint64) for x in (ODD, INVERSE)])
    if n <= 2 * STEP_CHARS:
        _powers = made
    return made


def chunk_sets(texts: list[bytes]) -> list[dict[int, int]]:
    """{digest: length} of each text's chunks; a digest has 40 bits."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return [{} for _ in texts]
    ends = np.cumsum(sizes)
    begin = boundaries(data, ends - sizes, ends)
    power = _power(len(data))
    digest = np.add.reduceat(MIX[data] * power[0, : len(data)], begin) * power[1, begin]
    length = np.diff(np.append(begin, len(data)))
    digest = (digest ^ digest >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + length.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    digest = (digest ^ digest >> np.uint64(29)) * np.uint64(0x94D049BB133111EB) >> np.uint64(24)
    cut = np.searchsorted(begin, ends).tolist()
    digests, lengths = digest.tolist(), length.tolist()
    return [dict(zip(digests[a:b], lengths[a:b], strict=True)) for a, b in zip([0, *cut[:-1]], cut, strict=True)]


def encode(chunks: dict[int, int]) -> str:
    """A fingerprint as text: base64 of sorted records of a 40-bit digest and an 8-bit length."""
    return base64.b64encode(b"".join((d << 8 | n).to_bytes(RECORD, "big") for d, n in sorted(chunks.items()))).decode()


def decode(fingerprint: str) -> dict[int, int]:
    """The chunk set of a fingerprint."""
    raw = base64.b64decode(fingerprint)
    return {int.from_bytes(raw[i : i + 5], "big"): raw[i + 5] for i in range(0, len(raw), RECORD)}


def containment(own: dict[int, int], other: dict[int, int]) -> float:
    """The part of own's length that other has, too."""
    if not own:
        return float(not other)
    return sum(own[d] for d in own.keys() & other.keys()) / sum(own.values())


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, fingerprint) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, text_col):
            sets = chunk_sets([t.encode("utf-8", "surrogatepass") for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(x) for x in sets], pa.string())], [id_col, "n_chars", "fingerprint"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_chars bigint, fingerprint string")


VALUES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compare(texts: list[str], after: list[str]) -> list[list]:
    """VALUES of each text with the one after it."""
    edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(texts, after, strict=True)]
    raw = [t.encode("utf-8", "surrogatepass") for t in edited]
    known = dict.fromkeys([*texts, *after])
    for t, x in zip(known, chunk_sets([t.encode("utf-8", "surrogatepass") for t in known]), strict=True):
        known[t] = x
    changed = chunk_sets(raw)
    own, following = [known[t] for t in texts], [known[t] for t in after]
    return [
        [len(t) for t in texts],
        [hashlib.sha256(r).hexdigest() for r in raw],
        [encode(x) for x in own],
        [encode(x) for x in changed],
        [containment(a, b) for a, b in zip(own, changed, strict=True)],
        [containment(a, b) for a, b in zip(own, following, strict=True)],
    ]


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each text and its edited text, whose last third is replaced by the next document's beginning.

    The next document is the one with the next smaller id; after the last comes the first. Packed texts are dealt over ranges
    of ids once; a range works on its own neighbours, and the few pairs that lie across two ranges are joined afterwards.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    types = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    arrow = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    within, first, last = 0, 1, 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress

        def opened() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, UNPACK_ROWS):
                    some = batch.slice(at, UNPACK_ROWS)
                    yield pa.RecordBatch.from_arrays([some.column(id_col), pa.array([unpack(z).decode("utf-8", "surrogatepass") for z in some.column("_packed").to_pylist()], pa.string())], [id_col, "text"])

        part, held_id, held, begun = TaskContext.get().partitionId(), None, "", False
        names, id_type = [id_col, *VALUES, "_place", "_part", "_text"], None

        def edge(i: pa.Array, place: int, text: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([i, *(pa.nulls(1, t) for t in arrow), pa.array([place], pa.int32()), pa.array([part], pa.int32()), pa.array([text], pa.string())], names)

        for batch, texts in text_batches(opened()):
            ids = batch.column(id_col)
            id_type = ids.type
            if not begun:
                yield edge(ids.slice(0, 1), first, texts[0])
                begun = True
            else:
                ids, texts = pa.concat_arrays([held_id, ids]), [held, *texts]
            n = len(texts) - 1
            if n:
                yield pa.RecordBatch.from_arrays([ids.slice(0, n), *(pa.array(v, t) for v, t in zip(_compare(texts[:-1], texts[1:]), arrow, strict=True)), pa.array([within] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string())], names)
            held_id, held = ids.slice(n, 1), texts[-1]
        if begun:
            yield edge(held_id.cast(id_type), last, held)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, after = (batch.column(c).to_pylist() for c in ("_text", "_after"))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *(pa.array(v, t) for v, t in zip(_compare(texts, after), arrow, strict=True))], [id_col, *VALUES])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch, texts in text_batches(batches, text_col):
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("_tie"), batch.column("_spread"), pa.array([squeeze(t.encode("utf-8", "surrogatepass")) for t in texts], pa.binary())], [id_col, "_tie", "_spread", "_packed"])

    order = [F.col(id_col).desc(), F.col("_tie"), F.col("_spread")]  # the last one deals repeated rows over ranges
    packed = docs.select(id_col, F.xxhash64(text_col).alias("_tie"), F.monotonically_increasing_id().alias("_spread"), text_col).mapInArrow(pack, f"{id_col} {kind}, _tie bigint, _spread bigint, _packed binary")
    dealt = packed.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order)
    held, _ = written(dealt.mapInArrow(run, f"{id_col} {kind}, {types}, _place int, _part int, _text string"), "edits")
    parts = sorted(r["_part"] for r in held.filter(F.col("_place") == first).select("_part").collect())  # one row a range
    follows = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "_part int, _next int")
    lasts = held.filter(F.col("_place") == last).select(id_col, "_part", "_text").join(F.broadcast(follows), "_part")
    firsts = held.filter(F.col("_place") == first).select(F.col("_part").alias("_next"), F.col("_text").alias("_after"))
    across = lasts.join(firsts, "_next").select(id_col, "_text", "_after").mapInArrow(finish, f"{id_col} {kind}, {types}")
    return held.filter(F.col("_place") == within).select(id_col, *VALUES).unionByName(across)
