"""Training-order token files.

Documents' ids, each followed by an end id, are one stream in each partition of the input; the stream is cut into sequences of a
fixed stride, and its last one is padded. Sequences are numbered densely, and a keyed Feistel permutation, walked along its cycle
until it falls into the range, gives each a global slot. Ranges of slots are shards, and each shard is one file of fixed-stride records
in slot order: 8 bytes of the slot, the ids as little-endian uint16 (uint32 for larger vocabularies), and one line feed. Training reads
them one after the other and resumes at any slot by arithmetic alone (Layout.locate).

Texts are encoded once. The encoded packs are written to the shared folder with their partition, and their place in it, before
anything is numbered, so an executor that is lost or added later changes no number: what follows reads these rows, not the input.

Null and empty texts are an end id alone. Repeated rows are documents of their own, null ids stay null, and ties don't matter, as
the order is that of the written rows. A very long text is a batch of its own. Of the input only id and text are read, so other
columns do no harm. An empty table gives no sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .bpe import codec
from .common import drop_path, fresh_path, shuffle_parts, text_batches, written

ROUNDS = 6
#: Sequences of a pack, and bytes of a shard that more shards are made for.
PACK_ROWS, SHARD_BYTES = 128, 256 << 20
HEAD, TAIL = 8, 1


class Feistel:
    """A keyed permutation of 0..n-1."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = np.random.Generator(np.random.PCG64(key)).integers(0, 1 << 63, ROUNDS, np.int64).astype(np.uint64)

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ x >> np.uint64(32)) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ self._mix(left, key), left
            else:
                left, right = right, left ^ self._mix(right, key)
        return left << self.half | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = self._once(np.asarray(x, np.uint64), back)
        while len(out := np.flatnonzero(x >= np.uint64(self.n))):
            x[out] = self._once(x[out], back)
        return x.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, False)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, True)


class Layout:
    """What is needed to find a slot: total sequences, shards, stride and bytes of an id."""

    def __init__(self, total: int, shards: int, stride: int, unit: int):
        self.total, self.shards, self.stride, self.unit = total, shards, stride, unit
        self.record = HEAD + stride * unit + TAIL

    def shard(self, slots: np.ndarray) -> np.ndarray:
        return slots // self.per_shard

    @property
    def per_shard(self) -> int:
        return max(1, -(-self.total // self.shards))

    def locate(self, slot: int) -> tuple[int, int]:
        """Shard and byte offset of a slot's record."""
        return slot // self.per_shard, slot % self.per_shard * self.record


class _Stream:
    """Cuts the ids of documents that follow each other into sequences; what is left waits for the next ones."""

    def __init__(self, stride: int, end_id: int, unit: np.dtype):
        self.stride, self.end_id, self.unit = stride, end_id, unit
        self.ids, self.rest = np.zeros(0, unit), []  # rest: (id, place in its document, length)

    def feed(self, names: list, ids: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, list[list]]:
        """Whole sequences as rows of ids, and the pieces in them: sequence, offset, document, start, length."""
        new = np.insert(ids.astype(self.unit), until, self.unit.type(self.end_id))
        sizes = np.diff(until, prepend=0) + 1
        names = [*(x for x, *_ in self.rest), *names]
        skip = np.array([*(x for _, x, _ in self.rest), *([0] * len(sizes))], np.int64)
        sizes = np.array([*(n for *_, n in self.rest), *sizes.tolist()], np.int64)
        stream = np.concatenate([self.ids, new])
        begin = np.cumsum(sizes) - sizes
        edges = np.unique(np.concatenate([begin, np.arange(0, len(stream), self.stride)])).astype(np.int64)
        length = np.diff(edges, append=len(stream))
        owner = np.searchsorted(begin, edges, "right") - 1
        start = edges - begin[owner] + skip[owner] if len(edges) else edges
        full = len(stream) // self.stride * self.stride
        inside = edges < full
        self.ids = stream[full:]
        self.rest = [(names[o], s, n) for o, s, n in zip(owner[~inside].tolist(), start[~inside].tolist(), length[~inside].tolist(), strict=True)]
        own = owner[inside].tolist()
        return stream[:full].reshape(-1, self.stride), [(edges[inside] // self.stride).tolist(), (edges[inside] % self.stride).tolist(), [names[o] for o in own], start[inside].tolist(), length[inside].tolist()]

    def end(self) -> tuple[np.ndarray, list[list]]:
        """The last sequence, padded."""
        if not len(self.ids):
            return np.zeros((0, self.stride), self.unit), [[], [], [], [], []]
        row = np.full((1, self.stride), self.end_id, self.unit)
        row[0, : len(self.ids)] = self.ids
        lengths = [n for *_, n in self.rest]
        offsets = [sum(lengths[:i]) for i in range(len(lengths))]
        return row, [[0] * len(lengths), offsets, [x for x, *_ in self.rest], [s for _, s, _ in self.rest], lengths]


def write_tokens(docs: DataFrame, vocabulary: str, path: str | None = None, key: int = 20240229, stride: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, Layout]:
    """Write all sequences in training order; returns the folder and its layout.

    The folder has shards, files of fixed-stride records, and index, a Parquet table of the documents' pieces: slot, offset there,
    document, start (ids of the document before it), length.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    kind = dict(docs.dtypes)[id_col]
    unit = np.dtype("<u4" if max(codec(vocabulary).word_size.size, end_id + 1) > 1 << 16 else "<u2")
    columns = ["part", "first", "n", "payload", "sequences", "offsets", "documents", "starts", "lengths"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TaskContext.get().partitionId(), 0
        own, stream, squeeze = codec(vocabulary), _Stream(stride, end_id, unit), zstandard.ZstdCompressor(level=9).compress
        id_type = None

        def packs(rows: np.ndarray, pieces: list[list]) -> Iterator[pa.RecordBatch]:
            nonlocal first
            for at in range(0, len(rows), PACK_ROWS):
                some = rows[at : at + PACK_ROWS]
                a, b = np.searchsorted(pieces[0], [at, at + len(some)]).tolist()
                lists = [[x - at for x in pieces[0][a:b]], *(p[a:b] for p in pieces[1:])]
                kinds = [pa.int32(), pa.int32(), id_type, pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([len(some)], pa.int32()), pa.array([squeeze(some.tobytes())], pa.binary()), *(pa.array([x], pa.list_(t)) for x, t in zip(lists, kinds, strict=True))], columns)
                first += len(some)

        for batch, texts in text_batches(batches, text_col):
            id_type = batch.column(id_col).type
            yield from packs(*stream.feed(batch.column(id_col).to_pylist(), *own.encode(texts)))
        yield from packs(*stream.end())

    schema = f"part int, first bigint, n int, payload binary, sequences array<int>, offsets array<int>, documents array<{kind}>, starts array<bigint>, lengths array<int>"
    held, held_path = written(docs.select(id_col, text_col).mapInArrow(encode, schema), "token-packs", "uncompressed")
    sizes = {r["part"]: r["n"] for r in held.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a number for each partition of the input
    base = np.zeros(max(sizes, default=-1) + 2, np.int64)
    for part, n in sizes.items():
        base[part + 1] = n
    base = np.cumsum(base)
    total = int(base[-1])
    record = HEAD + stride * unit.itemsize + TAIL
    layout = Layout(total, max(1, min(max(shuffle_parts(spark), -(-total * record // SHARD_BYTES)), total)), stride, unit.itemsize)
    shards = max(1, -(-total // layout.per_shard))
    shared = spark.sparkContext.broadcast(base)

    def slots(batch: pa.RecordBatch) -> list[np.ndarray]:
        """The slots of each pack's sequences."""
        rows = zip(*(batch.column(c).to_pylist() for c in ("part", "first", "n")), strict=True)
        order = Feistel(total, key)
        return [order.slots(shared.value[p] + f + np.arange(n)) for p, f, n in rows]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, squeeze = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=5).compress
        size = stride * unit.itemsize
        for batch in batches:
            for at, payload in zip(slots(batch), batch.column("payload").to_pylist(), strict=True):
                raw = unpack(payload)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(layout.shard(at).astype(np.int32)), pa.array([squeeze(raw[i : i + size]) for i in range(0, len(raw), size)], pa.binary())], ["slot", "shard", "payload"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = zip(batch.column("slot").to_pylist(), batch.column("payload").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([slot.to_bytes(HEAD, "little") + unpack(x) for slot, x in rows], pa.binary())], ["record"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = slots(batch)
            own = [batch.column(c) for c in ("sequences", "offsets", "documents", "starts", "lengths")]
            slot = [s[np.asarray(x, np.int64)] for s, x in zip(at, own[0].to_pylist(), strict=True)]
            if slot:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(slot)), *(c.flatten() for c in own[1:])], ["slot", "offset", id_col, "start", "length"])

    held.select("part", "first", "n", "sequences", "offsets", "documents", "starts", "lengths").mapInArrow(pieces, f"slot bigint, offset int, {id_col} {kind}, start bigint, length int").write.parquet(f"{path}/index")
    dealt = held.select("part", "first", "n", "payload").mapInArrow(emit, "slot bigint, shard int, payload binary").repartitionById(shards, "shard").sortWithinPartitions("slot")
    made = dealt.select("slot", "payload").mapInArrow(records, "record binary")
    made.select(F.col("record").cast("string")).write.option("lineSep", "\n").option("encoding", "UTF-8").text(f"{path}/shards")  # a cast changes no byte
    drop_path(spark, held_path)
    return path, layout


def read(spark: SparkSession, path: str, layout: Layout, slot: int = 0) -> DataFrame:
    """(slot, ids) from a slot on, ids being stride little-endian numbers. Shards before that of the slot aren't opened."""
    if not layout.total:
        return spark.createDataFrame([], "slot bigint, ids binary")
    files = [f.getPath() for f in _files(spark, f"{path}/shards")]
    wanted = [f.toString() for f in files if int(f.getName().split("-")[1]) >= layout.locate(slot)[0]]
    size = layout.stride * layout.unit
    rows = spark.sparkContext.binaryRecords(",".join(wanted), layout.record).map(lambda r: Row(slot=int.from_bytes(r[:HEAD], "little"), ids=bytes(r[HEAD : HEAD + size])))
    return spark.createDataFrame(rows, "slot bigint, ids binary").filter(F.col("slot") >= slot)


def _files(spark: SparkSession, folder: str) -> list:
    """Status of a folder's shard files."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    return [f for f in found if f.getPath().getName().startswith("part-")]


def digests(spark: SparkSession, path: str, layout: Layout) -> DataFrame:
    """One row for each sequence of the written shards: its slot, shard, CRC-32 of its ids, and how many pieces of documents it has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            sums = [zlib.crc32(np.frombuffer(x, f"<u{layout.unit}").astype("<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("slot"), pa.array(layout.shard(slot).astype(np.int32)), pa.array(sums, pa.int64())], ["slot", "shard", "ids_crc32"])

    crcs = read(spark, path, layout).mapInArrow(run, "slot bigint, shard int, ids_crc32 bigint")
    parts = spark.read.parquet(f"{path}/index").groupBy("slot").agg(F.count("*").alias("pieces"), F.sum("length").alias("n_ids"))
    return crcs.join(parts, "slot")
