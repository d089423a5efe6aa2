"""Byte-level BPE encoding and decoding.

Pre-tokenisation works on arrays. Every code point gets a class; a class (with one code point of look-ahead) is a
transition function of a small automaton. Functions compose associatively, so an inclusive scan over function numbers
gives the state before every code point, block by block and without a loop over the text. The state and the class say
whether a piece begins there. Pieces are cut from the text and go through a bounded cache of merged pairs; ids are
gathered by array operations, and each id's byte offset is kept, so that decoding is a gather, too.

Null texts count as empty; an empty text has no ids. Equal texts have equal ids, and each of several rows under one id is a row of
the result. A very long text is a step of its own, encoded whole. Columns but id and text are neither read nor kept, so further ones may
have any name. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_batches

#: Pieces whose ids a worker remembers; beyond it the cache starts anew.
CACHE_PIECES = 1_000_000
#: Pieces of more bytes are merged through a heap.
HEAP_BYTES = 200
#: Bytes of pieces that are merged together.
MERGE_BYTES = 1_000_000
#: Length of the runs that the scan goes through in step.
RUN = 512

# Classes of code points.
OTHER, LETTER, NUMBER, SPACE, BLANK = range(5)
# Symbols: a class with its look-ahead. A *_LAST white space stands before something else, others do not.
S_LETTER, S_NUMBER, S_OTHER, S_SPACE_LAST, S_SPACE, S_BLANK_LAST, S_BLANK, S_QUOTE1, S_QUOTE2 = range(9)
SYMBOLS = 9
# States after a code point.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, GLUE, IN_BLANKS, NEED1, NEED2 = range(8)
STATES = 8


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point, from the Unicode database."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    blank = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[blank] = BLANK
    table[0x20] = SPACE
    return table


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a code point, and whether a piece begins at it."""
    if symbol == S_LETTER:
        if state == NEED2:
            return NEED1, False
        if state == NEED1:
            return FRESH, False
        return IN_LETTERS, state not in (IN_LETTERS, GLUE)
    if symbol == S_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, GLUE)
    if symbol in (S_QUOTE1, S_QUOTE2) and state not in (IN_OTHERS, GLUE):
        return (NEED1 if symbol == S_QUOTE1 else NEED2), True
    if symbol in (S_OTHER, S_QUOTE1, S_QUOTE2):
        return IN_OTHERS, state not in (IN_OTHERS, GLUE)
    if symbol == S_SPACE_LAST:
        return GLUE, True
    if symbol == S_BLANK_LAST:
        return FRESH, True
    return IN_BLANKS, state != IN_BLANKS


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of each symbol's function, composition table, states by function, beginnings by state and symbol).

    Symbols from SYMBOLS on stand at the start of a text: their functions are constant.
    """
    first = [tuple(_step(s, x)[0] for s in range(STATES)) for x in range(SYMBOLS)]
    first += [(_step(FRESH, x)[0],) * STATES for x in range(SYMBOLS)]
    number: dict[tuple, int] = {}
    todo = list(dict.fromkeys(first))
    for f in todo:
        number.setdefault(f, len(number))
    for f in todo:  # the closure under composition
        for g in list(number):
            for h in (tuple(g[s] for s in f), tuple(f[s] for s in g)):
                if h not in number:
                    number[h] = len(number)
                    todo.append(h)
    functions = list(number)
    compose = np.array([[number[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint8)
    begins = np.array([[_step(s, x)[1] for x in range(SYMBOLS)] + [True] * SYMBOLS for s in range(STATES)])
    return np.array([number[f] for f in first], np.uint8), compose, np.array(functions, np.uint8), begins


def _symbols(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    kind = classes()[points]
    n = len(points)
    end = np.zeros(n, bool)  # last code point of its text
    end[starts[1:] - 1] = True
    end[-1] = True
    bare = np.empty(n, bool)  # what follows is neither white space nor the end
    bare[:-1] = kind[1:] < SPACE
    bare[end] = False
    symbols = np.array([S_OTHER, S_LETTER, S_NUMBER, S_SPACE, S_BLANK], np.uint8)[kind]
    symbols -= (bare & (kind >= SPACE)).view(np.uint8)  # the *_LAST symbols come just before the others
    quote = np.flatnonzero((points == 0x27) & ~end)
    if len(quote):
        last_of = starts[np.searchsorted(starts, quote, "right") - 1]
        after = points[quote + 1]
        symbols[quote[np.isin(after, np.frombuffer(b"stmd", np.uint8))]] = S_QUOTE1
        quote, after = (x[~end[quote + 1]] for x in (quote, after)) if len(last_of) else (quote, after)
        second = points[np.minimum(quote + 2, n - 1)]
        two = ((after == 0x72) | (after == 0x76)) & (second == 0x65) | (after == 0x6C) & (second == 0x6C)
        symbols[quote[two]] = S_QUOTE2
    symbols[starts] += SYMBOLS
    return symbols


def beginnings(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces begin in code points that hold several non-empty texts, which begin at starts."""
    functions, compose, states, begins = automaton()
    symbols = _symbols(points, starts)
    n, m = len(symbols), len(compose)
    runs = -(-n // RUN)
    padded = np.zeros(runs * RUN, np.uint8)
    padded[:n] = functions[symbols]
    scan = np.ascontiguousarray(padded.reshape(runs, RUN).T)  # one column for each run
    flat = compose.ravel()
    at = np.empty(runs, np.uint16)
    for j in range(1, RUN):
        np.multiply(scan[j - 1], m, out=at, dtype=np.uint16, casting="unsafe")
        at += scan[j]
        flat.take(at, out=scan[j])
    before = np.empty(runs, np.uint16)  # the state before each run
    state = FRESH
    for k, f in enumerate(scan[-1].tolist()):
        before[k] = state
        state = int(states[f, state])
    after = states.ravel().take(scan.astype(np.uint16) * STATES + before).T.ravel()[:n]
    prior = np.empty(n, np.uint16)
    prior[0] = FRESH
    prior[1:] = after[:-1]
    return np.flatnonzero(begins.ravel().take(prior * (2 * SYMBOLS) + symbols))


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def ragged(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions first[i], first[i] + 1, ... of all ranges one after the other."""
    ends = np.cumsum(sizes)
    out = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    return out + np.repeat(first - (ends - sizes), sizes)


class Merger:
    """Pair merging of many pieces at once: in each round every piece joins its pair of the lowest rank, leftmost first."""

    NONE = np.int64(1 << 40)

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(ranks[w[:k]], ranks[w[k:]], r) for w, r in ranks.items() for k in range(1, len(w)) if w[:k] in ranks and w[k:] in ranks]
        key = np.array([a << 32 | b for a, b, _ in pairs], np.int64)
        self.bits = max(8, int(len(pairs) * 8).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, self.NONE, np.int64)
        slot, todo, value = self._slot(key), np.arange(len(key)), np.array([r for *_, r in pairs], np.int64)
        while len(todo):
            free = self.key[slot[todo]] == -1
            self.key[slot[todo[free]]] = key[todo[free]]
            won = self.key[slot[todo]] == key[todo]
            self.rank[slot[todo[won]]] = value[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & (len(self.key) - 1)
        words = list(ranks)
        flat = np.frombuffer(b"".join(words), np.uint8)
        ids, sizes = self._merge(flat, np.array([len(w) for w in words]))
        #: Words of the vocabulary that merging doesn't reach; as pieces they are one id all the same.
        self.odd = {w for w, k in zip(words, sizes.tolist(), strict=True) if k > 1}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        slot = self._slot(key)
        out = np.full(len(key), self.NONE)
        todo = np.arange(len(key))
        while len(todo):
            found = self.key[slot]
            hit = found == key
            out[todo[hit]] = self.rank[slot[hit]]
            more = ~hit & (found != -1)
            todo, key, slot = todo[more], key[more], (slot[more] + 1) & (len(self.key) - 1)
        return out

    def __call__(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces (bytes one after the other, and each one's size), and how many each has."""
        if flat.size > MERGE_BYTES and len(sizes) > 1:
            half = len(sizes) // 2
            cut = int(sizes[:half].sum())
            parts = self(flat[:cut], sizes[:half]), self(flat[cut:], sizes[half:])
            return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        long = sizes > HEAP_BYTES
        if not self.odd and not long.any():
            return self._merge(flat, sizes)
        at = np.cumsum(sizes) - sizes
        alone = {}
        for i in np.flatnonzero(long) if not self.odd else range(len(sizes)):
            piece = flat[at[i] : at[i] + sizes[i]].tobytes()
            if piece in self.odd or long[i]:
                alone[int(i)] = [self.ranks[piece]] if piece in self.ranks else self._merge_long(piece)
        rest = np.ones(len(sizes), bool)
        rest[list(alone)] = False
        ids, own = self._merge(flat[np.repeat(rest, sizes)], sizes[rest])
        counts = np.zeros(len(sizes), np.int64)
        counts[rest] = own
        counts[list(alone)] = [len(x) for x in alone.values()]
        out = np.empty(int(counts.sum()), np.int64)
        out[np.repeat(rest, counts)] = ids
        first = np.cumsum(counts) - counts
        for i, x in alone.items():
            out[first[i] : first[i] + len(x)] = x
        return out, counts

    def _merge(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        done_ids, done_piece, done_order = [], [], []
        sizes = sizes.astype(np.int64)
        ids, piece = self.byte_id[flat], np.repeat(np.arange(len(sizes)), sizes)
        last = np.zeros(len(ids), bool)
        last[np.cumsum(sizes)[sizes > 0] - 1] = True
        rank = np.full(len(ids), self.NONE)
        inner = np.flatnonzero(~last)
        rank[inner] = self.pair_rank(ids[inner], ids[inner + 1])
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], last[:-1]]))
            best = np.minimum.reduceat(rank << 22 | np.arange(len(ids)), first)
            at = best & ((1 << 22) - 1)
            open_ = best >> 22 < self.NONE
            if not open_.all():
                counts = np.diff(np.append(first, len(ids)))
                stays = np.repeat(open_, counts)
                done_ids.append(ids[~stays])
                done_piece.append(piece[~stays])
                moved = np.cumsum(stays) - 1
                ids, piece, last, rank, at = ids[stays], piece[stays], last[stays], rank[stays], moved[at[open_]]
                if not len(ids):
                    break
            ids[at] = rank[at]
            last[at] = last[at + 1]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            ids, piece, last, rank, at = ids[keep], piece[keep], last[keep], rank[keep], moved[at]
            rank[at] = self.NONE
            right = at[~last[at]]
            left = at[at > 0] - 1
            left = left[~last[left]]
            both = np.concatenate([right, left])
            rank[both] = self.pair_rank(ids[both], ids[both + 1])
        if not done_ids:
            return np.empty(0, np.int64), np.zeros(len(sizes), np.int64)
        ids, piece = np.concatenate(done_ids), np.concatenate(done_piece)
        return ids[np.argsort(piece, kind="stable")], np.bincount(piece, minlength=len(sizes))

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same for one long piece, through a heap of pairs over a linked list: n log n."""
        get, n = self.ranks.get, len(piece)
        begin, stop = list(range(n)), list(range(1, n + 1))
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, until = heapq.heappop(heap)
            j = right[i] if alive[i] else n
            if j >= n or stop[j] != until:
                continue
            stop[i], alive[j], right[i] = until, False, right[j]
            if right[i] < n:
                left[right[i]] = i
                if (r := get(piece[begin[i] : stop[right[i]]])) is not None:
                    heapq.heappush(heap, (r, i, stop[right[i]]))
            if (k := left[i]) >= 0 and (r := get(piece[begin[k] : until])) is not None:
                heapq.heappush(heap, (r, k, until))
        return [self.ranks[piece[begin[i] : stop[i]]] for i in range(n) if alive[i]]


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.held, self.n = np.empty(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        need = self.n + len(more)
        if need > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.empty(max(need, 2 * self.n) - self.n, self.held.dtype)])
        self.held[self.n : need] = more
        self.n = need


class Cache:
    """Ids of pieces seen before, found by a hash of their code points and confirmed by the code points themselves."""

    ODD = np.uint64(0xD1342543DE82EF95)  # an odd multiplier and its inverse modulo 2**64
    INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))

    def __init__(self, merger: Merger, most: int):
        self.merger, self.most = merger, most
        self.bits = (4 * most).bit_length()
        self.power = np.ones(1, np.uint64)
        self.empty()

    def empty(self) -> None:
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.hash, self.at, self.size, self.id_at, self.id_size = (Grown(k) for k in (np.uint64, np.int64, np.int64, np.int64, np.int64))
        self.points, self.ids = Grown(np.uint32), Grown(np.uint32)

    def hashes(self, points: np.ndarray, begin: np.ndarray) -> np.ndarray:
        if len(self.power) <= len(points):
            self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(points), self.ODD)]), dtype=np.uint64)
            self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(points), self.INVERSE)]), dtype=np.uint64)
        mixed = (points.astype(np.uint64) + np.uint64(0x632BE5AB)) * np.uint64(0x2545F4914F6CDD1D)
        mixed ^= mixed >> np.uint64(29)
        mixed *= self.power[: len(points)]
        total = np.add.reduceat(mixed, begin) * self.inverse[begin]
        total ^= total >> np.uint64(32)
        return total * np.uint64(0x9E3779B97F4A7C15)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        entry = self.slots[slot]
        known = self.hash.held
        wrong = np.flatnonzero((entry >= 0) & (known[np.maximum(entry, 0)] != hashes))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (len(self.slots) - 1)
            entry[wrong] = e = self.slots[slot[wrong]]
            wrong = wrong[(e >= 0) & (known[np.maximum(e, 0)] != hashes[wrong])]
        return entry

    def insert(self, hashes: np.ndarray, first: int) -> None:
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(hashes))
        while len(todo):
            free = todo[self.slots[slot[todo]] < 0]
            self.slots[slot[free]] = (free + first).astype(np.int32)
            todo = todo[self.slots[slot[todo]] != todo + first]
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)

    def __call__(self, points: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and how many each piece has."""
        if self.hash.n > self.most:
            self.empty()
        size = np.diff(np.append(begin, len(points)))
        hashes = self.hashes(points, begin)
        entry = self.find(hashes)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            new, one, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            one = missing[one]
            ids, counts = self.merge(points, begin[one], size[one])
            first = self.hash.n
            for held, more in ((self.at, self.points.n + np.cumsum(size[one]) - size[one]), (self.id_at, self.ids.n + np.cumsum(counts) - counts), (self.hash, new), (self.size, size[one]), (self.id_size, counts), (self.points, points[ragged(begin[one], size[one])]), (self.ids, ids)):
                held.add(more)
            if self.hash.n < len(self.slots) // 2:
                self.insert(new, first)
            entry[missing] = first + back
        same = self.size.held[entry] == size
        if same.all():
            equal = self.points.held[ragged(self.at.held[entry], size)] == points
            same = equal.all() or np.logical_and.reduceat(equal, begin)
        counts = self.id_size.held[entry]
        ids = self.ids.held[ragged(self.id_at.held[entry], counts)]
        if same is True or np.all(same):
            return ids, counts
        ids, counts = self.merge(points, begin, size)  # two pieces with one hash: no cache for this batch
        return ids.astype(np.uint32), counts

    def merge(self, points: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = points[ragged(begin, size)]
        flat = np.frombuffer(own.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        width = 1 + (own > 0x7F).astype(np.int64) + (own > 0x7FF) + (own > 0xFFFF)
        return self.merger(flat, np.add.reduceat(width, np.cumsum(size) - size))


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.cache = Cache(Merger(ranks), CACHE_PIECES)
        token = {r: b for b, r in ranks.items()}
        self.words = [token.get(i, b"") for i in range(max(token) + 1)]
        self.word_size = np.array([len(w) for w in self.words], np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other (uint32), and where each text's ids end."""
        sizes = np.array([len(t) for t in texts], np.int64)
        whole = "".join(texts)
        if not whole:
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(sizes)
        begin = beginnings(points, (ends - sizes)[sizes > 0])
        ids, counts = self.cache(points, begin)
        return ids, np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(begin, ends)]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each id's bytes begin in the decoded bytes."""
        sizes = self.word_size[ids]
        return np.cumsum(sizes) - sizes

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids."""
        return b"".join(map(self.words.__getitem__, ids.tolist()))


@lru_cache(4)
def codec(path: str) -> Codec:
    """One codec for each vocabulary and worker."""
    return Codec(path)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of each text with the byte offset of each id: (id_col, ids array<int>, offsets array<long>).

    vocabulary: path of a tiktoken ranks file that every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch, texts in text_batches(batches, text_col):
            ids, until = own.encode(texts)
            begin = np.concatenate([[0], until[:-1]])
            byte = own.offsets(ids)
            first = np.concatenate([byte, [0]])[np.minimum(begin, len(byte))] if len(byte) else np.zeros(len(texts), np.int64)
            byte = byte - np.repeat(first, until - begin)
            ends = pa.array(np.concatenate([[0], until]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(byte))], [id_col, "ids", "offsets"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, ids array<int>, offsets array<bigint>")


def digest_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text, decode its ids, and return digests of both: (id_col, n_tokens, ids_sha256, decoded_sha256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch, texts in text_batches(batches, text_col):
            ids, until = own.encode(texts)
            decoded, byte = own.decode(ids), np.concatenate([[0], np.cumsum(own.word_size[ids])])
            raw = ids.astype("<u4").tobytes()
            ends = until.tolist()
            spans = list(zip([0, *ends[:-1]], ends, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col),
                    pa.array([b - a for a, b in spans], pa.int64()),
                    pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in spans], pa.string()),
                    pa.array([hashlib.sha256(decoded[byte[a] : byte[b]]).hexdigest() for a, b in spans], pa.string()),
                ],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
