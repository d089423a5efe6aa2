"""Pairs of texts whose difflib ratio reaches a threshold, without giving each pair to difflib.

difflib matches texts in runs that grow from letters which are rare in the second text (autojunk); besides these only a common beginning is a run.
So a ratio needs matched letters in few runs, and a run of m letters holds m - Q + 1 grams of Q letters: pairs that share fewer grams can't
reach it. The others are matched as difflib does, by the rare letters alone, until what is left can't reach the threshold.
Texts are whole, however long: pairing all places of a letter would take the square of their length for each run.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np

LETTERS = b"abcdefghijklmnopqrstuvwxyz0123456789"
#: Letters of a gram, counts of a bucket of grams that have a bit of their own, and the least and most buckets (as powers of 2).
Q, LEVELS, FEW, MANY = 5, 4, 9, 16
#: Texts from which on difflib drops frequent letters.
JUNK = 200
#: Letters of a run up to which it is looked up as a whole.
LONG = 32
#: Numbers of the letters.
CODE = np.zeros(256, np.int64)
CODE[np.frombuffer(LETTERS, np.uint8)] = np.arange(len(LETTERS))


def _codes(text: str) -> np.ndarray:
    return CODE[np.frombuffer(text.encode(), np.uint8)]


def _run(x: str, y: str, i: int, j: int, most: int) -> int:
    """Equal letters from x[i] and y[j] on, most at most."""
    k = 0
    while k + 32 <= most and x[i + k : i + k + 32] == y[j + k : j + k + 32]:
        k += 32
    while k < most and x[i + k] == y[j + k]:
        k += 1
    return k


class Kept:
    """Places of a text's runs of letters that difflib doesn't drop, by their letters: runs of one letter, of two, and so on, as far as asked for."""

    def __init__(self, text: str, kept: np.ndarray):
        self.text, self.letters, self.kept = text, kept, kept[_codes(text)]
        self._held, self._runs = np.flatnonzero(self.kept), []

    def runs(self, n: int) -> dict[str, list[int]]:
        """The places of each run of n letters; those of less are asked for before."""
        if n > len(self._runs):
            self._held = self._held[self._held + n <= len(self.text)]
            self._held = self._held[self.kept[self._held + n - 1]]
            found: dict[str, list[int]] = {}
            for p in self._held.tolist():
                found.setdefault(self.text[p : p + n], []).append(p)
            self._runs.append(found)
        return self._runs[n - 1]

    def shared(self, x: str, most: int) -> list[list[int]]:
        """Places of x's runs of 1, 2, ... letters, most at most, that are runs of this text, too."""
        out, held = [], np.flatnonzero(self.letters[_codes(x)]).tolist()
        for n in range(1, most + 1):
            runs = self.runs(n)
            held = [p for p in held if x[p : p + n] in runs]
            if not held:
                break
            out.append(held)
        return out


def _longest(x: str, places: list[int], anchors: dict[str, list[int]], alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """(i, j, k): the longest run of anchors' letters that both ranges have, the first of these; letter by letter."""
    i, j, k, last, runs = alo, blo, 0, -2, {}
    for p in places[bisect_left(places, alo) : bisect_left(places, ahi)]:
        before, runs = runs if p == last + 1 else {}, {}
        last = p
        own = anchors[x[p]]
        for b in own[bisect_left(own, blo) : bisect_left(own, bhi)]:
            n = runs[b] = before.get(b - 1, 0) + 1
            if n > k:
                i, j, k = p - n + 1, b - n + 1, n
    return i, j, k


def ratio(x: str, y: str, kept: Kept, least: float, most: int = LONG) -> float:
    """SequenceMatcher(None, x, y).ratio(), or 0.0 if it is below least. kept: runs of y's letters that aren't dropped.

    The longest run of a range is looked up by its letters, from the longest that x and y share down; only where it may have more than most letters are the
    letters' places paired, which takes the product of their counts.
    """
    total = len(x) + len(y)
    shared = kept.shared(x, most)
    matched, open_, due = 0, min(len(x), len(y)), [(0, len(x), 0, len(y))]
    while due:
        if 2.0 * (matched + open_) / total < least:
            return 0.0
        alo, ahi, blo, bhi = due.pop()
        open_ -= min(ahi - alo, bhi - blo)
        i, j, k = alo, blo, 0
        for n in range(min(len(shared), ahi - alo, bhi - blo), 0, -1):
            places, runs = shared[n - 1], kept.runs(n)
            for q in range(bisect_left(places, alo), bisect_left(places, ahi - n + 1)):
                p = places[q]
                own = runs[x[p : p + n]]
                at = bisect_left(own, blo)
                if at < len(own) and own[at] <= bhi - n:
                    i, j, k = p, own[at], n
                    break
            if k:
                break
        if k == most:
            i, j, k = _longest(x, shared[0], kept.runs(1), alo, ahi, blo, bhi)
        while i > alo and j > blo and x[i - 1] == y[j - 1]:
            i, j, k = i - 1, j - 1, k + 1
        k += _run(x, y, i + k, j + k, min(ahi - i - k, bhi - j - k))
        if k:
            matched += k
            for part in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)):
                if part[0] < part[1] and part[2] < part[3]:
                    due.append(part)
                    open_ += min(part[1] - part[0], part[3] - part[2])
    return 2.0 * matched / total if 2.0 * matched / total >= least else 0.0


class Texts:
    """Texts of a-z and 0-9 with the counts that bound their ratios."""

    def __init__(self, texts: list[str], autojunk: bool = True):
        self.texts, self.size = texts, np.array([len(t) for t in texts], np.int64)
        buckets = 1 << min(MANY, max(FEW, int(2 * self.size.max(initial=1)).bit_length()))
        self.letters = np.zeros((len(texts), len(LETTERS)), np.int32)
        self.grams = np.zeros((len(texts), LEVELS * buckets // 64), np.uint64)
        self.over = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            own = _codes(t)
            self.letters[k] = np.bincount(own, minlength=len(LETTERS))
            gram = np.zeros(max(0, len(own) - Q + 1), np.uint64)
            for q in range(Q):
                gram = gram * np.uint64(len(LETTERS)) + own[q : q + len(gram)].astype(np.uint64)
            hashed = (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - buckets.bit_length())
            counts = np.bincount(hashed.astype(np.int64), minlength=buckets)
            self.grams[k] = np.packbits(counts[None, :] > np.arange(LEVELS)[:, None], axis=1).reshape(-1).view(np.uint64)
            self.over[k] = np.maximum(counts - LEVELS, 0).sum()
        kept = self.letters <= (self.size // 100 + 1)[:, None]
        self.rare = kept if autojunk else np.ones_like(kept)
        if autojunk:
            self.rare[self.size < JUNK] = True
        self.most = LONG if autojunk else 1

    def possible(self, others: np.ndarray, k: int, least: float) -> np.ndarray:
        """Those of others whose ratio against text k, as the second one, may reach least."""
        both = self.size[others] + self.size[k]
        others = others[2 * np.minimum(self.size[others], self.size[k]) >= least * both - 1e-6]
        need = least * (self.size[others] + self.size[k]) / 2 - 1e-6
        low = np.minimum(self.letters[others], self.letters[k])
        held = low.sum(1) >= need
        others, need, low = others[held], need[held], low[held]
        unmatched = self.size[others] + self.size[k] - 2 * need
        runs = np.minimum(low[:, self.rare[k]].sum(1), unmatched) + 1
        shared = np.bitwise_count(self.grams[others] & self.grams[k]).sum(1, dtype=np.int64) + np.minimum(self.over[others], self.over[k])
        return others[shared >= need - runs * (Q - 1)]

    def alike(self, firsts: list[np.ndarray], least: float) -> Iterator[tuple[int, int, float]]:
        """(i, k, ratio) of each text k and those of firsts[k] whose ratio is least or more."""
        for k, others in enumerate(firsts):
            likely = self.possible(others, k, least).tolist() if len(others) else []
            kept = Kept(self.texts[k], self.rare[k]) if likely else None
            for i in likely:
                r = ratio(self.texts[i], self.texts[k], kept, least, self.most)
                if r >= least:
                    yield i, k, r
