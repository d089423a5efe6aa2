"""Verdicts on content: the bounded comparison gives difflib's own ratios, and tiles lose no pair of a block."""

import random
import time
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from quarryspark.operators import dedupe
from quarryspark.operators.likeness import Texts

WORDS = ["the", "and", "of", "that", "whensoever", "appeal", "court", "justice", "quay", "zone", "kept", "judge", "river", "x1", "section20"]


def _families(families: int, members: int) -> list[str]:
    """Random texts, each with copies in which a few words are others."""
    rng, out = random.Random(5), []
    for _ in range(families):
        own = [rng.choice(WORDS) for _ in range(rng.randint(60, 160))]
        for m in range(members):
            out.append("".join(rng.choice(WORDS) if rng.random() < m * 0.03 else w for w in own))
    return sorted(set(out))


def test_bounded_ratios_are_those_of_difflib():
    texts = _families(8, 6)
    for autojunk in (True, False):
        own = Texts(texts, autojunk)
        want = {(i, k): r for i, k in combinations(range(len(texts)), 2) if (r := SequenceMatcher(None, texts[i], texts[k], autojunk).ratio()) >= dedupe.SAME}
        assert want and {(i, k): r for i, k, r in own.alike([np.arange(k) for k in range(len(texts))], dedupe.SAME)} == want
    pairs = len(texts) * (len(texts) - 1) // 2
    assert sum(len(Texts(texts).possible(np.arange(k), k, dedupe.SAME)) for k in range(len(texts))) < pairs / 3  # difflib isn't asked for the rest


def test_tiles_lose_no_pair_and_a_text_of_two_blocks_meets_both(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "TILE", 4)
    texts = _families(5, 5)
    rows = [(t, "b") for t in texts] + [(texts[0], "c"), (texts[0][:-3] + "own", "c")]
    got = dedupe.verdicts(spark.createDataFrame(rows, "text string, block string"), F.col("block")).collect()
    digest = {t: spark.range(1).select(F.md5(F.lit(t))).first()[0] for t, _ in rows}
    want = {}
    for block in ("b", "c"):
        own = sorted({t for t, b in rows if b == block}, key=digest.get)
        for x, y in combinations(own, 2):
            if (r := SequenceMatcher(None, x, y).ratio()) >= dedupe.SAME:
                want[digest[x], digest[y]] = r
    assert {(r["a"], r["b"]): r["similarity"] for r in got} == want and len(got) == len(want)
    assert any(digest[texts[0][:-3] + "own"] in p for p in want)


def _long(rng, words):
    """A text of that many words, with letters among them that are rare in it."""
    return "".join(rng.choice(WORDS) if rng.random() > 0.1 else rng.choice("bf3456789") for _ in range(words))


def _wanted(spark, texts):
    """Pairs that difflib says are the same, by digest."""
    digest = {t: spark.range(1).select(F.md5(F.lit(t))).first()[0] for t in texts}
    pairs = [(x, y, SequenceMatcher(None, x, y).ratio()) for x, y in combinations(sorted(texts, key=digest.get), 2)]
    return {(digest[x], digest[y]): r for x, y, r in pairs if r >= dedupe.SAME}


def test_texts_are_compared_whole(spark):
    """Beyond 30,000 letters, an end can part texts of one beginning, and make texts of other beginnings the same."""
    rng = random.Random(7)
    own, end = _long(rng, 12_000), _long(rng, 5_000)
    texts = [own, own[:31_000] + end, "a" * 4_000 + own]
    got = dedupe.verdicts(spark.createDataFrame([(t, "b") for t in texts], "text string, block string"), F.col("block")).collect()
    want = _wanted(spark, texts)
    assert len(own) > 40_000 and {(r["a"], r["b"]): r["similarity"] for r in got} == want
    digest = [spark.range(1).select(F.md5(F.lit(t))).first()[0] for t in texts]
    assert list(want) == [tuple(sorted((digest[0], digest[2])))]


def test_tiles_by_letters_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "TILE_LETTERS", 3_000)
    texts = _families(3, 5)
    got = dedupe.verdicts(spark.createDataFrame([(t, "b") for t in texts], "text string, block string"), F.col("block")).collect()
    assert {(r["a"], r["b"]): r["similarity"] for r in got} == _wanted(spark, texts) != {}


def test_runs_of_rare_letters_are_matched_as_by_difflib():
    """Runs are looked up by their letters up to LONG of them, and paired letter by letter from there."""
    rng = random.Random(9)
    for _ in range(40):
        own = "".join("".join(rng.choices("zqxjk0123456789", k=rng.choice([1, 1, 2, 3, 8, 40]))) if rng.random() < 0.03 else rng.choice("etaoinsh") for _ in range(1_500))
        texts = [own]
        for edits in (1, 5, 40):
            other = list(own)
            for _ in range(edits):
                other[rng.randrange(len(other))] = rng.choice(["", "z", "et", "q7q7"])
            texts.append("".join(other))
        want = {(i, k): SequenceMatcher(None, texts[i], texts[k]).ratio() for i, k in combinations(range(len(texts)), 2)}
        assert {(i, k): r for i, k, r in Texts(texts).alike([np.arange(k) for k in range(len(texts))], 0.0)} == want


def test_long_near_copies_are_matched_in_time():
    rng = random.Random(3)
    own = _long(rng, 240_000)
    other = list(own)
    for p in range(50, len(own), 1_000):
        other[p] = "e" if other[p] != "e" else "a"  # a letter that is dropped, and doesn't move the others
    begin = time.monotonic()
    found = list(Texts([own, "".join(other)]).alike([np.arange(0), np.arange(1)], dedupe.SAME))
    assert len(found) == 1 and time.monotonic() - begin < 20
