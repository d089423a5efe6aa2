"""Hard negatives, embedding near duplicates and ranked search against brute force, and their edge cases."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryspark.llm import cells, negatives, ranked, registry
from quarryspark.llm.common import ship

SF = "/root/testdata/sf0.001"
CLASHES = ["block", "part", "score", "cell", "node", "n", "q", "rank", "item", "row", "term", "key", "dims"]


def frame(spark, rows, schema):
    ship(spark)
    extra = ", ".join(f"{c} int" for c in CLASHES)
    return spark.createDataFrame([(*r, *range(len(CLASHES))) for r in rows], f"{schema}, {extra}").repartition(3, F.monotonically_increasing_id())


def usable(rows):
    return [(i, v, x) for i, v, x in rows if i is not None and x is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]


def brute_negatives(rows, step=50, scale=256, positives=5, negatives_=3):
    whole = [(i, x, [math.floor(scale * c) for c in v]) for i, v, x in usable(rows)]
    anchors = {}
    for i, x, q in whole:
        if i % step == 0:
            anchors.setdefault(i, []).append((x, q))
    out = []
    for a, (found,) in anchors.items():
        label, own = found
        scored = sorted((-sum(p * r for p, r in zip(own, q)), i, x) for i, x, q in whole if i != a and len(q) == len(own))
        for s, p, _ in [t for t in scored if t[2] == label][:positives]:
            inside = [(i, t) for t, i, x in scored if x != label and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a, p, n + 1, i, -s, -t) for n, (i, t) in enumerate(inside[:negatives_])]
    return sorted(out)


def mined(df, **more):
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 50 == 0, **more).collect())


def vectors(seed, n, dims=40, labels=3):
    rnd, centre = random.Random(seed), [random.Random(7).gauss(0.3, 0.2) for _ in range(dims)]
    return [(i, [c + rnd.gauss(0, 0.2) for c in centre], rnd.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("blocks", [(512, 2048), (2, 16)])
def test_negatives_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", blocks[0])
    monkeypatch.setattr(negatives, "ROW_BLOCK", blocks[1])
    monkeypatch.setattr(negatives, "CLASSES", 2)  # labels share classes
    rows = vectors(1, 400) + [(1000 + i, None, 1) for i in range(3)] + [(None, [0.1] * 40, 1), (1003, [0.1] * 40, None), (1004, [None] + [0.1] * 39, 1), (1050, [math.nan] * 40, 1)]
    rows += [(2000 + i, rows[0][1], 1) for i in range(120)]  # a vector that many rows repeat
    rows += [(3000 + i, [0.5] * 7, i % 2) for i in range(60)] + [(4000, [], 0), (4001, [], 1), (4002, [], 0)]
    want = brute_negatives(rows)
    assert want and mined(frame(spark, rows, "vec_id bigint, embedding array<double>, label int")) == want


def test_negatives_of_odd_rows(spark):
    huge = [(0, [1e30, -2.0], 0), (1, [1e30, 1.0], 0), (2, [0.7e30, 5.0], 1), (3, [1.0, 1.0], 1), (50, [3.0, 1.0], 1), (51, [4.0, 1.0], 1), (52, [2.0, 1.0], 0), (50, [3.0, 1.0], 1), (53, [2.0, 1.0], 0), (53, [2.0, 1.0], 0)]
    got = mined(frame(spark, huge, "vec_id bigint, embedding array<double>, label int"))
    top = (1 << 63) - 1
    assert (50, 51, 1, 0, 256 * 256 * 13, 0) not in got and all(-top - 1 <= r[4] <= top for r in got)
    assert [r for r in got if r[:2] == (50, 51)] == [(50, 51, k, i, 851968, 458752) for k, i in ((1, 52), (2, 53), (3, 53))]
    empty = frame(spark, [], "vec_id bigint, embedding array<double>, label int")
    assert mined(empty) == []
    negative = [(0, [1.0], 0), (1, [-1.0], 0), (2, [-0.7], 1)]  # a window of a negative score is empty
    assert mined(frame(spark, negative, "vec_id bigint, embedding array<double>, label int")) == []


def test_negatives_blocks_meet_in_a_shuffle(spark):
    """An anchor block is sent to each row block, so no side of that join goes through the driver, and no tile is shuffled."""
    plan = negatives.mine(frame(spark, vectors(1, 200), "vec_id bigint, embedding array<double>, label int"), F.col("vec_id") % 50 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [block" in plan and "BroadcastHashJoin [block" not in plan and "tile" not in plan


def test_negatives_query(spark):
    assert registry.op11_hard_negatives(spark, SF).count() > 0


def brute_groups(rows, least=0.98):
    ok = [x is not None and v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v, x in rows]
    parent, links = list(range(len(rows))), Counter()

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in (a, b))
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                    links[a] += 1
                    links[b] += 1
                    parent[find(a)] = find(b)
    low = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)].append(r[0])
    out = []
    for i, r in enumerate(rows):
        c = min(low[find(i)], default=None)
        out.append((r[0], links[i], c, r[0] is not None and r[0] == c))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "nodes"), [(1024, 1024), (8, 20)])
def test_vector_groups_equal_brute_force(spark, monkeypatch, block, nodes):
    monkeypatch.setattr(cells, "BLOCK", block)
    monkeypatch.setattr(cells, "CELL_NODES", nodes)
    rnd, rows = random.Random(5), []
    for g in range(12):  # chains and clouds across cell borders
        x = np.array([rnd.gauss(0, 1) for _ in range(6)])
        for _ in range(25):
            x = x + np.array([rnd.gauss(0, 0.09) for _ in range(6)]) * np.linalg.norm(x)
            rows.append((len(rows) * 7 % 997, x.tolist(), rnd.choice([0, 0, 1])))
    rows += [(5000 + i, rows[3][1], 0) for i in range(60)] + [(5100, [2 * c for c in rows[3][1]], 0)]  # copies
    rows += [(6000, None, 0), (6001, rows[3][1], None), (6002, [0.0] * 6, 0), (6003, [math.inf] * 6, 0), (6004, [None] * 6, 0), (6005, [], 0), (None, rows[3][1], 0), (None, [0.0, -0.0], 0)]
    rows += [(7000, [1.0, 2.0], 1), (7001, [1.0, 2.01], 1), (7001, [1.0, 2.01], 1), (7002, [1e-200, 2e-200], 1), (7003, [1e200, 2e200], 1)]
    got = cells.near_duplicates(frame(spark, rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert sorted((tuple(r[c] for c in ("vec_id", "n_links", "component_id", "kept")) for r in got), key=repr) == brute_groups(rows)


def test_cells_lose_no_pair():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 5))
    y = cells.unit(np.concatenate([x, x + rng.normal(scale=0.07, size=x.shape)]))
    for count in (1, 7, 40):
        rows, cell, own = cells.places(y, cells.centroids(y[:200], count), 0.98)
        at = defaultdict(set)
        for r, c, o in zip(rows.tolist(), cell.tolist(), own.tolist()):
            at[r].add((c, o))
        for a, b in zip(*np.nonzero(np.triu(y @ y.T >= 0.98, 1))):
            met = [(c, o, p) for c, o in at[a] for d, p in at[b] if c == d and (o or p)]
            assert len(met) == 1


def test_groups_of_empty_and_unlinked_tables(spark):
    kinds = "vec_id bigint, embedding array<float>, label int"
    assert cells.near_duplicates(frame(spark, [], kinds)).count() == 0
    alone = cells.near_duplicates(frame(spark, [(1, None, 1), (2, [1.0], None)], kinds)).collect()
    assert sorted(tuple(r) for r in alone) == [(1, 0, 1, True), (2, 0, 2, True)]


def brute_ranking(docs, items, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(i, Counter(split(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    total, df = sum(sum(c.values()) for _, c in own), Counter(t for _, c in own for t in c)
    asked = {}
    for i, t in items:
        if t is not None:
            asked[i] = min(asked.get(i, t), t)
    out = []
    for i, t in asked.items():
        scored = []
        for d, c in own:
            m = 50 + (50 * sum(c.values()) * len(own)) // total
            score = sum(math.floor(1000 * math.log((2 * len(own) + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 20 * m)) for x in set(split(t)) if c[x])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("tiers", "vocabulary", "held"), [((1024, 4096), 500_000, 2_000_000), ((4, 12), 40, 100)])
def test_ranked_search_equals_brute_force(spark, monkeypatch, tiers, vocabulary, held):
    for name, value in (("TIERS", tiers), ("VOCABULARY", vocabulary), ("CELLS", held), ("KEPT", held)):
        monkeypatch.setattr(ranked, name, value)
    rnd = random.Random(4)
    words = [f"w{n}" for n in range(60)] + ["Éa", "ÉA", "日本", "x1"]
    odds = [1 / (n + 1) for n in range(len(words))]
    docs = [(i, " ".join(rnd.choices(words, odds, k=rnd.randrange(1, 60)))) for i in range(250)]
    docs += [(i, "Rare W1-w1_w2") for i in range(300, 320)]  # ties
    docs += [(1, "w5 w5 rare"), (None, "w3 rare"), (400, ""), (401, None), (402, " .,;"), (403, "w1 " * 30_000)]
    items = [(1, "w1 w5 W9"), (2, "rare"), (3, None), (4, ""), (5, "nowhere"), (6, "ÉA 日本 w59 x1"), (7, " ".join(words)), (None, "w7"), (8, "w2"), (8, "w1 w2")]
    found = ranked.search(frame(spark, docs, "doc_id bigint, text string"), frame(spark, items, "item_id bigint, text string"), k=7).collect()
    assert sorted((tuple(r)[:4] for r in found), key=repr) == brute_ranking(docs, items, 7)
    assert {r["tier"] for r in found} == ({0} if tiers[0] > 300 else {0, 1, 2} & {r["tier"] for r in found}) and (tiers[0] > 300 or 2 in {r["tier"] for r in found})


def test_tiers_bound_what_they_leave_out(spark, monkeypatch):
    monkeypatch.setattr(ranked, "TIERS", (3, 9))
    rnd = random.Random(8)
    docs = frame(spark, [(i, " ".join(rnd.choices("abc", (6, 2, 1), k=rnd.randrange(1, 30)))) for i in range(80)], "doc_id bigint, text string")
    forward = ranked._forward(docs.select("doc_id", "text"), {b"a": 0, b"b": 1, b"c": 2}).withColumn("row", F.monotonically_increasing_id()).cache()
    frequency = np.array([sum(t in r["terms"] for r in forward.collect()) for t in range(3)])
    w = ranked.Weights(80, int(forward.agg(F.sum("n")).first()[0]), frequency)
    postings, cuts = ranked._tiers(forward, w)
    held = defaultdict(list)
    for r in postings.collect():
        held[r["term"], r["tier"]].append(r["impact"])
    for r in forward.collect():
        for t, c in zip(r["terms"], r["counts"]):
            impact = int(w.impacts(np.array([r["n"]]), np.array([1]), np.array([t]), np.array([c]))[0])
            assert impact in held[t, 0] or impact <= cuts[t][0][1]
            assert impact in held[t, 0] + held[t, 1] or impact <= cuts[t][1][1]
    assert all(len(held[t, 0]) <= 3 and len(held[t, 0]) + len(held[t, 1]) <= 9 for t in range(3))


def test_ranked_search_of_empty_tables(spark):
    docs, items = frame(spark, [], "doc_id bigint, text string"), frame(spark, [(1, "a b")], "item_id bigint, text string")
    assert ranked.search(docs, items).count() == 0
    assert ranked.search(items.select(F.col("item_id").alias("doc_id"), "text"), docs.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
    assert ranked.search(items.select(F.col("item_id").alias("doc_id"), "text"), items).select("doc_id").collect()[0][0] == 1
