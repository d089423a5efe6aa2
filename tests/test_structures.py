"""Vector table, containment and components against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryspark.operators import containment, dedupe, vectorindex
from quarryspark.operators.vectorindex import VectorIndex
from quarryspark.sources.shipping import fresh_path, ship

KIND = "id bigint, source string, vector array<double>"


def brute(rows, q, k, sources=None):
    q = np.array(q)
    near = [(1 - np.array(v) @ q / (np.linalg.norm(v) * np.linalg.norm(q)), i) for i, s, v in rows if sources is None or s in sources]
    return sorted((round(d, 9), i) for d, i in near)[:k]


@pytest.fixture(scope="module")
def clustered(spark):
    ship(spark)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = [(i, f"s{0 if i % 3 == 0 else 1 if i % 50 == 1 else 2 + i % 7}", (centres[i % 12] + rng.normal(scale=0.15, size=16)).tolist()) for i in range(1500)]
    odd = [(9000, "s0", None), (None, "s0", rows[0][2]), (9001, "s0", [0.0] * 16), (9002, "s0", [float("nan")] * 16), (9003, "s0", [1.0, 2.0]), (9004, "s0", [None] + [1.0] * 15)]
    index = VectorIndex(spark, fresh_path(spark, "vectors-test")).build(spark.createDataFrame(rows + odd, KIND).repartition(4))
    return rows, index


@pytest.mark.parametrize("sources", [None, {"s0"}, {"s1"}, {"s4", "s5"}, {"none"}])
def test_nearest_equals_brute_force_at_each_selectivity(spark, monkeypatch, clustered, sources):
    monkeypatch.setattr(vectorindex, "WAVES", (1, 3, 8))
    rows, index = clustered
    asked = {k: rows[k][2] for k in (0, 7, 501, 1499)}
    queries = spark.createDataFrame([*asked.items(), (77, None), (78, [0.0] * 16), (None, rows[0][2])], "qid bigint, q array<double>")
    wanted = spark.createDataFrame([(s,) for s in sources], "source string") if sources is not None else None
    got = {}
    for r in index.nearest(queries, 20, wanted).collect():
        got.setdefault(r["qid"], []).append((round(r["distance"], 9), r["id"]))
    for q, v in asked.items():
        want = brute(rows, v, 20, sources)
        assert [i for _, i in sorted(got.get(q, []))] == [i for _, i in want]
    assert not {77, 78, None} & set(got)


def test_few_cells_are_read_where_vectors_are_clustered(spark, clustered):
    rows, index = clustered
    query = spark.createDataFrame([(1, rows[1][2])], "qid bigint, q array<double>")
    close = index.within(query, 0.05)
    assert sorted(r["id"] for r in close.collect()) == sorted(i for d, i in brute(rows, rows[1][2], 1500) if d <= 0.05)
    text = close._jdf.queryExecution().executedPlan().toString()
    cells = spark.read.parquet(f"{index.root}/cells").count()
    read = text[text.index("PartitionFilters") :].split("]")[0]
    assert "cell" in read and read.count(",") < cells
    some = index.nearest(query, 3, spark.createDataFrame([("s2",)], "source string").coalesce(1))
    assert len(some.collect()) == 3


def test_empty_vector_table(spark):
    index = VectorIndex(spark, fresh_path(spark, "vectors-test")).build(spark.createDataFrame([(1, "a", None)], KIND))
    assert index.nearest(spark.createDataFrame([(1, [1.0])], "qid bigint, q array<double>"), 3).count() == 0


@pytest.mark.parametrize("shard", [8_000_000, 40])
def test_longest_contained_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(containment, "SHARD_CHARS", shard)
    rnd = random.Random(3)
    names = ["".join(rnd.choices("abc", k=rnd.randrange(1, 6))) for _ in range(60)] + ["", None, "aaaa", "aaaa"]
    texts = [(i, "".join(rnd.choices("abcd", k=rnd.randrange(0, 40)))) for i in range(80)] + [(80, None), (81, "ab"), (81, "ca"), (82, "dddd")]
    got = containment.longest_contained(spark.createDataFrame(texts, "id bigint, norm string"), spark.createDataFrame([(n,) for n in names], "norm string"), "id")
    want = set()
    for i, t in texts:
        held = [n for n in names if n and t and n in t]
        want |= {(i, n) for n in held if len(n) == max(map(len, held))}
    ids = {i for i, _ in texts if i != 81}
    assert {tuple(r) for r in got.collect() if r["id"] in ids} == {w for w in want if w[0] in ids}
    assert containment.longest_contained(spark.createDataFrame(texts, "id bigint, norm string"), spark.createDataFrame([], "norm string"), "id").count() == 0


@pytest.mark.parametrize("share", [0.001, 0.05])
def test_components_with_a_hub(spark, monkeypatch, share):
    monkeypatch.setattr(dedupe, "HUB_SHARE", share)
    rnd = random.Random(6)
    edges = [(5, 1000 + i) for i in range(300)] + [(2000 + i, 2001 + i) for i in range(120)] + [(rnd.randrange(3000, 3400), rnd.randrange(3000, 3400)) for _ in range(180)] + [(4000, 4000), (None, 1), (1, None), (2050, 5), (5, 1000)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = dedupe.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert len(got) == len(parent) and {r["node"]: r["root"] for r in got} == {x: find(x) for x in parent}
    assert dedupe.connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_give_up_after_their_rounds(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "ROUNDS", 1)
    with pytest.raises(RuntimeError):
        dedupe.connected(spark.createDataFrame([(1, 2), (2, 3)], "a bigint, b bigint"))
