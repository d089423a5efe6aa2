"""Searches of many queries: members and queries of a cell meet in blocks, with the distances and ties of a comparison of all pairs."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarryspark.operators import vectorindex
from quarryspark.operators.vectorindex import VectorIndex, cosine_distance
from quarryspark.sources.shipping import fresh_path, ship


def test_many_queries_meet_vectors_in_blocks(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(vectorindex, "ROW_BLOCK", 50)
    monkeypatch.setattr(vectorindex, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vectorindex, "WAVES", (1, 3))
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8)).astype(np.float32)
    vectors = [(centres[i % 6] + rng.normal(scale=0.3, size=8)).astype(np.float32).astype(float) for i in range(400)]
    vectors += [vectors[3]] * 150 + [3 * vectors[3]] * 20 + [vectors[3] * (1 + 1e-9 * np.arange(8))] * 20 + [-vectors[4]] * 5
    rows = spark.createDataFrame([(int(i), f"s{i % 4}", v.tolist()) for i, v in zip(rng.permutation(len(vectors)), vectors, strict=True)], "id bigint, source string, vector array<double>").localCheckpoint()
    queries = rows.filter("id % 9 = 1").select(F.col("id").alias("qid"), F.col("vector").alias("q"))
    index = VectorIndex(spark, fresh_path(spark, "vectors-test")).build(rows)
    pairs = rows.crossJoin(queries).select("qid", "id", "source", cosine_distance(F.col("vector"), F.col("q")).alias("distance")).localCheckpoint()
    order = Window.partitionBy("qid").orderBy("distance", "id")
    for sources in (None, ["s1", "s2"]):
        some = pairs if sources is None else pairs.filter(F.col("source").isin(sources))
        want = some.withColumn("at", F.row_number().over(order)).filter("at <= 10").drop("at")
        got = index.nearest(queries, 10, None if sources is None else spark.createDataFrame([(s,) for s in sources], "source string"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    close = index.within(queries, 0.2)
    plan = close._jdf.queryExecution().executedPlan().toString()
    assert "CoGroupsInArrow" in plan and "aggregate(zip_with" not in plan  # a pair of vectors is no row of a join
    assert sorted(map(tuple, close.collect())) == sorted(map(tuple, pairs.filter("distance <= 0.2").collect()))
