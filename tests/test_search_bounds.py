"""What a search and the build of its index read and shuffle: documents once, and posting rows by block instead of a row a document and word."""

from pyspark.sql import functions as F

from quarryspark.operators import cases
from quarryspark.operators.textindex import Phrase, TextIndex
from quarryspark.sources.shipping import fresh_path


def test_a_segment_takes_its_documents_once(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def told(batches):
        for b in batches:
            with open(calls, "a") as f:
                f.writelines(f"{i}\n" for i in b["id"])
            yield b

    rows = [(i, "o", f"writ of the court {i} of the the of") for i in range(30)]
    docs = spark.createDataFrame(rows, "id bigint, owner string, text string").coalesce(1).mapInPandas(told, "id bigint, owner string, text string")
    index = TextIndex(spark, fresh_path(spark, "index-test"))
    index.add(docs)
    assert sorted(map(int, open(calls).read().split())) == list(range(30))
    found = index.hits([Phrase.of("of the"), Phrase.of("th", star=True), Phrase.of("the of"), Phrase.of("none here")])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(i, 9, 2, 3, 1, 0) for i in range(30)]
    assert plan.count("Exchange") == 1 and "hashpartitioning(segment" in plan and "block" in plan.split("hashpartitioning(")[1].split(")")[0]


def test_judges_are_told_apart_once_a_bench(spark):
    rows = [(f"c{i}", ["Hon. Justice NATION_3, P.C., J.; Building CJ", "Furniture CJ", "Nobody J.", None][i % 4]) for i in range(40)]
    table = spark.createDataFrame(rows, "case_no string, judges string").withColumn("seat", F.lit(1))
    found = cases.judge_cases(table, ["building"], ["furniture"])
    assert {r["case_no"] for r in found.collect()} == {c for c, j in rows if j and ("Building" in j or "Furniture" in j)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "Contains" not in plan  # benches were held against the names beforehand
