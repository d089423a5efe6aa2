"""A merge reads what it is given a few times, whatever the number of tables, and meets judgements by file name once."""

import pytest

from quarryspark.sources import library
from quarryspark.sources.library import Library
from quarryspark.sources.shipping import fresh_path


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_a_merge_reads_its_pairs_a_few_times(spark, monkeypatch, tmp_path, broadcast):
    monkeypatch.setattr(library, "BROADCAST_ROWS", broadcast)
    calls, make = str(tmp_path / "calls"), spark.createDataFrame
    lib = Library(spark, fresh_path(spark, "library"))
    lib.change(
        {
            "judgements": make([("a", "K1", 2), ("b", "D1", 3), ("c", "K2", 0), ("d", "D2", 5), ("f", "S", 1), ("g", "S", 4), ("h", "D3", 7), (None, "N", 1), ("i", None, 2)], "filename string, case_no string, n_chunks int"),
            "chunks": make([("K1", "k"), ("D1", "x"), ("D2", "y"), ("S", "s"), (None, "n")], "case_no string, text string"),
            "benches": make([("D1", "J1"), ("D3", "J3"), ("D2", "J4")], "case_no string, judge string"),
        }
    )

    def told(batches):
        for b in batches:
            with open(calls, "a") as f:
                f.writelines(f"{x}\n" for x in b["dropped"])
            yield b

    given = [("b", "a"), ("d", "c"), ("h", "c"), ("g", "a"), ("f", "nowhere"), ("unknown", "a"), ("i", None)]
    lib.merge(make(given, "dropped string, keeper string").coalesce(1).mapInPandas(told, "dropped string, keeper string"))
    read = open(calls).read().split()
    assert max(read.count(x) for x, _ in given) <= 3

    def rows(name):
        return sorted((tuple(r) for r in lib.table(name).collect()), key=str)

    assert rows("judgements") == sorted([("a", "K1", 2), ("c", "K2", 5), ("f", "S", 1), (None, "N", 1), ("i", None, 2)], key=str)  # f's keeper doesn't exist
    assert rows("chunks") == sorted([("K1", "k"), ("K2", "y"), ("S", "s"), (None, "n")], key=str)
    assert rows("benches") == [("K1", "J1"), ("K2", "J4")]
    assert rows("log") == [("b", "D1", "a", "K1", False), ("d", "D2", "c", "K2", False), ("g", "S", "a", "K1", True), ("h", "D3", "c", "K2", False)]
