"""Renames and merges over all tables of the case library."""

import pytest

from quarryspark.sources.library import Library
from quarryspark.sources.shipping import fresh_path


@pytest.fixture
def library(spark):
    lib = Library(spark, fresh_path(spark, "library"))
    make = spark.createDataFrame
    lib.change(
        {
            "judgements": make([("a", "K1", 2), ("b", "D1", 3), ("c", "K2", 0), ("d", "D2", 5), ("e", "D2", 1), ("f", "S", 1), ("g", "S", 4), ("h", "D3", 7)], "filename string, case_no string, n_chunks int"),
            "chunks": make([("K1", "k"), ("D1", "x"), ("D2", "y"), ("D2", "z"), ("S", "s"), ("D3", "w")], "case_no string, text string"),
            "benches": make([("D1", "J1"), ("D3", "J3"), ("K2", "J2"), ("D2", "J4")], "case_no string, judge string"),
            "bookmarks": make([(1, "K1"), (1, "D1"), (2, "D1"), (3, "D2"), (3, "D3"), (4, "S")], "user int, case_no string"),
        }
    )
    return lib


def rows(lib, name, number=None):
    return sorted(tuple(r) for r in lib.table(name, number).collect())


PAIRS = [("b", "a"), ("d", "c"), ("e", "c"), ("h", "c"), ("g", "a")]


def test_merge_reaches_all_tables(spark, library):
    library.merge(spark.createDataFrame(PAIRS, "dropped string, keeper string"))
    assert rows(library, "judgements") == [("a", "K1", 2), ("c", "K2", 5), ("f", "S", 1)]
    assert rows(library, "chunks") == [("K1", "k"), ("K2", "y"), ("K2", "z"), ("S", "s")]  # K1 has chunks; D2's come before D3's
    assert rows(library, "benches") == [("K1", "J1"), ("K2", "J2")]
    assert rows(library, "bookmarks") == [(1, "K1"), (2, "K1"), (3, "K2"), (4, "S")]
    assert rows(library, "log") == [("b", "D1", "a", "K1", False), ("d", "D2", "c", "K2", False), ("e", "D2", "c", "K2", False), ("g", "S", "a", "K1", True), ("h", "D3", "c", "K2", False)]
    assert rows(library, "chunks", 1) == [("D1", "x"), ("D2", "y"), ("D2", "z"), ("D3", "w"), ("K1", "k"), ("S", "s")]


def test_rename_reaches_all_tables(spark, library):
    library.rename(spark.createDataFrame([("D2", "N2"), ("none", "x"), (None, "y")], "old string, new string"))
    assert [r for r in rows(library, "judgements") if r[0] in "de"] == [("d", "N2", 5), ("e", "N2", 1)]
    assert ("N2", "J4") in rows(library, "benches") and (3, "N2") in rows(library, "bookmarks") and not any("D2" in r for n in library.tables() for r in rows(library, n))


def test_a_merge_that_dies_leaves_the_version_before(spark, library, monkeypatch):
    fresh, seen = library.versions.fresh, []

    def dies(name):
        seen.append(name)
        if len(seen) == 3:
            raise OSError("no more")
        return fresh(name)

    monkeypatch.setattr(library.versions, "fresh", dies)
    before = {n: rows(library, n) for n in library.tables()}
    with pytest.raises(OSError):
        library.merge(spark.createDataFrame(PAIRS, "dropped string, keeper string"))
    assert library.versions.latest() == 1 and {n: rows(library, n) for n in library.tables()} == before
    monkeypatch.undo()
    library.merge(spark.createDataFrame(PAIRS, "dropped string, keeper string"))
    assert rows(library, "judgements") == [("a", "K1", 2), ("c", "K2", 5), ("f", "S", 1)]


def test_nothing_to_merge(spark, library):
    library.merge(spark.createDataFrame([], "dropped string, keeper string"))
    assert len(rows(library, "judgements")) == 8 and rows(library, "log") == []
