"""Queries against their SQL twins on small tables with rows that the samples don't have."""

import random
import time

import duckdb
import pytest

from quarryspark import catalog
from quarryspark.functions import names
from quarryspark.operators import containment, extract, pipelines, resolve


def both(spark, folder, name, **tables):
    """(rows of the query, rows of its SQL) on tables given as SQL."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    df = catalog.queries()[name](spark, str(folder))
    return sorted(map(tuple, df.collect()), key=repr), sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall(), key=repr)


@pytest.mark.parametrize("name", ["i11_login_throttle", "i11_throttle_stream"])
def test_throttle_counts_fractions_of_seconds(spark, tmp_path, name):
    times = ["00:00:00.1", "00:04:58.1", "00:04:59.9", "00:05:00.5", "00:05:00.5", "00:09:59.499999", "00:09:59.5"]
    events = " UNION ALL ".join(f"SELECT {i}::BIGINT AS event_id, TIMESTAMP '2024-01-01 {t}' AS ts, 7::BIGINT AS user_id, 'error' AS event_type" for i, t in enumerate(times))
    got, want = both(spark, tmp_path, name, events=events)
    assert got == want and [r[2] for r in got] == [1, 2, 2, 4, 4, 3, 4]


def test_expansion_hook_upper_cases_letter_by_letter(spark, tmp_path):
    texts = ["Erßi nada", "ßßßßß", "ŉab", "ﬁx", "ñandú", "ǆ", "", "ab"]
    got, want = both(spark, tmp_path, "q10_expansion_hook", benchmark=" UNION ALL ".join(f"SELECT {i}::BIGINT AS item_id, '{t}' AS text" for i, t in enumerate(texts)))
    assert got == want and got[0] == (0, "Erßi nada, ERẞI")


def test_batch_extractor_takes_empty_null_and_foreign_texts(spark, tmp_path):
    texts = ["'Abc DEF'", "''", "'   '", "chr(10) || chr(9)", "NULL", "'ΑΣ ΟΔΟΣ Σ'", "'İSTANBUL Iı'", "'ẞ ǅ ŉ ﬁ ÀÉ 𐐀'", "'a' || chr(0) || 'B'"]
    rows = [f"SELECT {9007199254740993 + i}::BIGINT AS doc_id, {t} AS text" for i, t in enumerate(texts)] + ["SELECT NULL, 'Null ID'", "SELECT 1, (SELECT string_agg(chr(i::INT), '' ORDER BY i) FROM range(1, 55296) r(i))"]
    got, want = both(spark, tmp_path, "i9_batch_extractor", documents=" UNION ALL ".join(rows))
    assert got == want and len(got) == len(rows)


def test_failing_calls_are_rows_after_their_retries():
    calls = []

    def work(text):
        calls.append(text)
        if text == "bad" or len(calls) < 2:
            raise ValueError(f"no {text}")
        return text.upper()

    row = pipelines.with_retries(work)
    assert [row(t) for t in ("good", "bad", None)] == [("GOOD", None), (None, "no bad"), (None, None)] and calls == ["good"] * 2 + ["bad"] * 3


def test_long_names_are_found_by_grams_without_an_automaton(spark, monkeypatch):
    monkeypatch.setattr(containment, "GRAM", 3)
    monkeypatch.setattr(containment, "_finder", None)  # names of GRAM letters or more never get there
    rnd = random.Random(5)
    names = ["".join(rnd.choices("abc", k=rnd.randrange(3, 8))) for _ in range(80)] + ["aaaa", "aaaa", None]
    texts = [(i, "".join(rnd.choices("abcd", k=rnd.randrange(0, 40)))) for i in range(80)] + [(80, None), (81, "aa"), (82, "dddd"), (83, "aaaaa"), (84, "aaaaa")]
    got = containment.longest_contained(spark.createDataFrame(texts, "id bigint, norm string"), spark.createDataFrame([(n,) for n in names], "norm string"), "id")
    want = set()
    for i, t in texts:
        held = [n for n in names if n and t and n in t]
        want |= {(i, n) for n in held if len(n) == max(map(len, held))}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_citations_of_a_report_meet_by_classes_of_parties(spark):
    """Cases of one report with the same party names tie, however many they are; another is found beside them."""
    cases = [(f"Nation v. Customer {i:05} (7 NLR)", "7 NLR") for i in range(4000)] + [("Nation v. Perera (7 NLR)", "7 NLR")]
    asked = [(i, f"nation against customer, 7 NLR 1{i:04}") for i in range(4000)] + [(5000, "Nation and Perera, 7 NLR 3"), (5001, "Perera, 8 NLR 3")]
    df = resolve.resolve_citations(spark.createDataFrame(asked, "id bigint, cited string"), spark.createDataFrame(cases, "case_no string, report_cite string"))
    assert [tuple(r) for r in df.collect()] == [(5000, "Nation v. Perera (7 NLR)", 3)]


def greedy(rows):
    """The clusters of group_names, every name held against every member before it."""
    clusters = []
    for name, n in sorted(rows, key=lambda r: (-r[1], r[0])):
        if p := names.Person.read(name):
            home = next((c for c in clusters if any(p.same(q) for *_, q in c)), None)
            if home is None:
                clusters.append(home := [])
            home.append((name, n, p))
    return sorted((name, max(c, key=lambda x: (len(x[2].sounds[1]), x[1]))[2].shown()) for c in clusters for name, *_ in c)


def test_names_are_grouped_as_by_brute_force(spark):
    rnd = random.Random(11)

    def word(low, high):
        return "".join(rnd.choice("bkrnst") + rnd.choice("aiu") for _ in range(rnd.randrange(low, high))).title()

    stems = [word(2, 10) for _ in range(25)]

    def spelt():
        s = list(rnd.choice(stems))
        for _ in range(rnd.randrange(3)):
            s[rnd.randrange(1, len(s))] = rnd.choice(["", "a", "k", "r", "st"])
        given = rnd.choice(["", "A. ", "B. C. ", "Ranil ", "Ranal ", "Mary Ann ", "de "])
        return f"Justice {given}{''.join(s)}, J."

    rows = [(name, rnd.randrange(1, 4)) for name in sorted({spelt() for _ in range(500)})]
    assert sorted(map(tuple, extract.group_names(spark.createDataFrame(rows, "name string, n bigint")).collect())) == greedy(rows)


def test_many_names_are_grouped_in_time(spark):
    rows = [(f"Justice Supplier {str(i).zfill(9).translate(str.maketrans('0123456789', 'abcdefghij'))}", 1) for i in range(0, 60_000, 7)]
    begin = time.monotonic()
    assert extract.group_names(spark.createDataFrame(rows, "name string, n bigint")).count() == len(rows)
    assert time.monotonic() - begin < 90
