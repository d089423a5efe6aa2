"""The stored index against brute force, through changes; case search; versions."""

import math
import random
import re
import tracemalloc
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarryspark import catalog
from quarryspark.operators import cases, textindex
from quarryspark.operators.textindex import Phrase, TextIndex
from quarryspark.plans.query import Vocabulary
from quarryspark.sources.shipping import fresh_path, ship
from quarryspark.sources.versions import Conflict, Versions

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def frame(spark, rows):
    ship(spark)
    return spark.createDataFrame(rows, "id bigint, owner string, text string").repartition(3)


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def count(text, phrase):
    own = words(text)
    n = len(phrase.words)
    like = lambda i: own[i : i + n - 1] == list(phrase.words[:-1]) and (own[i + n - 1].startswith(phrase.words[-1]) if phrase.star else own[i + n - 1] == phrase.words[-1])
    return sum(like(i) for i in range(len(own) - n + 1))


def brute(rows, phrases):
    size = {i: max(1, len(words(t))) for i, _, t in rows}
    mean = sum(size.values()) / max(1, len(size))
    f = {i: [count(t, p) for p in phrases] for i, _, t in rows}
    d = [sum(x[k] > 0 for x in f.values()) for k in range(len(phrases))]
    idf = [math.log((len(rows) - x + 0.5) / (x + 0.5)) for x in d]
    part = lambda i, k: (idf[k] if idf[k] > 0 else 1e-6) * f[i][k] * 2.2 / (f[i][k] + 1.2 * (0.25 + 0.75 * size[i] / mean))
    return {i: (f[i], [part(i, k) for k in range(len(phrases))]) for i in f if any(f[i])}


PHRASES = [Phrase(("alpha",)), Phrase(("alpha", "beta")), Phrase(("beta", "ga"), True), Phrase(("del",), True), Phrase(("x",)), Phrase(("alpha", "beta", "alpha"))]


def rows_of(rnd, ids):
    return [(i, f"case {i % 7}", " ".join(rnd.choices(["alpha", "beta", "gamma", "Gabbro", "delta", "x,y"], (5, 4, 3, 1, 1, 1), k=rnd.randrange(0, 40)))) for i in ids]


def same(index, rows):
    want = brute(rows, PHRASES)
    got = {r["id"]: r for r in index.scored(PHRASES).collect()}
    assert {i: [r[f"f{k}"] for k in range(len(PHRASES))] for i, r in got.items()} == {i: f for i, (f, _) in want.items()}
    for i, (_, s) in want.items():
        assert [got[i][f"s{k}"] for k in range(len(PHRASES))] == pytest.approx(s)
    for k in (1, 5):
        terms = ["alpha", "delta", "x", "nowhere"]
        best = brute(rows, [Phrase((t,)) for t in terms])
        order = sorted(((-round(sum(s), 9), i) for i, (_, s) in best.items()))[:k]
        found = [(-round(r["score"], 9), r["id"]) for r in index.top(terms, k).collect()]
        assert [i for _, i in found] == [i for _, i in order]


@pytest.mark.parametrize("blocks", [16, 1])
def test_index_equals_brute_force_through_changes(spark, monkeypatch, blocks):
    monkeypatch.setattr(textindex, "FIRST_BLOCKS", blocks)
    rnd = random.Random(2)
    index, rows = TextIndex(spark, fresh_path(spark, "index-test")), rows_of(rnd, range(40)) + [(60, "case 1", None), (61, "case 2", "alpha " * 300)]
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "6")  # several blocks
    try:
        index.add(frame(spark, rows))
        same(index, rows)
        new = rows_of(rnd, range(100, 130))
        index.replace(frame(spark, new))  # owners case 0 to 6: all of theirs go
        rows = new
        same(index, rows)
        index.delete(spark.createDataFrame([("case 3",), ("case 9",)], "owner string"))
        rows = [r for r in rows if r[1] != "case 3"]
        same(index, rows)
        index.change(add=frame(spark, [(200, "case 3", "alpha beta"), (101, "case 8", "alpha gamma")]), ids=spark.createDataFrame([(101,)], "id bigint"))
        rows = [r for r in rows if r[0] != 101] + [(200, "case 3", "alpha beta"), (101, "case 8", "alpha gamma")]
        same(index, rows)
        before = index.versions.latest()
        index.compact()
        state = index.state()
        assert len(state["segments"]) == 1 and not state["tombs"] and index.versions.latest() == before + 1
        same(index, rows)
        index.versions.drop_unnamed(keep=1)
        same(index, rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_empty_index(spark):
    index = TextIndex(spark, fresh_path(spark, "index-test"))
    assert index.hits([Phrase(("a",))]).count() == 0 and index.top(["a"], 3).count() == 0 and index.statistics() == (0, 0)
    index.add(frame(spark, []))
    index.add(frame(spark, [(1, "a", ""), (2, "a", "?!")]))
    assert index.scored([Phrase(("a",)), Phrase(())]).count() == 0 and index.statistics() == (2, 2)
    index.delete(spark.createDataFrame([("a",)], "owner string"))
    assert index.statistics() == (0, 0)


def test_packed_rows_come_back(monkeypatch):
    rng = random.Random(5)
    for unpack in (1, 40, 1 << 20):
        monkeypatch.setattr(textindex, "UNPACK", unpack)
        rows = []
        for _ in range(60):
            n = rng.choice((1, 1, 2, 9))
            ids = [rng.choice((rng.getrandbits(63), -rng.getrandbits(63), rng.randrange(300), textindex.NO_ID)) for _ in range(n)]
            at = [sorted(rng.sample(range(rng.choice((9, 70_000))), rng.randint(1, 7))) for _ in ids]
            rows.append((ids, [rng.randrange(1, 1 << 31) for _ in ids], [len(a) for a in at], at))
        flat = lambda k: np.array([x for r in rows for x in r[k]])
        steps = np.array([x - y for r in rows for a in r[3] for x, y in zip(a, [0, *a], strict=False)])
        docs = np.array([len(r[0]) for r in rows])
        packed = textindex._packed(docs, flat(0), flat(1), flat(2), steps)
        same = pa.array(docs.astype(np.int32))
        sent = pa.RecordBatch.from_arrays([pa.array(["t"] * len(rows)), pa.array(range(len(rows))), same, same, same, packed, same], ["term", "block", "n", "max_freq", "min_len", "packed", "bucket"])
        back = [r for b in textindex._unpacked(iter([sent])) for r in b.to_pylist()]
        assert [r["block"] for r in back] == list(range(len(rows)))
        assert [(r["docs"], r["lens"], r["freqs"], r["positions"]) for r in back] == [([None if i == textindex.NO_ID else i for i in a], b, c, d) for a, b, c, d in rows]
    assert not list(textindex._unpacked(iter([sent.slice(0, 0)])))


def test_terms_are_packed_some_at_a_time(monkeypatch):
    monkeypatch.setattr(textindex, "TaskContext", type("At", (), {"get": staticmethod(lambda: type("Part", (), {"partitionId": lambda self: 3})())}))
    rng = random.Random(6)
    texts = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randrange(40))] for _ in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array([None if i == 7 else 100 - i for i in range(50)], pa.int64()), pa.array(texts, pa.list_(pa.string()))], ["id", "tokens"])
    want = {t: [(None if i == 7 else 100 - i, len(x), [k for k, w in enumerate(x) if w == t]) for i, x in enumerate(texts) if t in x] for t in {w for x in texts for w in x}}
    for pack in (1, 200, 1 << 20):
        monkeypatch.setattr(textindex, "PACK", pack)
        sent = [b.append_column("bucket", b.column("n")) for b in textindex._inverted(iter([batch]))]
        assert (len(sent) > 1) == (pack < 1 << 20)
        rows = [r for b in textindex._unpacked(iter(sent)) for r in b.to_pylist()]
        assert {r["term"]: list(zip(r["docs"], r["lens"], r["positions"], strict=True)) for r in rows} == want and len(rows) == len(want)
        assert all(r["freqs"] == [len(p) for p in r["positions"]] and r["n"] == len(r["docs"]) and r["max_freq"] == max(r["freqs"]) and r["min_len"] == min(r["lens"]) and r["block"] == 3 << 32 for r in rows)


def test_searches_read_their_buckets_alone(spark):
    for name in ("f2_phrase_and_prefix", "f3_boolean_groups", "f4_bm25", "f8_matching_cases", "r2_keyword_search"):
        text = plan(catalog.queries()[name](spark, SF))
        assert "PartitionFilters: [bucket" in text and "IN (" in text[text.index("PartitionFilters: [bucket") :], name
        assert "documents.parquet" not in text or name == "f8_matching_cases"
    plain = plan(catalog.queries()["f3_boolean_groups"](spark, SF))
    assert "positions" not in "".join(re.findall(r"ReadSchema: struct<[^\n]*", plain)) and "EqualTo(term" in plain or "In(term" in plain


def test_a_block_that_cannot_matter_is_not_read(spark, monkeypatch):
    monkeypatch.setattr(textindex, "FIRST_BLOCKS", 1)
    index = TextIndex(spark, fresh_path(spark, "index-test"))
    for k in range(4):  # a segment of its own each
        index.add(frame(spark, [(10 * k + i, "a", "alpha " * (50 if k == 2 else 1) + "filler " * (0 if k == 2 else 60)) for i in range(5)] + [(10 * k + 9, "a", "other")]).coalesce(1))
    read = []
    plain = TextIndex.hits

    def seen(self, phrases, state=None, blocks=None):
        read.append(blocks)
        return plain(self, phrases, state, blocks)

    monkeypatch.setattr(TextIndex, "hits", seen)
    assert [r["id"] for r in index.top(["alpha"], 3).collect()] == [20, 21, 22]
    assert len(read) == 1 and read[0].count() == 1


def test_versions(spark):
    v = Versions(spark, fresh_path(spark, "versions"))
    assert v.latest() == 0 and v.read() == {}
    assert v.commit({"a": 1}, 0) == 1 and v.commit({"a": 2}, 1) == 2
    with pytest.raises(Conflict):
        v.commit({"a": 3}, 1)
    assert v.read() == {"a": 2} and v.read(1) == {"a": 1}


CASES = [("c1", "f1", "2001-02-03", "Road Board v. Perera", "", "", ""), ("c1", "f2", "2003", "Road Board v. Silva", "", "", ""), ("c2", "f3", "", "Unrelated", "", "", ""), ("c3", "f4", "1999-01-01", "Boardwalk v. Y", "", "urgent", ""), ("c4", "f5", "2002-05-05", "", "", "", "")]


@pytest.fixture(scope="module")
def library(spark):
    index = TextIndex(spark, fresh_path(spark, f"index-{uuid.uuid4().hex}"))
    at = lambda d, p: d << cases.PAGE_BITS | p
    index.add(frame(spark, [(at(1, 1), "c1", "road works at the road"), (at(1, 2), "c1", "nothing"), (at(2, 4), "c2", "the road board met the road board"), (at(2, 5), "c2", "a board of the road"), (at(3, 1), "c3", "sea"), (at(4, 7), "c4", "only roads here"), (at(9, 1), "lost", "road board")]))
    return spark.createDataFrame(CASES, "case_no string, filename string, date string, parties string, judges string, keywords string, legislation string"), index


def found(df):
    return [(r["case_no"], r["why"], r["hits"], r["page"], r["date"]) for r in df.collect()]


def test_case_search_claims_by_the_strictest_tier(spark, library):
    rows, index = library
    hits = cases.keyword_search(rows, index, "road board")
    assert found(hits) == [("c1", "metadata", 1, None, "2003"), ("c2", "phrase", 1, 4, "")]
    assert [r["snippet"] for r in hits.collect()] == ["Road Board v. Silva", "the «road» «board» met the «road» «board»"]
    loose = {r[0]: r[1:4] for r in found(cases.keyword_search(rows, index, "road sea "))}
    assert loose == {"c1": ("broad", 1, 1), "c2": ("broad", 2, 4), "c3": ("broad", 1, 1)}
    assert cases.keyword_search(rows, index, " ").count() == 0
    prefix = {r[0]: r[1:4] for r in found(cases.keyword_search(rows, index, "roads her"))}
    assert prefix == {"c4": ("text", 1, 7)}
    short = {r[0] for r in found(cases.keyword_search(rows, index, "board")) if r[1] == "metadata"}
    assert short == {"c1", "c3"}  # a short word must begin a word


def test_metadata_by_an_acronym(spark, library):
    rows, index = library
    v = Vocabulary(acronyms={"rb": ("road board",)})
    assert found(cases.keyword_search(rows, index, "rb", v))[0][:2] == ("c1", "metadata")


def test_facets(spark, library):
    rows, index = library
    assert cases.faceted_search(rows, index).count() == 0 and cases.faceted_search(rows, index, query=" ").count() == 0
    assert [r["case_no"] for r in cases.faceted_search(rows, index, year="2003").collect()] == ["c1"]
    assert [r["case_no"] for r in cases.faceted_search(rows, index, month="January").collect()] == ["c3"]
    assert [r["case_no"] for r in cases.faceted_search(rows, index, area=([], ["road board", "sea"])).collect()] == ["c3", "c2"]
    near = spark.createDataFrame([("c4", 0.3, 2, "by meaning"), ("c1", 0.1, 1, "x")], "case_no string, distance double, hits bigint, shown string")
    both = cases.faceted_search(rows, index, query="road board", semantic=near)
    assert [(r["case_no"], r["why"], r["hits"]) for r in both.collect()] == [("c1", "metadata", 1), ("c2", "phrase", 1), ("c4", "semantic", 2)]
    assert [r["case_no"] for r in cases.faceted_search(rows, index, query="road board", year="2002", semantic=near).collect()] == ["c4"]


def test_areas(spark, library):
    rows, index = library
    area = cases.area_search(rows, index, ["C1", "c3"], ["road board"])
    assert [(r["case_no"], r["source"], r["page"]) for r in area.collect()] == [("c1", 0, None), ("c3", 0, None), ("c2", 1, 4)]
    assert cases.area_search(rows, index).count() == 0


def test_large_batches_are_several_blocks_of_bounded_memory(monkeypatch):
    """What a task holds to invert a batch doesn't grow with the batch, and no posting is lost between its blocks."""
    monkeypatch.setattr(textindex, "TaskContext", type("At", (), {"get": staticmethod(lambda: type("Part", (), {"partitionId": lambda self: 0})())}))
    rng = np.random.default_rng(7)
    sizes = [1_500_000, *[300] * 10_000, 0]
    words = pa.array([f"w{i}" for i in range(5000)]).take(pa.array(rng.integers(0, 5000, sum(sizes))))
    tokens = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), words)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes)), pa.int64()), tokens], ["id", "tokens"])
    tracemalloc.start()
    blocks, docs, peak = set(), 0, 0
    for b in textindex._inverted(iter([batch])):
        blocks |= set(b.column("block").to_pylist())
        docs += sum(b.column("n").to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    flat = np.repeat(np.arange(len(sizes)), sizes) * 5000 + np.array([int(w[1:]) for w in words.to_pylist()])
    assert len(blocks) == 4 and docs == len(np.unique(flat)) and peak < 150 << 20
