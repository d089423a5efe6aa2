"""Unit vectors, brute force on small inputs, and shapes of plans."""

import itertools
import math
import re
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quarryspark.functions import names
from quarryspark.functions import text as T
from quarryspark.operators import analysis, dedupe, extract, resolve, search
from quarryspark.operators.textindex import TextIndex
from quarryspark.plans.query import Vocabulary, metadata_variants, tiers
from quarryspark.sources.listing import archive_records, crawl, crawlable, upsert
from quarryspark.sources.shipping import fresh_path

VOCABULARY = Vocabulary(
    acronyms={"rda": ("road development authority",), "cpc": ("petroleum corporation", "civil procedure code"), "hrc": ("human rights commission",), "hrcx": ("human rights commission",)},
    synonyms={"sacking": ("termination of employment", "dismissal")},
)


def shown(tier):
    return tier.name, [list(g) for g in tier.groups], tier.star


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("bunker fuel related cases", [("phrase", [["bunker fuel"]], False), ("all", [["bunker"], ["fuel"]], False), ("any", [["bunker"], ["fuel"]], False)]),
        ("RDA", [("phrase", [["rda", "road development authority"]], False), ("all", [["rda", "road development authority"]], True)]),
        ('"natural justice" bias', [("phrase", [["natural justice"], ["bias"]], False), ("all", [["natural justice"], ["bias"]], True), ("any", [["natural justice"], ["bias"]], True)]),
        ("road development authority", [("phrase", [["road development authority", "rda"]], False), ("all", [["road development authority", "rda"]], True)]),
        ("of the", [("phrase", [["of the"]], False), ("all", [["of"], ["the"]], True), ("any", [["of"], ["the"]], True)]),
        ("human rights commission ", [("phrase", [["human rights commission", "hrcx"]], False), ("all", [["human rights commission", "hrcx"]], True)]),
        ("", []),
    ],
)
def test_tiers(query, want):
    assert [shown(t) for t in tiers(query, VOCABULARY)] == want


def test_metadata_variants():
    assert metadata_variants("cpc", VOCABULARY) == ["cpc", "petroleum corporation", "civil procedure code"]
    assert metadata_variants("Road Development Authority", VOCABULARY) == ["Road Development Authority", "rda"]
    assert len(metadata_variants("x", VOCABULARY, lambda _: [str(i) for i in range(30)])) == 12


def one(spark, make, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(make(*map(F.col, names)).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("make", "values", "want"),
    [
        (T.case_signatures, ("SC/FR/272/2016",), ["272/2016"]),
        (T.case_signatures, ("SC FR Application 272/2016",), ["272/2016"]),
        (T.case_signatures, ("SC FR 446 19",), ["446/2019"]),
        (T.case_signatures, ("1 99 and 2/1980 and 3-456",), ["1/1999", "2/1980", "3/19456"]),
        (T.report_keys, ("(1943) 45 N.L.R. 73",), ["45 NLR"]),
        (T.report_keys, ("[1982] 1 Sri L.R. 18",), ["SLR 1982"]),
        (T.report_cite, ("new-law-reports-volume-068",), "68 NLR"),
        (T.report_cite, ("sri-lanka-law-reports-1982",), "SLR 1982"),
        (T.statute_short_name, ("Chap 19 : Penal Code",), "Penal Code"),
        (T.statute_short_name, ("25/2021 : Penal Code (Amendment)",), "Penal Code (Amendment)"),
        (T.statute_short_name, ("Constitution of Sri Lanka",), "Constitution"),
        (T.statute_label, ("Online  Safety Act,", "9", "2024"), "Online Safety Act, No. 9 of 2024"),
        (T.statute_label, ("Safety Act", "", "2024"), "Safety Act (2024)"),
        (T.canonical_judge, ("J.A.N. de Silva CJ",), "jandesilva"),
        (T.canonical_judge, ("Hon. J.A.N. De Silva, C.J.",), "jandesilva"),
        (T.date_key, ("2020",), 2020),
        (T.date_key, ("2020-01-01",), 20200101),
        (T.date_key, (None,), 0),
        (T.citation_terms, ("SC Appeal 12/2020 Perera v. Silva",), "Perera Silva"),
        (dedupe.group_key, ("SC/APPEAL/243/2014",), "scappeal|243/2014"),
        (dedupe.group_key, ("SC APPEAL 243 14",), "scappeal|243/2014"),
        (dedupe.group_key, ("no number",), None),
        (extract.paragraphs, ("a\n\nb\n \nc",), ["a b c"]),
        (extract.paragraphs, ("",), []),
        (extract.paragraphs, ("x" * 3000,), ["x" * 3000]),
        (extract.paragraphs, ("\n".join(["y" * 700] * 3),), ["y" * 700] * 3),
    ],
)
def test_column_functions(spark, make, values, want):
    assert one(spark, make, *values) == want


@pytest.mark.parametrize(
    ("pages", "want"),
    [
        (["Before : Hon. Justice Mahinda Samayawardhena\nRanil Perera, J.\nCounsel : X"], ["Mahinda Samayawardhena, J.", "Ranil Perera, J."]),
        (["1978 Present: Perera, Silva and Fernando, JJ."], ["Perera, J.", "Silva, J.", "Fernando, J."]),
        (["text", "x", "y", "z", "Ranil Perera, J.\nI agree.\n\n\n\n\n"], ["Ranil Perera, J."]),
        (["caption\nRanil Perera, J.\nMary Silva, C.J.\nmore text"], ["Ranil Perera, J.", "Mary Silva, C.J."]),
        (["nothing here, before the court"], []),
        ([""], []),
    ],
)
def test_bench(pages, want):
    assert names.bench(pages) == want


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("1. Hon. Justice Ann Perera", "Ann Perera, J."),
        ("S. N. Silva, P.C., J.", "S. N. Silva, P.C., J."),
        ("A. Fernando, Acting Chief Justice", "A. Fernando, A.C.J."),
        ("P E R E R A,  C. J.", "Perera, C.J."),
        ("Silva, J. I agree", None),
        ("Ann Perera", None),
        ("Justice Perera", None),
        ("", None),
    ],
)
def test_judge_lines(line, want):
    assert names.judge(line) == want


def test_authors():
    assert names.author("Ann Perera, J.\nThe appellant sued the bank.") == "Ann Perera, J."
    assert names.author("as was said Per Weeramantry J in that case") == "Weeramantry, J."
    assert names.author("nobody is named here") == ""


def test_parties():
    assert names.parties("1. Ann Perera 2. Bob Silva Plaintiffs Vs. The Bank Defendant-Respondent-Respondent") == [("Ann Perera", "Plaintiffs", "petitioner"), ("Bob Silva", "Plaintiffs", "petitioner"), ("The Bank", "Defendant-Respondent", "respondent")]
    assert names.parties("Ann Perera Vs. Bob Silva") == [("Ann Perera", "", "petitioner"), ("Bob Silva", "", "respondent")]
    assert names.parties("") == []


def test_names_and_dates():
    assert names.short_case_name("A. A. GUNAWARDENA Appellant and Mrs. R. K. D. GUNAWARDENA Respondent") == "Gunawardena v. Gunawardena"
    assert names.author("Held. Pathirana, J.— The appeal") == "Pathirana, J."
    assert extract.date_from_text("Argued 2 May 2001. Decided on 3rd June, 2002. On 1/1/2020") == "2002-06-03"
    assert extract.date_from_text("none") == ""
    one = names.Person.read
    assert one("Hon. Justice S. Rajapakse, J.").same(one("Sunil Rajapaksa"))
    assert not one("A. de Silva").same(one("A. Silva"))
    assert one("Mr. and Mrs.") is None and one("Hon.Justice K. de Abrew and another").shown() == "K. de Abrew"


def test_names_set_letter_by_letter():
    assert names.judge("P E R E R A, J.") == "Perera, J."
    assert names.judge("V Y T H IA L IN G A M, J.") == "Vythialingam, J."
    assert names.judge("A. H. M. D. Nawaz, J.") == "A. H. M. D. Nawaz, J."
    assert names.author("W I T H E R S, J.\nThe appellant") == "Withers, J."


def test_author_of_several_lines():
    assert names.author("SILVA, J.\nDIAS, J.\nThe plaintiff sued") == "Dias, J."
    assert names.author("SILVA, J.\nDIAS, J.\n") == "Dias, J."
    assert names.author("SILVA, J.\nDIAS, J.\nsued. Per Soza, J., later. Held by ABRAMS C.J. – yes") == "Abrams, C.J."
    assert names.author("Permissibility. Vythialingam, J. The petitioner") == "Vythialingam, J."
    assert names.author("the judge J. said") == ""


@pytest.mark.parametrize("raw", ["Supreme Court", "I agree", "Justice", "The Petitioner", "Order of Silva", "", "J."])
def test_what_is_no_person(raw):
    assert names.Person.read(raw) is None


def test_persons_behind_other_words():
    assert names.Person.read("Judgment of Hon. Justice Silva").shown() == "Silva"
    assert names.Person.read("Before: A. B. de Silva, J.").shown() == "A. B. de Silva"
    assert names.Person.read("Sisira de Abrew and Perera, JJ").shown() == "Sisira de Abrew"


@pytest.mark.parametrize(
    ("text", "want"),
    [("On 12-03-1999", "1999-03-12"), ("decided 1.2.1950 and 3 May 1949", "1949-05-03"), ("decided 1.2.1950 and then 3.4.1949", "1950-02-01"), ("decided May 3, 1960. Decided on 4th June 1959", "1959-06-04"), ("June 4. 2001 x", "2001-06-04"), ("31/12/2030 1/1/1899", ""), ("5 May2001", ""), ("1 - 2 - 1999", ""), ("Decided 9 May 2001, 10 May 2002", "2001-05-09")],
)
def test_dates_of_texts(text, want):
    assert extract.date_from_text(text) == want


def test_italic_citations():
    runs = [(1, "Silva"), (1, "v Perera"), (1, "[1992] 1 SLR 3"), (1, "inter alia"), (2, "Dias (1992)"), (2, "(1943) 45 N.L.R. 73"), (3, "obiter dicta"), (4, "SC Appeal 5/2001"), (5, "A vs. B"), (6, "silva V PERERA [1992] 1 slr 3")]
    assert analysis.italic_citations(runs) == [(1, "Silva v Perera [1992] 1 SLR 3", "case"), (2, "Dias (1992)", "reporter"), (2, "(1943) 45 N.L.R. 73", "reporter"), (4, "SC Appeal 5/2001", "reporter"), (5, "A vs. B", "case")]


def test_outline_of_nested_values():
    value = {"cause_of_action": "debt", "parties": [{"name": "A", "roles": ["x", None, "y"]}, "B", []], "n": None, "deep": {"k": {"z": 1}}}
    assert analysis.outline(value) == ["Cause Of Action: debt", "Parties:", "  • Name: A", "  Roles:", "    • x", "    • y", "  • B", "N: None", "Deep:", "  K:", "    Z: 1"]
    assert analysis.outline(["a", {"b": 1, "c": 2}]) == ["• a", "• B: 1", "C: 2"] and analysis.outline(3) == ["3"] and analysis.outline([]) == []


def test_legislation_of_an_answer():
    told = [{"statute": "Not specified in the text"}, "Section 5 of the Penal Code", {"x": "", "y": "Evidence Ordinance, Section 32"}, "N/A", "the facts", ["Article 12 of the Constitution"], "Evidence Ordinance, Section 32"]
    found, kept = analysis.legislation(told, ["Silva v. Perera", {"case_name": "Customs Ordinance, No. 17 of 1869"}, {"case_name": "The Act v. The Code"}])
    assert found == ["Section 5 of the Penal Code — Section 5", "Evidence Ordinance — Section 32", "Article 12 of the Constitution — Article 12", "Customs Ordinance, No. 17 of 1869"]
    assert kept == ["Silva v. Perera", {"case_name": "The Act v. The Code"}]
    assert analysis.legislation("Penal Code", []) == (["Penal Code"], []) and analysis.legislation(None, []) == ([], [])


def test_sounds_are_the_same_in_both_forms(spark):
    raw = ["Rajapakshe", "Weerasinghe", "Whyte", "", "Thhaa", "Fonseka-Silva 3"]
    got = spark.createDataFrame([(x,) for x in raw], "n string").select(extract.phonetic_key(F.col("n"))).collect()
    assert [r[0] for r in got] == [names.sound(x) for x in raw]


def test_crawl(spark):
    links = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (4, 5), (5, 5), (9, 1), (2, None)], "a bigint, b bigint")
    start = spark.createDataFrame([(1,), (None,)], "node bigint")
    want = [(1, 0, None), (2, 1, 1), (3, 1, 1), (4, 2, 2), (5, 3, 4)]
    assert sorted(tuple(r) for r in crawl(links, start).collect()) == want
    assert sorted(tuple(r) for r in crawl(links, start, most=3).collect()) == want[:3]
    urls = [("http://a.org/x/", True), ("https://b.a.org/y.html", True), ("http://ba.org/", False), ("http://a.org/x.PDF", False), ("http://a.org/?add-to-cart=1", False), ("nothing", False)]
    assert [r[0] for r in spark.createDataFrame([u[:1] for u in urls], "u string").select(crawlable(F.col("u"), "a.org")).collect()] == [w for _, w in urls]


@pytest.mark.parametrize(("raw", "want"), [('```json\n{"a": 1}\n```', {"a": 1}), ('<think>{"b": 2}</think>{"a": [1, 2,], }', {"a": [1, 2]}), ('{"a": {"b": "c', {"a": {"b": "c"}}), ("[1, 2]", None), ("none", None)])
def test_repair_json(raw, want):
    assert extract.repair_json(raw) == want


def test_archive_rows():
    html = "<table><tr><th>x</th></tr><tr><td data-order='2020-01-02'>2 Jan</td><td class='case-code'><b>SC 1/2020</b></td><td>A v B</td><td>J; K</td><td>a, b\nc</td><td><a href='/d/x%20y.pdf'>get</a></td></tr><tr><td>no link</td></tr></table>"
    assert archive_records(html, "https://example.org/list") == [{"filename": "x y.pdf", "url": "https://example.org/d/x%20y.pdf", "case_no": "SC 1/2020", "date": "2020-01-02", "parties": "A v B", "judges": ["J", "K"], "keywords": ["a", "b", "c"]}]


def test_loose_tier_only_without_stricter(spark):
    index = TextIndex(spark, fresh_path(spark, "index-units"))
    index.add(spark.createDataFrame([(1, "o", "alpha beta"), (2, "o", "alpha"), (3, "o", "gamma")], "id bigint, owner string, text string"))
    assert [(r["id"], r["tier"]) for r in search.tiered_hits(index, "alpha beta ", Vocabulary()).collect()] == [(1, 1)]
    assert sorted((r["id"], r["tier"]) for r in search.tiered_hits(index, "alpha gamma ", Vocabulary()).collect()) == [(1, 3), (2, 3), (3, 3)]


def test_fuzzy_equals_brute_force(spark):
    terms = ["rajapakse", "rajapaksha", "rajapaksa", "rajapakshalage", "perera", "silva", "rajah"]
    df = spark.createDataFrame([(t,) for t in terms], "term string")
    got = [r["term"] for r in search.fuzzy(df, spark.createDataFrame([("rajapakshe",)], "token string")).orderBy("rank").collect()]
    want = sorted(((SequenceMatcher(None, "rajapakshe", t).ratio(), t) for t in terms), reverse=True)
    assert got == [t for r, t in want if r >= 0.82]


def test_resolution_cascade(spark):
    cases = spark.createDataFrame([("SC/FR/272/2016", ""), ("SC APPEAL 5 19", ""), ("CA 5/2019", ""), ("Perera v. Gunawardena (45 NLR)", "45 NLR"), ("Silva v. Fernando (45 NLR)", "45 NLR")], "case_no string, report_cite string")
    asked = ["sc fr 272 2016", "SC FR Application 272/2016", "CA No 5/19", "Silva v. Someone (1943) 45 N.L.R. 73", "see Perera v. Gunawardena (45 NLR) at 3", "Unknown 9/1999", ""]
    got = {r["id"]: (r["case_no"], r["step"]) for r in resolve.resolve_citations(spark.createDataFrame(list(enumerate(asked)), "id bigint, cited string"), cases).collect()}
    assert got == {0: ("SC/FR/272/2016", 1), 1: ("SC/FR/272/2016", 2), 2: ("CA 5/2019", 2), 3: ("Silva v. Fernando (45 NLR)", 3), 4: ("Perera v. Gunawardena (45 NLR)", 3)}


def test_statute_cascade(spark):
    known = spark.createDataFrame([("Penal Code", "Penal Code", "", ""), ("Penal Code (Amendment)", "25/2021 : Penal Code (Amendment)", "25", "2021")], "statute string, title string, act_no string, year string")
    asked = ["penal code", "Section 304 of the Penal Code", "the Penal Code (Amendment), s. 2", "Act No. 25 of 2021", "Nothing"]
    got = {r["id"]: (r["statute"], r["step"]) for r in resolve.resolve_statutes(spark.createDataFrame(list(enumerate(asked)), "id bigint, cited string"), known).collect()}
    assert got == {0: ("Penal Code", 1), 1: ("Penal Code", 3), 2: ("Penal Code (Amendment)", 3), 3: ("Penal Code (Amendment)", 2)}


def test_twins_chain_and_strangers(spark):
    base = "".join(f"word{i} " for i in range(60))
    near, far = base.replace("word10 ", "other "), "".join(f"else{i} " for i in range(60))
    rows = [(1, base, "b"), (2, near, "b"), (3, base, "b"), (4, far, "b"), (5, base.replace("word20 ", "x "), "c"), (6, "short", "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, block string")
    got = {r["doc_id"]: r["cluster"] for r in dedupe.twins(df, F.col("block"), autojunk=False).collect()}
    assert got[1] == got[2] == got[3] and len({got[1], got[4], got[5], got[6]}) == 4


def test_every_turn_is_planned_whole(spark):
    from quarryspark import catalog

    sf = "/root/testdata/sf0.001"
    turns = [r for r in spark.read.parquet(f"{sf}/conversations.parquet").collect() if r["text"] is not None]
    assert any(len(r["text"]) > 80 for r in turns)
    want = {(f"{r['conv_id']}/{r['turn']}", i, x.name, len(x.groups), x.star) for r in turns for i, x in enumerate(tiers(r["text"], Vocabulary()))}
    assert {tuple(r) for r in catalog.queries()["q8_tiers"](spark, sf).collect()} == want


def test_connected_crosses_long_chains(spark):
    chain = [(i, i + 1) for i in range(1, 131)] + [(200 - i, 201 - i) for i in range(0, 3)] + [(500, 500)]
    got = {r["node"]: r["root"] for r in dedupe.connected(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 132)}, **{i: 198 for i in range(198, 202)}, 500: 500}


def test_upsert_fills_missing_texts(spark):
    old = spark.createDataFrame([(1, "a", "x", 0), (2, "b", "y", 0)], "k int, v string, w string, seq int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 1)], "k int, v string, seq int")
    assert sorted(tuple(r) for r in upsert(old, new, ["k"], "seq").select("k", "v", "w").collect()) == [(1, "a", "x"), (2, "c", ""), (3, "d", "")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    from quarryspark import catalog

    sf, q = "/root/testdata/sf0.001", catalog.queries()
    assert "CartesianProduct" not in plan(q["q6_fuzzy_variants"](spark, sf))
    assert plan(q["r8_combined_search"](spark, sf)).count("Exchange hashpartitioning(case_no") == 1
    assert "TakeOrderedAndProject" in plan(q["r2_keyword_search"](spark, sf))
    scan = plan(q["j11_not_indexed"](spark, sf))
    assert "text" not in "".join(re.findall(r"ReadSchema: struct<[^>]*>", scan))
    assert "PushedFilters" in plan(q["j10_exists"](spark, sf)) and "GreaterThan(l_quantity" in plan(q["j10_exists"](spark, sf))


def test_tokens_are_the_same_in_python(spark):
    texts = ["Élan vital", "don't stop_now 12½ ǅ", "日本 x", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.tokens(F.col("t"))).collect()
    assert [r[0] for r in got] == [T.plain_tokens(t) for t in texts] and got[0][0] == ["elan", "vital"]
