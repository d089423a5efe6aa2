"""Joins: chunks to cases, citations to cases, statutes by name, connected and citing cases, resume filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.register import operator
from ..sources.shipping import materialised
from ..sources.tables import BENCH, JUDGEMENTS, LINES, STATUTES, bench, judgements, lines, statutes, table
from .containment import longest_contained

J, S = f"WITH {JUDGEMENTS}", f"WITH {STATUTES}"


@operator(f"WITH {LINES} SELECT d.source, d.lang, count(*) AS chunks, CAST(sum(length(l.text)) AS BIGINT) AS characters FROM l JOIN documents d USING (doc_id) GROUP BY ALL")
def j1_chunks_of_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with their documents."""
    d = table(spark, sf, "documents").select("doc_id", "lang", F.col("source").alias("of"))
    joined = lines(spark, sf).select("doc_id", F.length("text").alias("n")).join(d, "doc_id")
    return joined.groupBy(F.col("of").alias("source"), "lang").agg(F.count("*").alias("chunks"), F.sum("n").alias("characters"))


def resolve_citations(cited: DataFrame, cases: DataFrame, id_col: str = "id", text_col: str = "cited") -> DataFrame:
    """(id_col, case_no, step): the case that each citation names, if any.

    1 equal but for punctuation; 2 number and year, the court's letters deciding between several cases; 3 report key and the
    one case that shares most party names; 4 the longest case number contained. Cases (case_no, report_cite) that are equal
    but for punctuation count as the one that sorts first.
    """
    c = cases.groupBy(T.norm_alnum(F.col("case_no")).alias("norm")).agg(F.min("case_no").alias("case_no"), F.max("report_cite").alias("report_cite")).filter("norm <> ''")
    c = materialised(c, "cases")
    asked = materialised(cited.select(id_col, F.col(text_col).alias("text"), T.norm_alnum(F.col(text_col)).alias("norm")).filter("norm <> ''"), "cited")
    one = asked.join(c.select("norm", "case_no"), "norm").select(id_col, "case_no", F.lit(1).alias("step"))

    numbered = c.select("case_no", F.regexp_replace(F.lower("case_no"), "[^a-z]", "").alias("letters"), F.explode(F.array_distinct(T.case_signatures(F.col("case_no")))).alias("sign"))
    several = numbered.withColumn("n", F.count("*").over(Window.partitionBy("sign")))
    named = asked.select(id_col, "norm", F.posexplode(T.case_signatures(F.col("text"))).alias("pos", "sign"))
    two = named.join(several, "sign").filter((F.col("n") == 1) | ((F.col("letters") != "") & F.col("norm").contains(F.col("letters"))))
    two = two.groupBy(id_col).agg(F.min_by("case_no", F.struct("pos", "case_no")).alias("case_no")).withColumn("step", F.lit(2))

    # cases, and citations, of a report that have the same party names are one class: classes meet, not their members
    reported = c.filter("report_cite <> ''").select("case_no", F.col("report_cite").alias("report"), F.array_sort(T.party_tokens(F.col("case_no"))).alias("words"))
    classes = reported.groupBy("report", "words").agg(F.count("*").alias("k"), F.min("case_no").alias("case_no"))
    classes = materialised(classes.select(F.explode("words").alias("word"), "report", "words", "k", "case_no"), "report-words")
    by_report = asked.select(id_col, F.explode(F.array_distinct(T.report_keys(F.col("text")))).alias("report"), T.party_tokens(F.col("text")).alias("words")).select(id_col, "report", F.explode("words").alias("word"))
    told = by_report.join(classes.select("report", "word").distinct(), ["report", "word"]).groupBy(id_col, "report").agg(F.array_sort(F.collect_set("word")).alias("asked"))
    told = materialised(told, "report-asked")
    shared = told.select("report", "asked").distinct().select("report", "asked", F.explode("asked").alias("word")).join(classes, ["report", "word"])
    shared = shared.groupBy("report", "asked", "words").agg(F.count("*").alias("n"), F.first("k").alias("k"), F.first("case_no").alias("case_no"))
    top = shared.groupBy("report", "asked", "n").agg(F.sum("k").alias("k"), F.min("case_no").alias("case_no"))
    top = top.groupBy("report", "asked").agg(F.max_by(F.struct("k", "case_no"), "n").alias("_best")).filter("_best.k = 1")
    top = told.join(top, ["report", "asked"]).select(id_col, "report", F.col("_best.case_no").alias("case_no"))
    three = top.groupBy(id_col).agg(F.min_by("case_no", "report").alias("case_no")).withColumn("step", F.lit(3))

    found = materialised(one.unionByName(two).unionByName(three), "found")
    left = asked.join(found.select(id_col), id_col, "left_anti")
    long = c.filter(F.length("norm") >= 9)
    four = longest_contained(left, long, id_col).withColumnRenamed("name", "norm").join(long, "norm")
    four = four.groupBy(id_col).agg(F.min_by("case_no", F.struct(-F.length("norm"), "case_no")).alias("case_no")).withColumn("step", F.lit(4))
    return found.unionByName(four).groupBy(id_col).agg(F.min_by("case_no", "step").alias("case_no"), F.min("step").alias("step"))


@operator()
def j2_resolve_citation(spark: SparkSession, sf: str) -> DataFrame:
    """A citation of every case, in another spelling, resolved."""
    j = judgements(spark, sf)
    k = F.col("seq")
    cited = F.when(k % 5 == 0, F.lower("case_no")).when(k % 5 == 1, F.concat(F.lit("S.C. Appeal No. "), F.get(T.case_signatures(F.col("case_no")), F.lit(0)))).when(k % 5 == 2, F.concat("case_no", F.lit(" at p. 7"))).otherwise(F.concat(F.lit("see the decision in "), "case_no", F.lit(", above")))
    return resolve_citations(j.select("seq", cited.alias("cited")).filter("cited IS NOT NULL"), j, "seq", "cited")


def resolve_statutes(cited: DataFrame, known: DataFrame, id_col: str = "id", text_col: str = "cited") -> DataFrame:
    """(id_col, statute, step): 1 an equal name, 2 number and year, 3 the longest name of six letters or more that is contained.

    known: (statute, title, short, act_no, year), short being the title's short name, derived where it is missing. Names are joined by equality, contained ones are found by an automaton over all names.
    """
    known = known if "short" in known.columns else known.withColumn("short", T.statute_short_name(F.col("title")))
    names = known.select("statute", F.explode(F.array(T.norm_alnum(F.col("title")), T.norm_alnum(F.col("short")), T.norm_alnum(F.col("statute")))).alias("norm")).filter("norm <> ''")
    names = names.groupBy("norm").agg(F.min("statute").alias("statute"))
    asked = cited.select(id_col, F.col(text_col).alias("text"), T.norm_alnum(F.col(text_col)).alias("norm")).filter("norm <> ''")
    one = asked.join(names, "norm").select(id_col, "statute", F.lit(1).alias("step"))
    numbered = known.filter("act_no <> '' AND year <> ''").groupBy(F.concat(F.col("act_no").cast("int").cast("string"), F.lit("/"), "year").alias("sign")).agg(F.min("statute").alias("statute"))
    pattern = r"(?i)\bno\.?\s*([0-9]{1,3})\s+of\s+([0-9]{4})"
    sign = F.concat(F.regexp_extract("text", pattern, 1).cast("int").cast("string"), F.lit("/"), F.regexp_extract("text", pattern, 2))
    two = asked.filter(F.col("text").rlike(pattern)).select(id_col, sign.alias("sign")).join(numbered, "sign").select(id_col, "statute", F.lit(2).alias("step"))
    found = one.unionByName(two)
    long = names.filter(F.length("norm") >= 6)
    left = asked.join(found.select(id_col), id_col, "left_anti")
    three = longest_contained(left, long, id_col).withColumnRenamed("name", "norm").join(long, "norm")
    three = three.groupBy(id_col).agg(F.min_by("statute", F.struct(-F.length("norm"), "statute")).alias("statute")).withColumn("step", F.lit(3))
    return found.unionByName(three).groupBy(id_col).agg(F.min_by("statute", "step").alias("statute"), F.min("step").alias("step"))


@operator()
def j3_resolve_statute(spark: SparkSession, sf: str) -> DataFrame:
    """A reference to every statute resolved."""
    named = statutes(spark, sf).select("seq", "title", "act_no", "year", T.statute_label(F.col("title"), F.col("act_no"), F.col("year")).alias("statute"), T.statute_short_name(F.col("title")).alias("short"))
    s = materialised(named, "statutes")  # long expressions, evaluated once
    known = s.select("statute", "title", "short", "act_no", "year")
    k = F.col("seq")
    cited = F.when(k % 3 == 0, F.upper("title")).when(k % 3 == 1, F.concat(F.lit("Section 9 of the "), "short")).otherwise(F.concat(F.lit("Act No. "), F.coalesce(T.nonempty(F.col("act_no")), F.lit("1")), F.lit(" of "), "year"))
    return resolve_statutes(s.select("seq", cited.alias("cited")), known, "seq", "cited")


@operator(J + ", m AS (SELECT filename, (regexp_matches(lower(parties), '\\bcustomer_000000007\\b'))::INT + (regexp_matches(lower(parties), '\\bnation_7\\b'))::INT AS score FROM j WHERE date LIKE '199%') SELECT filename, CAST(score AS INTEGER) AS score FROM m WHERE score > 0 ORDER BY score DESC, filename LIMIT 10")
def j4_by_parties_and_date(spark: SparkSession, sf: str) -> DataFrame:
    """Cases of a decade by whole words of the parties' names, best first."""
    p = F.lower("parties")
    score = p.rlike(r"\bcustomer_000000007\b").cast("int") + p.rlike(r"\bnation_7\b").cast("int")
    return judgements(spark, sf).filter(F.col("date").like("199%")).select("filename", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "filename").limit(10)


@operator(J + ", w AS (SELECT 'nation_7' AS a, 'customer' AS b, '0001' AS c) SELECT filename, CAST(contains(lower(parties), a)::INT + contains(lower(parties), b)::INT + contains(lower(parties), c)::INT AS INTEGER) AS shared FROM j, w WHERE contains(lower(parties), a)::INT + contains(lower(parties), b)::INT + contains(lower(parties), c)::INT >= 2")
def j6_connected_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Cases whose parties contain two or more of the distinct longest words of a case's."""
    p = F.lower("parties")
    shared = sum((p.contains(w).cast("int") for w in ("nation_7", "customer", "0001")), F.lit(0))
    return judgements(spark, sf).select("filename", shared.alias("shared")).filter("shared >= 2")


@operator("WITH e AS (SELECT DISTINCT l_suppkey AS source, l_partkey AS target FROM lineitem) SELECT target AS cited, count(*) AS citing FROM e WHERE source <> target GROUP BY target")
def j7_citing_cases(spark: SparkSession, sf: str) -> DataFrame:
    """How many others cite each case."""
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")).distinct()
    return e.filter("source <> target").groupBy(F.col("target").alias("cited")).agg(F.count("*").alias("citing"))


@operator(f"{J}, {BENCH} SELECT seq, array_to_string(list(display ORDER BY seat), ' | ') AS bench FROM b GROUP BY seq")
def j8_bench_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Each case's bench by seat."""
    seats = bench(spark, sf).groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("seat", "display"))).alias("s"))
    return seats.select("seq", F.array_join(F.transform("s", lambda x: x["display"]), " | ").alias("bench"))


@operator("SELECT d.doc_id, coalesce(CASE WHEN l.quality IS NOT NULL THEN 'indexed ' || l.quality END, CASE WHEN d.n_chars > 2000 THEN 'parsed' END, 'analysis') AS origin FROM documents d LEFT JOIN labels l USING (doc_id)")
def j9_bench_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """The first source that has an answer."""
    l = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("indexed "), F.col("quality").cast("string")).alias("first"))
    return table(spark, sf, "documents").join(l, "doc_id", "left").select("doc_id", F.coalesce("first", F.when(F.col("n_chars") > 2000, "parsed"), F.lit("analysis")).alias("origin"))


@operator("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity > 49)")
def j10_exists(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf, "supplier").join(l, "s_suppkey", "left_semi").select("s_suppkey")


@operator("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j11_not_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that the ledger doesn't have."""
    return table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@operator("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def j12_listing_minus_disk(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


@operator("SELECT p_partkey, coalesce(max(CASE WHEN l_returnflag = 'R' THEN l_shipdate::DATE::VARCHAR END), '') AS carried FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def j13_carry_over(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of an earlier manifest, where it has them."""
    l = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("d"))
    return table(spark, sf, "part").join(l, "p_partkey", "left").select("p_partkey", F.coalesce("d", F.lit("")).alias("carried"))


@operator("WITH u AS (SELECT l_orderkey AS id, 'part ' || (l_partkey % 50) AS name, l_linenumber AS pos, l_suppkey AS tie FROM lineitem), f AS (SELECT id, lower(name) AS name, min(pos * 1000000 + tie) AS first_at FROM u GROUP BY ALL) SELECT id, array_to_string(list(name ORDER BY first_at, name), '; ') AS merged FROM f GROUP BY id")
def j14_merged_lists(spark: SparkSession, sf: str) -> DataFrame:
    """An ordered union without repeats."""
    l = table(spark, sf, "lineitem")
    f = l.groupBy(F.col("l_orderkey").alias("id"), F.lower(F.concat(F.lit("part "), (F.col("l_partkey") % 50).cast("string"))).alias("name")).agg(F.min(F.col("l_linenumber") * 1_000_000 + F.col("l_suppkey")).alias("at"))
    return f.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]), "; ").alias("merged"))
