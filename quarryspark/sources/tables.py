"""Source tables, and the views of them that stand for the case library: judgements, benches, statutes, listings.

Each view has a SQL twin, a list of common table expressions, so that queries over it can be compared with another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_empty(c: Column) -> Column:
    """Null, '' and '[]' are all empty."""
    return c.isNull() | (c == "") | (c == "[]")


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each judgment document, made of orders and their customers and nations."""
    o, c, n = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    key = F.col("o_orderkey")
    year = F.date_format("o_orderdate", "yyyy")
    number = (key % 997 + 1).cast("string")
    form = key % 4
    volume = (key % 80 + 1).cast("string")
    case_no = (
        F.when(form == 0, F.concat(F.lit("SC/APPEAL/"), number, F.lit("/"), year))
        .when(form == 1, F.concat(F.lit("SC APPEAL "), number, F.lit(" "), F.substring(year, 3, 2)))
        .when(form == 2, F.concat(F.initcap("n_name"), F.lit(" v. "), F.substring("c_name", 1, 18), F.lit(" ("), volume, F.lit(" NLR)")))
        .otherwise(F.concat(F.lit("CA-WRIT-"), number, F.lit("-"), year))
    )
    date = F.when(key % 10 == 0, F.lit("")).when(key % 10 == 1, year).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    cite = F.when(form != 2, F.lit("")).when(key % 3 == 0, F.concat(F.lit("SLR "), year)).otherwise(F.concat(volume, F.lit(" NLR")))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # nation has 25 rows
    return joined.select(
        F.concat(F.lit("case_"), key.cast("string"), F.lit(".pdf")).alias("filename"),
        case_no.alias("case_no"),
        date.alias("date"),
        F.when(key % 13 == 0, F.lit("")).otherwise(F.concat("c_name", F.lit(" v. "), F.initcap("n_name"))).alias("parties"),
        F.concat(F.lit("Hon. Justice "), F.upper("n_name"), F.lit(", P.C., J.; "), F.initcap("c_mktsegment"), F.lit(" CJ")).alias("judges"),
        F.concat(F.lower("o_orderpriority"), F.lit("; "), F.lower("c_mktsegment"), F.lit(", "), F.lower("n_name")).alias("keywords"),
        F.concat(F.lit("Section "), (key % 300).cast("string"), F.lit(" of the Penal Code")).alias("legislation"),
        (key % 40).cast("int").alias("n_chunks"),
        cite.alias("report_cite"),
        key.alias("seq"),
    )


JUDGEMENTS = """j AS (SELECT 'case_' || o_orderkey || '.pdf' AS filename,
  CASE o_orderkey % 4 WHEN 0 THEN 'SC/APPEAL/' || (o_orderkey % 997 + 1) || '/' || strftime(o_orderdate, '%Y')
    WHEN 1 THEN 'SC APPEAL ' || (o_orderkey % 997 + 1) || ' ' || substr(strftime(o_orderdate, '%Y'), 3, 2)
    WHEN 2 THEN upper(n_name[1]) || lower(n_name[2:]) || ' v. ' || substr(c_name, 1, 18) || ' (' || (o_orderkey % 80 + 1) || ' NLR)'
    ELSE 'CA-WRIT-' || (o_orderkey % 997 + 1) || '-' || strftime(o_orderdate, '%Y') END AS case_no,
  CASE o_orderkey % 10 WHEN 0 THEN '' WHEN 1 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date,
  CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE c_name || ' v. ' || upper(n_name[1]) || lower(n_name[2:]) END AS parties,
  'Hon. Justice ' || upper(n_name) || ', P.C., J.; ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' CJ' AS judges,
  lower(o_orderpriority) || '; ' || lower(c_mktsegment) || ', ' || lower(n_name) AS keywords,
  'Section ' || (o_orderkey % 300) || ' of the Penal Code' AS legislation,
  CAST(o_orderkey % 40 AS INTEGER) AS n_chunks,
  CASE WHEN o_orderkey % 4 <> 2 THEN '' WHEN o_orderkey % 3 = 0 THEN 'SLR ' || strftime(o_orderdate, '%Y') ELSE (o_orderkey % 80 + 1) || ' NLR' END AS report_cite,
  o_orderkey AS seq
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each statute, made of parts."""
    p = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    act, year = (key % 90 + 1).cast("string"), (size + 1970).cast("string")
    name = F.initcap("p_name")
    raw = (
        F.when(key % 5 == 0, F.concat(F.lit("Chap "), act, F.lit(" : "), name, F.lit(" Code")))
        .when(key % 5 == 1, F.concat(act, F.lit("/"), year, F.lit(" : "), name, F.lit(" Act (Amendment)")))
        .when(key % 5 == 2, F.concat(name, F.lit(" Act,  No. "), act, F.lit(" of "), year))
        .when(key % 5 == 3, F.concat(name, F.lit(" Act of Sri Lanka")))
        .otherwise(F.lit("English"))
    )
    return p.select(
        F.concat(F.lit("act-"), key.cast("string"), F.lit(".pdf")).alias("filename"),
        raw.alias("title"),
        F.when(key % 3 == 0, act).otherwise(F.lit("")).alias("act_no"),
        F.when(key % 7 == 0, F.lit("")).otherwise(year).alias("year"),
        F.lower(F.regexp_replace("p_type", " ", "-")).alias("category"),
        key.alias("seq"),
    )


STATUTES = """s AS (SELECT 'act-' || p_partkey || '.pdf' AS filename,
  CASE p_partkey % 5 WHEN 0 THEN 'Chap ' || (p_partkey % 90 + 1) || ' : ' || cap || ' Code'
    WHEN 1 THEN (p_partkey % 90 + 1) || '/' || (p_size + 1970) || ' : ' || cap || ' Act (Amendment)'
    WHEN 2 THEN cap || ' Act,  No. ' || (p_partkey % 90 + 1) || ' of ' || (p_size + 1970)
    WHEN 3 THEN cap || ' Act of Sri Lanka' ELSE 'English' END AS title,
  CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 90 + 1 AS VARCHAR) ELSE '' END AS act_no,
  CASE WHEN p_partkey % 7 = 0 THEN '' ELSE CAST(p_size + 1970 AS VARCHAR) END AS year,
  lower(replace(p_type, ' ', '-')) AS category, p_partkey AS seq
  FROM (SELECT *, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS cap FROM part))"""


def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seats of each judgment's bench: (case_no, display, seat), one row for each judge named."""
    j = judgements(spark, sf_dir)
    return j.select("case_no", "seq", F.posexplode(F.split("judges", "; ")).alias("seat", "display"))


BENCH = "b AS (SELECT case_no, seq, CAST(unnest(range(len(string_split(judges, '; ')))) AS INTEGER) AS seat, unnest(string_split(judges, '; ')) AS display FROM j)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents: (doc_id, page, para, text), a page is a line, as the texts have no blank lines."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumn("page", F.col("pos") + 1).drop("pos")


LINES = "l AS (SELECT doc_id, source, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INTEGER) AS page, unnest(string_split(text, chr(10))) AS text FROM documents)"
