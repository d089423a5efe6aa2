"""Deduplication of documents: blocks, verdicts on content, components, survivorship, and its application."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.register import operator
from ..sources.library import Library
from ..sources.shipping import fresh_path, materialised
from ..sources.tables import JUDGEMENTS, is_empty, judgements, table
from .likeness import Texts

#: Characters of normalised text that d2_content_keys counts at most, the least that can be compared, and the ratio that makes texts the same.
CAP, COMPARABLE, SAME = 30_000, 200, 0.90
J = f"WITH {JUDGEMENTS}"


def group_key(case_no: Column) -> Column:
    """Court letters and sorted distinct signatures of a case number; null without a signature."""
    signs = F.array_sort(F.array_distinct(T.case_signatures(case_no)))
    return F.when(F.size(signs) > 0, F.concat(F.regexp_replace(F.lower(case_no), "[^a-z]", ""), F.lit("|"), F.array_join(signs, ";")))


SIGN = r"regexp_extract_all(case_no, '([0-9]{{1,4}})\s*[/\- ]\s*([0-9]{{2,4}})', {})[1]"


@operator(J + f", k AS (SELECT filename, regexp_replace(lower(case_no), '[^a-z]', '', 'g') AS letters, {SIGN.format(1)} AS n, {SIGN.format(2)} AS y FROM j) SELECT filename, CASE WHEN n IS NOT NULL THEN letters || '|' || n || '/' || CASE WHEN length(y) = 4 THEN y WHEN CAST(y AS INTEGER) < 50 THEN '20' || y ELSE '19' || y END END AS key FROM k")
def d1_group_key(spark: SparkSession, sf: str) -> DataFrame:
    return judgements(spark, sf).select("filename", group_key(F.col("case_no")).alias("key"))


@operator("SELECT doc_id, md5(text) AS digest, CAST(length(left(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 30000)) AS BIGINT) AS comparable FROM documents")
def d2_content_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"), F.length(F.left(T.norm_alnum(F.col("text")), F.lit(CAP))).cast("bigint").alias("comparable"))


#: Texts of a tile and their letters, about: a block's tiles meet in pairs, so a task holds two of them at a time.
TILE, TILE_LETTERS = 128, 4_000_000


def verdicts(docs: DataFrame, block: Column, id_col: str = "doc_id", text_col: str = "text", autojunk: bool = True) -> DataFrame:
    """(a, b, similarity): pairs of distinct texts of a block, by digest, that are the same.

    Equal texts are one digest beforehand; a text in several blocks is compared in each. Texts without another in their block stay where they are. The others
    are dealt to tiles of their block, and each pair of tiles is a group of bounded size, in which only pairs that may reach the threshold are compared, by their whole
    texts. Blocks are to be selective: the bounds are looked at for all pairs of a block.
    """
    one = docs.select(F.md5(text_col).alias("digest"), block.alias("block"), T.norm_alnum(F.col(text_col)).alias("norm")).filter((F.length("norm") >= COMPARABLE) & F.col("block").isNotNull())
    sizes = one.select("digest", "block", F.length("norm").alias("n")).distinct().groupBy("block").agg(F.count("*").alias("count"), F.sum("n").alias("letters")).filter("count > 1")
    shared = sizes.select("block", F.least("count", F.greatest(F.ceil(F.col("count") / TILE), F.ceil(F.col("letters") / TILE_LETTERS))).cast("int").alias("tiles"))
    texts = one.join(shared, "block").groupBy("digest", "block").agg(F.any_value("norm").alias("norm"), F.any_value("tiles").alias("tiles"))
    own = texts.withColumn("tile", F.pmod(F.xxhash64("digest"), F.col("tiles")).cast("int"))
    dealt = own.select("digest", "block", "norm", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("_with"))
    met = dealt.select("block", F.least("tile", "_with").alias("s"), F.greatest("tile", "_with").alias("t"), "tile", "digest", "norm")

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("digest", ignore_index=True)
        digest, tile, within = group["digest"], group["tile"].to_numpy(), key[1] == key[2]
        firsts = [np.flatnonzero(within | (tile[:k] != tile[k])) for k in range(len(group))]
        found = [(digest[i], digest[k], r) for i, k, r in Texts(group["norm"].tolist(), autojunk).alike(firsts, SAME)]
        return pd.DataFrame(found, columns=["a", "b", "similarity"])

    # few bytes, but much work: adaptive execution would put it all in few tasks
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * docs.sparkSession.sparkContext.defaultParallelism)
    return met.repartition(tasks, "block", "s", "t").groupBy("block", "s", "t").applyInPandas(run, "a string, b string, similarity double").dropDuplicates(["a", "b"])


#: A node is a hub if it holds this share of all links; there are at most 1 / HUB_SHARE of them. Rounds after which components() gives up.
HUB_SHARE, ROUNDS = 0.001, 60


def _least_of(links: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """links (a, b) with least, n of a's row in least (a, least, n): hubs meet it by broadcast, so that their links stay where they are."""
    hub = F.col("n") >= max(2.0, total * HUB_SHARE)
    marked = links.join(F.broadcast(least.filter(hub).select("a", F.col("least").alias("_hub"))), "a", "left")
    found = marked.filter("_hub IS NOT NULL").select("a", "b", F.col("_hub").alias("least"))
    return found.unionByName(marked.filter("_hub IS NULL").select("a", "b").join(least.filter(~hub).select("a", "least"), "a"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the least node of its component. A loop makes its node a component.

    Stars are contracted: in turn, each node's greater neighbours and then all its smaller ones are linked to the least one near it, which about
    halves distances. Each round is a written table; rounds end when one changes nothing, and more than ROUNDS are an error. Nulls link nothing.
    """
    named = edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL")
    held, seen = materialised(named.filter("a <> b").distinct(), "links"), None
    for _ in range(ROUNDS):
        n = held.count()
        mark = (n, held.agg(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()[0])
        if mark == seen:
            stars = held.select(F.col("a").alias("node"), F.col("b").alias("root")).union(held.select("b", "b").distinct())
            alone = named.filter("a = b").select(F.col("a").alias("node")).distinct().join(stars.select("node"), "node", "left_anti")
            return stars.union(alone.select("node", F.col("node").alias("root")))
        seen = mark
        both = held.select("a", "b").union(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n")).select("a", F.least("a", "least").alias("least"), "n")
        large = _least_of(both.filter("b > a"), near, 2 * n).select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()
        large = materialised(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
        down = large.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n"))
        moved = _least_of(large, down, n).select(F.col("b").alias("a"), F.col("least").alias("b"))
        held = materialised(moved.union(down.select("a", F.col("least").alias("b"))).filter("a <> b").distinct(), "links")
    raise RuntimeError(f"components aren't settled after {ROUNDS} rounds")


def twins(docs: DataFrame, block: Column, id_col: str = "doc_id", text_col: str = "text", autojunk: bool = True) -> DataFrame:
    """(id, cluster): documents of equal or nearly equal content within a block under one digest."""
    roots = connected(verdicts(docs, block, id_col, text_col, autojunk))
    own = docs.select(id_col, F.md5(text_col).alias("digest"))
    return own.join(roots.withColumnRenamed("node", "digest"), "digest", "left").select(id_col, F.coalesce("root", "digest").alias("cluster"))


def language_block() -> Column:
    """Language, length class and first letters."""
    return F.concat_ws("|", "lang", F.floor(F.length("text") / 64).cast("string"), F.substring(T.norm_alnum(F.col("text")), 1, 12))


@operator()
def d3_same_content(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts on pairs of distinct texts within blocks."""
    return verdicts(table(spark, sf, "documents"), language_block()).select("a", "b", F.round("similarity", 6).alias("similarity"))


@operator("WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, root) USING KEY (node) AS (SELECT a, min(a) FROM b GROUP BY a UNION SELECT b.b, min(r.root) FROM r JOIN b ON b.a = r.node JOIN recurring.r AS own ON own.node = b.b WHERE r.root < own.root GROUP BY b.b) SELECT node, root FROM r")
def d4_components(spark: SparkSession, sf: str) -> DataFrame:
    """Connected components of all links under their least node."""
    return connected(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")))


def keeper_score() -> Column:
    """What makes a row the one to keep: the greatest of these in order."""
    filled = sum(((~is_empty(F.col(c))).cast("int") for c in ("date", "parties", "judges")), F.lit(0)) + (~(is_empty(F.col("keywords")) & is_empty(F.col("legislation")))).cast("int")
    return F.struct(filled, F.col("n_chunks") > 0, F.col("case_no").contains("/"), F.length("parties"), F.col("n_chunks"), -F.length("filename"), F.col("filename"))


SCORE = "((date <> '')::INT + (parties <> '')::INT + (judges <> '')::INT + (keywords <> '' OR legislation <> '')::INT)"
ORDER = f"{SCORE} DESC, n_chunks > 0 DESC, contains(case_no, '/') DESC, length(parties) DESC, n_chunks DESC, length(filename), filename DESC"


@operator(J + f" SELECT case_no, filename AS keeper FROM (SELECT case_no, filename, row_number() OVER (PARTITION BY case_no ORDER BY {ORDER}) AS n FROM j) WHERE n = 1")
def d5_keepers(spark: SparkSession, sf: str) -> DataFrame:
    """The row to keep of each case: an aggregate, so that a case of many rows is no hot window."""
    return judgements(spark, sf).groupBy("case_no").agg(F.max_by("filename", keeper_score()).alias("keeper"))


@operator(J + f", r AS (SELECT *, row_number() OVER (PARTITION BY case_no ORDER BY {ORDER}) AS n FROM j) SELECT case_no, coalesce(arg_min(nullif(date, ''), n), '') AS date, coalesce(arg_min(nullif(parties, ''), n), '') AS parties FROM r GROUP BY case_no")
def d6_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Each field from the best row that has it."""
    score = keeper_score()
    fields = [F.coalesce(F.max_by(c, F.when(F.col(c) != "", score)), F.lit("")).alias(c) for c in ("date", "parties")]
    return judgements(spark, sf).groupBy("case_no").agg(*fields)


@operator(J + f", r AS (SELECT *, row_number() OVER (PARTITION BY case_no ORDER BY {ORDER}) AS n FROM j), k AS (SELECT case_no, filename AS keeper, n_chunks AS kept FROM r WHERE n = 1) SELECT r.filename, k.keeper, CASE WHEN k.kept > 0 THEN 'drop chunks' ELSE 'repoint chunks' END AS action FROM r JOIN k USING (case_no) WHERE r.n > 1")
def d7_merge_log(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of each row that goes."""
    j = judgements(spark, sf)
    k = j.groupBy("case_no").agg(F.max_by(F.struct("filename", "n_chunks"), keeper_score()).alias("k"))
    return j.select("case_no", "filename").join(k, "case_no").filter("filename <> k.filename").select("filename", F.col("k.filename").alias("keeper"), F.when(F.col("k.n_chunks") > 0, "drop chunks").otherwise("repoint chunks").alias("action"))


def _move_sql(name: str, own: str, also: str = "") -> str:
    """What becomes of the case numbers of a child table in a merge: new is null where the rows go."""
    free = f"keeper_no NOT IN (SELECT case_no FROM {own}){also}"
    moved = f"{name} AS (SELECT case_no, CASE WHEN {free} AND row_number() OVER (PARTITION BY keeper_no ORDER BY dropped) = 1 THEN keeper_no END AS new FROM m WHERE case_no IN (SELECT case_no FROM {own}))"
    return moved


MERGE_SQL = (
    f"{J}, c AS (SELECT case_no, doc_id FROM documents JOIN j ON seq = doc_id), b AS (SELECT case_no, unnest(string_split(judges, '; ')) AS display FROM j),"
    " p AS (SELECT d.filename AS dropped, d.case_no, k.case_no AS keeper_no, k.n_chunks AS keeper_chunks FROM j d JOIN j k ON k.seq = d.seq - 1 WHERE d.seq % 5 = 1),"
    " l AS (SELECT * FROM j WHERE filename NOT IN (SELECT dropped FROM p)),"
    " m AS (SELECT case_no, arg_min(keeper_no, dropped) AS keeper_no, arg_min(keeper_chunks, dropped) AS keeper_chunks, min(dropped) AS dropped FROM p WHERE case_no NOT IN (SELECT case_no FROM l) GROUP BY case_no),"
    f" {_move_sql('cm', 'c', ' AND keeper_chunks <= 0')}, {_move_sql('bm', 'b')}"
    " SELECT 'judgements' AS part, case_no, count(*) AS n FROM l GROUP BY case_no UNION ALL SELECT 'log', case_no, count(*) FROM p GROUP BY case_no"
    " UNION ALL SELECT 'chunks', coalesce(new, c.case_no), count(*) FROM c LEFT JOIN cm ON cm.case_no = c.case_no WHERE cm.case_no IS NULL OR new IS NOT NULL GROUP BY ALL"
    " UNION ALL SELECT 'benches', coalesce(new, b.case_no), count(*) FROM b LEFT JOIN bm ON bm.case_no = b.case_no WHERE bm.case_no IS NULL OR new IS NOT NULL GROUP BY ALL"
)


@operator(MERGE_SQL)
def d7_merged_library(spark: SparkSession, sf: str) -> DataFrame:
    """A library of cases, passages and benches in which a fifth of the documents is merged into others: rows of each table by case."""
    j = materialised(judgements(spark, sf).select("seq", "filename", "case_no", "n_chunks", "judges"), "library-source")
    library = Library(spark, fresh_path(spark, "library"))
    passages = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), "doc_id").join(j.select("seq", "case_no"), "seq").select("case_no", "doc_id")
    library.change({"judgements": j.select("filename", "case_no", "n_chunks"), "chunks": passages, "benches": j.select("case_no", F.explode(F.split("judges", "; ")).alias("display"))})
    keeper = F.concat(F.lit("case_"), (F.col("seq") - 1).cast("string"), F.lit(".pdf"))
    library.merge(j.filter("seq % 5 = 1").select(F.col("filename").alias("dropped"), keeper.alias("keeper")))
    parts = [library.table(n).groupBy("case_no").count().select(F.lit(n).alias("part"), "case_no", F.col("count").alias("n")) for n in ("judgements", "chunks", "benches", "log")]
    return reduce(DataFrame.unionByName, parts)


@operator("SELECT doc_id FROM documents d WHERE doc_id <> (SELECT min(doc_id) FROM documents e WHERE e.text = d.text) AND source NOT IN (SELECT source FROM documents WHERE lang = 'xx')")
def d8_dropped_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of rows that went, but for those of surviving names."""
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", F.md5("text").alias("m"))
    keep = d.groupBy("m").agg(F.min("doc_id").alias("doc_id"))
    alive = d.filter("lang = 'xx'").select("source")
    return d.join(keep.select("doc_id"), "doc_id", "left_anti").join(alive, "source", "left_anti").select("doc_id")


@operator(J + " SELECT case_no, count(*) AS documents, count(*) - 1 AS dropped, array_to_string(list_sort(list_filter([CASE WHEN count(*) FILTER (date = '') > 0 AND count(*) FILTER (date <> '') > 0 THEN 'date' END, CASE WHEN count(*) FILTER (parties = '') > 0 AND count(*) FILTER (parties <> '') > 0 THEN 'parties' END], lambda x: x IS NOT NULL)), ', ') AS fields FROM j GROUP BY case_no HAVING count(*) > 1")
def d9_report(spark: SparkSession, sf: str) -> DataFrame:
    """Cases with several rows, and the fields that these could fill for each other."""
    def mixed(c: str) -> Column:
        return F.when((F.count_if(F.col(c) == "") > 0) & (F.count_if(F.col(c) != "") > 0), c)

    g = judgements(spark, sf).groupBy("case_no").agg(F.count("*").alias("documents"), (F.count("*") - 1).alias("dropped"), F.array_join(F.array_sort(F.array_compact(F.array(mixed("date"), mixed("parties")))), ", ").alias("fields"))
    return g.filter("documents > 1")
