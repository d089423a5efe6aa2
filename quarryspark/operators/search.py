"""Full-text, vector and faceted search over whole tables.

Text searches read a stored positional index (textindex), made once of a folder's documents; the SQL twins scan the texts, as
phrases of tokens joined with marked borders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.query import STOPWORDS, Tier, Vocabulary, tiers, words
from ..plans.register import operator
from ..sources.tables import JUDGEMENTS, LINES, judgements, table
from .textindex import Phrase, TextIndex, built
from .vectorindex import VectorIndex
from .vectorindex import built as vector_table

def marked(c: Column) -> Column:
    """A text's tokens between border spaces."""
    return F.concat(F.lit(" "), F.array_join(T.tokens(c), "  "), F.lit(" "))


def needle(phrase: str, star: bool = False) -> str:
    """What a phrase looks like in marked text; star: its last word is a prefix."""
    return " " + "  ".join(words(phrase)) + ("" if star else " ")


def phrases_of(plan: list[Tier]) -> list[list[list[Phrase]]]:
    """The phrases of each group of each tier."""
    return [[[Phrase.of(p, t.star and i == len(t.groups) - 1) for p in g] for i, g in enumerate(t.groups)] for t in plan]


def distinct(told: list[list[list[Phrase]]]) -> list[Phrase]:
    return list(dict.fromkeys(p for t in told for g in t for p in g))


def tier_phrases(plan: list[Tier]) -> tuple[list[Phrase], list[Column]]:
    """The phrases of some tiers, and whether a row of hits() of these (f0, f1, ...) satisfies each tier."""
    told = phrases_of(plan)
    phrases = distinct(told)
    at = {p: F.col(f"f{i}") > 0 for i, p in enumerate(phrases)}
    groups = [[reduce(lambda a, b: a | b, (at[p] for p in g)) for g in t] for t in told]
    return phrases, [reduce((lambda a, b: a | b) if t.any_group else (lambda a, b: a & b), g) for t, g in zip(plan, groups, strict=True)]


def tiered_hits(index: TextIndex, query: str, vocabulary: Vocabulary) -> DataFrame:
    """(id, tier, score) of documents that match: tier 1 phrase, 2 all, 3 any; the first tier to claim a document wins.

    The loose tier counts only where nothing stricter matched at all. The score counts whole phrases, not prefixes.
    """
    number = {"phrase": 1, "all": 2, "any": 3}
    plan = tiers(query, vocabulary)
    if not plan:
        return index.spark.createDataFrame([], "id bigint, tier int, score double")
    phrases, met = tier_phrases(plan)
    whole = list(dict.fromkeys(Phrase(p.words) for p in phrases))
    every = phrases + [p for p in whole if p not in phrases]
    scored = index.scored(every)
    tier = F.coalesce(*(F.when(m, number[t.name]) for m, t in zip(met, plan, strict=True)))
    score = reduce(lambda a, b: a + b, (F.col(f"s{every.index(p)}") for p in whole))
    found = scored.select("id", tier.alias("tier"), score.alias("score")).filter(F.col("tier").isNotNull())
    best = found.agg(F.min("tier").alias("_best"))
    return found.crossJoin(F.broadcast(best)).filter((F.col("tier") < 3) | (F.col("_best") == 3)).select("id", "tier", "score")  # best has one row


TOK = "m AS (SELECT doc_id, lang, source, t, ' ' || array_to_string(t, '  ') || ' ' AS m FROM (SELECT doc_id, lang, source, regexp_extract_all(strip_accents(lower(text)), '([\\p{L}\\p{N}]+)', 1) AS t FROM documents))"


def _count(phrase: str, star: bool = False) -> str:
    s = needle(phrase, star)
    return f"CAST((length(m) - length(replace(m, '{s}', ''))) / {len(s)} AS BIGINT)"


def _bm25_sql(phrases: list[str]) -> str:
    n = range(len(phrases))
    f = ", ".join(f"{_count(p)} AS f{i}" for i, p in enumerate(phrases))
    d = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in n)
    s = " + ".join(f"(CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d{i} + 0.5) / (d{i} + 0.5)) END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in n)
    return f"{TOK}, f AS (SELECT doc_id, lang, source, m, greatest(len(t), 1) AS len, {f} FROM m), g AS (SELECT count(*) AS n, avg(len) AS mean, {d} FROM f), z AS (SELECT f.*, {s} AS score FROM f, g)"


@operator(f"WITH {TOK} SELECT token, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM (SELECT doc_id, unnest(t) AS token FROM m) GROUP BY token")
def f1_postings(spark: SparkSession, sf: str) -> DataFrame:
    """The inverted index' dictionary: each token with its document and collection frequency."""
    return postings(table(spark, sf, "documents")).groupBy("token").agg(F.count("*").alias("documents"), F.sum("n").alias("occurrences"))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(token, id, n, first): one row for each token of each document, aggregated before the shuffle."""
    exploded = docs.select(id_col, F.posexplode(T.tokens(F.col(text_col))).alias("pos", "token"))
    return exploded.groupBy("token", id_col).agg(F.count("*").alias("n"), F.min("pos").alias("first"))


def documents_index(spark: SparkSession, sf: str) -> TextIndex:
    """The stored index of the documents; their sources own them."""
    return built(spark, sf, "documents", lambda: table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("owner"), "text"))


@operator(f"WITH {TOK} SELECT doc_id, {_count('of the')} AS phrase_hits, {_count('to onan', True)} AS prefix_hits FROM m WHERE contains(m, ' of  the ') OR contains(m, ' to  onan')")
def f2_phrase_and_prefix(spark: SparkSession, sf: str) -> DataFrame:
    found = documents_index(spark, sf).hits([Phrase.of("of the"), Phrase.of("to onan", star=True)])
    return found.select(F.col("id").alias("doc_id"), F.col("f0").alias("phrase_hits"), F.col("f1").alias("prefix_hits"))


@operator(f"WITH {TOK} SELECT doc_id FROM m WHERE (contains(m, ' onan ') OR contains(m, ' anat ')) AND (contains(m, ' that ') OR contains(m, ' with '))")
def f3_boolean_groups(spark: SparkSession, sf: str) -> DataFrame:
    tier = Tier("all", (("onan", "anat"), ("that", "with")))
    phrases, met = tier_phrases([tier])
    return documents_index(spark, sf).hits(phrases).filter(met[0]).select(F.col("id").alias("doc_id"))


@operator(f"WITH {_bm25_sql(['onan', 'anat', 'of the'])} SELECT doc_id, round(score, 6) AS score FROM z WHERE f0 + f1 + f2 > 0")
def f4_bm25(spark: SparkSession, sf: str) -> DataFrame:
    scored = documents_index(spark, sf).scored([Phrase.of(x) for x in ("onan", "anat", "of the")])
    return scored.select(F.col("id").alias("doc_id"), F.round(F.col("s0") + F.col("s1") + F.col("s2"), 6).alias("score"))


@operator(f"WITH {_bm25_sql(['onan', 'anat', 'that'])} SELECT doc_id, round(score, 6) AS score FROM z WHERE f0 + f1 + f2 > 0 ORDER BY score DESC, doc_id LIMIT 25")
def f4_best(spark: SparkSession, sf: str) -> DataFrame:
    """The best documents for some words; blocks of documents whose bound is too low are not read."""
    return documents_index(spark, sf).top(["onan", "anat", "that"], 25).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@operator()
def f5_snippet(spark: SparkSession, sf: str) -> DataFrame:
    """The earliest window of twelve tokens with the most distinct terms, terms between marks."""
    terms = {"onan", "anat", "that"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "snippet": [snippet(t, terms) for t in b["text"]]})

    found = table(spark, sf, "documents").filter(marked(F.col("text")).contains(" onan ")).select("doc_id", "text")
    return found.mapInPandas(run, "doc_id bigint, snippet string")


def snippet(text: str, terms: set[str], size: int = 12) -> str:
    """A window of a text around its search terms."""
    own = text.split()
    hit = [next((w for w in words(t) if w in terms), None) for t in own]
    best, count = 0, -1
    for i in range(max(1, len(own) - size + 1)):
        n = len({h for h in hit[i : i + size] if h})
        if n > count:
            best, count = i, n
    part = [f"«{w}»" if h else w for w, h in zip(own[best : best + size], hit[best : best + size], strict=True)]
    return ("…" if best else "") + " ".join(part) + ("…" if best + size < len(own) else "")


@operator(f"WITH {TOK} SELECT lang, count(DISTINCT CASE WHEN contains(m, ' onan ') OR contains(m, ' anat ') THEN doc_id END) AS matching FROM m GROUP BY lang")
def f8_matching_cases(spark: SparkSession, sf: str) -> DataFrame:
    found = documents_index(spark, sf).hits([Phrase.of("onan"), Phrase.of("anat")]).select(F.col("id").alias("doc_id"), F.lit(1).alias("hit"))
    d = table(spark, sf, "documents").select("doc_id", "lang").join(found, "doc_id", "left")
    return d.groupBy("lang").agg(F.count_distinct(F.when(F.col("hit") == 1, F.col("doc_id"))).alias("matching"))


@operator(f"WITH {_bm25_sql(['onan anat', 'onan', 'anat'])}, c AS (SELECT doc_id, source, score, CASE WHEN contains(m, ' onan  anat ') THEN 1 WHEN contains(m, ' onan ') AND contains(m, ' anat') THEN 2 WHEN contains(m, ' onan ') OR contains(m, ' anat') THEN 3 END AS tier FROM z), h AS (SELECT * FROM c WHERE tier IS NOT NULL) SELECT doc_id, tier, round(score, 6) AS score FROM h WHERE tier < 3 OR (SELECT min(tier) FROM h) = 3")
def r1_tiered_hits(spark: SparkSession, sf: str) -> DataFrame:
    hits = tiered_hits(documents_index(spark, sf), "onan anat", Vocabulary())
    return hits.select(F.col("id").alias("doc_id"), "tier", F.round("score", 6).alias("score"))


@operator(f"WITH {_bm25_sql(['onan anat', 'onan', 'anat'])}, c AS (SELECT doc_id, score, CASE WHEN contains(m, ' onan  anat ') THEN 1 WHEN contains(m, ' onan ') AND contains(m, ' anat') THEN 2 WHEN contains(m, ' onan ') OR contains(m, ' anat') THEN 3 END AS tier FROM z), h AS (SELECT * FROM c WHERE tier IS NOT NULL) SELECT doc_id, tier, round(score, 6) AS score FROM h WHERE tier < 3 OR (SELECT min(tier) FROM h) = 3 ORDER BY tier, round(score, 6) DESC, doc_id LIMIT 60")
def r2_keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    """The best sixty rows by tier, relevance and id."""
    return r1_tiered_hits(spark, sf).orderBy("tier", F.desc("score"), "doc_id").limit(60)


VEC = "d AS (SELECT e.vec_id, e.label, 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


def _vectors(spark: SparkSession, sf: str) -> tuple[VectorIndex, DataFrame]:
    """The stored vectors, and the first of them as a query."""
    e = table(spark, sf, "embeddings")
    index = vector_table(spark, sf, lambda: e.select(F.col("vec_id").alias("id"), F.col("label").alias("source"), F.col("embedding").alias("vector")))
    return index, e.filter("vec_id = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


def _near(spark: SparkSession, sf: str, k: int) -> DataFrame:
    index, query = _vectors(spark, sf)
    return index.nearest(query, k)


@operator(f"WITH {VEC} SELECT vec_id, round(distance, 6) AS distance FROM d ORDER BY round(distance, 6), vec_id LIMIT 20")
def r3_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty vectors nearest to a query vector."""
    index, query = _vectors(spark, sf)
    return index.nearest(query, 20).select(F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance")).orderBy("distance", "vec_id").limit(20)


@operator("WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 3) SELECT qid, vec_id, label AS source, round(1 - list_cosine_similarity(embedding::DOUBLE[], q), 6) AS distance FROM embeddings, q WHERE label IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], q), vec_id) <= 20")
def r3_filtered_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty nearest vectors of several queries, from the sources that another table names."""
    index, _ = _vectors(spark, sf)
    queries = table(spark, sf, "embeddings").filter("vec_id % 50 = 3").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    sources = table(spark, sf, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("source"))
    return index.nearest(queries, 20, sources).select("qid", F.col("id").alias("vec_id"), F.col("source").cast("int").alias("source"), F.round("distance", 6).alias("distance"))


@operator(f"WITH {VEC} SELECT label, count(*) AS hits, round(min(distance), 6) AS best, arg_min(vec_id, round(distance, 6) * 1e9 + vec_id) AS nearest FROM d WHERE distance <= 0.65 GROUP BY label ORDER BY best, label LIMIT 15")
def r4_semantic_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Near vectors by group: hits, the best distance and whose it is. A distance of exactly 0 counts."""
    index, query = _vectors(spark, sf)
    near = index.within(query, 0.65).select(F.col("id").alias("vec_id"), F.col("source").cast("int").alias("label"), F.round("distance", 6).alias("d"))
    return near.groupBy("label").agg(F.count("*").alias("hits"), F.min("d").alias("best"), F.min_by("vec_id", F.struct("d", "vec_id")).alias("nearest")).orderBy("best", "label").limit(15)


J = f"WITH {JUDGEMENTS}"


@operator(J + " SELECT case_no, max(date) AS date, max(CASE WHEN case_no ILIKE 'SC/APPEAL/1%' THEN 0 ELSE 1 END) AS source FROM j WHERE case_no ILIKE 'SC/APPEAL/1%' OR contains(lower(keywords), 'urgent') GROUP BY case_no ORDER BY date DESC, case_no LIMIT 120")
def r5_area_search(spark: SparkSession, sf: str) -> DataFrame:
    """Cases of an area by number prefix or terms; the prefix wins, newest first."""
    j = judgements(spark, sf)
    by_prefix = F.col("case_no").ilike("SC/APPEAL/1%")
    found = j.filter(by_prefix | F.lower("keywords").contains("urgent"))
    return found.groupBy("case_no").agg(F.max("date").alias("date"), F.max(F.when(by_prefix, 0).otherwise(1)).alias("source")).orderBy(F.desc("date"), "case_no").limit(120)


@operator(J + " SELECT DISTINCT case_no FROM j WHERE case_no ILIKE 'SC/APPEAL/1%' OR contains(lower(keywords), 'urgent')")
def r6_area_cases(spark: SparkSession, sf: str) -> DataFrame:
    return judgements(spark, sf).filter(F.col("case_no").ilike("SC/APPEAL/1%") | F.lower("keywords").contains("urgent")).select("case_no").distinct()


CANON = "lower(regexp_replace(regexp_replace(regexp_replace({c}, '^Hon\\. Justice ', ''), '( CJ|, P\\.C\\., J\\.)$', ''), '[^A-Za-z0-9]', '', 'g'))"


@operator(J + f" SELECT DISTINCT case_no FROM (SELECT case_no, unnest(string_split(judges, '; ')) AS display FROM j) WHERE {CANON.format(c='display')} IN ('nation3', 'building')")
def r7_judge_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Cases where one of the judges sat, whatever the spelling."""
    b = judgements(spark, sf).select("case_no", F.explode(F.split("judges", "; ")).alias("display"))
    return b.filter(T.canonical_judge(F.col("display")).isin("nation3", "building")).select("case_no").distinct()


@operator(J + f""", judge AS (SELECT DISTINCT case_no FROM (SELECT case_no, unnest(string_split(judges, '; ')) AS display FROM j) WHERE {CANON.format(c='display')} = 'building'),
  area AS (SELECT DISTINCT case_no FROM j WHERE contains(lower(keywords), 'high') OR contains(lower(keywords), 'urgent')), period AS (SELECT DISTINCT case_no FROM j WHERE substr(date, 1, 4) BETWEEN '1996' AND '1998'),
  k AS (SELECT case_no, max(date) AS date, arg_max(parties, date || filename) AS parties FROM j WHERE case_no IN (FROM judge) AND case_no IN (FROM area) AND case_no IN (FROM period) GROUP BY case_no)
  SELECT case_no, date, parties FROM k ORDER BY date DESC, case_no LIMIT 200""")
def r8_combined_search(spark: SparkSession, sf: str) -> DataFrame:
    return combined_search(judgements(spark, sf), judges=["building"], areas=["high", "urgent"], years=(1996, 1998))


def sat(judges: Column, wanted: list[str]) -> Column:
    """Whether one of the wanted judges (canonical names) is among the judges named. The cheap test goes first."""
    near = F.lit(False)
    for w in wanted:
        near = near | T.norm_alnum(judges).contains(w)
    return F.when(near, F.exists(F.split(judges, "; "), lambda x: T.canonical_judge(x).isin(wanted))).otherwise(F.lit(False))


def combined_search(j: DataFrame, judges: list[str] = (), areas: list[str] = (), years: tuple[int, int] | None = None, query: DataFrame | None = None, most: int = 200) -> DataFrame:
    """Cases that meet every facet given, each by any of its rows, newest first; a case shows its latest row.

    judges are canonical names, areas are parts of keywords, query has the cases (case_no) that text or vectors found. Facets are flags of
    one pass, grouped by case.
    """
    flags = []
    if judges:
        flags.append(sat(F.col("judges"), list(judges)))
    if areas:
        flags.append(reduce(lambda a, b: a | b, (F.lower("keywords").contains(x) for x in areas)))
    if years:
        flags.append(F.substring("date", 1, 4).between(str(years[0]), str(years[1])))
    shown = j.groupBy("case_no").agg(F.max("date").alias("date"), F.max_by("parties", F.concat("date", "filename")).alias("parties"), *(F.bool_or(f).alias(f"_f{i}") for i, f in enumerate(flags)))
    for i in range(len(flags)):
        shown = shown.filter(f"_f{i}")
    if query is not None:
        shown = shown.join(query.select("case_no").distinct(), "case_no", "left_semi")
    return shown.select("case_no", "date", "parties").orderBy(F.desc("date"), "case_no").limit(most)


@operator(f"WITH {LINES}, {_bm25_sql(['onan'])}, x AS (SELECT doc_id AS id, 0 AS branch, round(-score, 6) AS key FROM z WHERE f0 > 0 ORDER BY key, id LIMIT 16), {VEC}, v AS (SELECT vec_id AS id, 1 AS branch, round(distance, 6) AS key FROM d ORDER BY key, id LIMIT 24), u AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY branch) AS n FROM (FROM x UNION ALL FROM v)) SELECT id, branch, key FROM u WHERE n = 1 ORDER BY branch, key, id LIMIT 20")
def r9_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    """Text hits by relevance, then vector hits by distance, one row for each id."""
    text = documents_index(spark, sf).scored([Phrase.of("onan")])
    first = text.select("id", F.lit(0).alias("branch"), F.round(-F.col("s0"), 6).alias("key")).orderBy("key", "id").limit(16)
    second = _near(spark, sf, 24).select("id", F.lit(1).alias("branch"), F.round("distance", 6).alias("key")).orderBy("key", "id").limit(24)
    one = first.union(second).withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("branch"))).filter("n = 1")
    return one.select("id", "branch", "key").orderBy("branch", "key", "id").limit(20)


@operator(J + " SELECT filename, date FROM j ORDER BY date DESC, filename LIMIT 50 OFFSET 100")
def r11_page(spark: SparkSession, sf: str) -> DataFrame:
    """The third page of fifty, by date."""
    return judgements(spark, sf).select("filename", "date").orderBy(F.desc("date"), "filename").offset(100).limit(50)


@operator("SELECT doc_id, array_to_string(regexp_extract_all(strip_accents(lower(text)), '([\\p{L}\\p{N}]+)', 1)[1:8], ' ') AS first_words FROM documents")
def r12_capped_lists(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.slice(T.tokens(F.col("text")), 1, 8), " ").alias("first_words"))


@operator(f"WITH {_bm25_sql(['onan'])}, x AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS r FROM z WHERE f0 > 0 ORDER BY r LIMIT 50), {VEC}, v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round(distance, 6), vec_id) AS r FROM d ORDER BY r LIMIT 50) SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM (FROM x UNION ALL FROM v) GROUP BY id")
def r13_rank_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Reciprocal ranks of the fifty best text and vector hits added up."""
    text = documents_index(spark, sf).scored([Phrase.of("onan")]).select("id", F.round("s0", 6).alias("k"))
    best = text.orderBy(F.desc("k"), "id").limit(50).withColumn("r", F.row_number().over(Window.orderBy(F.desc("k"), "id")))  # fifty rows
    near = _near(spark, sf, 50).select("id", F.round("distance", 6).alias("k")).orderBy("k", "id").limit(50)
    near = near.withColumn("r", F.row_number().over(Window.orderBy("k", "id")))  # fifty rows
    return best.select("id", "r").union(near.select("id", "r")).groupBy("id").agg(F.round(F.sum(F.lit(1.0) / (F.col("r") + 60)), 9).alias("score"))


@operator(J + " SELECT filename, case_no, date, string_split(judges, '; ')[1] AS author, len(string_split(judges, '; ')) AS seats, trim(string_split(parties, ' v. ')[1]) AS petitioner, coalesce(trim(string_split(parties, ' v. ')[2]), '') AS respondent FROM j")
def r14_full_record(spark: SparkSession, sf: str) -> DataFrame:
    """Everything about each case in one row."""
    bench, sides = F.split("judges", "; "), F.split("parties", r" v\. ")
    return judgements(spark, sf).select("filename", "case_no", "date", F.get(bench, F.lit(0)).alias("author"), F.size(bench).cast("bigint").alias("seats"), F.trim(F.get(sides, F.lit(0))).alias("petitioner"), F.coalesce(F.trim(F.get(sides, F.lit(1))), F.lit("")).alias("respondent"))


@operator(J + " SELECT o.c_custkey AS id, coalesce(min(CASE WHEN j.case_no = o.wanted THEN j.filename END), min(j.filename), 'not found') AS opened FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'SC/APPEAL/' || c_custkey || '/1997' WHEN 1 THEN lower('SC/APPEAL/' || c_custkey || '/1996') ELSE 'none' END AS wanted FROM customer) o LEFT JOIN j ON lower(j.case_no) = lower(o.wanted) GROUP BY o.c_custkey")
def r15_open_with_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """The row of an id, or else one that differs in case only, or else 'not found'."""
    k = F.col("c_custkey")
    wanted = F.when(k % 3 == 0, F.concat(F.lit("SC/APPEAL/"), k.cast("string"), F.lit("/1997"))).when(k % 3 == 1, F.concat(F.lit("sc/appeal/"), k.cast("string"), F.lit("/1996"))).otherwise("none")
    asked = table(spark, sf, "customer").select(k.alias("id"), wanted.alias("wanted"), F.lower(wanted).alias("low"))
    j = judgements(spark, sf).select("filename", "case_no", F.lower("case_no").alias("low"))
    found = asked.join(j, "low", "left")
    return found.groupBy("id").agg(F.coalesce(F.min(F.when(F.col("case_no") == F.col("wanted"), F.col("filename"))), F.min("filename"), F.lit("not found")).alias("opened"))


@operator("SELECT doc_id, len(t) AS n, array_to_string(t[1:5], ' ') AS head FROM (SELECT doc_id, regexp_extract_all(lower(text), '([\\p{L}\\p{N}_]+)', 1) AS t FROM documents)")
def q1_query_tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = T.query_tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(t).cast("bigint").alias("n"), F.array_join(F.slice(t, 1, 5), " ").alias("head"))


@operator(r"""WITH w AS (SELECT DISTINCT p_name AS phrase, lower(array_to_string(list_transform(string_split(p_name, ' '), lambda w: w[1]), '')) AS acronym FROM part)
  SELECT acronym, count(*) AS expansions, max(phrase) AS latest FROM w GROUP BY acronym""")
def q2_acronyms(spark: SparkSession, sf: str) -> DataFrame:
    """Acronyms with their expansions, both ways; of several the last wins in reverse."""
    w = table(spark, sf, "part").select(F.col("p_name").alias("phrase")).distinct()
    acronym = F.lower(F.array_join(F.transform(F.split("phrase", " "), lambda x: F.substring(x, 1, 1)), ""))
    return w.groupBy(acronym.alias("acronym")).agg(F.count("*").alias("expansions"), F.max("phrase").alias("latest"))


def lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """Words of four letters or more in the metadata, without stopwords."""
    j = judgements(spark, sf)
    found = j.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "parties", "judges", "keywords")), F.lit("([a-z]{4,})"), 1))).alias("term")).distinct()
    names = table(spark, sf, "part").select(F.explode(F.regexp_extract_all(F.lower("p_name"), F.lit("([a-z]{4,})"), 1)).alias("term")).distinct()
    return found.union(names).distinct().filter(~F.col("term").isin(sorted(STOPWORDS)))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of a word between two spaces before and one behind."""
    s = F.concat(F.lit("  "), c, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substr(s, i, F.lit(3))))


LEX = """x AS (SELECT DISTINCT unnest(regexp_extract_all(lower(concat_ws(' ', parties, judges, keywords)), '([a-z]{4,})', 1)) AS term FROM j UNION SELECT DISTINCT unnest(regexp_extract_all(lower(p_name), '([a-z]{4,})', 1)) FROM part)"""


@operator(J + f", {LEX} SELECT trigram, count(*) AS terms FROM (SELECT term, unnest(list_distinct(list_transform(range(1, length(term) + 2), lambda i: substr('  ' || term || ' ', i, 3)))) AS trigram FROM x WHERE term NOT IN ('case', 'with', 'that', 'this', 'from')) GROUP BY trigram")
def q5_trigram_index(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon(spark, sf).select("term", F.explode(trigrams(F.col("term"))).alias("trigram")).groupBy("trigram").agg(F.count("*").alias("terms"))


def fuzzy(terms: DataFrame, asked: DataFrame, most: int = 6, least: float = 0.82) -> DataFrame:
    """(token, term, ratio, rank): words of terms that are spelled nearly like each token of asked.

    Candidates come from an equality join on trigrams; a Ratcliff-Obershelp ratio confirms them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(ratio=[SequenceMatcher(None, x, y).ratio() for x, y in zip(b["token"], b["term"], strict=True)])[["token", "term", "ratio"]]

    left = asked.filter(F.length("token") >= 5).select("token", F.explode(trigrams(F.col("token"))).alias("trigram"))
    right = terms.select("term", F.explode(trigrams(F.col("term"))).alias("trigram"))
    shared = left.join(right, "trigram").filter("token <> term").groupBy("token", "term").agg(F.count("*").alias("n"))
    size = F.length("token")
    likely = shared.filter(((F.col("n") >= 2) | (size <= 6)) & (F.abs(F.length("term") - size) <= F.greatest(F.lit(3), F.floor(size / 2))))
    scored = likely.select("token", "term").mapInPandas(run, "token string, term string, ratio double").filter(F.col("ratio") >= least)
    order = Window.partitionBy("token").orderBy(F.desc("ratio"), F.desc("term"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


@operator()
def q6_fuzzy_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Spelling variants of every word of the lexicon, asked for as it is and with its third letter doubled."""
    terms = lexicon(spark, sf)
    w = F.col("term")
    asked = terms.select(w.alias("token")).union(terms.select(F.concat(F.left(w, F.lit(3)), F.substring(w, 3, 1), F.substr(w, F.lit(4))).alias("token"))).distinct()
    return fuzzy(terms, asked).select("token", "term", F.round("ratio", 6).alias("ratio"), "rank")
