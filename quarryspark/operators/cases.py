"""Search for cases: metadata and passages, in tiers, with hits, the best passage, its page and a date.

A case is claimed by the strictest tier that any of its rows or passages meets: 0 metadata, 1 phrase, 2 all terms, 3 any term, 4 meaning. What a tier
knows of a case (hits, best score, where) is one aggregate that merges, so a case of many passages is no hot group; the claim is the least tier
that isn't empty. The loose tier counts only where nothing stricter matched anywhere. Passages come from the stored index, whose
texts are read only for the rows that are shown.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.query import Tier, Vocabulary, metadata_variants, tiers
from ..plans.register import operator
from ..sources.shipping import materialised
from ..sources.tables import JUDGEMENTS, judgements, lines
from .search import CANON, distinct, needle, phrases_of, sat, snippet, tier_phrases
from .textindex import Phrase, TextIndex, built

#: Tiers by the name of their reason.
TIERS = {"metadata": 0, "phrase": 1, "text": 2, "broad": 3, "semantic": 4}
REASON = {"phrase": "phrase", "all": "text", "any": "broad"}
FIELDS = ["case_no", "parties", "judges", "keywords", "legislation"]
#: Characters of the parties that stand for a passage, and letters below which a single word must begin a word of the metadata.
SHOWN, SHORT = 110, 6
PAGE_BITS = 24


def passages(spark: SparkSession, sf: str) -> TextIndex:
    """The index of the pages of the cases' documents: id is document and page, the case number owns it."""

    def docs() -> DataFrame:
        of = judgements(spark, sf).select(F.col("seq").alias("doc_id"), F.col("case_no").alias("owner"))
        rows = lines(spark, sf).select("doc_id", F.shiftleft(F.col("doc_id"), PAGE_BITS).bitwiseOR(F.col("page").cast("bigint")).alias("id"), "text")
        return rows.join(of, "doc_id").select("id", "owner", "text")

    return built(spark, sf, "passages", docs)


_kept: dict[tuple[str, str], DataFrame] = {}


def case_table(spark: SparkSession, sf: str) -> DataFrame:
    """The judgements as a stored table, written at first use in this application: a search reads it several times."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _kept:
        _kept[key] = materialised(judgements(spark, sf), "cases")
    return _kept[key]


def metadata_hits(cases: DataFrame, variants: list[str]) -> DataFrame:
    """(case_no, shown): cases with a row that contains one of the strings in a field; shown are the parties of the newest row of the first string."""
    whole = F.concat_ws(" ", *FIELDS)
    found = []
    for v in variants:
        low = v.lower()
        hit = reduce(lambda a, b: a | b, (F.contains(F.lower(c), F.lit(low)) for c in FIELDS))
        if len(v) < SHORT and " " not in v:
            hit = hit & whole.rlike(rf"(?i)\b{re.escape(v)}")
        found.append(hit)
    if not found:
        return cases.select("case_no", F.lit("").alias("shown")).limit(0)
    first = F.coalesce(*(F.when(h, i) for i, h in enumerate(found)))
    rows = cases.select("case_no", "date", "filename", "parties", first.alias("at")).filter("at IS NOT NULL")
    best = F.max_by(F.left("parties", F.lit(SHOWN)), F.struct((-F.col("at")).alias("at"), "date", "filename"))
    return rows.groupBy("case_no").agg(best.alias("shown"))


def passage_hits(index: TextIndex, plan: list[Tier]) -> DataFrame:
    """(case_no, t0, t1, ...): for each tier null, or its hits, best score and the passage that has it."""
    phrases, met = tier_phrases(plan)
    scored = index.scored(phrases)
    told = []
    for i, t in enumerate(phrases_of(plan)):
        own = distinct([t])
        told.append(F.when(met[i], reduce(lambda a, b: a + b, (F.col(f"s{phrases.index(p)}") for p in own))).alias(f"_s{i}"))
    rows = scored.select("id", *told).join(index.docs().select("id", F.col("owner").alias("case_no")), "id")
    return rows.groupBy("case_no").agg(*(F.when(F.count(f"_s{i}") > 0, F.struct(F.count(f"_s{i}").alias("hits"), F.max(f"_s{i}").alias("score"), F.max_by("id", F.when(F.col(f"_s{i}").isNotNull(), F.struct(F.round(f"_s{i}", 9), -F.col("id")))).alias("id"))).alias(f"t{i}") for i in range(len(plan))))


def case_hits(cases: DataFrame, index: TextIndex, query: str, vocabulary: Vocabulary = Vocabulary(), semantic: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """(case_no, tier, score, hits, shown, id): what claims each case; the greater the score the better.

    shown has parties for a case that metadata claimed, id the best passage for others. semantic: (case_no, distance, hits, shown) of cases that vectors found,
    for those that nothing else claims.
    """
    schema = "case_no string, tier int, score double, hits bigint, shown string, id bigint"
    plan = tiers(query, vocabulary)
    if not plan:
        return index.spark.createDataFrame([], schema)
    meta = metadata_hits(cases, metadata_variants(query.strip(), vocabulary)).select("case_no", F.struct(F.lit(0).alias("tier"), F.lit(0.0).alias("score"), F.lit(1).cast("bigint").alias("hits"), "shown", F.lit(None).cast("bigint").alias("id")).alias("claim"))
    own = [F.when(F.col(f"t{i}").isNotNull(), F.struct(F.lit(TIERS[REASON[t.name]]).alias("tier"), F.col(f"t{i}.score").alias("score"), F.col(f"t{i}.hits").alias("hits"), F.lit(None).cast("string").alias("shown"), F.col(f"t{i}.id").alias("id"))) for i, t in enumerate(plan)]
    text = passage_hits(index, plan).join(cases.select("case_no").distinct(), "case_no", "left_semi").select("case_no", F.coalesce(*own).alias("claim")).filter("claim IS NOT NULL")
    found = meta.unionByName(text).groupBy("case_no").agg(F.min_by("claim", "claim.tier").alias("claim")).select("case_no", "claim.*")
    best = found.agg(F.min("tier").alias("_best"))
    strict = found.crossJoin(F.broadcast(best)).filter((F.col("tier") < 3) | (F.col("_best") == 3)).drop("_best")  # best has one row
    if semantic is None:
        return strict
    near = semantic.join(strict.select("case_no"), "case_no", "left_anti").select("case_no", F.lit(4).alias("tier"), (-F.col("distance")).alias("score"), "hits", "shown", F.lit(None).cast("bigint").alias("id"))
    return strict.unionByName(near)


def ranked(rows: DataFrame, most: int) -> DataFrame:
    """The first rows by tier, score and date, newest first, with page and reason."""
    why = F.element_at(F.array(*map(F.lit, TIERS)), F.col("tier") + 1)
    best = rows.orderBy("tier", F.desc(F.round("score", 6)), F.desc(T.date_key(F.col("date"))), "case_no").limit(most)
    return best.withColumns({"page": F.col("id").bitwiseAND((1 << PAGE_BITS) - 1).cast("int"), "why": why})


def dated(hits: DataFrame, cases: DataFrame) -> DataFrame:
    return hits.join(cases.groupBy("case_no").agg(F.max("date").alias("date")), "case_no")


def with_snippets(rows: DataFrame, index: TextIndex, query: str, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:  # noqa: B008
    """rows (few, with id and shown) with snippet: the parties, or the best passage around its terms, which are marked."""
    wanted = [r["id"] for r in rows.filter("id IS NOT NULL").select("id").distinct().collect()]  # the rows that are shown
    terms = {w for t in tiers(query, vocabulary) for g in t.groups for p in g for w in T.plain_tokens(p)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "passage": [snippet(t, terms) for t in b["text"]]})

    texts = index.docs().filter(F.col("id").isin(wanted)).select("id", "text").mapInPandas(run, "id bigint, passage string")
    return rows.join(F.broadcast(texts), "id", "left").withColumn("snippet", F.coalesce("shown", "passage", F.lit(""))).drop("passage")  # a row for each of wanted


def keyword_search(cases: DataFrame, index: TextIndex, query: str, vocabulary: Vocabulary = Vocabulary(), most: int = 60) -> DataFrame:  # noqa: B008
    """(case_no, date, why, hits, page, tier, score, snippet): the best cases for a query."""
    shown = materialised(ranked(dated(case_hits(cases, index, query, vocabulary), cases), most), "shown")  # few rows, which are read twice
    best = with_snippets(shown, index, query, vocabulary).orderBy("tier", F.desc(F.round("score", 6)), F.desc(T.date_key(F.col("date"))), "case_no")
    return best.select("case_no", "date", "why", "hits", "page", "tier", F.round("score", 6).alias("score"), "snippet")


def area_cases(cases: DataFrame, index: TextIndex, prefixes: list[str] = (), terms: list[str] = ()) -> DataFrame:
    """(case_no, source, id): cases of an area: 0 by a prefix of their number, else 1 by a passage that has one of its terms (phrases)."""
    found = cases.select("case_no", F.lit(1).alias("source"), F.lit(None).cast("bigint").alias("id")).limit(0)
    for p in prefixes:
        found = found.unionByName(cases.filter(F.lower("case_no").startswith(p.lower())).select("case_no", F.lit(0).alias("source"), F.lit(None).cast("bigint").alias("id")))
    if terms:
        hits = index.hits([Phrase.of(t) for t in terms]).select("id").join(index.docs().select("id", F.col("owner").alias("case_no")), "id")
        found = found.unionByName(hits.groupBy("case_no").agg(F.min("id").alias("id")).join(cases.select("case_no").distinct(), "case_no", "left_semi").select("case_no", F.lit(1).alias("source"), "id"))
    return found.groupBy("case_no").agg(F.min("source").alias("source"), F.min_by("id", "source").alias("id"))


def area_search(cases: DataFrame, index: TextIndex, prefixes: list[str] = (), terms: list[str] = (), most: int = 120) -> DataFrame:
    """(case_no, date, source, page): the newest cases of an area."""
    found = dated(area_cases(cases, index, prefixes, terms), cases)
    return found.orderBy(F.desc("date"), "case_no").limit(most).select("case_no", "date", "source", F.col("id").bitwiseAND((1 << PAGE_BITS) - 1).cast("int").alias("page"))


def judge_cases(cases: DataFrame, canonical: list[str], variants: list[str] = ()) -> DataFrame:
    """(case_no): cases where one of the judges sat, by canonical name, or whose judges contain one of their spellings."""
    hit = sat(F.col("judges"), list(canonical)) if canonical else F.lit(False)
    for v in variants:
        hit = hit | F.contains(F.lower("judges"), F.lit(v.lower()))
    benches = materialised(cases.select("judges").distinct().filter(hit), "benches")  # far fewer than cases, and the tests are slow
    return cases.join(benches, "judges", "left_semi").select("case_no").distinct()


def faceted_search(cases: DataFrame, index: TextIndex, judges: tuple[list[str], list[str]] | None = None, area: tuple[list[str], list[str]] | None = None, year: str | None = None, month: str | None = None, query: str | None = None, vocabulary: Vocabulary = Vocabulary(), semantic: DataFrame | None = None, most: int = 200) -> DataFrame:  # noqa: B008
    """(case_no, date, parties, why, hits, page, tier, score, id, shown): cases that meet every facet given; none given: none.

    judges: canonical names and spellings; area: prefixes and terms; month: its English name. With a query the order is by tier, score and date, else
    by date. Each facet is a set of cases; sets meet by semi joins on the case number.
    """
    shown = cases.groupBy("case_no").agg(F.max("date").alias("date"), F.max_by(F.left("parties", F.lit(SHOWN)), F.struct("date", "filename")).alias("parties"))
    if not any((judges, area, year, month, query and query.strip())):
        return shown.limit(0).select("case_no", "date", "parties", F.lit("").alias("why"), F.lit(0).cast("bigint").alias("hits"), F.lit(0).alias("page"), F.lit(0).alias("tier"), F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("id"), F.lit("").alias("shown"))
    sets = []
    if judges:
        sets.append(judge_cases(cases, *judges))
    if area:
        sets.append(area_cases(cases, index, *area).select("case_no"))
    if year or month:
        met = F.lit(True)
        if year:
            met = met & (T.year_of(F.col("case_no"), F.col("date")) == year)
        if month:
            met = met & (T.month_of(F.col("date")) == month)
        sets.append(cases.filter(met).select("case_no").distinct())
    for s in sets:
        shown = shown.join(s, "case_no", "left_semi")
    if query and query.strip():
        found = shown.join(case_hits(cases, index, query, vocabulary, semantic), "case_no")
        return ranked(found, most).select("case_no", "date", "parties", "why", "hits", "page", "tier", F.round("score", 6).alias("score"), "id", "shown")
    newest = shown.orderBy(F.desc("date"), "case_no").limit(most)
    return newest.select("case_no", "date", "parties", F.lit("").alias("why"), F.lit(0).cast("bigint").alias("hits"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("tier"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("bigint").alias("id"), F.col("parties").alias("shown"))


# --- SQL twins: the same tiers by scanning texts


def _hits_sql(query: str, vocabulary: Vocabulary) -> str:
    """Common table expressions up to claims (case_no, tier, score, hits, page) and dates (case_no, date)."""
    plan = tiers(query, vocabulary)
    told = phrases_of(plan)
    phrases = distinct(told)
    f = ", ".join(f"CAST((length(m) - length(replace(m, '{needle(' '.join(p.words), p.star)}', ''))) / {len(needle(' '.join(p.words), p.star))} AS BIGINT) AS f{i}" for i, p in enumerate(phrases))
    d = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(phrases)))
    s = ", ".join(f"(CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d{i} + 0.5) / (d{i} + 0.5)) END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / mean)) AS s{i}" for i in range(len(phrases)))
    claims = []
    for t, own in zip(plan, told, strict=True):
        groups = [[phrases.index(p) for p in g] for g in own]
        met = (" OR " if t.any_group else " AND ").join("(" + " OR ".join(f"f{k} > 0" for k in g) + ")" for g in groups)
        score = " + ".join(f"s{k}" for k in dict.fromkeys(k for g in groups for k in g))
        claims.append(f"SELECT case_no, {TIERS[REASON[t.name]]} AS tier, max({score}) AS score, count(*) AS hits, arg_max(page, (round({score}, 9), -doc_id, -page)) AS page FROM z WHERE {met} GROUP BY case_no")
    like = " OR ".join("(" + " OR ".join(f"contains(lower({c}), '{v.lower()}')" for c in FIELDS) + ")" + (f" AND regexp_matches(concat_ws(' ', {', '.join(FIELDS)}), '(?i)\\b{re.escape(v)}')" if len(v) < SHORT and " " not in v else "") for v in metadata_variants(query.strip(), vocabulary))
    claims.append(f"SELECT case_no, 0 AS tier, 0.0 AS score, 1 AS hits, NULL AS page FROM j WHERE {like} GROUP BY case_no")
    tokens = r"regexp_extract_all(strip_accents(lower(text)), '([\p{L}\p{N}]+)', 1)"
    return (
        f"WITH {JUDGEMENTS}, l AS (SELECT doc_id, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INTEGER) AS page, unnest(string_split(text, chr(10))) AS text FROM documents),"
        f" m AS (SELECT case_no, doc_id, page, t, ' ' || array_to_string(t, '  ') || ' ' AS m FROM (SELECT j.case_no, doc_id, page, {tokens} AS t FROM l JOIN j ON j.seq = l.doc_id)),"
        f" f AS (SELECT case_no, doc_id, page, greatest(len(t), 1) AS len, {f} FROM m), g AS (SELECT count(*) AS n, avg(len) AS mean, {d} FROM f), z AS (SELECT f.*, {s} FROM f, g),"
        f" a AS ({' UNION ALL '.join(claims)}), b AS (SELECT case_no, min(tier) AS tier FROM a GROUP BY case_no), claims AS (SELECT a.* FROM a JOIN b USING (case_no, tier) WHERE tier < 3 OR (SELECT min(tier) FROM b) = 3),"
        " dates AS (SELECT case_no, max(date) AS date FROM j GROUP BY case_no)"
    )


DATE_KEY = "coalesce(TRY_CAST(regexp_replace(substr(date, 1, 10), '[^0-9]', '', 'g') AS BIGINT), 0)"
SHOW = f"SELECT case_no, date, CAST(tier AS INTEGER) AS tier, round(score, 6) AS score, hits, page FROM claims JOIN dates USING (case_no) ORDER BY tier, round(score, 6) DESC, {DATE_KEY} DESC, case_no"
#: An acronym whose expansion is a name in the metadata.
VOCABULARY = Vocabulary(acronyms={"onan": ("nation_7", "of the")})
BOTH = "onan anat"


@operator(_hits_sql(BOTH, Vocabulary()) + SHOW.replace("SELECT", " SELECT", 1))
def r1_case_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Every case that a query of two words finds, with tier, score, hits and page."""
    cases = case_table(spark, sf)
    found = ranked(dated(case_hits(cases, passages(spark, sf), BOTH), cases), 1 << 30)
    return found.select("case_no", "date", "tier", F.round("score", 6).alias("score"), "hits", "page")


@operator(_hits_sql("onan", VOCABULARY) + SHOW.replace("SELECT", " SELECT", 1) + " LIMIT 60")
def r2_case_search(spark: SparkSession, sf: str) -> DataFrame:
    """The sixty best cases for an acronym: those whose metadata have an expansion first, then by passages."""
    return keyword_search(case_table(spark, sf), passages(spark, sf), "onan", VOCABULARY).select("case_no", "date", "tier", "score", "hits", "page")


AREA = (["SC/APPEAL/1"], ["of the", "anat onan"])
AREA_SQL = "m AS (SELECT j.case_no, doc_id, page, ' ' || array_to_string(regexp_extract_all(strip_accents(lower(text)), '([\\p{L}\\p{N}]+)', 1), '  ') || ' ' AS m FROM l JOIN j ON j.seq = l.doc_id), a AS (SELECT case_no, 0 AS source, NULL AS id FROM j WHERE starts_with(lower(case_no), 'sc/appeal/1') UNION ALL SELECT case_no, 1, min(doc_id * 16777216 + page) FROM m WHERE contains(m, ' of  the ') OR contains(m, ' anat  onan ') GROUP BY case_no)"
L = "l AS (SELECT doc_id, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INTEGER) AS page, unnest(string_split(text, chr(10))) AS text FROM documents)"


@operator(f"WITH {JUDGEMENTS}, {L}, {AREA_SQL}, b AS (SELECT case_no, min(source) AS source, arg_min(id, source) AS id FROM a GROUP BY case_no) SELECT case_no, date, source, CAST(CASE WHEN source = 1 THEN id % 16777216 END AS INTEGER) AS page FROM b JOIN (SELECT case_no, max(date) AS date FROM j GROUP BY case_no) USING (case_no) ORDER BY date DESC, case_no LIMIT 120")
def r5_area_by_text(spark: SparkSession, sf: str) -> DataFrame:
    """The newest cases of an area, by number and by the terms of their texts."""
    return area_search(case_table(spark, sf), passages(spark, sf), *AREA)


@operator(_hits_sql("onan", VOCABULARY) + f", x AS ({AREA_SQL.partition(', a AS (')[2][:-1]}), who AS (SELECT DISTINCT case_no FROM (SELECT case_no, judges, unnest(string_split(judges, '; ')) AS display FROM j) WHERE {CANON.format(c='display')} IN ('building', 'nation3') OR contains(lower(judges), 'furniture')), period AS (SELECT DISTINCT case_no FROM j WHERE date LIKE '1996%' OR (NOT regexp_matches(date, '^[0-9]{{4}}') AND CAST(list_max(list_filter(list_transform(regexp_extract_all(case_no, '((?:19|20)[0-9]{{2}})', 1), lambda y: CAST(y AS INTEGER)), lambda y: y BETWEEN 1950 AND 2027)) AS VARCHAR) = '1996')), shown AS (SELECT case_no, max(date) AS date, arg_max(parties[1:110], (date, filename)) AS parties FROM j GROUP BY case_no) SELECT case_no, date, parties, CAST(tier AS INTEGER) AS tier, round(score, 6) AS score, hits, page FROM claims JOIN shown USING (case_no) WHERE case_no IN (SELECT case_no FROM x) AND case_no IN (FROM who) AND case_no IN (FROM period) ORDER BY tier, round(score, 6) DESC, {DATE_KEY} DESC, case_no LIMIT 200")
def r8_faceted_search(spark: SparkSession, sf: str) -> DataFrame:
    """Cases that meet a judge, an area, a year and a query, in the order of the query."""
    found = faceted_search(case_table(spark, sf), passages(spark, sf), judges=(["building", "nation3"], ["furniture"]), area=AREA, year="1996", query="onan", vocabulary=VOCABULARY)
    return found.select("case_no", "date", "parties", "tier", "score", "hits", "page")
