"""Projections, predicates and scalar functions as queries over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.register import operator
from ..sources.tables import JUDGEMENTS, STATUTES, judgements, statutes, table

J, S = f"WITH {JUDGEMENTS} ", f"WITH {STATUTES} "
COLUMNS = ["case_no", "parties", "judges", "keywords", "legislation"]


@operator(J + "SELECT filename, case_no, date FROM j WHERE " + " OR ".join(f"contains(lower({c}), 'nation_7')" for c in COLUMNS))
def p1_metadata_like(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose metadata contain a text, upper or lower case."""
    j = judgements(spark, sf)
    hit = F.lit(False)
    for c in COLUMNS:
        hit = hit | F.lower(c).contains("nation_7")
    return j.filter(hit).select("filename", "case_no", "date")


@operator(J + r"SELECT filename FROM j WHERE regexp_matches(lower(concat_ws(' ', case_no, parties, judges, keywords, legislation)), '\bnat')")
def p2_short_token(spark: SparkSession, sf: str) -> DataFrame:
    """Short words must start a word of the metadata."""
    return judgements(spark, sf).filter(F.lower(F.concat_ws(" ", *COLUMNS)).rlike(r"\bnat")).select("filename")


@operator(J + "SELECT filename, case_no FROM j WHERE case_no ILIKE 'sc/app%'")
def p3_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return judgements(spark, sf).filter(F.col("case_no").ilike("sc/app%")).select("filename", "case_no")


@operator(J + """, m AS (SELECT filename, CASE WHEN parties <> '' THEN parties ELSE case_no END || CASE WHEN report_cite <> '' THEN ' (' || report_cite || ')' ELSE '' END AS label FROM j
  WHERE contains(lower(case_no), 'cust') OR contains(lower(parties), 'cust') OR contains(lower(report_cite), 'cust') ORDER BY filename LIMIT 5)
  SELECT filename, CASE WHEN length(label) > 60 THEN substr(label, 1, 57) || '...' ELSE label END AS label FROM m""")
def p4_type_ahead(spark: SparkSession, sf: str) -> DataFrame:
    """The first five suggestions for what was typed so far."""
    q = "cust"
    j = judgements(spark, sf)
    label = F.concat(F.when(F.col("parties") != "", F.col("parties")).otherwise(F.col("case_no")), F.when(F.col("report_cite") != "", F.concat(F.lit(" ("), "report_cite", F.lit(")"))).otherwise(""))
    hit = F.lower("case_no").contains(q) | F.lower("parties").contains(q) | F.lower("report_cite").contains(q)
    found = j.filter(hit).select("filename", label.alias("label")).orderBy("filename").limit(5)
    return found.select("filename", F.when(F.length("label") > 60, F.concat(F.substring("label", 1, 57), F.lit("..."))).otherwise(F.col("label")).alias("label"))


@operator(J + "SELECT filename, date, substr(parties, 1, 100) AS snippet FROM j WHERE contains(lower(judges), 'justice nation_7') ORDER BY date DESC, filename LIMIT 200")
def p5_cases_by_judge(spark: SparkSession, sf: str) -> DataFrame:
    found = judgements(spark, sf).filter(F.lower("judges").contains("justice nation_7"))
    return found.select("filename", "date", F.substring("parties", 1, 100).alias("snippet")).orderBy(F.desc("date"), "filename").limit(200)


@operator(J + "SELECT filename, date, substr(parties, 1, 100) AS snippet FROM j WHERE contains(lower(keywords), 'urgent') ORDER BY date DESC, filename LIMIT 200")
def p5_cases_by_keyword(spark: SparkSession, sf: str) -> DataFrame:
    found = judgements(spark, sf).filter(F.lower("keywords").contains("urgent"))
    return found.select("filename", "date", F.substring("parties", 1, 100).alias("snippet")).orderBy(F.desc("date"), "filename").limit(200)


@operator(J + "SELECT filename, case_no FROM j WHERE case_no = 'sc appeal 2 97' OR (lower(case_no) = lower('sc appeal 2 97') AND NOT EXISTS (SELECT 1 FROM j WHERE case_no = 'sc appeal 2 97'))")
def p6_nocase_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Equal case numbers; if there are none, those equal but for case."""
    wanted = "sc appeal 2 97"
    near = judgements(spark, sf).filter(F.collate("case_no", "UTF8_LCASE") == F.collate(F.lit(wanted), "UTF8_LCASE")).select("filename", "case_no", (F.col("case_no") == wanted).alias("exact"))
    best = near.agg(F.coalesce(F.bool_or("exact"), F.lit(False)).alias("any"))
    return near.crossJoin(F.broadcast(best)).filter(F.col("exact") | ~F.col("any")).select("filename", "case_no")  # best has one row


@operator(J + r"""SELECT filename, CASE WHEN regexp_matches(date, '^[0-9]{4}') THEN substr(date, 1, 4) ELSE CAST(list_max(list_filter(list_transform(regexp_extract_all(case_no, '((?:19|20)[0-9]{2})', 1), lambda x: CAST(x AS INTEGER)), lambda x: x BETWEEN 1950 AND 2027)) AS VARCHAR) END AS year,
  CASE WHEN length(date) >= 7 THEN ['January','February','March','April','May','June','July','August','September','October','November','December'][CAST(substr(date, 6, 2) AS INTEGER)] END AS month FROM j""")
def p7_year_month(spark: SparkSession, sf: str) -> DataFrame:
    c, d = F.col("case_no"), F.col("date")
    return judgements(spark, sf).select("filename", T.year_of(c, d).alias("year"), T.month_of(d).alias("month"))


@operator(J + "SELECT filename, coalesce(TRY_CAST(regexp_replace(substr(date, 1, 10), '[^0-9]', '', 'g') AS BIGINT), 0) AS date_key FROM j")
def p8_date_key(spark: SparkSession, sf: str) -> DataFrame:
    return judgements(spark, sf).select("filename", T.date_key(F.col("date")).alias("date_key"))


@operator(J + r"SELECT filename FROM j WHERE CASE WHEN date <> '' THEN date >= '1998-06-01' ELSE coalesce(list_max(list_transform(regexp_extract_all(case_no, '((?:19|20)[0-9]{2})', 1), lambda x: CAST(x AS INTEGER))) >= 1998, false) END")
def p9_matches_since(spark: SparkSession, sf: str) -> DataFrame:
    """Dated rows by date; others by the latest year in the name; those without a year are out."""
    years = F.transform(F.regexp_extract_all("case_no", F.lit("((?:19|20)[0-9]{2})"), 1), lambda x: x.cast("int"))
    return judgements(spark, sf).filter(F.when(F.col("date") != "", F.col("date") >= "1998-06-01").otherwise(F.coalesce(F.array_max(years) >= 1998, F.lit(False)))).select("filename")


LABEL = """CASE WHEN act_no <> '' AND year <> '' THEN t || ', No. ' || act_no || ' of ' || year WHEN year <> '' AND NOT contains(t, year) THEN t || ' (' || year || ')' ELSE t END"""


@operator(S + f"SELECT filename, {LABEL} AS label FROM (SELECT *, regexp_replace(trim(regexp_replace(title, '\\s+', ' ', 'g')), '[.,]+$', '') AS t FROM s)")
def p10_statute_label(spark: SparkSession, sf: str) -> DataFrame:
    return statutes(spark, sf).select("filename", T.statute_label(F.col("title"), F.col("act_no"), F.col("year")).alias("label"))


_HEAD = "trim(split_part(t, ':', 1))"
_NAME = f"CASE WHEN contains(t, ':') AND (starts_with(lower({_HEAD}), 'chap') OR contains({_HEAD}, '/')) THEN trim(substr(t, strpos(t, ':') + 1)) ELSE t END"
SHORT = f"SELECT filename, CASE WHEN ends_with(lower(n), ' of sri lanka') THEN n[:-14] ELSE n END AS short_name FROM (SELECT filename, {_NAME} AS n FROM (SELECT filename, array_to_string(list_filter(string_split(title, ' '), lambda w: w <> ''), ' ') AS t FROM s))"


@operator(f"{S} {SHORT}")
def p11_statute_short_name(spark: SparkSession, sf: str) -> DataFrame:
    return statutes(spark, sf).select("filename", T.statute_short_name(F.col("title")).alias("short_name"))


@operator(S + "SELECT filename, CASE WHEN lower(trim(title)) NOT IN ('', 'english', 'sinhala', 'tamil', 'view', 'download') THEN trim(title) WHEN category <> '' THEN array_to_string(list_transform(string_split(replace(category, '-', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE replace(regexp_replace(filename, '\\.pdf$', ''), '-', ' ') END AS title FROM s")
def p12_statute_title(spark: SparkSession, sf: str) -> DataFrame:
    """A title that names a language or link only gives way to the category, then to the file name."""
    t, c = F.trim("title"), F.col("category")
    junk = F.lower(t).isin("", "english", "sinhala", "tamil", "view", "download")
    return statutes(spark, sf).select("filename", F.when(~junk, t).when(c != "", F.initcap(F.replace(c, F.lit("-"), F.lit(" ")))).otherwise(F.replace(F.regexp_replace("filename", r"\.pdf$", ""), F.lit("-"), F.lit(" "))).alias("title"))


DERIVE = """WITH u AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN lpad(CAST(p_size AS VARCHAR), 2, '0') || '-' || (1950 + p_size) || '_E.pdf' ELSE 'file-' || p_partkey || '.pdf' END AS file,
  CASE p_partkey % 2 WHEN 0 THEN p_name || ' Act No. ' || p_size || ' of ' || (1960 + p_size) ELSE p_name END AS title, CASE WHEN p_partkey % 5 = 0 THEN 'acts-' || (1970 + p_size) ELSE 'acts' END AS slug FROM part)"""


@operator(DERIVE + r""", v AS (SELECT *, regexp_extract(file, '^([0-9]{1,3})[-_]([0-9]{4})', 1) AS fa, regexp_extract(file, '^([0-9]{1,3})[-_]([0-9]{4})', 2) AS fy,
  regexp_extract(title, '(?i)\bNo\.?\s*([0-9]{1,3})\s+of\s+([0-9]{4})', 1) AS ta, regexp_extract(title, '(?i)\bNo\.?\s*([0-9]{1,3})\s+of\s+([0-9]{4})', 2) AS ty, regexp_extract(slug, '\b(19[0-9]{2}|20[0-9]{2})\b', 1) AS sy, regexp_extract(title, '\b(19[0-9]{2}|20[0-9]{2})\b', 1) AS ay FROM u)
  SELECT id, CASE WHEN fa <> '' THEN fa ELSE ta END AS act_no, coalesce(nullif(fy, ''), nullif(ty, ''), nullif(sy, ''), ay) AS year FROM v""")
def p13_statute_meta(spark: SparkSession, sf: str) -> DataFrame:
    """Number and year from the file name, then the title, then the page's address."""
    p = table(spark, sf, "part")
    k, n = F.col("p_partkey"), F.col("p_size")
    u = p.select(
        k.alias("id"),
        F.when(k % 3 == 0, F.concat(F.lpad(n.cast("string"), 2, "0"), F.lit("-"), (n + 1950).cast("string"), F.lit("_E.pdf"))).otherwise(F.concat(F.lit("file-"), k.cast("string"), F.lit(".pdf"))).alias("file"),
        F.when(k % 2 == 0, F.concat("p_name", F.lit(" Act No. "), n.cast("string"), F.lit(" of "), (n + 1960).cast("string"))).otherwise(F.col("p_name")).alias("title"),
        F.when(k % 5 == 0, F.concat(F.lit("acts-"), (n + 1970).cast("string"))).otherwise("acts").alias("slug"),
    )
    in_file, in_title, any_year = r"^([0-9]{1,3})[-_]([0-9]{4})", r"(?i)\bNo\.?\s*([0-9]{1,3})\s+of\s+([0-9]{4})", r"\b(19[0-9]{2}|20[0-9]{2})\b"
    act = F.coalesce(T.nonempty(F.regexp_extract("file", in_file, 1)), F.regexp_extract("title", in_title, 1))
    year = F.coalesce(T.nonempty(F.regexp_extract("file", in_file, 2)), T.nonempty(F.regexp_extract("title", in_title, 2)), T.nonempty(F.regexp_extract("slug", any_year, 1)), F.regexp_extract("title", any_year, 1))
    return u.select("id", act.alias("act_no"), year.alias("year"))


@operator(r"""SELECT page_id, CASE WHEN regexp_matches(path, '/(?:en|acts)(?:/|$)') THEN 'statute' WHEN regexp_matches(path, '/(?:fr|cases)(?:/|$)') THEN 'case' ELSE 'document' END AS kind, regexp_extract(regexp_replace(path, '/+$', ''), '([^/]*)$', 1) AS category,
  regexp_matches(host, 'example\.(com|org)$') AND NOT contains(url, 'add-to-cart') AND NOT regexp_matches(path, '(?i)\.(?:jpe?g|png|css|js|zip|pdf)$') AS crawlable
  FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)""")
def p14_page_kind(spark: SparkSession, sf: str) -> DataFrame:
    """Kind, category and whether to crawl, from a page's address."""
    u = table(spark, sf, "pages").select("page_id", "url", F.parse_url("url", F.lit("HOST")).alias("host"), F.coalesce(F.parse_url("url", F.lit("PATH")), F.lit("")).alias("path"))
    kind = F.when(F.col("path").rlike("/(?:en|acts)(?:/|$)"), "statute").when(F.col("path").rlike("/(?:fr|cases)(?:/|$)"), "case").otherwise("document")
    crawl = F.col("host").rlike(r"example\.(com|org)$") & ~F.col("url").contains("add-to-cart") & ~F.col("path").rlike(r"(?i)\.(?:jpe?g|png|css|js|zip|pdf)$")
    return u.select("page_id", kind.alias("kind"), F.regexp_extract(F.regexp_replace("path", "/+$", ""), "([^/]*)$", 1).alias("category"), crawl.alias("crawlable"))


@operator(J + r"""SELECT filename, CASE WHEN slug = '' THEN 'doc' ELSE slug END || '-' || left(md5(filename), 6) || '.pdf' AS local_name FROM (SELECT filename, trim(substr(trim(regexp_replace(lower(trim(parties)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 55), '-') AS slug FROM j)""")
def p15_local_name(spark: SparkSession, sf: str) -> DataFrame:
    """A readable file name that doesn't collide."""
    s = T.slug(F.col("parties"))
    return judgements(spark, sf).select("filename", F.concat(F.when(s == "", "doc").otherwise(s), F.lit("-"), F.left(F.md5("filename"), F.lit(6)), F.lit(".pdf")).alias("local_name"))


@operator("""SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN CAST(c_custkey % 80 AS INTEGER) || ' NLR' WHEN 1 THEN 'SLR ' || (1950 + c_custkey % 70) ELSE '' END AS cite FROM customer""")
def p16_report_cite(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    category = F.when(k % 3 == 0, F.concat(F.lit("new-law-reports-volume-"), F.lpad((k % 80).cast("string"), 3, "0"))).when(k % 3 == 1, F.concat(F.lit("sri-lanka-law-reports-"), (k % 70 + 1950).cast("string"))).otherwise("other-reports")
    return table(spark, sf, "customer").select(k.alias("id"), T.report_cite(category).alias("cite"))


@operator("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 3 THEN 'PART ' || p_partkey ELSE replace(p_name, ' ', ' ') || ' v ' || p_brand END AS title FROM (SELECT p_partkey, p_name, trim(regexp_replace(p_brand, '[^A-Za-z0-9]+', ' ', 'g')) AS p_brand FROM part)""")
def p17_clean_title(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    brand = F.trim(F.regexp_replace("p_brand", "[^A-Za-z0-9]+", " "))
    packed = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-v-"), F.replace(brand, F.lit(" "), F.lit("-")))
    title = F.when(k % 4 == 0, F.concat(packed, F.lit(".pdf"))).when(k % 4 == 1, F.concat(F.lit("  "), F.replace(packed, F.lit("-"), F.lit("_")), F.lit(".,"))).when(k % 4 == 2, F.concat("p_name", F.lit("   v "), brand)).otherwise(F.lit(" .PDF"))
    return table(spark, sf, "part").select(k.alias("id"), T.clean_title(title, F.concat(F.lit("part_"), k.cast("string"), F.lit(".pdf"))).alias("title"))


@operator("""WITH y AS (SELECT doc_id, CAST(20 + doc_id % 60 AS INTEGER) AS volume, CAST(1893 + round((20 + doc_id % 60) * 1.07) AS INTEGER) AS est, 1910 + CAST(n_chars % 60 AS INTEGER) AS a, 1915 + CAST(n_chars % 50 AS INTEGER) AS b, n_chars % 4 = 0 AS second FROM documents),
  l AS (SELECT doc_id, est, unnest(CASE WHEN second THEN [a, b, b] ELSE [a, b] END) AS year, unnest(CASE WHEN second THEN [1, 2, 3] ELSE [1, 2] END) AS pos FROM y),
  k AS (SELECT doc_id, year, count(*) AS n, min(pos) AS first FROM l WHERE abs(year - est) <= 8 GROUP BY ALL)
  SELECT doc_id, CAST(coalesce(best, est) AS VARCHAR) AS year FROM y LEFT JOIN (SELECT doc_id, arg_max(year, n * 10 - first) AS best FROM k GROUP BY doc_id) USING (doc_id)""")
def p19_case_year(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent year near the volume's era, the earliest named of equally frequent ones, or the era's estimate."""
    d = table(spark, sf, "documents")
    n, volume = F.col("n_chars"), F.col("doc_id") % 60 + 20
    est = (F.lit(1893) + F.round(volume * 1.07)).cast("int")
    text = F.concat(F.lit("Decided in "), (n % 60 + 1910).cast("string"), F.lit(" after "), (n % 50 + 1915).cast("string"), F.when(n % 4 == 0, F.concat(F.lit(" and "), (n % 50 + 1915).cast("string"))).otherwise(""))
    named = d.select("doc_id", est.alias("est"), F.posexplode_outer(F.regexp_extract_all(F.substring(text, 1, 4000), F.lit(r"\b(1[89][0-9]{2}|20[0-2][0-9])\b"), 1)).alias("pos", "y")).withColumn("y", F.col("y").cast("int"))
    near = named.withColumn("y", F.when(F.abs(F.col("y") - F.col("est")) <= 8, F.col("y")))
    counted = near.groupBy("doc_id", "est", "y").agg(F.count("y").alias("n"), F.min("pos").alias("first"))
    best = counted.groupBy("doc_id", "est").agg(F.max_by("y", F.struct("n", -F.col("first"))).alias("best"))
    return best.select("doc_id", F.coalesce("best", "est").cast("string").alias("year"))


@operator(S + """SELECT filename, CASE n WHEN 1 THEN title WHEN 2 THEN title || ' [' || tag || ']' ELSE title || ' [' || tag || '-' || n || ']' END AS unique_id FROM (SELECT filename, title, regexp_extract(filename, '-([^-]*)\\.pdf$', 1) AS tag, row_number() OVER (PARTITION BY title ORDER BY filename) AS n FROM s)""")
def p20_unique_id(spark: SparkSession, sf: str) -> DataFrame:
    """Names that occur twice get a tag, later ones a tag and a number. Row numbers are taken within a name alone."""
    n = F.row_number().over(Window.partitionBy("title").orderBy("filename"))
    s = statutes(spark, sf).select("filename", "title", F.regexp_extract("filename", r"-([^-]*)\.pdf$", 1).alias("tag"), n.alias("n"))
    return s.select("filename", F.when(F.col("n") == 1, F.col("title")).when(F.col("n") == 2, F.concat("title", F.lit(" ["), "tag", F.lit("]"))).otherwise(F.concat("title", F.lit(" ["), "tag", F.lit("-"), F.col("n").cast("string"), F.lit("]"))).alias("unique_id"))


_ACT = "list_has_any(string_split(replace(split_part(title, 'No.', 1), ',', ''), ' '), ['Act']) AND contains(title, 'No.') AND coalesce(TRY_CAST(trim(split_part(split_part(title, 'No.', 2), ' of ', 2))[1:4] AS INTEGER) BETWEEN 1800 AND 2099, false)"
_GAZETTE = "starts_with(title, 'No.') AND contains(title, '/') AND length(trim(split_part(title[4:], '/', 1))) BETWEEN 3 AND 4"
_BILL = "length(split_part(title, '_', 2)) = 1 AND length(split_part(title, '-', 1)) <= 3 AND TRY_CAST(split_part(split_part(title, '_', 1), '-', 2) AS INTEGER) BETWEEN 1000 AND 9999"


@operator(S + f"SELECT filename, title FROM s WHERE NOT (({_ACT}) OR ({_GAZETTE}) OR ({_BILL}))")
def p21_reject_non_cases(spark: SparkSession, sf: str) -> DataFrame:
    return statutes(spark, sf).filter(~is_no_case(F.col("title"))).select("filename", "title")


def is_no_case(title: Column) -> Column:
    """Whether a title is that of an act ('... Act ... No. n of y'), a gazette ('No. n/m') or a bill ('n-y_L')."""
    numbered = F.regexp_extract(title, r"No\.\s*[0-9]+\s+of\s+([0-9]{4})", 1).try_cast("int").between(1800, 2099)
    act = F.array_contains(F.split(F.substring_index(title, "No.", 1), r"\W+"), "Act") & F.coalesce(numbered, F.lit(False))
    gazette = title.startswith("No.") & F.length(F.regexp_extract(title, r"^No\.\s*([0-9]+)/[0-9]", 1)).between(3, 4)
    number, year, letter = F.substring_index(title, "-", 1), F.substring_index(F.substring_index(title, "_", 1), "-", -1), F.substring_index(title, "_", -1)
    bill = (title == F.concat(number, F.lit("-"), year, F.lit("_"), letter)) & number.rlike("^[0-9]{1,3}$") & year.rlike("^[0-9]{4}$") & letter.rlike("^[A-Z]$")
    return act | gazette | bill


@operator(J + "SELECT filename, upper(replace(regexp_replace(filename, '\\.pdf$', ''), '_', ' ')) AS case_no FROM j")
def p22_case_no_from_filename(spark: SparkSession, sf: str) -> DataFrame:
    return judgements(spark, sf).select("filename", T.case_no_from_filename(F.col("filename")).alias("case_no"))


@operator("SELECT doc_id, length(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS n, md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS digest FROM documents")
def p23_norm_alnum(spark: SparkSession, sf: str) -> DataFrame:
    norm = T.norm_alnum(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.length(norm).cast("bigint").alias("n"), F.md5(norm).alias("digest"))


SIG = r"list_transform(range(1, len(regexp_extract_all({c}, '([0-9]{{1,4}})\s*[/\- ]\s*([0-9]{{2,4}})', 1)) + 1), lambda i: regexp_extract_all({c}, '([0-9]{{1,4}})\s*[/\- ]\s*([0-9]{{2,4}})', 1)[i] || '/' || CASE WHEN length(regexp_extract_all({c}, '([0-9]{{1,4}})\s*[/\- ]\s*([0-9]{{2,4}})', 2)[i]) = 4 THEN '' WHEN CAST(regexp_extract_all({c}, '([0-9]{{1,4}})\s*[/\- ]\s*([0-9]{{2,4}})', 2)[i] AS INTEGER) < 50 THEN '20' ELSE '19' END || regexp_extract_all({c}, '([0-9]{{1,4}})\s*[/\- ]\s*([0-9]{{2,4}})', 2)[i])"


@operator(J + f"SELECT filename, array_to_string({SIG.format(c='case_no')}, ';') AS signatures FROM j")
def p24_case_signatures(spark: SparkSession, sf: str) -> DataFrame:
    return judgements(spark, sf).select("filename", F.array_join(T.case_signatures(F.col("case_no")), ";").alias("signatures"))


@operator("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 80 + 1) || ' NLR' WHEN 1 THEN 'SLR ' || strftime(o_orderdate, '%Y') ELSE '' END AS keys FROM orders")
def p25_report_keys(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    year = F.date_format("o_orderdate", "yyyy")
    cited = F.when(k % 3 == 0, F.concat(F.lit("("), year, F.lit(") "), (k % 80 + 1).cast("string"), F.when(k % 2 == 0, " N.L.R. 73").otherwise(" New Law Reports 5"))).when(k % 3 == 1, F.concat(F.lit("["), year, F.lit("] 1 Sri L.R. 18"))).otherwise(F.concat(F.lit("SC "), year))
    return table(spark, sf, "orders").select(k.alias("id"), F.array_join(T.report_keys(cited), ";").alias("keys"))


@operator(J + "SELECT filename, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(parties), '([a-z]{4,})', 1)), lambda w: w NOT IN ('appellant','respondent','petitioner','defendant','plaintiff','others','another','the','and','law','reports','volume','sri','lanka','ceylon'))), ' ') AS words FROM j")
def p26_party_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return judgements(spark, sf).select("filename", F.array_join(F.array_sort(T.party_tokens(F.col("parties"))), " ").alias("words"))


_BARE = rf"regexp_replace(case_no, '{T.SIGNATURE}', ' ', 'g')"
_WORDS = f"regexp_extract_all({_BARE}, '[A-Za-z0-9_]+[.]?|[^A-Za-z0-9_]')"
_KEPT = f"list_transform({_WORDS}, lambda w: CASE WHEN list_contains({T.COURT_WORDS}, upper(rtrim(w, '.'))) THEN ' ' ELSE w END)"


@operator(J + f"SELECT filename, array_to_string(list_filter(string_split(array_to_string({_KEPT}, ''), ' '), lambda w: w <> ''), ' ') AS terms FROM j")
def p27_citation_terms(spark: SparkSession, sf: str) -> DataFrame:
    return judgements(spark, sf).select("filename", T.citation_terms(F.col("case_no")).alias("terms"))


@operator("""SELECT s_suppkey AS id, upper(n_name[1]) || lower(n_name[2:]) AS display, lower(regexp_replace(n_name, '[^A-Z0-9]', '', 'g')) AS canonical FROM supplier JOIN (SELECT n_nationkey, replace(n_name, ' ', '') AS n_name FROM nation) ON s_nationkey = n_nationkey""")
def p28_judge_names(spark: SparkSession, sf: str) -> DataFrame:
    """Titles and suffixes of many forms vanish, whatever the case."""
    k = F.col("s_suppkey")
    n = table(spark, sf, "nation").select("n_nationkey", F.replace("n_name", F.lit(" "), F.lit("")).alias("name"))
    s = table(spark, sf, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    raw = F.when(k % 5 == 0, F.concat(F.lit("Hon. Justice "), "name", F.lit(", P.C., J."))).when(k % 5 == 1, F.concat(F.lit("Hon'ble Mr. Justice "), "name", F.lit(" CJ"))).when(k % 5 == 2, F.concat(F.lit("Dr. "), "name", F.lit(", PC"))).when(k % 5 == 3, F.concat("name", F.lit(", Chief Justice"))).otherwise(F.concat(F.lit(" Judge "), "name", F.lit(" J. ")))
    return s.select(k.alias("id"), T.clean_judge(raw).alias("display"), T.canonical_judge(raw).alias("canonical"))


@operator(J + "SELECT filename, array_to_string(list_sort(list_filter(regexp_extract_all(lower(judges), '([a-z]+)', 1), lambda w: length(w) > 1 AND w NOT IN ('hon', 'justice', 'pc', 'cj'))), ' ') AS key FROM j")
def p30_judge_key(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted words of the names without titles."""
    words = F.filter(F.regexp_extract_all(F.lower("judges"), F.lit("([a-z]+)"), 1), lambda w: (F.length(w) > 1) & ~w.isin("hon", "justice", "pc", "cj"))
    return judgements(spark, sf).select("filename", F.array_join(F.array_sort(words), " ").alias("key"))


@operator("""SELECT doc_id, CASE WHEN n_chars <= 3584 THEN text ELSE substr(text, 1, 2150) || chr(10) || '[...]' || chr(10) || right(text, 1434) END AS fitted FROM documents""")
def p31_fit_to_context(spark: SparkSession, sf: str) -> DataFrame:
    """Long texts keep 60 % of the budget at the head and the rest at the tail; 3.5 characters a token, 1024 tokens."""
    budget = int(1024 * 3.5)
    head = int(budget * 0.6)
    t = F.col("text")
    fitted = F.when(F.length(t) <= budget, t).otherwise(F.concat(F.substring(t, 1, head), F.lit("\n[...]\n"), F.right(t, F.lit(budget - head))))
    return table(spark, sf, "documents").select("doc_id", fitted.alias("fitted"))


@operator("SELECT conv_id, turn, length(text) // 4 AS tokens, CAST(round((length(text) // 4) * CASE role WHEN 'assistant' THEN 0.000015 ELSE 0.000003 END, 9) AS DOUBLE) AS cost FROM conversations")
def p32_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Four characters a token; three millionths a token in, fifteen out."""
    n = F.floor(F.length("text") / 4)
    return table(spark, sf, "conversations").select("conv_id", "turn", n.alias("tokens"), F.round(n * F.when(F.col("role") == "assistant", 15e-6).otherwise(3e-6), 9).alias("cost"))


@operator("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'c' || user_id END AS case_no, CASE WHEN event_id % 5 = 0 OR event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 50 AS INTEGER) END AS page, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(event_id % 7 AS VARCHAR) END AS para FROM events""")
def p36_citation_field(spark: SparkSession, sf: str) -> DataFrame:
    """'[case | page:para]' as fields; null words are null, a page that is no number is a paragraph."""
    e = F.col("event_id")
    cite = F.when(e % 5 == 0, "null").when(e % 3 == 0, F.concat(F.lit("[c"), F.col("user_id").cast("string"), F.lit(" | x]"))).otherwise(F.concat(F.lit("[c"), F.col("user_id").cast("string"), F.lit(" | "), (e % 50).cast("string"), F.lit(":"), (e % 7).cast("string"), F.lit("]")))
    bare = F.regexp_replace(F.trim(cite), r"^\[|\]$", "")
    bare = F.when(~F.lower(bare).isin("", "null", "none", "n/a"), bare)
    place = F.trim(F.element_at(F.split(bare, r"\|"), 2))
    page, para = F.trim(F.element_at(F.split(place, ":"), 1)), F.trim(F.get(F.split(place, ":"), F.lit(1)))
    is_number = page.rlike("^[0-9]+$")
    return table(spark, sf, "events").select("event_id", F.trim(F.element_at(F.split(bare, r"\|"), 1)).alias("case_no"), F.when(is_number, page.cast("int")).alias("page"), F.when(is_number, para).otherwise(page).alias("para"))


#: A precedent's treatments, with the verb forms that mean each. Fixed values.
TREATMENTS = {"applied": ("apply", "applies"), "followed": ("follow", "follows"), "distinguished": ("distinguish", "distinguishes"), "overruled": ("overrule", "overrules"), "considered": ("consider", "considers")}
#: What a field of an analysis has where the source says nothing. Fixed value.
NOT_AVAILABLE = "Information not available in source text."


def treatment(c: Column) -> Column:
    """A word for a precedent's treatment as one of the values; anything else is NOT_AVAILABLE."""
    word = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    known = F.create_map(*(F.lit(x) for value, forms in TREATMENTS.items() for form in (value, *forms) for x in (form, value.upper())))
    return F.coalesce(F.try_element_at(known, word), F.lit("NOT_AVAILABLE"))


RAW_TREATMENT = "CASE o_orderkey % 8 WHEN 0 THEN ' Applied ' WHEN 1 THEN 'FOLLOWS' WHEN 2 THEN 'distinguish' WHEN 3 THEN 'Overruled' WHEN 4 THEN 'considers' WHEN 5 THEN 'not followed' WHEN 6 THEN 'cited' END"


@operator(f"SELECT id, CASE WHEN w IN ('applied', 'apply', 'applies') THEN 'APPLIED' WHEN w IN ('followed', 'follow', 'follows') THEN 'FOLLOWED' WHEN w IN ('distinguished', 'distinguish', 'distinguishes') THEN 'DISTINGUISHED' WHEN w IN ('overruled', 'overrule', 'overrules') THEN 'OVERRULED' WHEN w IN ('considered', 'consider', 'considers') THEN 'CONSIDERED' ELSE 'NOT_AVAILABLE' END AS treatment FROM (SELECT o_orderkey AS id, lower(trim({RAW_TREATMENT})) AS w FROM orders)")
def p37_treatment(spark: SparkSession, sf: str) -> DataFrame:
    """Words for a precedent's treatment as one of six values."""
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), treatment(F.expr(RAW_TREATMENT)).alias("treatment"))


def quality(fields: list[Column]) -> dict[str, Column]:
    """How many core fields of an analysis are filled, their share, and whether it is hollow: fewer than two."""
    filled = sum((F.coalesce((F.trim(c) != "") & (F.trim(c) != NOT_AVAILABLE), F.lit(False)).cast("int") for c in fields), F.lit(0))
    return {"filled": filled, "ratio": F.round(filled / float(len(fields)), 2), "hollow": filled < 2}


#: The seven core fields of each judgment's analysis, as SQL over the view.
CORE = ["CASE WHEN seq % 3 = 0 THEN parties ELSE '' END", "CASE WHEN seq % 5 < 2 THEN legislation ELSE '" + NOT_AVAILABLE + "' END", "report_cite", "CASE WHEN seq % 7 = 0 THEN keywords END", "CASE WHEN seq % 4 = 0 THEN date ELSE '  ' END", "CASE WHEN seq % 11 = 0 THEN judges END", "CASE WHEN seq % 6 = 0 THEN case_no END"]


@operator(J + " SELECT filename, CAST(filled AS INTEGER) AS filled, round(filled / 7.0::DOUBLE, 2) AS ratio, filled < 2 AS hollow FROM (SELECT filename, " + " + ".join(f"CASE WHEN trim({c}) NOT IN ('', '{NOT_AVAILABLE}') THEN 1 ELSE 0 END" for c in CORE) + " AS filled FROM j)")
def p39_quality(spark: SparkSession, sf: str) -> DataFrame:
    """The completeness of each judgment's analysis."""
    return judgements(spark, sf).select("filename", *(c.alias(n) for n, c in quality([F.expr(c) for c in CORE]).items()))


def doc_kind(cite: Column) -> Column:
    """What kind of report a citation is from; without one the court's own judgment."""
    return F.when(cite.endswith("NLR"), "NLR report").when(cite.startswith("SLR"), "SLR report").when(cite == "Digest", "Digest").otherwise("SC judgment")


@operator(J + " SELECT filename, CASE WHEN c LIKE '%NLR' THEN 'NLR report' WHEN c LIKE 'SLR%' THEN 'SLR report' WHEN c = 'Digest' THEN 'Digest' ELSE 'SC judgment' END AS kind FROM (SELECT filename, CASE WHEN seq % 9 = 0 THEN 'Digest' ELSE report_cite END AS c FROM j)")
def p40_doc_kind(spark: SparkSession, sf: str) -> DataFrame:
    return judgements(spark, sf).select("filename", doc_kind(F.when(F.col("seq") % 9 == 0, "Digest").otherwise(F.col("report_cite"))).alias("kind"))


@operator("SELECT doc_id, CASE WHEN length(text) > 180 THEN substr(text, 1, 180) || '...' ELSE text END AS card FROM documents ORDER BY doc_id LIMIT 40")
def p41_cards(spark: SparkSession, sf: str) -> DataFrame:
    """The first forty cards; a long text is cut."""
    return table(spark, sf, "documents").orderBy("doc_id").limit(40).select("doc_id", F.when(F.length("text") > 180, F.concat(F.substring("text", 1, 180), F.lit("..."))).otherwise(F.col("text")).alias("card"))


@operator("SELECT user_id AS id, 'p:' || max(event_id) AS secret FROM events GROUP BY user_id")
def p42_parse_users(spark: SparkSession, sf: str) -> DataFrame:
    """'a:b,c:d' as rows; only the first colon parts a pair, a later pair wins."""
    e = table(spark, sf, "events").withColumn("pair", F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(":p:"), F.col("event_id").cast("string")))
    spec = e.groupBy((F.col("user_id") % 16).alias("g")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "pair"))), lambda x: x["pair"]), ",").alias("spec"))
    pairs = spec.select(F.posexplode(F.split("spec", ",")).alias("pos", "pair")).select("pos", F.substring_index("pair", ":", 1).alias("name"), F.regexp_extract("pair", "^[^:]*:(.*)$", 1).alias("secret"))
    return pairs.groupBy("name").agg(F.max_by("secret", "pos").alias("secret")).select(F.substring("name", 2, 20).cast("bigint").alias("id"), "secret")


@operator("SELECT n_nationkey AS id, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ', J.' AS name FROM nation")
def p43_judge_display(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat("n_name", F.lit(", J."))
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.initcap(F.lower(F.regexp_replace(raw, r"(?i)[\s,]+J\.?\s*$", ""))), F.lit(", J.")).alias("name"))


@operator("SELECT c_custkey AS id, CAST(1990 + least(c_custkey % 7, c_custkey % 11) AS INTEGER) AS low, CAST(1990 + greatest(c_custkey % 7, c_custkey % 11) AS INTEGER) AS high FROM customer")
def p44_parse_years(spark: SparkSession, sf: str) -> DataFrame:
    """'Y', 'Y-Y' or 'Y:Y' as an ordered range."""
    k = F.col("c_custkey")
    a, b = (k % 7 + 1990).cast("string"), (k % 11 + 1990).cast("string")
    spec = F.when(a == b, a).when(k % 2 == 0, F.concat(a, F.lit("-"), b)).otherwise(F.concat(a, F.lit(" : "), b))
    ends = F.transform(F.regexp_extract_all(spec, F.lit(r"([0-9]{4})"), 1), lambda x: x.cast("int"))
    return table(spark, sf, "customer").select(k.alias("id"), F.array_min(ends).alias("low"), F.array_max(ends).alias("high"))
