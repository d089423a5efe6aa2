"""Listing pages, sitemaps and manifests: from HTML to typed records."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.register import operator
from .shipping import materialised
from .tables import JUDGEMENTS, judgements, table

LINK = r"""(?i)<a\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)["']?[^>]*>"""
#: First words of a link's text that say nothing of what it leads to; 'read' does so before 'more'. Fixed values.
GENERIC = ["click", "download", "english", "here", "link", "open", "pdf", "see", "sinhala", "sinhalese", "tamil", "view"]


def is_generic(title: Column) -> Column:
    """Whether a link's text is too short or begins with words that say nothing."""
    own = F.split(F.lower(F.trim(title)), "[^a-z0-9_]+")
    return (F.length(title) < 3) | F.get(own, F.lit(0)).isin(GENERIC) | (F.array_join(F.slice(own, 1, 2), " ") == "read more")


def links(html: Column) -> Column:
    """Addresses of all links, in order."""
    return F.regexp_extract_all(html, F.lit(LINK), 1)


class _Table(HTMLParser):
    """Rows of tables: cells' texts, the first matching link, the first data-order, and texts by class."""

    def __init__(self, suffix: str):
        super().__init__()
        self.suffix, self.rows, self.row, self.open = suffix, [], None, []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "tr":
            self.row = {"cells": [], "link": None, "order": None, "by": {}}
            self.rows.append(self.row)
        if self.row is None:
            return
        if tag == "a" and self.row["link"] is None and self.suffix in (a.get("href") or "").lower():
            self.row["link"] = a["href"]
        if self.row["order"] is None and a.get("data-order"):
            self.row["order"] = a["data-order"]
        if tag == "td":
            self.row["cells"].append([])
        if tag not in ("br", "img", "input", "hr", "meta", "link"):
            self.open.append((tag, (a.get("class") or "").split()))
            for c in self.open[-1][1]:
                self.row["by"].setdefault(c, []).append([])

    def handle_endtag(self, tag):
        while self.open and self.open[-1][0] != tag and any(t == tag for t, _ in self.open):
            self.open.pop()
        if self.open and self.open[-1][0] == tag:
            self.open.pop()
        if tag == "tr":
            self.row, self.open = None, []

    def handle_data(self, data):
        if self.row is not None and data.strip():
            if self.row["cells"] and any(t == "td" for t, _ in self.open):
                self.row["cells"][-1].append(data.strip())
            for _, classes in self.open:
                for c in classes:
                    self.row["by"][c][-1].append(data.strip())


def archive_records(html: str, base: str, suffix: str = ".pdf") -> list[dict]:
    """One record for each table row with a link to a document: by class where there is one, by position otherwise."""
    parser, out = _Table(suffix), {}
    parser.feed(html)
    for row in parser.rows:
        if not row["link"]:
            continue
        cells = [" ".join(c) for c in row["cells"]]

        def cell(name: str, at: int, row=row, cells=cells) -> str:
            named = " ".join(row["by"].get(name, [[]])[0])
            return named or (cells[at] if at < len(cells) else "")

        url = urljoin(base, row["link"])
        name = unquote(urlparse(url).path.rsplit("/", 1)[-1])
        split = lambda s: [p.strip() for p in s.replace(";", ",").replace("\n", ",").split(",") if p.strip()]
        out[name] = {"filename": name, "url": url, "case_no": cell("case-code", 1), "date": row["order"] or "", "parties": cell("parties", 2), "judges": split(cell("judge", 3)), "keywords": split(cells[4]) if len(cells) > 4 else []}
    return list(out.values())


@operator()
def s1_archive_table(spark: SparkSession, sf: str) -> DataFrame:
    """Records of every page's table rows. A listing is laid out of each page's links, one row a link."""
    pages = table(spark, sf, "pages").select("page_id", "url", F.posexplode(links(F.col("html"))).alias("pos", "href"))
    row = F.concat(F.lit("<tr><td data-order='2024-01-"), F.lpad((F.col("pos") % 28 + 1).cast("string"), 2, "0"), F.lit("'>d</td><td class='case-code'>SC "), F.col("pos").cast("string"), F.lit("/2024</td><td>A v. B</td><td><span class=judge>X, Y</span></td><td>k1; k2</td><td><a href='"), "href", F.lit(".pdf'>get</a></td></tr>"))
    listing = pages.groupBy("page_id", "url").agg(F.concat(F.lit("<table>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", row.alias("row")))), lambda x: x["row"]), ""), F.lit("</table>")).alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [{"page_id": p} | r for p, u, h in zip(b["page_id"], b["url"], b["html"], strict=True) for r in archive_records(h, u)]
            yield pd.DataFrame(found, columns=["page_id", "filename", "url", "case_no", "date", "parties", "judges", "keywords"])

    return listing.mapInPandas(run, "page_id bigint, filename string, url string, case_no string, date string, parties string, judges array<string>, keywords array<string>")


@operator(r"""SELECT page_id, pos, regexp_extract(href, '([^/?#]*)(?:[?#].*)?$', 1) AS filename FROM (SELECT page_id, CAST(unnest(range(len(h))) AS INTEGER) AS pos, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)["'']?[^>]*>', 1) AS h FROM pages))""")
def s2_index_links(spark: SparkSession, sf: str) -> DataFrame:
    """File names of all links of a directory page."""
    p = table(spark, sf, "pages").select("page_id", F.posexplode(links(F.col("html"))).alias("pos", "href"))
    return p.select("page_id", "pos", F.regexp_extract("href", r"([^/?#]*)(?:[?#].*)?$", 1).alias("filename"))


@operator("WITH a AS (SELECT o_custkey AS k, max(o_orderdate)::DATE::VARCHAR AS date FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') SELECT coalesce(a.k, b.k) AS k, coalesce(date, '') AS date, CASE WHEN a.k IS NULL THEN 'index' WHEN b.k IS NULL THEN 'archive' ELSE 'both' END AS source FROM a FULL JOIN b ON a.k = b.k")
def s3_merge_listings(spark: SparkSession, sf: str) -> DataFrame:
    """Two listings as one, with where each entry comes from."""
    o = table(spark, sf, "orders")
    a = o.filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("date"))
    b = o.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k"), F.lit(True).alias("listed")).distinct()
    source = F.when(F.col("date").isNull(), "index").when(F.col("listed").isNull(), "archive").otherwise("both")
    return a.join(b, "k", "full_outer").select("k", F.coalesce("date", F.lit("")).alias("date"), source.alias("source")).orderBy(F.desc("date"), F.desc("k"))


@operator("SELECT DISTINCT url FROM pages WHERE regexp_matches(url, '/(?:en|fr)/')")
def s4_sitemap(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct addresses of a sitemap whose path is of the wanted kinds."""
    maps = table(spark, sf, "pages").select(F.concat(F.lit("<url><loc> "), "url", F.lit(" </loc></url>")).alias("xml"))
    found = maps.select(F.explode(F.regexp_extract_all("xml", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1)).alias("url")).distinct()
    return found.filter(F.col("url").rlike("/(?:en|fr)/")).orderBy("url")


@operator(r"""WITH a AS (SELECT page_id, CAST(unnest(range(len(h))) AS INTEGER) AS pos, unnest(h) AS href, unnest(t) AS title FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\b[^>]*\bhref="([^"]*)"[^>]*>([^<]*)</a>', 1) AS h, regexp_extract_all(html, '(?i)<a\b[^>]*\bhref="([^"]*)"[^>]*>([^<]*)</a>', 2) AS t FROM pages)),
  c AS (SELECT *, length(trim(title)) < 3 OR list_contains({GENERIC}, regexp_extract(lower(trim(title)), '^[a-z0-9_]+')) OR starts_with(lower(trim(title)), 'read more') AS generic FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY generic, pos) AS n FROM c)
  SELECT page_id, href, CASE WHEN generic THEN 'heading' ELSE trim(title) END AS title FROM r WHERE n = 1""".replace("{GENERIC}", str(GENERIC)))
def s5_document_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Each address once, under its first descriptive link text, or else the page's heading."""
    pattern = r'(?i)<a\b[^>]*\bhref="([^"]*)"[^>]*>([^<]*)</a>'
    p = table(spark, sf, "pages").select("page_id", F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), 1).alias("href"), F.regexp_extract_all("html", F.lit(pattern), 2).alias("title")).alias("z"))
    a = p.select("page_id", F.posexplode("z").alias("pos", "x")).select("page_id", "pos", "x.href", F.trim("x.title").alias("title"))
    generic = is_generic(F.col("title"))
    n = F.row_number().over(Window.partitionBy("page_id", "href").orderBy(generic, "pos"))
    return a.withColumns({"generic": generic, "n": n}).filter("n = 1").select("page_id", "href", F.when(F.col("generic"), "heading").otherwise(F.col("title")).alias("title"))


def crawl(links: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """(node, depth, owner): breadth first over links (a, b) from start (node) until nothing new is found.

    Each node is found once, at its least depth; its owner is the least node of the depth before that links to it. most: pages at most, those of
    less depth and of lesser names first. A round joins the frontier alone with the links; what has been found is a written table, so a round's plan stays
    small, and a lost executor repeats one round.
    """
    spark = links.sparkSession
    edges = links.select("a", "b").filter("a <> b")
    kind = dict(edges.dtypes)["b"]
    frontier = materialised(start.select(F.col("node").cast(kind).alias("node")).filter("node IS NOT NULL").distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("owner")), "crawl")
    found, depth = frontier, 0
    while not frontier.isEmpty() and (most is None or found.count() < most):
        depth += 1
        reached = edges.join(frontier.select(F.col("node").alias("a")), "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("owner")).filter("node IS NOT NULL")
        frontier = materialised(reached.join(found.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), "owner"), "crawl")
        found = found.unionByName(frontier)
    return found if most is None else found.orderBy("depth", "node").limit(most)


def crawlable(url: Column, host: str) -> Column:
    """Whether an address is a page of a host: no query that changes anything, no file of a kind that isn't a page."""
    path = F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)
    own = F.parse_url(url, F.lit("HOST"))
    kind = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce((own == host) | own.endswith("." + host), F.lit(False)) & ~F.contains(url, F.lit("add-to-cart")) & ~kind.isin("jpg", "jpeg", "png", "gif", "css", "js", "zip", "pdf")


@operator("WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_partkey <> l_suppkey), w(node, depth, owner) USING KEY (node) AS (SELECT 1::BIGINT, 0, NULL::BIGINT UNION SELECT b, min(depth) + 1, min(a) FROM w JOIN e ON a = node WHERE b NOT IN (SELECT node FROM recurring.w) GROUP BY b) SELECT node, depth, owner FROM w")
def s6_crawl(spark: SparkSession, sf: str) -> DataFrame:
    """Breadth first over all links from a first page, each node at its least depth and with the page that led to it."""
    links = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    return crawl(links, spark.range(1, 2).select(F.col("id").alias("node")))


@operator(r"SELECT page_id, CASE WHEN h <> '' THEN h ELSE trim(regexp_replace(t, '(?i)\s*[-–|]\s*Example\s*$', '')) END AS title FROM (SELECT page_id, trim(regexp_extract(html, '(?is)<h[12][^>]*>([^<]*)</h[12]>', 1)) AS h, trim(regexp_extract(html, '(?is)<title>([^<]*)</title>', 1)) AS t FROM pages)")
def s7_page_title(spark: SparkSession, sf: str) -> DataFrame:
    """The first heading, or else the title without the site's name."""
    h, t = F.trim(F.regexp_extract("html", r"(?is)<h[12][^>]*>([^<]*)</h[12]>", 1)), F.trim(F.regexp_extract("html", r"(?is)<title>([^<]*)</title>", 1))
    return table(spark, sf, "pages").select("page_id", F.coalesce(T.nonempty(h), F.trim(F.regexp_replace(t, r"(?i)\s*[-–|]\s*Example\s*$", ""))).alias("title"))


@operator("SELECT o_custkey AS name, max(o_orderkey) AS latest FROM orders GROUP BY o_custkey")
def s8_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON manifest as a map from file name to its last entry."""
    entry = table(spark, sf, "orders").select(F.to_json(F.struct(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("seq"))).alias("json"))
    read = entry.select(F.from_json("json", "name bigint, seq bigint").alias("e")).select("e.*")
    return read.groupBy("name").agg(F.max("seq").alias("latest"))


@operator("WITH p AS (SELECT user_id AS doc, 1 + event_id % 9 AS page, event_id FROM events WHERE event_id % 9 NOT IN (3, 4)), m AS (SELECT doc, max(page) AS last FROM p GROUP BY doc), g AS (SELECT doc, last, unnest(range(1, last + 1)) AS page FROM m) SELECT g.doc, g.page, coalesce(string_agg(p.event_id::VARCHAR, ' ' ORDER BY p.event_id), '') AS text FROM g LEFT JOIN p ON p.doc = g.doc AND p.page = g.page GROUP BY ALL")
def s11_pages_text(spark: SparkSession, sf: str) -> DataFrame:
    """Items as one text a page; pages without items are empty texts."""
    e = table(spark, sf, "events")
    p = e.select(F.col("user_id").alias("doc"), (F.col("event_id") % 9 + 1).alias("page"), "event_id").filter(~(F.col("event_id") % 9).isin(3, 4))
    every = p.groupBy("doc").agg(F.max("page").alias("last")).select("doc", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("page"))
    text = p.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), " ").alias("text"))
    return every.join(text, ["doc", "page"], "left").select("doc", "page", F.coalesce("text", F.lit("")).alias("text"))


@operator("SELECT page_id, CASE WHEN len(s) > 2 THEN s[1] ELSE 'General' END AS subject, s[len(s)] AS file FROM (SELECT page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS s FROM pages)")
def s13_note_files(spark: SparkSession, sf: str) -> DataFrame:
    """Subject and file name from a path; short paths are General."""
    parts = F.filter(F.split(F.coalesce(F.parse_url("url", F.lit("PATH")), F.lit("")), "/"), lambda x: x != "")
    return table(spark, sf, "pages").select("page_id", F.when(F.size(parts) > 2, F.get(parts, F.lit(0))).otherwise("General").alias("subject"), F.get(parts, F.size(parts) - 1).alias("file"))


@operator("SELECT user_id, arg_max(event_type, event_id) AS last_state FROM events GROUP BY user_id")
def s14_progress(spark: SparkSession, sf: str) -> DataFrame:
    """The last line of a progress log for each key."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_state"))


@operator("WITH u AS (SELECT c_custkey AS k, c_name AS v, 0 AS seq FROM customer UNION ALL SELECT o_custkey, 'order ' || o_orderkey, o_orderkey + 1 FROM orders) SELECT k, arg_max(v, seq) AS v FROM u GROUP BY k")
def k1_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Rows replaced by key, the last write wins."""
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"), F.lit(0).cast("bigint").alias("seq"))
    new = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("v"), (F.col("o_orderkey") + 1).alias("seq"))
    return upsert(old, new, ["k"], "seq").select("k", "v")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Old and new rows as one table, of each key the row of the greatest seq; missing texts become empty."""
    both = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_row"))
    texts = {c for c, t in both.dtypes if t == "string"}
    return best.select(*keys, *(F.coalesce(F.col(f"_row.{c}"), F.lit("")).alias(c) if c in texts else F.col(f"_row.{c}") for c in rest))


@operator("SELECT user_id, count(*) AS queries, CAST(sum(event_id % 1000) AS BIGINT) AS tokens FROM events GROUP BY user_id")
def k2_accumulate(spark: SparkSession, sf: str) -> DataFrame:
    """Counters that add up by key."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("queries"), F.sum(F.col("event_id") % 1000).alias("tokens"))


@operator("SELECT event_type AS stage, count(*) AS count FROM events GROUP BY event_type")
def k3_funnel_increment(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("count"))


@operator("SELECT doc_id || '|p' || (i + 1) || '|' || i AS chunk_id, CAST(length(t) AS BIGINT) AS size FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS t FROM documents)")
def k4_chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks under ids that are the same on every run."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    return d.select(F.concat(F.col("doc_id").cast("string"), F.lit("|p"), (F.col("i") + 1).cast("string"), F.lit("|"), F.col("i").cast("string")).alias("chunk_id"), F.length("t").cast("bigint").alias("size"))


@operator("WITH m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS keeper FROM documents) SELECT l.doc_id, m.keeper FROM labels l JOIN m USING (doc_id) WHERE m.keeper = l.doc_id OR m.keeper NOT IN (SELECT doc_id FROM labels)")
def k6_repoint(spark: SparkSession, sf: str) -> DataFrame:
    """Child rows move to the keeper if it has none, and go otherwise."""
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("m"))
    keepers = d.groupBy("m").agg(F.min("doc_id").alias("keeper"))
    children = table(spark, sf, "labels").select("doc_id").join(d.join(keepers, "m").select("doc_id", "keeper"), "doc_id")
    has = table(spark, sf, "labels").select(F.col("doc_id").alias("keeper"))
    own = children.filter("keeper = doc_id")
    return own.union(children.filter("keeper <> doc_id").join(has, "keeper", "left_anti").select("doc_id", "keeper"))


@operator("SELECT l_orderkey, CASE WHEN l_partkey % 2 = 0 THEN l_partkey + 1000000 ELSE l_partkey END AS partkey FROM lineitem")
def k7_rename_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """One map of old to new keys, applied to a table that refers to them."""
    old = table(spark, sf, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_partkey") + 1_000_000).alias("new"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(old, "l_partkey", "left").select("l_orderkey", F.coalesce("new", "l_partkey").alias("partkey"))


@operator("SELECT user_id, event_type, count(*) % 2 = 1 AS marked, arg_max(props, event_id) AS note FROM events GROUP BY user_id, event_type")
def k8_toggles_and_notes(spark: SparkSession, sf: str) -> DataFrame:
    """A toggle is the parity of its clicks; a note is the last one."""
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg((F.count("*") % 2 == 1).alias("marked"), F.max_by("props", "event_id").alias("note"))


@operator(f"WITH {JUDGEMENTS} SELECT filename, replace(judges, '; ', ', ') AS judges, regexp_extract(legislation, 'Section ([0-9]+) of', 1) || ' of ' || regexp_extract(legislation, ' of the (.*)$', 1) AS legislation FROM j")
def k9_export(spark: SparkSession, sf: str) -> DataFrame:
    """Lists flattened for a spreadsheet."""
    return judgements(spark, sf).select("filename", F.array_join(F.split("judges", "; "), ", ").alias("judges"), F.concat(F.regexp_extract("legislation", "Section ([0-9]+) of", 1), F.lit(" of "), F.regexp_extract("legislation", " of the (.*)$", 1)).alias("legislation"))
