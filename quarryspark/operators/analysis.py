"""Around model answers: caches, tidying, quality gates, checks against the text, links. Model calls themselves are adapters."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions import text as T
from ..plans.query import Vocabulary, tiers
from ..plans.register import operator
from ..sources.tables import JUDGEMENTS, judgements, table
from .extract import table_function

J = f"WITH {JUDGEMENTS}"


#: What marks a bracket as a reference to a file or a note. Fixed values.
REFERENCE_MARKS = ["/", "|", "Notes", ".pdf", ".txt", ".docx"]


def tidy_synthesis(c: Column) -> Column:
    """A synthesis without references to notes, with headings in bold and one blank line between paragraphs at most."""
    pieces = F.regexp_extract_all(c, F.lit(r"(\[[^\]]*\]|\[?[^\[]+|\[)"), 1)  # brackets, and what lies between them

    def is_bracket(x: Column) -> Column:
        return x.startswith("[") & x.endswith("]")

    def told(x: Column) -> Column:
        """Whether 'as per' leads to the next piece."""
        return F.coalesce(F.rtrim(x).endswith("as per"), F.lit(False))

    def piece(x: Column, i: Column) -> Column:
        before, after = F.try_element_at(pieces, i), F.try_element_at(pieces, i + 2)
        led = F.when(i > 0, told(before)).otherwise(F.lit(False)) & is_bracket(x)
        dull = F.trim(F.substr(x, F.lit(2), F.length(x) - 2)) == ""
        for mark in REFERENCE_MARKS:
            dull = dull | x.contains(mark)
        text = F.when(told(x) & F.coalesce(is_bracket(after), F.lit(False)), F.regexp_replace(x, r"\(?as per\s*$", "")).otherwise(x)
        closing = F.when(i > 1, told(F.try_element_at(pieces, i - 1)) & is_bracket(before)).otherwise(F.lit(False))
        text = F.when(closing & text.startswith(")"), F.substr(text, F.lit(2))).otherwise(text)
        return F.when(is_bracket(x), F.when(led | dull, "").otherwise(x)).otherwise(text)

    def line(x: Column) -> Column:
        words = F.filter(F.split(F.trim(x), r"[ \t]+"), lambda w: w != "")
        marked = F.get(words, F.lit(0)).rlike("^#{1,6}$")
        plain = F.array_join(F.filter(words, lambda w: ~w.rlike("^#{1,6}$")), " ")
        return F.regexp_replace(F.when(F.coalesce(marked, F.lit(False)) & (plain != ""), F.concat(F.lit("**"), plain, F.lit("**"))).otherwise(plain), " +([.,;:?!])", "$1")

    lines = F.transform(F.split(F.array_join(F.transform(pieces, piece), ""), "\n"), line)
    kept = F.filter(lines, lambda x, i: (x != "") | (F.coalesce(F.get(lines, i - 1), F.lit("")) != ""))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")


@operator("SELECT event_id, '**Heading ' || event_type || '**' || chr(10) || 'A point about ' || event_type || '. More.' AS tidy FROM events")
def p33_tidy_synthesis(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("### Heading "), "event_type", F.lit("\nA point (as per [Notes/x.pdf]) about   "), "event_type", F.lit(" [a/b|3:1] . More ."))
    return table(spark, sf, "events").select("event_id", tidy_synthesis(raw).alias("tidy"))


#: Words that an instrument's name ends with, placeholders for none, and the longest entry. Fixed values.
INSTRUMENTS = ("Ordinance", "Act", "Code", "Law", "Constitution")
PLACEHOLDERS = frozenset(["", "n/a", "na", "none"])
ENTRY = 90


def _instrument(text: str) -> tuple[str, str]:
    """The first instrument that a text names, from the first capital of its phrase on, with number and year; and what stands behind it."""
    at = 0
    for phrase in re.findall(r"[\w'() ,]+|[^\w'() ,]+", text):
        begin = next((i for i, c in enumerate(phrase) if c.isascii() and c.isupper()), None)
        if begin is not None:
            ends = [phrase.find(w, begin + 1) + len(w) for w in INSTRUMENTS if phrase.find(w, begin + 1) > 0]
            if ends:
                rest = text[at + min(ends) :]
                words = rest.replace(".", ". ").split()
                numbered = words[:1] in (["No."], [",No."]) or words[:2] == [",", "No."]
                words = [w for w in words if w != ","]
                year = words[3][:4] if len(words) > 3 else ""
                if numbered and words[1].isdigit() and words[2] == "of" and year.isdigit() and len(year) == 4:
                    return f"{phrase[begin : min(ends)]}, No. {words[1]} of {year}", rest
                return phrase[begin : min(ends)], rest
        at += len(phrase)
    return "", ""


def _place(text: str) -> str:
    """The first section or article that a text names, as it is written."""
    words = text.split()
    for i, w in enumerate(words[:-1]):
        bare = w.strip("(,;")
        number = words[i + 1].rstrip(".,;")
        if bare in ("Section", "Sections", "section", "sections", "S.", "s.") and number[:1].isalnum() and (number[0].isdigit() or number[0].isupper()):
            return f"{bare} {number}"
        if bare == "Article" and number:
            return f"Article {number}"
    return ""


def _said(entry: Any) -> str:
    """An entry as text: of an object its first text that isn't empty, of a list its items."""
    if isinstance(entry, dict):
        return next((v.strip() for v in entry.values() if isinstance(v, str) and v.strip()), "")
    return ", ".join(map(_said, entry)) if isinstance(entry, list) else "" if entry is None else str(entry).strip()


def legislation(told: Any, precedents: list[Any]) -> tuple[list[str], list[Any]]:
    """(instruments, precedents): each instrument once with its section; what an answer filed as a precedent though it is an instrument is moved.

    Entries are texts, objects or lists; placeholders and entries that name no instrument go.
    """
    entries = told if isinstance(told, list) else [told]
    kept = []
    for p in precedents:
        name = str(p.get("case_name", "")) if isinstance(p, dict) else str(p)
        if _instrument(name)[0] and not names_sides(name):
            entries = [*entries, name]
        else:
            kept.append(p)
    out: dict[str, None] = {}
    for e in entries:
        text = " ".join(_said(e).split())
        low = text.lower()
        if low in PLACEHOLDERS or "not specified" in low or "not available" in low:
            continue
        name, _ = _instrument(text)
        place = _place(text)
        shown = f"{name.strip(' ,')} — {place}" if name and place else name.strip(" ,")
        if len(shown) > ENTRY:
            shown = f"Constitution of Sri Lanka, {place}" if place.startswith("Article") and "Constitution" in text else _instrument(name.rpartition(",")[2])[0].strip()
        if shown:
            out.setdefault(shown)
    return list(out), kept


@operator("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'Penal Code — Section ' || p_size WHEN 1 THEN 'Evidence Act, No. ' || p_size || ' of 1995' END AS entry, 1 + CAST(p_partkey % 3 <> 2 AS INTEGER) AS entries, 1 AS precedents FROM part")
def p35_legislation(spark: SparkSession, sf: str) -> DataFrame:
    """Instruments that answers name, from entries of several kinds and from precedents that are none; placeholders go."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    entry = F.when(k % 3 == 0, F.concat(F.lit("contrary to Penal Code, Section "), n)).when(k % 3 == 1, F.concat(F.lit("see the Evidence Act, No. "), n, F.lit(" of 1995"))).otherwise("Not specified in the text")
    answer = F.to_json(F.struct(F.array(entry, entry).alias("told"), F.array(F.struct(F.lit("Perera v. Silva").alias("case_name")), F.struct(F.lit("Customs Ordinance").alias("case_name"))).alias("precedents")))

    def read(text: str) -> list[tuple]:
        held = json.loads(text)
        found, kept = legislation(held["told"], held["precedents"])
        return [(found[0] if len(found) > 1 else None, len(found), len(kept))]

    return table_function(table(spark, sf, "part").select(k.alias("id"), answer.alias("answer")), "id bigint, entry string, entries int, precedents int", ["id", "answer"], read)


@dataclass(frozen=True)
class _Item:
    """An item of a list that outline() has still to show."""

    value: Any


def outline(value: Any) -> list[str]:
    """Nested values as lines: a key with its value or above its values, list items behind bullets; nulls in lists are left out.

    The value is taken apart by a stack of (depth, key or None, item of a list?, value); a bullet takes the place before the first line of its item.
    """
    lines: list[str] = []
    stack: list[tuple[int, str | None, int | None, Any]] = [(0, None, None, value)]
    while stack:
        depth, key, owner, v = stack.pop()
        if owner is not None:  # the end of a list item: its first line gets the bullet
            if len(lines) > owner:
                lines[owner] = "  " * depth + "• " + lines[owner].lstrip()
            continue
        nested = isinstance(v, (dict, list))
        if key is not None:
            label = str(key).replace("_", " ").strip().title()
            lines.append("  " * depth + (f"{label}:" if nested else f"{label}: {v}"))
        elif not nested:
            lines.append("  " * depth + str(v))
        inner = depth + (key is not None)
        if isinstance(v, dict):
            stack += [(inner, k, None, x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            stack += [(inner, None, None, _Item(x)) for x in reversed(v) if x is not None]
        if isinstance(v, _Item):
            lines.pop()
            stack += [(depth, None, len(lines), None), (depth, None, None, v.value)]
    return lines


@operator("SELECT event_id, 'K: ' || json_extract_string(props, '$.k') AS pretty FROM events")
def p38_pretty_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table_function(table(spark, sf, "events").select("event_id", "props"), "event_id bigint, pretty string", ["event_id", "props"], lambda p: [("\n".join(outline(json.loads(p))),)])


@operator("SELECT doc_id, CASE WHEN l.quality IS NULL THEN 'analyse' WHEN l.quality = 0 THEN 'analyse again' ELSE 'cached' END AS action FROM documents LEFT JOIN labels l USING (doc_id)")
def l2_analysis_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Cached analyses are used, hollow ones made again."""
    cached = table(spark, sf, "labels").select("doc_id", "quality")
    q = F.col("quality")
    return table(spark, sf, "documents").select("doc_id").join(cached, "doc_id", "left").select("doc_id", F.when(q.isNull(), "analyse").when(q == 0, "analyse again").otherwise("cached").alias("action"))


@operator("SELECT doc_id, left(array_to_string(regexp_extract_all(strip_accents(lower(text)), '([\\p{L}\\p{N}]+)', 1)[1:40], ' ') || ' ' || left(text, 100), 300) AS query FROM documents")
def l1_retrieval_query(spark: SparkSession, sf: str) -> DataFrame:
    """Keywords and reasons as the query for notes, 300 characters."""
    return table(spark, sf, "documents").select("doc_id", F.left(F.concat(F.array_join(F.slice(T.tokens(F.col("text")), 1, 40), " "), F.lit(" "), F.left("text", F.lit(100))), F.lit(300)).alias("query"))


@operator("SELECT doc_id, CASE WHEN n_chars > 6000 THEN left(text, 6000) || ' […]' ELSE text END AS trimmed FROM documents WHERE n_chars >= 80")
def l7_comparison_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Texts for a comparison, cut; too short ones are out."""
    t = F.col("text")
    return table(spark, sf, "documents").filter("n_chars >= 80").select("doc_id", F.when(F.col("n_chars") > 6000, F.concat(F.left(t, F.lit(6000)), F.lit(" […]"))).otherwise(t).alias("trimmed"))


@operator(J + ", a AS (SELECT seq, list_sort(list_distinct(regexp_extract_all(lower(judges), '([a-z0-9_]{3,})', 1))) AS told, list_sort(list_distinct(regexp_extract_all(lower(keywords), '([a-z0-9_]{3,})', 1))) AS found FROM j) SELECT seq, array_to_string(list_filter(told, lambda x: NOT list_contains(found, x)), ' ') AS missing, len(list_intersect(told, found)) = 0 AS issue FROM a")
def l8_verify(spark: SparkSession, sf: str) -> DataFrame:
    """What an answer names and the text doesn't; whether nothing agrees."""
    words = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_]{3,})"), 1)))
    a = judgements(spark, sf).select("seq", words("judges").alias("told"), words("keywords").alias("found"))
    return a.select("seq", F.array_join(F.array_sort(F.array_except("told", "found")), " ").alias("missing"), (F.size(F.array_intersect("told", "found")) == 0).alias("issue"))


@operator("SELECT doc_id FROM labels WHERE quality = 0 OR doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 100)")
def l9_purge_hollow(spark: SparkSession, sf: str) -> DataFrame:
    """Analyses to be deleted: hollow ones and those of texts that can't be read."""
    l, d = table(spark, sf, "labels"), table(spark, sf, "documents").filter("n_chars > 100").select("doc_id")
    return l.filter("quality = 0").select("doc_id").union(l.filter("quality <> 0 OR quality IS NULL").select("doc_id").join(d, "doc_id", "left_anti"))


@operator("SELECT conv_id, CAST(i AS INTEGER) AS step, 'Step ' || i || ' ' || role AS prompt FROM (SELECT conv_id, turn, role, unnest(range(1, 4)) AS i FROM conversations WHERE turn = 0)")
def l10_prompt_steps(spark: SparkSession, sf: str) -> DataFrame:
    """A prompt file in its steps, without what stands before the first."""
    c = table(spark, sf, "conversations").filter("turn = 0")
    doc = F.concat(F.lit("# head\n"), *(F.concat(F.lit(f"## Prompt Step {i} "), "role", F.lit("\n\n")) for i in (1, 2, 3)))
    return c.select("conv_id", F.posexplode(F.slice(F.split(doc, "## Prompt "), 2, 99)).alias("pos", "prompt")).select("conv_id", (F.col("pos") + 1).alias("step"), F.regexp_replace("prompt", r"^\s+|\s+$", "").alias("prompt"))


@operator(J + " SELECT seq, CASE WHEN contains(case_no, '/') THEN 'As [' || case_no || '](/?case=' || case_no || ') held' ELSE 'As ' || case_no || ' held' END AS linked FROM j")
def l6_link_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Case numbers in an answer become links, once."""
    answer = F.concat(F.lit("As "), "case_no", F.lit(" held"))
    link = F.concat(F.lit("["), F.replace("case_no", F.lit("_"), F.lit(" ")), F.lit("](/?case="), "case_no", F.lit(")"))
    due = F.col("case_no").contains("/") & ~answer.contains(F.concat(F.lit("case="), "case_no"))
    return judgements(spark, sf).select("seq", F.when(due, F.replace(answer, F.col("case_no"), link)).otherwise(answer).alias("linked"))


#: Series of reports, and courts whose name before '/', '.' or a space begins a number. Fixed values.
REPORTS = frozenset("SLR NLR CLW BARR SCC APPCAS".split())
COURTS = frozenset("SC CA HC".split())
#: Characters from which a citation isn't lengthened any more, and those a citation has at least. Fixed values.
STITCHED, CITED = 180, 6


def _letters(word: str) -> str:
    return re.sub("[^A-Z]", "", word.upper())


def names_report(text: str) -> bool:
    """Whether a text names where a case is reported: a year in brackets, a volume of a series, or a court's number."""
    words = text.split()
    for i, w in enumerate(words):
        for opened, closed in ("[]", "()"):
            inside = w.partition(opened)[2].partition(closed)
            if inside[1] and len(inside[0]) == 4 and inside[0].isdigit() and inside[0][:2] in ("19", "20"):
                return True
        if w.isdigit() and len(w) < 4 and any(_letters("".join(words[i + 1 : i + k])) in REPORTS for k in (2, 3, 4)):
            return True
        first = re.split("[/.]", w, maxsplit=1)
        if _letters(first[0].lstrip("([")) in COURTS and (len(first) > 1 or i + 1 < len(words)):
            return True
    return False


def names_sides(text: str) -> bool:
    return any(w.strip(",;:()[]").removesuffix(".").lower() in ("v", "vs", "versus") for w in text.split())


def _stitched(texts: Iterator[str]) -> Iterator[str]:
    """A page's runs, each with those after it until it names a report or is long."""
    held = ""
    for t in texts:
        held = f"{held} {t}".strip()
        if names_report(held) or len(held) >= STITCHED:
            yield held
            held = ""
    if held:
        yield held


def italic_citations(runs: list[tuple[int, str]]) -> list[tuple[int, str, str]]:
    """(page, text, kind) of the case citations in italic runs, each once; kind is case or reporter."""
    out: dict[str, tuple[int, str, str]] = {}
    for page, own in groupby(runs, key=lambda r: r[0]):
        for whole in _stitched(t for _, t in own):
            text = " ".join(whole.split()).strip(" .,;:")
            kind = "case" if names_sides(text) else "reporter" if names_report(text) else None
            key = "".join(c for c in text.lower() if c.isascii() and c.isalnum())[:80]
            if kind and key and len(text) >= CITED:
                out.setdefault(key, (page, text, kind))
    return list(out.values())


@operator()
def x12_italic_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Citations stitched from each document's italic runs."""
    l = table(spark, sf, "lineitem")
    text = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("Perera v. Silva "), F.col("l_partkey").cast("string"))).when(F.col("l_linenumber") % 3 == 1, "(1943) 45 N.L.R. 73").otherwise("inter alia")
    runs = l.filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("page"), F.col("l_suppkey").alias("pos"), text.alias("text")))).alias("runs"))
    return table_function(runs.select("l_orderkey", F.to_json("runs").alias("runs")), "doc bigint, page int, text string, kind string", ["l_orderkey", "runs"], lambda r: italic_citations([(x["page"], x["text"]) for x in json.loads(r)]))


@operator()
def x13_parsed_names(spark: SparkSession, sf: str) -> DataFrame:
    """Given names and surname of each judge named."""
    named = judgements(spark, sf).select("seq", F.explode(F.split("judges", "; ")).alias("name"))

    def parsed(name: str) -> list[tuple]:
        p = names.Person.read(name)
        return [(list(p.givens), " ".join(filter(None, [p.particle, p.family])))] if p else []

    return table_function(named, "seq bigint, givens array<string>, surname string", ["seq", "name"], parsed)


@operator()
def q8_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """The tiers of every conversation turn as a query."""
    asked = table(spark, sf, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    return table_function(asked, "id string, pos int, tier string, groups int, star boolean", ["id", "text"], lambda t: [(i, x.name, len(x.groups), x.star) for i, x in enumerate(tiers(t, Vocabulary()))])


@operator(J + ", b AS (SELECT case_no, seq, CAST(unnest(range(len(string_split(judges, '; ')))) AS INTEGER) AS seat, unnest(string_split(judges, '; ')) AS display FROM j), c AS (SELECT seq, lower(regexp_replace(regexp_replace(regexp_replace(display, '^Hon\\. Justice ', ''), '( CJ|, P\\.C\\., J\\.)$', ''), '[^A-Za-z0-9]', '', 'g')) AS canonical, min(seat) AS first_seat FROM b GROUP BY ALL) SELECT seq, canonical, CAST(row_number() OVER (PARTITION BY seq ORDER BY first_seat) - 1 AS INTEGER) AS seat FROM c")
def i6_reindexed_benches(spark: SparkSession, sf: str) -> DataFrame:
    """Benches with each judge once, seats without gaps."""
    b = judgements(spark, sf).select("seq", F.posexplode(F.split("judges", "; ")).alias("seat", "display"))
    c = b.groupBy("seq", T.canonical_judge(F.col("display")).alias("canonical")).agg(F.min("seat").alias("first"))
    return c.select("seq", "canonical", (F.row_number().over(Window.partitionBy("seq").orderBy("first")) - 1).alias("seat"))


@operator("WITH t AS (SELECT doc_id, lang || '-' || (n_chars % 50) AS name FROM documents) SELECT doc_id, CASE WHEN doc_id = first THEN name ELSE name || ' [' || left(md5(doc_id::VARCHAR), 6) || ']' END AS renamed FROM (SELECT *, min(doc_id) OVER (PARTITION BY name) AS first FROM t)")
def i8_collision_rename(spark: SparkSession, sf: str) -> DataFrame:
    """A name that is taken gets a tag that is the same on every run."""
    t = table(spark, sf, "documents").select("doc_id", F.concat("lang", F.lit("-"), (F.col("n_chars") % 50).cast("string")).alias("name"))
    first = t.groupBy("name").agg(F.min("doc_id").alias("first"))
    tag = F.left(F.md5(F.col("doc_id").cast("string")), F.lit(6))
    return t.join(first, "name").select("doc_id", F.when(F.col("doc_id") == F.col("first"), F.col("name")).otherwise(F.concat("name", F.lit(" ["), tag, F.lit("]"))).alias("renamed"))


def replaced(index: DataFrame, rows: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """An index whose rows of the changed keys are deleted, and the new rows inserted; a changed key without new rows is gone."""
    return index.join(changed.select(key).distinct(), key, "left_anti").unionByName(rows.join(changed.select(key).distinct(), key, "left_semi"))


@operator("WITH w AS (SELECT doc_id, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INTEGER) AS para, unnest(string_split(text, chr(10))) AS text FROM documents), c AS (SELECT doc_id, quality FROM labels), m AS (SELECT doc_id, para, text FROM w WHERE doc_id NOT IN (SELECT doc_id FROM c) UNION ALL SELECT doc_id, para, 'new ' || text FROM w JOIN c USING (doc_id) WHERE quality = 1) SELECT doc_id, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS size, md5(min(text)) AS least FROM m GROUP BY doc_id")
def k5_replace_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A chunk index brought up to date: chunks of relabelled documents are deleted, those of good ones inserted anew."""
    d, c = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", "quality")
    index = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select("doc_id", (F.col("pos") + 1).alias("para"), "text")
    new = index.join(c.filter("quality = 1").select("doc_id"), "doc_id", "left_semi").withColumn("text", F.concat(F.lit("new "), "text"))
    whole = replaced(index, new, c, "doc_id")
    return whole.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("size"), F.md5(F.min("text")).alias("least"))


@operator("SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, -CAST(label AS DOUBLE) + vec_id / 1e6 AS score FROM embeddings) ORDER BY score DESC, vec_id LIMIT 10")
def r10_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates by another scorer's column, the best ten."""
    score = -F.col("label").cast("double") + F.col("vec_id") / 1e6
    return table(spark, sf, "embeddings").select("vec_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)
