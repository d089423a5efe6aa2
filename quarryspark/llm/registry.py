"""The contract queries of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cells, chunking, html, langid, negatives, packing, quality, ranked, simhash, tokenfile, topk, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.filter("vec_id % 100 = 0"), k=10, scale=1024)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"), shingle=3, distance=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.score(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "lang", "perplexity", "accepted")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    examples = toxicity.fit(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out")  # no id: not held out
    return toxicity.score(docs, examples).select("doc_id", held_out, "score", "predicted", "evidence")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), added=added)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))  # no id: not held out
    codes = langid.fit(docs.filter(~held_out))
    return langid.predict(docs.select("doc_id", "text"), codes).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, layout = tokenfile.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tokenfile.digests(spark, path, layout)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.compare_edits(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return negatives.mine(vectors, F.col("vec_id") % 50 == 0, positives=5, negatives=3, window=(50, 95), scale=256)


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.near_duplicates(table(spark, sf_dir, "embeddings"), similarity=0.98)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50).select("item_id", "rank", "doc_id", "score")


OP11_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
  SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3"""

OP12_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
  r AS (SELECT a, a AS b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
  n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS least FROM r GROUP BY a)
  SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(least, vec_id) AS component_id, vec_id = coalesce(least, vec_id) AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""WITH t AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id),
  g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM d), i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
  w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g WHERE term IN (SELECT term FROM i) GROUP BY term, docs),
  s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // tokens)))) AS BIGINT) AS score FROM i JOIN p USING (term) JOIN w USING (term) JOIN d USING (doc_id), g GROUP BY ALL)
  SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 50"""


def queries() -> dict[str, Query]:
    """Each operator's query over its whole table."""
    return {f.__name__: f for f in (op1_topk, op2_byte_bpe, op3_simhash, op4_html, op5_quality, op6_toxicity, op7_packing, op8_langid, op9_tokenfile, op10_fingerprints, op11_hard_negatives, op12_embedding_dedup, op13_ranked_search)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express on whole tables."""
    return {"op11_hard_negatives": OP11_SQL, "op12_embedding_dedup": OP12_SQL, "op13_ranked_search": OP13_SQL}
