"""Files as documents: notes and judgments of several formats, with encodings guessed in order.

Formats that need other software (PDF text, OCR) come through readers that the caller passes in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.register import operator
from .tables import table

Reader = Callable[[bytes], list[str]]
#: A page with less text than this is to be read by OCR.
OCR_BELOW = 200
#: Bytes of files that a task reads at once, about.
PART_BYTES = 1 << 20


def decoded(raw: bytes) -> str:
    """Text by the first encoding that fits: UTF-8, then Latin-1 (which fits any bytes)."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.parts.append(" ".join(data.split()))


def html_text(raw: bytes) -> str:
    """A page's texts joined by single spaces."""
    parser = _Text()
    parser.feed(decoded(raw))
    return " ".join(parser.parts)


def pages_of(name: str, raw: bytes, readers: dict[str, Reader], ocr: Reader | None = None) -> list[str]:
    """A file's pages by its suffix; one of an unknown suffix is decoded as text."""
    suffix = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if suffix in ("txt", "md"):
        return [decoded(raw)]
    if suffix in ("html", "htm"):
        return [html_text(raw)]
    if suffix not in readers:
        return [decoded(raw)]
    pages = readers[suffix](raw)
    if ocr and sum(len(p.strip()) for p in pages) < OCR_BELOW:
        return ocr(raw) or pages
    return pages


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of batches (path, content) of PART_BYTES of content at most; a larger file is a slice of its own."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("content")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            before = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + PART_BYTES, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def read_files(files: DataFrame, readers: dict[str, Reader] | None = None, ocr: Reader | None = None) -> DataFrame:
    """(path, page, text, error) of files (path, content), as spark.read.format("binaryFile") gives them. Errors stay with their file."""
    own = readers or {}
    names = ["path", "page", "text", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            out = []
            for path, raw in zip(part.column("path").to_pylist(), part.column("content").to_pylist(), strict=True):
                try:
                    out += [(path, i, t, None) for i, t in enumerate(pages_of(path, bytes(raw), own, ocr), 1)]
                except Exception as e:  # noqa: BLE001  a reader may raise anything
                    out.append((path, 0, "", str(e)))
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    return files.select("path", "content").mapInArrow(run, "path string, page int, text string, error string")


@operator("SELECT 'd' || doc_id || '.txt' AS path, length(text) AS size FROM documents")
def s10_read_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as text files, read back."""
    files = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return read_files(files).select("path", F.length("text").cast("bigint").alias("size"))


@operator()
def s9_read_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as HTML files, read as text."""
    files = table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return read_files(files).select("path", "page", F.length("text").cast("bigint").alias("size"), "error")


@operator("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'utf-8' ELSE 'latin-1' END AS encoding FROM documents")
def s15_encodings(spark: SparkSession, sf: str) -> DataFrame:
    """The encoding of bytes: UTF-8 if they are valid, Latin-1 otherwise."""
    d = table(spark, sf, "documents")
    text = F.concat(F.lit("é"), "text")
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode(text, "UTF-8")).otherwise(F.encode(F.translate(text, "œŒ’“”–—…€ẞ", "oO'\"\"--.ES"), "ISO-8859-1"))
    return d.select("doc_id", F.when(F.is_valid_utf8(raw.cast("string")), "utf-8").otherwise("latin-1").alias("encoding"))


@operator("SELECT page_id, i AS page, CASE i WHEN 1 THEN 'first ' || page_id ELSE url END AS text FROM (SELECT page_id, url, unnest(range(1, CASE page_id % 4 WHEN 0 THEN 3 ELSE 2 END))::INTEGER AS i FROM pages)")
def s12_uploaded_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of uploaded bytes by their suffix: text, HTML, a format with a reader of its own, and one that nothing knows."""
    k = F.col("page_id")
    first = F.concat(F.lit("first "), k.cast("string"))
    suffix = F.element_at(F.array(*map(F.lit, ("two", "txt", "html", "xyz"))), (k % 4 + 1).cast("int"))
    content = F.when(k % 4 == 0, F.concat(first, F.lit("\f"), "url")).when(k % 4 == 2, F.concat(F.lit("<p>"), first, F.lit("</p><script>x</script>"))).otherwise(first)
    files = table(spark, sf, "pages").select(F.concat(k.cast("string"), F.lit("."), suffix).alias("path"), F.encode(content, "UTF-8").alias("content"))
    read = read_files(files, {"two": lambda raw: raw.decode().split("\f")})
    return read.select(F.substring_index("path", ".", 1).cast("bigint").alias("page_id"), "page", "text")
