"""Files: PDF folders with a pluggable extractor, and Parquet sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

#: Columns of chunk tables, in order.
JUDGMENT_COLUMNS = "chunk_id text doc_id case_number pages section section_type section_hierarchy footnotes date judges char_offset parent_section classification_confidence classification_evidence tokens split_method".split()
TREATY_COLUMNS = "chunk_id text doc_name part section article paragraph sub_paragraph pages date source article_type section_type section_hierarchy classification_confidence classification_evidence tokens split_method".split()

WORD = "struct<ord:bigint,text:string,x0:double,y0:double,x1:double,y1:double,font_size:double,font_name:string,page_num:int>"
_SCHEMA = f"path string, filename string, text string, words array<{WORD}>, _error string"
#: An extractor maps the bytes of a file to its text and words (dicts of WORD's fields).
Extractor = Callable[[bytes], tuple[str, list[dict]]]


def plain_text(content: bytes) -> tuple[str, list[dict]]:
    """Extractor of UTF-8 text files, pages ended by form feeds; heights count lines, as there is no layout."""
    pages = content.decode("utf-8").split("\f")
    words, n = [], 0
    for number, page in enumerate(pages, 1):
        for y, line in enumerate(page.split("\n")):
            for x, w in enumerate(line.split()):
                words.append({"ord": n, "text": w, "x0": float(x), "y0": 20.0 * y, "x1": float(x + 1), "y1": 20.0 * y + 10, "font_size": 12.0, "font_name": "text", "page_num": number})
                n += 1
    return "".join(p + "\n" for p in pages), words


def pdf_text(content: bytes) -> tuple[str, list[dict]]:
    """Extractor of PDF files for clusters whose workers have PyMuPDF, which is imported in the task.

    Every page's text is followed by a line feed. Words are tuples of box, text, block, line and number; as chunk
    tables expect them, ``font_size`` is the block's number and ``font_name`` the line's.
    """
    import pymupdf

    texts, words = [], []
    with pymupdf.open(stream=content, filetype="pdf") as pages:
        for number, page in enumerate(pages, 1):
            texts.append(page.get_text() + "\n")
            for x0, y0, x1, y1, text, block, line, *_ in page.get_text("words"):
                words.append({"ord": len(words), "text": text, "x0": float(x0), "y0": float(y0), "x1": float(x1), "y1": float(y1), "font_size": float(block), "font_name": str(line), "page_num": number})
    return "".join(texts), words


def _extract(extractor: Extractor):
    kinds = pa.list_(pa.struct([("ord", pa.int64()), ("text", pa.string()), *((k, pa.float64()) for k in ("x0", "y0", "x1", "y1", "font_size")), ("font_name", pa.string()), ("page_num", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    text, words, error = *extractor(content.as_py()), None
                except Exception as e:  # a file that fails is skipped whole, with its reason
                    text, words, error = None, None, f"{type(e).__name__}: {e}"
                columns = ([path], pa.string()), ([path.rsplit("/", 1)[-1]], pa.string()), ([text], pa.string()), ([words], kinds), ([error], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns], names=["path", "filename", "text", "words", "_error"])

    return run


def scan_folder(spark: SparkSession, paths: str | list[str], extractor: Extractor, glob: str = "*.pdf", fallback: Extractor | None = None) -> DataFrame:
    """Files of one or more folders (not below them) -> path, filename, text, words, _error.

    ``fallback`` (OCR) runs on the files whose text looks lost: under 100 characters or 50 Latin letters. Only those go
    through it.
    """
    return extracted(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(paths), extractor, fallback)


def extracted(files: DataFrame, extractor: Extractor, fallback: Extractor | None = None) -> DataFrame:
    """(path, content) -> path, filename, text, words, _error."""
    files = files.select("path", "content")
    found = files.mapInArrow(_extract(extractor), _SCHEMA)
    if fallback is None:
        return found
    lost = F.col("_error").isNull() & X.needs_ocr(F.coalesce("text", F.lit("")))
    again = files.join(found.filter(lost).select("path"), "path", "left_semi").select("path", "content").mapInArrow(_extract(fallback), _SCHEMA)
    return found.filter(~lost).unionByName(again)


def readable(files: DataFrame) -> DataFrame:
    """Files without an error."""
    return files.filter("_error is null").drop("_error")


def words_of(files: DataFrame) -> DataFrame:
    """(doc_id, words) -> one row per word."""
    return files.select("doc_id", F.explode("words").alias("w")).select("doc_id", "w.*")


def ocr_words(text_by_page: DataFrame) -> DataFrame:
    """(doc_id, page_num, text) -> words with the made-up boxes of OCR: 20 high, 25 apart, size 12."""
    split = text_by_page.select("doc_id", "page_num", F.posexplode(X.words(F.col("text"))).alias("ord", "text"))
    y = F.col("ord") * 25.0
    return split.select("doc_id", F.col("ord").cast("long").alias("ord"), "text", F.lit(0.0).alias("x0"), y.alias("y0"), F.lit(100.0).alias("x1"), (y + 20).alias("y1"), F.lit(12.0).alias("font_size"), F.lit("ocr").alias("font_name"), "page_num")


def save_chunks(chunks: DataFrame, path: str, columns: list[str] = JUDGMENT_COLUMNS, partition_by: str | None = None) -> None:
    """Chunks as Parquet, in the order of ``columns``."""
    writer = chunks.select(*columns).write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
