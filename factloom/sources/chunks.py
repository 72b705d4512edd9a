"""Pages and page-local chunks of documents."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values.
MAX_CHARS, OVERLAP = 1800, 200
BREAKS = ["\n\n", "\n", ". ", "; "]
LEAST_SHARE = 0.6


def normalise_page(text: str) -> str:
    """Lines trimmed, blank-line runs reduced to one, ends trimmed."""
    lines = "\n".join(line.strip() for line in text.splitlines())
    return re.sub(r"\n{3,}", "\n\n", lines).strip()


def cut(text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    """Greedy pieces of at most ``max_chars``, cut at the last strong break in the later part of a window."""
    pieces, start = [], 0
    while start < len(text):
        window = text[start : start + max_chars]
        end = start + len(window)
        if end < len(text):
            least = int(LEAST_SHARE * len(window))
            found = next((at + len(b) for b in BREAKS if (at := window.rfind(b)) >= least), len(window))
            end = start + found
        if piece := text[start:end].strip():
            pieces.append(piece)
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return pieces


@F.udtf(returnType="chunk_index int, text string")
class SplitText:
    """The pieces of a text, numbered from 0; a null text has none."""

    def eval(self, text: str, max_chars: int, overlap: int):
        if max_chars <= 0 or not 0 <= overlap < max_chars:
            raise ValueError("max_chars must be positive and overlap between 0 and max_chars")
        yield from enumerate(cut(normalise_page(text or ""), max_chars, overlap))


def register_split_text(spark: SparkSession, name: str = "split_text") -> None:
    """Make the splitter a table function of SQL: ``FROM pages p, LATERAL split_text(p.text, 1800, 200)``."""
    spark.udtf.register(name, SplitText)


def chunk_pages(pages: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(source_document, page_number, text) to (source_document, page_number, text, chunk_index).

    Cutting carries state along a page, so it runs in Arrow batches; the index counts through the document.
    """
    if max_chars <= 0 or not 0 <= overlap < max_chars:
        raise ValueError("max_chars must be positive and overlap between 0 and max_chars")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (d, p, k, piece)
                for d, p, t in zip(b.source_document, b.page_number, b.text, strict=True)
                for k, piece in enumerate(cut(normalise_page(t or ""), max_chars, overlap))
            ]
            yield pd.DataFrame(rows, columns=["source_document", "page_number", "_k", "text"])

    pieces = pages.select("source_document", "page_number", "text").mapInPandas(run, "source_document string, page_number int, _k int, text string")
    order = Window.partitionBy("source_document").orderBy("page_number", "_k")
    return pieces.withColumn("chunk_index", F.row_number().over(order) - 1).select("source_document", "page_number", "text", "chunk_index")


def read_pages(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]]) -> DataFrame:
    """Pages of binary documents below ``path``; ``parse`` gives a document's page texts, an empty list is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, body in zip(b.path, b.content, strict=True):
                found = parse(bytes(body))
                if not found:
                    raise ValueError(f"{name} has no pages")
                yield pd.DataFrame({"source_document": name.rsplit("/", 1)[-1], "page_number": range(1, len(found) + 1), "text": [normalise_page(t) for t in found]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "source_document string, page_number int, text string")


def document_chunks(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]], max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Binary documents below ``path`` straight to their chunks."""
    return chunk_pages(read_pages(spark, path, parse), max_chars, overlap)


def text_pages(docs: DataFrame, page_chars: int = 4000) -> DataFrame:
    """Plain texts (doc_id, text) as documents whose pages hold ``page_chars`` characters."""
    count = F.greatest(F.ceil(F.length("text") / page_chars), F.lit(1)).cast("int")
    return docs.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source_document"), F.col("text").alias("_t"), F.explode(F.sequence(F.lit(1), count)).alias("page_number")
    ).select("source_document", "page_number", F.substring(F.col("_t"), (F.col("page_number") - 1) * page_chars + 1, F.lit(page_chars)).alias("text"))
