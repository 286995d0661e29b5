"""Table functions for SQL: a text's chunks, sentences and heading parts, to be joined with LATERAL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.chunking import split_text
from ..sources.files import HEADING
from .text import cleaned


@udtf(returnType="chunk_index long, start_index long, text string", useArrow=True)
class SplitChunks:
    """split_chunks(text, size, overlap): the rows of `chunking.recursive_chunks` for one text; null and blank texts have none."""

    def eval(self, text: str | None, size: int, overlap: int) -> Iterator[tuple[int, int, str]]:
        if not 0 <= overlap < size:
            raise ValueError("overlap must be smaller than size")
        at = 0
        for i, chunk in enumerate(split_text(text, size, overlap) if text and text.strip() else ()):
            at = text.find(chunk, max(0, at))
            yield i, at, chunk
            at += len(chunk) - overlap


@udtf(returnType="page int, text string", useArrow=True)
class SplitParts:
    """split_parts(text): the cleaned parts of a text from heading to heading, numbered from 1, as a file of it has; null and blank texts have none."""

    def eval(self, text: str | None) -> Iterator[tuple[int, str]]:
        for i, part in enumerate(HEADING.split(cleaned(text)), 1):
            if part.strip():
                yield i, part.strip()


def register(spark: SparkSession) -> None:
    """Makes split_chunks and split_parts table functions of the session's SQL."""
    spark.udtf.register("split_chunks", SplitChunks)
    spark.udtf.register("split_parts", SplitParts)
