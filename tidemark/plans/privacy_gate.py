"""Privacy gate over any text corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import privacy
from tidemark.sources.dimensions import corpus_lines


def corpus_findings(documents: DataFrame, file: str = "doc_id", body: str = "text",
                    contacts: tuple[str, ...] = privacy.REVIEWED_CONTACTS) -> DataFrame:
    """(file, line_no, kind) for every line with private data; reviewed public contacts pass."""
    composed = privacy.with_nfkc(documents.select(file, body), body)
    return corpus_lines(composed, file, body).select(
        "file", "line_no", F.explode(privacy.corpus_kinds(F.col("line"), contacts)).alias("kind"))


def text_findings(documents: DataFrame, file: str = "doc_id", body: str = "text") -> DataFrame:
    """(file, kind): the first private value of each whole text under all its spellings."""
    return privacy.with_private_kind(documents.select(F.col(file).alias("file"), body), body).where(
        F.col("kind").isNotNull()).select("file", "kind")
