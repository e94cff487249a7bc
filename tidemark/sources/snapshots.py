"""Snapshot documents as three tables: headers, feeds, opportunities."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schema as S
from tidemark.functions.facts import bound, variant_fields
from tidemark.operators.documents import is_strict_json
from tidemark.session import written


@dataclass(frozen=True)
class SnapshotTables:
    """Rows of all tables are keyed by ``snapshotKey``; ``pos`` is the stored array position."""

    headers: DataFrame
    feeds: DataFrame
    opportunities: DataFrame


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(snapshotKey, doc VARIANT) of all files within the size bound, and the refused files with the reason."""
    return _accepted(_parsed_files(spark, path))


def _parsed_files(spark: SparkSession, path: str) -> DataFrame:
    # a compressed file is bound by the text it holds
    size = F.greatest(F.col("_metadata.file_size"), F.octet_length("value").cast("bigint"))
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("snapshotKey"), size.alias("size"),
        F.when(is_strict_json(F.col("value")), F.try_parse_json("value")).alias("doc"))


def _accepted(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    too_big = F.col("size") > S.MAX_SNAPSHOT_BYTES
    refused = files.where(too_big | F.col("doc").isNull()).select(
        "snapshotKey", F.when(too_big, "exceeds the size limit").otherwise("not strict JSON").alias("message"))
    return files.where(~too_big & F.col("doc").isNotNull()).select("snapshotKey", "doc"), refused


def typed(doc: str | Column, name: str, kind: T.DataType) -> Column:
    """A value of a document with exactly its type at every level; anything else is null, so no cast ever loses or invents something.

    Whole numbers come only from numbers without a fraction, texts from texts, a struct from an object, an array of texts from one that has nothing else.
    """
    return typed_value(F.try_variant_get(doc, f"$.{name}", "variant"), kind)


def typed_value(whole: Column, kind: T.DataType) -> Column:
    """``typed`` of the VARIANT itself."""
    found = F.schema_of_variant(whole)
    if isinstance(kind, T.LongType):
        exact = F.try_variant_get(whole, "$", "double")
        return F.when(found.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (exact == F.floor(exact)), F.try_variant_get(whole, "$", "bigint"))
    if isinstance(kind, T.StructType):
        return _struct(whole, kind, lambda fields, struct: F.when(fields.isNotNull(), struct))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(F.try_variant_get(whole, "$", "array<variant>"), lambda item: _struct(item, kind.elementType, lambda _, struct: struct))
    if isinstance(kind, T.ArrayType):
        return F.when(found.rlike("^ARRAY<(STRING|VOID)>$"), F.try_variant_get(whole, "$", kind.simpleString()))
    return F.when(found == "STRING", F.try_variant_get(whole, "$", "string"))


def _struct(whole: Column, kind: T.StructType, of: Callable[[Column, Column], Column]) -> Column:
    """``of`` (the fields of an object, null for anything else, and the struct of their typed values)."""
    return bound(variant_fields(whole, kind.fieldNames()), lambda fields: of(
        fields, F.struct(*[typed_value(fields[part.name], part.dataType).alias(part.name) for part in kind.fields])))


def opportunity_fields(item: str) -> Column:
    """The values of an opportunity VARIANT, taken in one pass, for ``opportunity_columns``."""
    return variant_fields(F.col(item), S.OPPORTUNITY.fieldNames())


def opportunity_columns(fields: str) -> list[Column]:
    """The typed columns of ``opportunity_fields``."""
    return [typed_value(F.col(f"{fields}.{part.name}"), part.dataType).alias(part.name) for part in S.OPPORTUNITY.fields]


def header_columns() -> list[Column]:
    """The typed header columns of a document VARIANT ``doc``."""
    text, number = T.StringType(), T.LongType()
    field = lambda name, kind: typed("doc", name, kind).alias(name)
    return [
        field("schemaVersion", number), field("scanAt", text), field("defaultFeedId", text),
        F.struct(*[typed("doc", f"counts.{name}", number).alias(name) for name in S.COUNT_KEYS]).alias("counts"),
        *[field(name, text) for name in S.APPROVAL_KEYS]]


def feed_array() -> Column:
    """The typed feeds of a document VARIANT ``doc``, in stored order."""
    return typed("doc", "feeds", T.ArrayType(S.FEED))


def feed_rows(documents: DataFrame, feeds: Column) -> DataFrame:
    return documents.select("snapshotKey", F.posexplode(feeds).alias("pos", "item")).select("snapshotKey", F.col("pos").cast("bigint").alias("pos"), "item.*")


def as_tables(documents: DataFrame) -> SnapshotTables:
    """Typed tables of parsed documents of either schema version."""
    number = T.LongType()
    headers = documents.select("snapshotKey", *header_columns())
    feeds = feed_rows(documents, feed_array())
    opportunities = documents.select(
        "snapshotKey", typed("doc", "schemaVersion", number).alias("schemaVersion"),
        F.posexplode(F.try_variant_get("doc", "$.opportunities", "array<variant>")).alias("pos", "item")).select(
        "snapshotKey", "schemaVersion", F.col("pos").cast("bigint").alias("pos"), opportunity_fields("item").alias("item")).select(
        "snapshotKey", "schemaVersion", "pos", *opportunity_columns("item"))
    return SnapshotTables(headers, feeds, opportunities)


def read_snapshots(spark: SparkSession, path: str) -> SnapshotTables:
    """The tables of all files; a file that ``read_documents`` refuses is an error, not a gap."""
    # Small files are slow to open and texts slow to parse: both are done once, for the check and for all tables.
    documents, refused = _accepted(written(_parsed_files(spark, path)))
    first = refused.limit(20).collect()
    if first:
        raise ValueError("refused files, see read_documents for all:\n" + "\n".join(f"{r['snapshotKey']}: {r['message']}" for r in first))
    return as_tables(documents)
