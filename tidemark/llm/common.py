"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_folder(spark: SparkSession, what: str) -> str:
    """A new folder for one run below the folder all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: later branches read equal rows, lineage is cut."""
    spark = df.sparkSession
    path = run_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder and the path there, for files which tasks write themselves."""
    if urlparse(uri).scheme:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def let(value: Column, body) -> Column:
    """``body`` of ``value`` with ``value`` computed once, also where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def boxed(df: DataFrame, **named: str) -> DataFrame:
    """The whole row as struct ``row`` and the columns an operator needs beside it under its own names.

    Extra columns of the input, whatever their names, then cannot clash with what the operator adds.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[F.col(f"`{c}`").alias(name) for name, c in named.items()])


def slices(batches: Iterator[pa.RecordBatch], text: str, budget: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most ``budget`` bytes of ``text`` each, one row at least."""
    for batch in batches:
        lengths = [0 if n is None else n for n in pa.compute.binary_length(batch.column(text)).to_pylist()]
        begin = total = 0
        for i, n in enumerate(lengths):
            if i > begin and total + n > budget:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if batch.num_rows > begin:
            yield batch.slice(begin)
