"""Dimension data: provinces, legacy archive, logo records, text corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schema as S
from tidemark.operators.positions import first_wins


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def read_provinces(spark: SparkSession, path: str) -> DataFrame:
    """{province: [school, ...]} -> (name, province); a school listed twice keeps its first province."""
    schema = T.MapType(T.StringType(), T.ArrayType(T.StringType()))
    lists = _whole(spark, path).select(F.map_entries(F.from_json("value", schema)).alias("entries"))
    schools = lists.select(F.posexplode("entries").alias("rank", "entry")).select(
        F.col("entry.key").alias("province"), F.col("rank").alias("pos"), F.explode("entry.value").alias("name"))
    return first_wins(schools, ["name"], "pos").select("name", "province")


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    """{feedId: [row, ...]} -> (feedId, pos, legacy columns)."""
    schema = T.MapType(T.StringType(), T.ArrayType(S.LEGACY_ROW))
    feeds = _whole(spark, path).select(F.explode(F.from_json("value", schema)).alias("feedId", "rows"))
    return feeds.select("feedId", F.posexplode("rows").alias("pos", "row")).select(
        "feedId", F.col("pos").cast("bigint").alias("pos"), "row.*")


def read_logo_records(spark: SparkSession, path: str) -> DataFrame:
    """[{rank, name, logo_url}, ...] -> (pos, name, logo_url)."""
    rows = _whole(spark, path).select(F.posexplode(
        F.from_json("value", "array<struct<rank:string,name:string,logo_url:string>>")).alias("pos", "row"))
    return rows.select(F.col("pos").cast("bigint").alias("pos"), "row.name", "row.logo_url")


def corpus_lines(documents: DataFrame, file: str = "doc_id", body: str = "text") -> DataFrame:
    """(file, line_no, line) of any table with a text column."""
    return documents.select(F.col(file).alias("file"), F.posexplode(F.split(F.col(body), "\n", -1)).alias("line_no", "line")).select(
        "file", (F.col("line_no") + 1).cast("bigint").alias("line_no"), "line")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Whole files of a folder as (file, text)."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
