"""The snapshot store: complete writes, a manifest with the head, optimistic publication."""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import diagnostic_text
from tidemark.sources.snapshots import SnapshotTables

PARTS = ("headers", "feeds", "opportunities")
MANIFEST = "seq bigint, snapshotId string, previousSnapshotId string, dataHash string, approvedAt string, folder string"
SNAPSHOT_FILES = "snapshot"


class MovedHead(RuntimeError):
    """The published head changed between reading and publishing."""


def write_tables(tables: SnapshotTables, folder: str) -> None:
    """Write into a fresh folder; an existing one is never touched.  Rows keep their position as a column."""
    for part in PARTS:
        getattr(tables, part).write.mode("errorifexists").parquet(f"{folder}/{part}")


def read_tables(spark: SparkSession, folder: str) -> SnapshotTables:
    return SnapshotTables(*[spark.read.parquet(f"{folder}/{part}") for part in PARTS])


def create_exclusively(spark: SparkSession, path: str, content: str) -> bool:
    """A new file with all its content at once; False, and nothing changed, if there is one of that name.

    The content is written beside it under a name readers skip.  Then one step of the file system gives it its name: a hard link on a local disk, elsewhere Hadoop's rename without
    overwriting, which is atomic on HDFS (an object store has to offer the same).
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    target = fs.makeQualified(target)
    fs.mkdirs(target.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    if fs.getScheme() == "file":
        source, name = draft.toUri().getPath(), target.toUri().getPath()
        with open(source, "x", encoding="utf-8") as file:
            file.write(content)
        try:
            os.link(source, name)
        except FileExistsError:
            return False
        finally:
            os.unlink(source)
        return True
    out = fs.create(draft, False)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as error:
        fs.delete(draft, False)
        if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True


class SnapshotStore:
    """Folder layout: ``snapshot/<key>-<attempt>/{headers,feeds,opportunities}`` and a ``manifest`` of one file for each publication, named by its number.

    Readers follow the manifest only, so the folder of a publication that failed is never seen, and the same snapshot can be
    published again, into a fresh folder.  A number is given to one writer only: of two that start from one head the second one gets ``MovedHead``.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, snapshot_id: str) -> str:
        return f"{self.root}/{SNAPSHOT_FILES}/{snapshot_id.replace(':', '_')}-{uuid.uuid4().hex[:12]}"

    def manifest(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).json(f"{self.root}/manifest")

    def head(self):
        """The newest manifest row, or None."""
        try:
            return self.manifest().orderBy(F.col("seq").desc()).first()
        except AnalysisException as error:  # an empty store has no manifest folder yet
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def read(self, snapshot_id: str) -> SnapshotTables:
        found = self.manifest().where(F.col("snapshotId") == snapshot_id).orderBy(F.col("seq").desc()).first()
        if found is None:
            raise LookupError(f"no published snapshot {snapshot_id}")
        return read_tables(self.spark, found["folder"])

    def publish(self, sealed: SnapshotTables, expected_head: str | None) -> str:
        """Write the tables, then claim the number behind the expected head."""
        header = sealed.headers.select("snapshotId", "previousSnapshotId", "dataHash", "approvedAt").first()
        folder = self._folder(header["snapshotId"])
        write_tables(sealed, folder)
        head = self.head()
        if (head["snapshotId"] if head else None) != expected_head:
            raise MovedHead("the approved snapshot changed during approval")
        entry = header.asDict() | {"seq": head["seq"] + 1 if head else 1, "folder": folder}
        if not create_exclusively(self.spark, f"{self.root}/manifest/{entry['seq']:012d}.json", json.dumps(entry) + "\n"):
            raise MovedHead("another snapshot was published from the same head")
        return header["snapshotId"]


def write_diff(changes: DataFrame, folder: str) -> None:
    """The long table, one folder for each change type, ids in code-point order inside it.

    One JSON document with four arrays would have to be gathered in one task, so lines take its place.
    """
    (changes.orderBy("changeType", "projectId").write.mode("errorifexists").partitionBy("changeType").json(folder))


def diagnostic(spark: SparkSession, ok: bool, checked_at: str, stage: str, message: str) -> DataFrame:
    """One failure or success record for the quality log."""
    row = spark.createDataFrame([(ok, checked_at, stage, message)], "ok boolean, checkedAt string, stage string, message string")
    return row.withColumn("message", diagnostic_text(F.col("message")))


def append_events(events: DataFrame, folder: str) -> None:
    events.write.mode("append").parquet(folder)
