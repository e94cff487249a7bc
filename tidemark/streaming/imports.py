"""Arriving scouting batches: each one is imported, compared and published at most once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.operators import digest, seals
from tidemark.operators.diff import diff
from tidemark.plans.importing import import_batch
from tidemark.plans.publishing import approve
from tidemark.sources.scouting import from_documents
from tidemark.sources.store import SnapshotStore


def arriving_batches(spark: SparkSession, folder: str) -> DataFrame:
    """One document for each trigger, in order of arrival."""
    return (
        spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", 1).load(folder)
        .select("value", F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_path").alias("file"))
    )


def import_stream(batches: DataFrame, store: SnapshotStore, on_result: Callable[[str, str, DataFrame | None], None],
                  aliases: DataFrame | None = None, approved_at: Callable[[str], str] = lambda scan_at: scan_at) -> DataStreamWriter:
    """Import every arriving batch against the store's head.

    ``on_result(file, status, frame)`` gets ``refused`` with violations, ``no-change``, or ``published`` with the
    diff.  A replayed batch has the head's hash and publishes nothing.
    """
    def handle(batch: DataFrame, _: int) -> None:
        for row in batch.select("file").collect():  # one file for each trigger
            scouting = from_documents(batch.where(F.col("file") == row["file"]))
            head = store.head()
            current = store.read(head["snapshotId"]) if head else None
            candidate = import_batch(scouting, current.opportunities if current else None, aliases)
            if not candidate.violations.isEmpty():
                on_result(row["file"], "refused", candidate.violations)
                continue
            tables = candidate.tables
            # in the scheme of the head, so that equal content gives equal hashes
            contract = current is not None and current.headers.select(seals.scheme_of(current.headers)).first()[0] == seals.CANONICAL
            hashed = digest.canonical_hashes if contract else seals.multiset_seals
            fresh = hashed(tables.headers, tables.feeds, tables.opportunities).first()["computedHash"]
            if head and fresh == head["dataHash"]:
                on_result(row["file"], "no-change", None)
                continue
            changes = diff(current.opportunities, tables.opportunities, "pos") if current else None
            approve(store, tables, approved_at(scouting.scan_at))
            on_result(row["file"], "published", changes)

    return batches.writeStream.foreachBatch(handle)
