"""Re-derive a static board at every tick of a clock stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.operators.board import derive


def ticking_board(ticks: DataFrame, board: DataFrame, on_board: Callable[[DataFrame, int], None],
                  column: str = "timestamp") -> DataStreamWriter:
    """For each micro-batch of ticks call ``on_board(derived board, as_of_ms)`` with the newest tick.

    The board is read by its own plan each time; keep it cached or stored to avoid rebuilding it.
    """
    def tick(batch: DataFrame, _: int) -> None:
        newest = batch.agg(F.max(F.unix_millis(F.col(column))).alias("ms")).first()["ms"]
        if newest is not None:
            on_board(derive(board, newest), newest)

    return ticks.writeStream.foreachBatch(tick)
