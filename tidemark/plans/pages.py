"""What a reader of the board asks for: ranked rows, facet panel, calendar, catalog."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidemark.functions.dates import BOARD_ZONE
from tidemark.operators import board, calendar, catalog, facets


@dataclass(frozen=True)
class BoardPage:
    rows: DataFrame
    facets: DataFrame
    counts: DataFrame


def board_page(rows: DataFrame, provinces: DataFrame, chosen: board.BoardFilter, as_of_ms: int) -> BoardPage:
    """Derive, filter and order one feed; facets and totals are over all of its rows."""
    located = board.resolve_province(board.derive(rows, as_of_ms), provinces)
    visible = board.apply_filter(located, chosen).orderBy(*board.board_order())
    return BoardPage(visible, facets.all_facets(located), facets.visible_counts(located, board.predicate(chosen)))


def calendar_page(rows: DataFrame, as_of_ms: int, zone: str = BOARD_ZONE) -> tuple[DataFrame, DataFrame]:
    """The 42-day grid with counts and the first items of each day."""
    first_day = calendar.pick_month(rows, as_of_ms, zone).first()["first_day"]
    derived = board.derive(rows, as_of_ms)
    return calendar.month(rows, as_of_ms, zone, first_day), calendar.preview(derived, as_of_ms, zone, first_day)


def catalog_page(approved: DataFrame, approved_feeds: DataFrame, legacy: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Feeds, rows and rows per feed of approved and archived data together."""
    feeds = catalog.catalog_feeds(approved_feeds, legacy)
    rows = catalog.catalog_rows(approved, approved_feeds, legacy)
    return feeds, rows, facets.feed_counts(rows, feeds)
