"""Ordering and paging from request values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor.operators.ranking import slice_of

# Limits of the shared paginator.
MAX_PAGE_SIZE = 100
DEFAULT_PAGE_SIZE = 10


def clamp_page(page: int, size: int) -> tuple[int, int]:
    """Page number and size within the paginator's limits."""
    if size > MAX_PAGE_SIZE:
        size = MAX_PAGE_SIZE
    elif size <= 0:
        size = DEFAULT_PAGE_SIZE
    return max(page, 1), size


def page_of(df: DataFrame, page: int, size: int, order: Sequence) -> DataFrame:
    """One page in a total order; size 0 gives all rows in order."""
    if size == 0:
        return df.orderBy(*order)
    return slice_of(df, order, max(size * (page - 1), 0), size)


def window_of(df: DataFrame, order: Sequence, limit: int | None, offset: int | None, default_limit: int | None = None):
    """Limit and offset from the request, the template's limit as fallback. A limit of 0 gives no rows."""
    return slice_of(df, order, offset or 0, default_limit if limit is None else limit)


def checked_order(df: DataFrame, order: str | None, default: str | None = None, tie: Sequence[str] = ()) -> list:
    """Order columns from ``"column"`` or ``"column asc|desc"``; anything else is an error."""
    text = order or default
    if not text:
        return [F.asc(t) for t in tie]
    column, *rest = text.split(" ")
    if column not in df.columns:
        raise ValueError(f"order column {column!r} is not a column of the table")
    direction = rest[0] if rest else "asc"
    if direction not in ("asc", "desc"):
        raise ValueError(f"order direction {direction!r} is not allowed")
    first = F.desc(column) if direction == "desc" else F.asc(column)
    return [first, *[F.asc(t) for t in tie if t != column]]


def lenient_order(df: DataFrame, column: str | None, descending: bool, fallback: str) -> list:
    """Order by a request column; a column the table does not have falls back silently."""
    name = column if column in df.columns else fallback
    first = F.desc(name) if descending and name == column else F.asc(name)
    return [first] if name == fallback else [first, F.asc(fallback)]
