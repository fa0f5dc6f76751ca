"""Sorts, pages and keyset cursors."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT = "taken_at_desc"
#: Column, whether it rises, of each sort that may be asked for. The id breaks ties in the same direction.
SORTS = {"taken_at_desc": ("taken_at", False), "taken_at_asc": ("taken_at", True), "rating_desc": ("rating", False), "filename_asc": ("filename", True), "imported_at_desc": ("imported_at", False)}
PAGE_LIMIT = 2000


def order(sort: str) -> list[Column]:
    """Nulls last either way; an unknown name means the default."""
    column, rises = SORTS.get(sort, SORTS[DEFAULT])
    return [F.col(column).asc_nulls_last(), F.col("id").asc()] if rises else [F.col(column).desc_nulls_last(), F.col("id").desc()]


def page(rows: DataFrame, sort: str, number: int, size: int) -> DataFrame:
    """Pages count from 1."""
    size = min(max(1, size), PAGE_LIMIT)
    return rows.orderBy(*order(sort)).offset((max(1, number) - 1) * size).limit(size)


def cursor_behind(row, sort: str) -> str:
    """An opaque text that names a row's place in a sort: the sort, the row's value in it, and the id."""
    value = row[SORTS[sort][0]]
    return json.dumps([sort, value.isoformat() if isinstance(value, datetime) else value, row["id"]]).encode().hex()


def place_of(cursor: str) -> tuple[str, object, int] | None:
    """What cursor_behind has put in; None for any other text."""
    try:
        sort, value, row_id = json.loads(bytes.fromhex(cursor))
    except (ValueError, TypeError):
        return None
    return (sort, value, row_id) if isinstance(row_id, int) else None


def after_cursor(rows: DataFrame, cursor: str | None, sort: str, size: int) -> DataFrame:
    """The page behind a cursor. A corrupt cursor gives page 1; one of another sort is an error."""
    sort = sort if sort in SORTS else DEFAULT
    place = place_of(cursor) if cursor else None
    if place is not None:
        of, key, row_id = place
        if of != sort:
            raise ValueError("the cursor belongs to another sort")
        column, rises = SORTS[sort]
        behind = F.col("id") > row_id if rises else F.col("id") < row_id
        if key is None:
            rows = rows.filter(F.col(column).isNull() & behind)
        else:
            value = F.lit(datetime.fromisoformat(key)).cast("timestamp_ntz") if column.endswith("_at") else F.lit(key)
            further = F.col(column) > value if rises else F.col(column) < value
            rows = rows.filter(further | ((F.col(column) == value) & behind) | F.col(column).isNull())
    return rows.orderBy(*order(sort)).limit(min(max(1, size), PAGE_LIMIT))


def stack_order() -> list[Column]:
    """The cover, then derivatives, then RAW files; within each by file name."""
    return [F.when(F.col("is_cover"), 0).when(F.col("role") == "derivative", 1).otherwise(2), F.col("role").desc(), F.col("filename")]
