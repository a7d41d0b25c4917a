"""Order-sensitive lookups over a view: pages, cursors, jumps, scrubbing and zooming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.exact_json import pretty_json
from logweave.functions.record import severity_name, time_text

CONTEXT = 5
#: Most characters of a record that are shown.
SHOWN = 256 * 1024


def page(view: DataFrame, top: int, rows: int) -> DataFrame:
    """``rows`` rows in line order from the first whose line_id is at least ``top``."""
    return view.where(F.col("line_id") >= top).orderBy("line_id").limit(rows)


def lower_bound(view: DataFrame, cursor: int) -> DataFrame:
    """One row: the first line_id at or after the cursor."""
    return view.where(F.col("line_id") >= cursor).agg(F.min("line_id").alias("line_id"))


def snap_cursor(view: DataFrame, cursor: int) -> DataFrame:
    """One row: the largest line_id at or before the cursor, else the smallest (null for an empty view)."""
    return view.agg(F.coalesce(F.max(F.when(F.col("line_id") <= cursor, F.col("line_id"))), F.min("line_id")).alias("line_id"))


def jump_to_time(view: DataFrame, micros: int) -> DataFrame:
    """One row: the first line_id, in line order, whose time is at or after ``micros``."""
    return view.where(F.col("ts_micros") >= micros).agg(F.min("line_id").alias("line_id"))


def move(view: DataFrame, cursor: int, by: int) -> DataFrame:
    """The row ``by`` places from the first at or after the cursor, clamped to the view."""
    n, before = view.agg(F.count(F.lit(1)), F.count_if(F.col("line_id") < cursor)).first()
    at = max(0, min(n - 1, before + by))
    # Within the half of the view that holds it, so no more than |by| rows and the edges are ranked.
    if at >= before:
        return view.where(F.col("line_id") >= cursor).orderBy("line_id").offset(at - before).limit(1)
    return view.where(F.col("line_id") < cursor).orderBy(F.desc("line_id")).offset(before - 1 - at).limit(1)


def last_page(view: DataFrame, rows: int = 20) -> DataFrame:
    """The last ``rows`` rows in line order."""
    return view.orderBy(F.desc("line_id")).limit(rows).orderBy("line_id")


def detail(records: DataFrame, cursor: int, around: int = CONTEXT) -> DataFrame:
    """The record and ``around`` lines to both sides, of the unfiltered table; JSON is also given indented."""
    near = records.where(F.col("line_id").between(cursor - around, cursor + around))
    shown = F.substring("raw", 1, SHOWN)
    return near.select("line_id", (F.col("line_id") == cursor).alias("is_cursor"), shown.alias("raw"), pretty_json(shown).alias("pretty"))


def scrub_range(t_min: int, t_max: int, bins: int, b: int, zoom: tuple[int, int] | None = None) -> tuple[int, int]:
    """Inclusive time range of a scrubbed bin (``t_max``: one past the last time); the whole window while zoomed."""
    if zoom is not None:
        return zoom
    size = max(max(t_max - t_min, 1) // max(bins, 1), 1)
    b = min(b, max(bins, 1) - 1)
    return t_min + b * size, t_min + (b + 1) * size - 1


def zoom(full: tuple[int, int], window: tuple[int, int] | None, bins: int, b: int, inward: bool) -> tuple[int, int] | None:
    """Halve or double the shown window around the middle of bin ``b``; None once it covers ``full``.

    The shown bins end one past the window's last time. The result keeps its length at the edges of ``full``.
    """
    lo, hi = window or full
    width = max(hi + 1 - lo, 1) // max(bins, 1)
    middle = lo + min(b, max(bins, 1) - 1) * width + width // 2
    span = min(max(max(hi - lo, 1) // 2, 1) if inward else max(hi - lo, 1) * 2, full[1] - full[0])
    start = middle - span // 2
    end = start + span
    if start < full[0]:
        start, end = full[0], min(end + full[0] - start, full[1])
    if end > full[1]:
        start, end = max(start - (end - full[1]), full[0]), full[1]
    return None if start <= full[0] and end >= full[1] else (start, end)


def next_bookmark(marks: Sequence[int], cursor: int) -> int | None:
    """The bookmark after the cursor, or the first again."""
    ordered = sorted(set(marks))
    return next((m for m in ordered if m > cursor), ordered[0] if ordered else None)


def surviving(view: DataFrame, line_id: int) -> DataFrame:
    """The row if the view still holds it."""
    return view.where(F.col("line_id") == line_id)


def column_limit(width_cap: int, asked: int) -> int:
    """How many automatic columns fit."""
    return max(0, min(width_cap, asked + 1) - 1)


def table_rows(view: DataFrame, columns: Sequence[str], marks: Sequence[int] = ()) -> DataFrame:
    """What a table shows: mark, line_id, time, severity, automatic columns (missing: empty), raw only without such columns."""
    cells = [F.coalesce(F.get_json_object("raw", f"$['{c}']"), F.lit("")).alias(c) for c in columns]
    return view.select(F.col("line_id").isin(*marks).alias("marked") if marks else F.lit(False).alias("marked"), "line_id", time_text(F.col("ts_micros")).alias("time"), severity_name(F.col("severity")).alias("severity"), *(cells or ["raw"]))
