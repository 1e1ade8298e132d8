"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankline.schema import DRIVERS, N_DRIVERS, RAW_TS_FORMAT, STORED_TS_FORMAT

__all__ = [
    "whole_days", "weekday_mon0", "half_even_int", "driver_array", "nonblank", "blank_to_null",
    "position_first", "position_last", "parse_raw_ts", "parse_stored_ts", "to_datetime",
    "pad_to", "compose_ts", "count_chosen", "has_repeat",
]


def whole_days(start, end) -> Column:
    """Whole elapsed days (floor of the exact difference), not calendar boundaries."""
    return F.timestamp_diff("DAY", _c(start), _c(end))


def weekday_mon0(c) -> Column:
    """Day of week with Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(c))


def half_even_int(c) -> Column:
    """Round half to even, then to integer."""
    return F.bround(_c(c), 0).cast("int")


def driver_array(cols: list[str] | None = None) -> Column:
    return F.array(*[F.col(c) for c in (cols or DRIVERS)])


def blank_to_null(c) -> Column:
    return F.nullif(_c(c), F.lit(""))


def nonblank(arr: Column) -> Column:
    return F.filter(arr, lambda x: x.isNotNull() & (x != F.lit("")))


def count_chosen(arr: Column) -> Column:
    return F.size(nonblank(arr))


def has_repeat(arr: Column) -> Column:
    chosen = nonblank(arr)
    return F.size(chosen) > F.size(F.array_distinct(chosen))


def position_first(arr: Column, factor: str) -> Column:
    """1-based position of the first occurrence, 0 if absent."""
    return F.coalesce(F.array_position(arr, F.lit(factor)), F.lit(0)).cast("int")


def position_last(arr: Column, factor: str) -> Column:
    """1-based position of the last occurrence (highest driver wins), 0 if absent."""
    rp = F.array_position(F.reverse(arr), F.lit(factor))
    return F.coalesce(F.when(rp > 0, F.size(arr) + 1 - rp).otherwise(F.lit(0)), F.lit(0)).cast("int")


def parse_raw_ts(c) -> Column:
    """'M/D/YYYY H:MM' text -> timestamp_ntz, NULL when unparsable."""
    return F.try_to_timestamp(_c(c), F.lit(RAW_TS_FORMAT)).cast("timestamp_ntz")


def parse_stored_ts(c) -> Column:
    """Strict 'YYYY-MM-DD HH:MM:SS' text -> timestamp_ntz, NULL when invalid."""
    return F.try_to_timestamp(_c(c), F.lit(STORED_TS_FORMAT)).cast("timestamp_ntz")


def to_datetime(c) -> Column:
    """Time text in the usual forms -> timestamp_ntz, NULL when it is none."""
    return _c(c).try_cast("timestamp_ntz")


def pad_to(arr: Column, n: int = N_DRIVERS) -> Column:
    """Pad with NULLs / truncate an array to exactly n elements."""
    fill = F.array_repeat(F.lit(None).cast("string"), n)
    return F.slice(F.concat(arr, fill), 1, n)


def compose_ts(date_col, time_col) -> Column:
    """'YYYY-MM-DD' + 'HH:MM' -> timestamp_ntz."""
    text = F.concat(_c(date_col), F.lit(" "), _c(time_col), F.lit(":00"))
    return parse_stored_ts(text)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
