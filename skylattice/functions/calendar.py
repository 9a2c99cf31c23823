"""Date and time column functions. Everything stays TIMESTAMP_NTZ, so no session time zone is involved."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 of a zone-free timestamp."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), _col(ts))


def from_epoch_millis(ms) -> Column:
    return F.timestamp_add("MILLISECOND", _col(ms), F.expr(_EPOCH))


def from_epoch_seconds(s) -> Column:
    """Fractional epoch seconds to a zone-free timestamp (microsecond precision)."""
    return F.timestamp_add("MICROSECOND", F.rint(_col(s) * 1_000_000).cast("bigint"), F.expr(_EPOCH))


def local_time(ts, minutes: int = 330) -> Column:
    """Shift UTC to local clock time by a fixed offset (default +5 h 30 min)."""
    return F.timestamp_add("MINUTE", F.lit(minutes), _col(ts))


def round_to_hour(ts) -> Column:
    """Nearest full hour; a half hour goes to the even hour."""
    hours = F.rint(epoch_micros(ts) / F.lit(3.6e9)).cast("int")
    return F.timestamp_add("HOUR", hours, F.expr(_EPOCH))


def month_key(ts) -> Column:
    return F.date_format(_col(ts), "yyyy-MM")


def season_label(ts) -> Column:
    """'2021-22' for October 2021 to September 2022."""
    start = F.year(_col(ts)) - F.when(F.month(_col(ts)) < 10, 1).otherwise(0)
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(F.pmod(start + 1, F.lit(100)).cast("string"), 2, "0"))


def season_start_year(ts) -> Column:
    return F.year(_col(ts)) - F.when(F.month(_col(ts)) < 10, 1).otherwise(0)


def in_season(ts, months=(10, 11, 12, 1, 2, 3, 4, 5)) -> Column:
    return F.month(_col(ts)).isin(*months)


def month_starts(start, end) -> Column:
    """Array of the first days of all months in [start, end)."""
    first = F.trunc(_col(start).cast("date"), "month")
    last = F.date_sub(_col(end).cast("date"), 1)
    return F.sequence(first, last, F.expr("interval 1 month"))
