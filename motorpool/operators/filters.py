"""Row filters. Each is a plain predicate, so it reaches the scan."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motorpool.functions.scalars import before, col, day, moment

# Characters a filter value may hold
SAFE_CHARACTERS = r"[\w\s\-.,#&'()/%]+"
# The same set for whole columns, with letters and digits of every script spelt out
SAFE_TEXT = r"^[\p{L}\p{N}_\s\p{Z}\-.,#&'()/%]+$"

HORIZON_HOURS = {"1h": 1, "4h": 4, "24h": 24}


def assert_safe_value(value: str) -> str:
    if not re.fullmatch(SAFE_CHARACTERS, value):
        raise ValueError("invalid filter value")
    return value


def is_safe_text(text: Column | str) -> Column:
    return col(text).rlike(SAFE_TEXT)


def filter_equals(df: DataFrame, **wanted) -> DataFrame:
    """All given columns equal their values; ``None`` or empty text means no filter."""
    tests = []
    for name, value in wanted.items():
        if value is None or value == "":
            continue
        if isinstance(value, str):
            assert_safe_value(value)
        tests.append(F.col(name) == F.lit(value))
    return df.filter(reduce(and_, tests)) if tests else df


def _edge(df: DataFrame, name: str, bound: Column) -> Column:
    """A day or moment in the type of the column it is compared with.

    The column itself stays bare, so the test reaches the scan and prunes date partitions.
    Text times compare as text: a bare day sorts before all its moments.
    """
    kind = df.schema[name].dataType
    return bound.cast(kind if isinstance(kind, T.DatetimeType | T.StringType) else "timestamp_ntz")


def filter_since(df: DataFrame, ts: str, as_of, days: int = 0, hours: int = 0, minutes: int = 0) -> DataFrame:
    """A lookback. With days alone the whole first day counts, as a comparison of dates does."""
    if days and not (hours or minutes):
        start = F.date_sub(day(as_of), days)
    else:
        start = before(as_of, days, hours, minutes)
    return df.filter(F.col(ts) >= _edge(df, ts, start))


def filter_next_days(df: DataFrame, date: str, as_of, n: int | None = None) -> DataFrame:
    """From today to ``n`` days ahead, both included; no ``n`` leaves the end open."""
    today = day(as_of)
    ahead = F.col(date) >= today
    return df.filter(ahead if n is None else ahead & (F.col(date) <= F.date_add(today, n)))


def filter_day(df: DataFrame, ts: str, on) -> DataFrame:
    """One calendar day, half-open."""
    start = day(on)
    return df.filter(
        (F.col(ts) >= _edge(df, ts, start)) & (F.col(ts) < _edge(df, ts, F.date_add(start, 1)))
    )


def filter_between(df: DataFrame, ts: str, date_from=None, date_to=None) -> DataFrame:
    """Optional day bounds; the end day counts to its last instant."""
    if date_from is not None:
        df = df.filter(F.col(ts) >= _edge(df, ts, day(date_from)))
    if date_to is not None:
        df = df.filter(F.col(ts) < _edge(df, ts, F.date_add(day(date_to), 1)))
    return df


def filter_horizon(df: DataFrame, date: str, hour: str, as_of, horizon: str = "24h", mode: str = "clock_hour") -> DataFrame:
    """Forecast rows ahead; an unknown horizon means 24 hours.

    ``clock_hour`` keeps hour-of-day up to the limit on every day from today on.
    ``elapsed`` keeps rows that start within that many hours of ``as_of``.
    """
    hours = HORIZON_HOURS.get(horizon, 24)
    if mode == "clock_hour":
        return df.filter((F.col(date) >= day(as_of)) & (F.col(hour) <= hours))
    if mode == "elapsed":
        starts = F.col(date).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col(hour))
        # Hours of a day lie in 0 to 23, so the days are bounded and prune the scan.
        first, last = day(as_of), F.to_date(before(as_of, hours=-hours))
        return df.filter((F.col(date) >= first) & (F.col(date) <= last)).filter(
            (starts >= moment(as_of)) & (starts <= before(as_of, hours=-hours))
        )
    raise ValueError(f"unknown mode {mode!r}")


def filter_in(df: DataFrame, name: str, values) -> DataFrame:
    return df.filter(F.col(name).isin(*values))


def filter_flag(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col(name))


def filter_present(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col(name).isNotNull())


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup; no row means not found."""
    return df.filter(F.col(key) == F.lit(value))


def filter_columns_differ(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a) != F.col(b))


def at_latest_snapshot(df: DataFrame, date: str) -> DataFrame:
    """Rows of the last snapshot; the one-row maximum is a scalar subquery."""
    latest = df.agg(F.max(date)).scalar()
    return df.filter(F.col(date) == latest)
