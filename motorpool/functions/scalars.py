"""Scalar functions over columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from motorpool.schemas import STEPS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def moment(as_of) -> Column:
    """A date, datetime, ISO text or Column as a zone-free timestamp."""
    if isinstance(as_of, Column):
        return as_of.cast("timestamp_ntz")
    if isinstance(as_of, (dt.date, dt.datetime)):
        as_of = as_of.isoformat()
    return F.lit(as_of).cast("timestamp_ntz")


def day(as_of) -> Column:
    """The calendar day of :func:`moment`."""
    return moment(as_of).cast("date")


def before(as_of, days: int = 0, hours: int = 0, minutes: int = 0) -> Column:
    """``as_of`` less a lookback."""
    return moment(as_of) - F.expr(f"make_dt_interval({days}, {hours}, {minutes}, 0)")


def plus_minutes(ts: Column | str, minutes: Column) -> Column:
    """Timestamp plus whole minutes; a fraction of a minute is cut, not rounded."""
    return col(ts) + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"), F.lit(0))


def minute_number(ts: Column | str) -> Column:
    """Minutes since 1970 from calendar fields, so no session time zone takes part."""
    ts = col(ts)
    days = F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 1440 + F.hour(ts) * 60 + F.minute(ts)


def text_time(ts: Column | str) -> Column:
    """``yyyy-MM-dd HH:mm:ss``, a fraction of a second cut off."""
    return F.left(col(ts).cast("string"), F.lit(19))


def parse_time(text: Column | str) -> Column:
    return col(text).cast("timestamp_ntz")


def clock_text(hour: Column, minute: Column) -> Column:
    """``HH:mm``."""
    return F.concat(
        F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0")
    )


def iso_text(c: Column | str, kind: str) -> Column:
    """ISO 8601 text; the fraction of a second appears only when there is one."""
    text = col(c).cast("string")
    if kind == "date":
        return text
    seconds = F.replace(F.left(text, F.lit(19)), F.lit(" "), F.lit("T"))
    return F.when(F.length(text) == 19, seconds).otherwise(
        F.concat(seconds, F.rpad(F.substring(text, 20, 7), 7, "0"))
    )


def is_weekend(d: Column | str) -> Column:
    return F.dayofweek(col(d)).isin(1, 7)


def clamp(c: Column | str, lo, hi) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.least(hi, F.greatest(lo, col(c)))


def whole(c: Column | str) -> Column:
    """INT by truncation toward zero."""
    return col(c).cast("int")


def nullif(c: Column | str, value) -> Column:
    return F.nullif(col(c), F.lit(value))


def case_map(c: Column | str, mapping: Mapping, default=None) -> Column:
    """Simple CASE over constants."""
    c, result = col(c), F
    for key, value in mapping.items():
        result = result.when(c == F.lit(key), F.lit(value))
    return result.otherwise(F.lit(default))


def ellipsis(text: Column | str, width: int = 100) -> Column:
    """The first ``width`` characters, with ``...`` where something was cut."""
    text = col(text)
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width)), F.lit("..."))).otherwise(text)


def slug(text: Column | str) -> Column:
    """Lower case with every run of other characters as one ``_``, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", "_"), F.lit("_"))


def headline_words(code: Column | str) -> Column:
    """``snake_case`` as title words: a letter is a capital where none stands before it."""
    words = F.replace(col(code), F.lit("_"), F.lit(" "))
    letters = F.split(words, "")
    by_letter = F.array_join(
        F.transform(
            letters,
            lambda c, i: F.when((i > 0) & F.element_at(letters, F.greatest(i, F.lit(1))).rlike(r"\p{L}"), F.lower(c)).otherwise(F.upper(c)),
        ),
        "",
    )
    # Nearly all codes are plain words, which need no look at each letter.
    return F.when(words.rlike("^[A-Za-z ]*$"), F.initcap(words)).otherwise(by_letter)


def parse_steps(text: Column | str) -> Column:
    """JSON text as an array of steps; anything but a JSON list gives NULL."""
    text = col(text)
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, STEPS))


def parse_steps_loosely(text: Column | str) -> Column:
    """JSON text as an array of steps in which every step keeps what it has: a field that is absent
    or of another kind is NULL, and ``rest`` holds the whole step as JSON, with fields that the
    steps' type does not know. A step that is no object has only ``rest``. Anything but a JSON
    list gives NULL.
    """
    items = F.try_variant_get(F.try_parse_json(col(text)), "$", "array<variant>")

    def step(v: Column) -> Column:
        known = [F.try_variant_get(v, f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in STEPS.elementType.fields]
        return F.struct(*known, F.to_json(v).alias("rest"))

    return F.transform(items, step)


def along(start: Column | str, end: Column | str, progress: Column | str) -> Column:
    """Coordinate at a progress in [0, 1] between two ends, 6 digits."""
    start, end = col(start), col(end)
    return F.round(start + (end - start) * clamp(progress, 0.0, 1.0), 6)


def heading(lat0, lon0, lat1, lon1) -> Column:
    """Compass heading in [0, 360), 1 digit."""
    angle = F.degrees(F.atan2(col(lon1) - col(lon0), col(lat1) - col(lat0)))
    return F.round(F.pmod(angle, F.lit(360.0)), 1)


def pull_back(position: Column | str, centre: Column | str, limit: float = 0.015, share: float = 0.05) -> Column:
    """A position too far from the centre moves back by a share of its offset."""
    position = col(position)
    drift = position - col(centre)
    return F.when(F.abs(drift) > limit, position - drift * share).otherwise(position)


def battery_range(pct: Column | str, miles_per_pct: float) -> Column:
    return F.round(col(pct) * F.lit(miles_per_pct), 1)


def motion_status(charging: Column | str, passengers: Column | str, speed: Column | str) -> Column:
    """charging, then en_route with passengers, then idle below 2 mph, then active."""
    return (
        F.when(col(charging), "charging")
        .when(col(passengers) > 0, "en_route")
        .when(col(speed) < 2, "idle")
        .otherwise("active")
    )
