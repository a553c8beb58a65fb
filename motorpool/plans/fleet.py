"""Zones, vehicles, venue events and rides, built by hashing text seeds.

Build order: zones, vehicles, venue events, then rides and forecasts. Every build takes
``as_of`` in place of the current date, so a rerun gives the same rows.

The builds come in two versions that differ by more than the sampler: ``modulo`` and
``scaled``. The scaled one numbers by roster position, seeds rides and forecasts with their
ids, truncates a day's volume before its variation, waits longer on event days, keeps
fractions of a minute, and has live statuses from 10 o'clock on.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motorpool import schemas, values
from motorpool.functions.hashing import (
    hash32,
    hash_choice,
    hash_date,
    hash_int,
    hash_uniform,
    hash_weighted,
    seeded,
)
from motorpool.functions.scalars import (
    case_map,
    clamp,
    clock_text,
    col,
    day,
    is_weekend,
    parse_time,
    plus_minutes,
    text_time,
    whole,
)
from motorpool.operators.aggregates import group_max
from motorpool.operators.joins import grid, left_default, pick_from_list
from motorpool.operators.ordering import padded_id
from motorpool.session import materialise
from motorpool.sources.tables import inline_table


# --- row expansion ---------------------------------------------------------------


def expand_by_count(df: DataFrame, n: Column | str, index: str = "idx", piece: int = 100_000) -> DataFrame:
    """One row per unit, indexed from 1; a count of 0 or less gives no row.

    A count is first cut into pieces and the pieces are dealt by their hash to the session's
    shuffle partitions, so one very large count neither builds one long array nor keeps one
    task busy, and the number of tasks follows the session, not the machine that plans.
    """
    n = col(n)
    pieces = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / piece).cast("int")))
    cut = df.withColumn("__piece", F.explode(pieces))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # With the number given, small inputs that grow are not put together again.
    spread = cut.repartition(tasks, F.xxhash64(*[c for c in df.columns if isinstance(df.schema[c].dataType, T.AtomicType)], "__piece"))
    first = F.col("__piece") * F.lit(piece) + 1
    units = F.sequence(first, F.least(n, first + (piece - 1)).cast("int"))
    return spread.withColumn(index, F.explode(units)).drop("__piece")


def numbered_expand(df: DataFrame, n: str, major: str, minor: Sequence[str], index: str = "idx", number: str = "rn") -> DataFrame:
    """Expand by count with consecutive numbers in the order (major, minor, index).

    The numbers come from running totals of the counts, so the expanded rows are never sorted.
    The counts themselves are ranged by their order and written to the shared folder; totals
    run inside each range, and only one total per range meets in one task.
    """
    ranged = df.repartitionByRange(major, *minor).sortWithinPartitions(major, *minor)
    laid_out = materialise(ranged.withColumn("__at", F.monotonically_increasing_id()), "counts")
    placed = laid_out.withColumn("__part", F.shiftrightunsigned("__at", 33))
    units = F.greatest(F.col(n), F.lit(0))
    before_part = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy("__part").agg(F.sum(units).alias("__total"))
    starts = totals.select("__part", F.coalesce(F.sum("__total").over(before_part), F.lit(0)).alias("__start"))
    inside = W.partitionBy("__part").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(units).over(inside), F.lit(0))
    numbered = placed.withColumn("__offset", offset).join(F.broadcast(starts), "__part").drop("__at", "__part")
    return (
        expand_by_count(numbered, n, index)
        .withColumn(number, F.col("__start") + F.col("__offset") + F.col(index))
        .drop("__start", "__offset")
    )


# --- zones and vehicles ----------------------------------------------------------


def build_zones(spark: SparkSession, rows: Sequence[tuple] = tuple(values.ZONES)) -> DataFrame:
    return inline_table(spark, list(rows), schemas.FLEET_TABLES["zones"])


def zone_lists(rows: Sequence[tuple] = tuple(values.ZONES)) -> dict[str, list[str]]:
    """City -> its zone ids in roster order."""
    lists: dict[str, list[str]] = {}
    for zone_id, _, city, *_ in rows:
        lists.setdefault(city, []).append(zone_id)
    return lists


def city_choice(city: Column | str, seed: Column, lists: Mapping[str, Sequence], mode: str = "modulo") -> Column:
    """A hashed pick from the list that belongs to the row's city."""
    chosen = F
    for name, options in lists.items():
        chosen = chosen.when(col(city) == name, hash_choice(seed, options, mode))
    return chosen.otherwise(F.lit(None))


def build_vehicles(
    fleet: DataFrame,
    zones: Mapping[str, Sequence[str]],
    as_of,
    prefix: str = "VEH-",
    model: str = "Robotaxi",
    mode: str = "modulo",
) -> DataFrame:
    """Vehicles from (num, city): zone, status, battery, rides and dates by hash."""
    vid = F.col("vehicle_id")
    named = fleet.withColumn("vehicle_id", padded_id(prefix, F.col("num"), 3))
    noon = day(as_of).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(12))
    ago = F.make_dt_interval(
        F.lit(0),
        hash_int(seeded("last-ride-hrs-", vid), 0, 8, mode),
        hash_int(seeded("last-ride-min-", vid), 0, 59, mode),
    )
    first_day = F.date_sub(day(as_of), 180)
    picks, weights = values.VEHICLE_STATUS_PICKS, values.VEHICLE_STATUS_WEIGHTS
    if mode == "modulo":
        status, last_offset = hash_choice(seeded("status-", vid), picks), 149
    else:
        status, last_offset = hash_weighted(seeded("status-", vid), picks, weights, mode), 150
    return named.select(
        "vehicle_id",
        F.lit(model).alias("model"),
        "city",
        city_choice("city", seeded("cur-zone-", vid), zones, mode).alias("current_zone"),
        status.alias("status"),
        hash_int(seeded("battery-", vid), 20, 100, mode).alias("battery_pct"),
        hash_int(seeded("rides-today-", vid), 0, 25, mode).alias("rides_today"),
        text_time(noon - ago).alias("last_ride_at"),
        F.date_add(first_day, hash_int(seeded("commission-", vid), 0, last_offset, mode)).alias("commissioned_date"),
    )


# --- venue events ----------------------------------------------------------------


def demand_multiplier(attendance: Column | str) -> Column:
    return F.round(clamp(col(attendance) / F.lit(10000.0), 1.5, 4.0), 2)


def start_hour(event_type: Column | str, seed: Column, mode: str = "modulo") -> Column:
    """Start hour from the type's list, the default hour for an unknown type."""
    hour = F
    for kind, hours in values.START_HOURS.items():
        hour = hour.when(col(event_type) == kind, hash_choice(seed, hours, mode))
    return hour.otherwise(F.lit(values.DEFAULT_START_HOUR))


def venue_event_features(df: DataFrame, event_type: str, attendance: str, start: str, minute: str) -> DataFrame:
    """Length by type, end hour kept within the day, clock texts and the demand multiplier."""
    length = case_map(event_type, values.DURATIONS, values.DEFAULT_DURATION)
    return df.withColumns(
        {
            "start_time": clock_text(F.col(start), F.col(minute)),
            "end_time": clock_text(F.least(F.col(start) + length, F.lit(23)), F.col(minute)),
            "demand_multiplier": demand_multiplier(attendance),
        }
    )


def build_venue_events(
    venues: DataFrame,
    types: DataFrame,
    names: DataFrame,
    as_of,
    days: int = 180,
    mode: str = "modulo",
    order: str = "venue",
) -> DataFrame:
    """Events per venue, numbered in the ``order`` of a venue column.

    ``venues``: venue, city, zone, total_events, cap_lo, cap_hi. ``types`` and ``names``:
    venue, a 1-based index (type_idx, name_idx), and event_type or event_name.
    """
    counted = (
        venues.join(group_max(types, ["venue"], "type_idx", "type_count"), "venue")
        .join(group_max(names, ["venue"], "name_idx", "name_count"), "venue")
    )
    rows = numbered_expand(counted, "total_events", order, ["venue"], "nth", "rn")
    seed = F.concat_ws("-", F.col("venue"), (F.col("nth") - 1).cast("string"))

    def part(kind: str) -> Column:
        return F.concat(F.lit(kind), seed)

    hashed = rows.withColumns(
        {
            "event_date": hash_date(part("evt-date-"), F.date_sub(day(as_of), days), day(as_of), mode),
            "type_idx": hash_int(part("evt-type-"), F.lit(0), F.col("type_count") - 1, mode) + 1,
            "name_idx": hash_int(part("evt-name-"), F.lit(0), F.col("name_count") - 1, mode) + 1,
            "expected_attendance": hash_int(part("evt-att-"), F.col("cap_lo"), F.col("cap_hi"), mode),
            "minute": hash_choice(part("evt-min-"), [0, 0, 0, 30], mode),
            "__seed": part("evt-hour-"),
        }
    )
    typed = pick_from_list(hashed, types, ["venue", "type_idx"])
    resolved = typed.join(names, ["venue", "name_idx"], "left")
    timed = resolved.withColumn("start", start_hour("event_type", F.col("__seed"), mode))
    full = venue_event_features(timed, "event_type", "expected_attendance", "start", "minute")
    return full.withColumn("event_id", padded_id("EVT-", F.col("rn"), 4)).select(
        *schemas.FLEET_TABLES["venue_events"].names
    )


# --- rides -----------------------------------------------------------------------


def base_rate(city: Column | str, date: Column | str, rates: Mapping[str, tuple[int, int]]) -> Column:
    """Rides per day of a city, (weekday, weekend)."""
    rate = F
    for name, (weekday, weekend) in rates.items():
        rate = rate.when(col(city) == name, F.when(is_weekend(date), weekend).otherwise(weekday))
    return rate.otherwise(F.lit(None).cast("int"))


def daily_volume(
    base: Column | str,
    multiplier: Column | str,
    cap: Column | str,
    seed: Column,
    cap_after: bool = False,
    mode: str = "modulo",
) -> Column:
    """Rides of one day: base times the event multiplier, capped, varied by 15 %, truncated.

    The cap comes before the variation, so a day may exceed it; ``cap_after`` applies it last.
    The scaled build truncates before the cap as well.
    """
    raised = col(base) * F.greatest(col(multiplier), F.lit(1.0))
    if mode == "scaled" and not cap_after:
        raised = whole(raised)
    variation = hash_uniform(seed, 0.85, 1.15)
    if cap_after:
        return F.least(whole(raised * variation), col(cap))
    return whole(F.least(col(cap), raised) * variation)


def request_time(date: Column | str, seed: Column, mode: str = "modulo") -> Column:
    """A moment of the day, weighted to the evening. The modulus is two more than the weights add
    up to; that those two draws take hour 23 is our choice."""
    hour = hash_weighted(
        F.concat(F.lit("ride-hr-"), seed),
        list(range(24)),
        values.HOUR_REQUEST_WEIGHTS,
        mode,
        values.HOUR_REQUEST_MODULUS,
    )
    minute = hash_int(F.concat(F.lit("ride-min-"), seed), 0, 59, mode)
    second = hash_int(F.concat(F.lit("ride-sec-"), seed), 0, 59, mode)
    return col(date).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour, minute, second.cast("decimal(18,6)"))


def wait_minutes(seed: Column, event_day: Column | None = None) -> Column:
    """2 to 12 minutes; 5 to 20 on event days when a flag for them is given."""
    seed = F.concat(F.lit("ride-wait-"), seed)
    usual = F.round(hash_uniform(seed, 2.0, 12.0), 1)
    if event_day is None:
        return usual
    return F.when(event_day, F.round(hash_uniform(seed, 5.0, 20.0), 1)).otherwise(usual)


def fare_by_regime(date: Column | str, seed: Column, paid_from) -> Column:
    """Free before the switch date, 2 to 15 from it on."""
    fare = F.round(hash_uniform(F.concat(F.lit("ride-fare-"), seed), 2.0, 15.0), 2)
    return F.when(col(date) >= day(paid_from), fare).otherwise(F.lit(0.0))


def ride_status(date: Column | str, seed: Column, as_of, hour: Column | None = None, mode: str = "modulo") -> Column:
    """95 % completed and 5 % cancelled; today 70 % completed, 20 % in progress, 10 % cancelled.

    With ``hour`` the rule for today starts at 10 o'clock.
    """
    seed = F.concat(F.lit("ride-st-"), seed)
    today = col(date) == day(as_of)
    if hour is not None:
        today = today & (hour >= 10)
    live = hash_weighted(seed, ["completed", "in_progress", "cancelled"], [7, 2, 1], mode)
    if mode == "modulo":
        past = F.when(hash32(seed) % 20 == 0, "cancelled").otherwise("completed")
    else:
        past = hash_weighted(seed, ["completed", "cancelled"], [95, 5], mode)
    return F.when(today, live).otherwise(past)


def trip_times(df: DataFrame, request: str, wait: str, distance: str, speed: str, exact: bool = False) -> DataFrame:
    """Pickup and drop-off from wait, distance and minutes per mile.

    Whole minutes are added, the fraction cut; ``exact`` adds the fraction too.
    """
    trip = col(distance) * col(speed)
    if exact:
        def later(minutes):
            return col(request) + F.make_dt_interval(secs=(minutes * 60).cast("decimal(18,6)"))

        return df.withColumns({"pickup_ts": later(col(wait)), "dropoff_ts": later(col(wait) + trip)})
    return df.withColumn("trip_minutes", F.round(trip, 1)).withColumns(
        {
            "pickup_ts": plus_minutes(request, col(wait)),
            "dropoff_ts": plus_minutes(request, col(wait) + F.col("trip_minutes")),
        }
    )


def build_rides(
    cities: DataFrame,
    events: DataFrame,
    vehicles: Mapping[str, Sequence[str]],
    zones: Mapping[str, Sequence[str]],
    as_of,
    days: int = 180,
    rates: Mapping[str, tuple[int, int]] = values.CITY_BASE_RIDES,
    caps: Mapping[str, int] = values.CITY_RIDE_CAP,
    paid_from=values.PAID_FROM,
    mode: str = "modulo",
    cap_after: bool = False,
) -> DataFrame:
    """Rides per day and city; ``cities`` has one column, city. ``cap_after`` caps a day's rides
    after their variation, so that no day has more than the cap."""
    boost = group_max(events, ["event_date", "city"], "demand_multiplier", "event_mult").withColumnRenamed(
        "event_date", "ride_date"
    )
    span = F.sequence(F.date_sub(day(as_of), days), day(as_of))
    days_of = left_default(grid(cities, ride_date=span), boost, ["ride_date", "city"], "event_mult", 1.0)
    scaled = mode == "scaled"
    variation = seeded("day-var-", case_map("city", values.CITY_CODES) if scaled else "city", "ride_date")
    sized = days_of.withColumn("base", base_rate("city", "ride_date", rates)).withColumn(
        "ride_count", daily_volume("base", "event_mult", case_map("city", caps), variation, cap_after, mode)
    )
    rides = numbered_expand(sized, "ride_count", "ride_date", ["city"], "ride_num", "rn").withColumn(
        "ride_id", padded_id("RD-", F.col("rn"), 7)
    )
    own = ["ride_id", "ride_date"] if scaled else ["ride_date", "city", "ride_num"]
    rides = rides.withColumn("seed", F.concat_ws("-", *[F.col(c).cast("string") for c in own]))
    seed = F.col("seed")

    def part(kind: str) -> Column:
        return F.concat(F.lit(kind), seed)

    drawn = rides.withColumns(
        {
            "vehicle_id": city_choice("city", part("ride-veh-"), vehicles, mode),
            "pickup_zone": city_choice("city", part("ride-pu-"), zones, mode),
            "dropoff_zone": city_choice("city", part("ride-do-"), zones, mode),
            "request_ts": request_time("ride_date", seed, mode),
            "wait_time_min": wait_minutes(seed, F.col("event_mult") > 1.0 if scaled else None),
            "distance_miles": F.round(hash_uniform(part("ride-dist-"), 1.0, 15.0), 1),
            "speed": hash_uniform(part("ride-speed-"), 2.5, 5.0),
            "fare_usd": fare_by_regime("ride_date", seed, paid_from),
        }
    )
    hour = F.hour("request_ts") if scaled else None
    timed = trip_times(drawn, "request_ts", "wait_time_min", "distance_miles", "speed", exact=scaled)
    return timed.withColumns(
        {
            "ride_status": ride_status("ride_date", seed, as_of, hour, mode),
            "request_time": text_time("request_ts"),
            "pickup_time": text_time("pickup_ts"),
            "dropoff_time": text_time("dropoff_ts"),
        }
    ).select(*schemas.FLEET_TABLES["rides"].names)


def with_ride_times(rides: DataFrame) -> DataFrame:
    """Typed twins of the text times: request_ts, pickup_ts, dropoff_ts."""
    return rides.withColumns(
        {f"{step}_ts": parse_time(f"{step}_time") for step in ("request", "pickup", "dropoff")}
    )
