"""Whole table builds over rosters taken from the supplier table."""

from itertools import accumulate

from pyspark.sql import functions as F

from motorpool import values
from motorpool.bindings import domain
from motorpool.bindings.domain import sql_round, with_cte
from motorpool.bindings.registry import Source, query
from motorpool.bindings.scalars import sql_hash, sql_uniform
from motorpool.plans import fleet

_ZONES = {"North": ["N1", "N2", "N3"], "South": ["S1", "S2"]}


@query(
    "i02_build_vehicles",
    f"""
    WITH roster AS (SELECT 'VEH-' || lpad(s_suppkey::VARCHAR, greatest(3, length(s_suppkey::VARCHAR))::INT, '0') AS vehicle_id,
                           CASE WHEN s_nationkey < 12 THEN 'North' ELSE 'South' END AS city FROM supplier)
    SELECT vehicle_id, city, CASE city WHEN 'North' THEN (['N1', 'N2', 'N3'])[({sql_hash("'cur-zone-' || vehicle_id")} % 3 + 1)::INT]
                                  ELSE (['S1', 'S2'])[({sql_hash("'cur-zone-' || vehicle_id")} % 2 + 1)::INT] END AS current_zone,
           (['active', 'active', 'active', 'idle', 'charging', 'maintenance', 'en_route'])[({sql_hash("'status-' || vehicle_id")} % 7 + 1)::INT] AS status,
           CAST(20 + {sql_hash("'battery-' || vehicle_id")} % 81 AS INT) AS battery_pct,
           CAST({sql_hash("'rides-today-' || vehicle_id")} % 26 AS INT) AS rides_today,
           strftime(TIMESTAMP '2024-01-30 12:00:00' - to_hours({sql_hash("'last-ride-hrs-' || vehicle_id")} % 9)
                    - to_minutes({sql_hash("'last-ride-min-' || vehicle_id")} % 60), '%Y-%m-%d %H:%M:%S') AS last_ride_at,
           strftime(DATE '2024-01-30' - 180 + CAST({sql_hash("'commission-' || vehicle_id")} % 150 AS INT), '%Y-%m-%d') AS commissioned
    FROM roster""",
)
def _(src: Source):
    roster = src.supplier.select(
        F.col("s_suppkey").alias("num"), F.when(F.col("s_nationkey") < 12, "North").otherwise("South").alias("city")
    )
    made = fleet.build_vehicles(roster, _ZONES, "2024-01-30")
    return made.withColumn("commissioned", F.col("commissioned_date").cast("string")).drop("commissioned_date", "model")


_TYPES = ["concert", "hockey", "expo"]


@query(
    "i04_build_venue_events",
    f"""
    WITH rows AS (SELECT s_name AS venue, 'City ' || (s_suppkey % 5) AS city, s_suppkey * 100 AS room, unnest(range(0, (s_suppkey % 9)::BIGINT)) AS i FROM supplier),
    drawn AS (SELECT *, row_number() OVER (ORDER BY venue, i) AS rn, venue || '-' || i AS seed FROM rows),
    typed AS (SELECT *, (['concert', 'hockey', 'expo'])[({sql_hash("'evt-type-' || seed")} % 3 + 1)::INT] AS event_type,
                     1000 + {sql_hash("'evt-att-' || seed")} % (room + 1) AS attendance, {sql_hash("'evt-hour-' || seed")} % 2 AS second,
                     CASE WHEN {sql_hash("'evt-min-' || seed")} % 4 = 3 THEN 30 ELSE 0 END AS m FROM drawn),
    timed AS (SELECT *, CASE event_type WHEN 'concert' THEN 19 + second WHEN 'hockey' THEN 17 + 2 * second ELSE 9 + second END AS h,
                     CASE event_type WHEN 'expo' THEN 8 ELSE 3 END AS hours FROM typed)
    SELECT 'EVT-' || lpad(rn::VARCHAR, greatest(4, length(rn::VARCHAR))::INT, '0') AS event_id, venue, city, event_type,
           'show ' || ({sql_hash("'evt-name-' || seed")} % 4 + 1) AS event_name, CAST(attendance AS INT) AS expected_attendance,
           strftime(DATE '2024-01-30' - 180 + CAST({sql_hash("'evt-date-' || seed")} % 181 AS INT), '%Y-%m-%d') AS day,
           lpad(h::VARCHAR, 2, '0') || ':' || lpad(m::VARCHAR, 2, '0') AS start_time,
           lpad(least(h + hours, 23)::VARCHAR, 2, '0') || ':' || lpad(m::VARCHAR, 2, '0') AS end_time,
           {sql_round("least(4.0::DOUBLE, greatest(1.5::DOUBLE, attendance / 10000.0::DOUBLE))", 2)} AS demand_multiplier
    FROM timed""",
)
def _(src: Source):
    key = F.col("s_suppkey")
    venues = src.supplier.select(
        F.col("s_name").alias("venue"),
        domain.text("City ", key % 5).alias("city"),
        domain.text("Z", "s_nationkey").alias("zone"),
        (key % 9).cast("int").alias("total_events"),
        F.lit(1000).alias("cap_lo"),
        (key * 100 + 1000).cast("int").alias("cap_hi"),
    )

    def listed(index, name, entries):
        pairs = F.array(*[F.struct(F.lit(i).alias(index), F.lit(e).alias(name)) for i, e in enumerate(entries, 1)])
        return src.supplier.select(F.col("s_name").alias("venue"), F.inline(pairs))

    types = listed("type_idx", "event_type", _TYPES)
    names = listed("name_idx", "event_name", [f"show {i}" for i in range(1, 5)])
    made = fleet.build_venue_events(venues, types, names, "2024-01-30")
    return made.withColumn("day", F.col("event_date").cast("string")).drop("event_date", "zone")


# --- whole ride builds -------------------------------------------------------------

_CITIES = [f"City {i}" for i in range(5)]
_FLEET = {c: [f"{c}/V{i}" for i in range(3 + n)] for n, c in enumerate(_CITIES)}
_STOPS = {c: [f"{c}/Z{i}" for i in range(2 + n)] for n, c in enumerate(_CITIES)}
_RATES = {c: (20 + 5 * n, 30 + 5 * n) for n, c in enumerate(_CITIES)}
_CAPS = {c: 45 + 5 * n for n, c in enumerate(_CITIES)}
_AS_OF, _DAYS, _PAID = "2024-01-20", 16, "2024-01-10"


def _case(column: str, mapping: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items()) + " END"


def _index(seed: str, n: str, scaled: bool) -> str:
    """A 0-based pick among ``n``."""
    return f"CAST(trunc({sql_uniform(seed, '0.0::DOUBLE', f'({n}) - 1 + 0.999::DOUBLE')}) AS INT)" if scaled else f"CAST({sql_hash(seed)} % ({n}) AS INT)"


def _weighted(seed: str, options: list, weights: list, scaled: bool, modulus: int | None = None) -> str:
    total = sum(weights)
    if scaled:
        draw, edges, test = f"{sql_hash(seed)}::DOUBLE / 4294967295.0::DOUBLE", [f"{x!r}::DOUBLE" for x in accumulate(w / total for w in weights)], "<="
    else:
        draw, edges, test = f"{sql_hash(seed)} % {modulus or total}", [str(x) for x in accumulate(weights)], "<"
    return "CASE " + " ".join(f"WHEN {draw} {test} {e} THEN {o}" for o, e in zip(options[:-1], edges)) + f" ELSE {options[-1]} END"


def _rides_sql(scaled: bool, cap_after: bool = False) -> str:
    day = "strftime(d, '%Y-%m-%d')"
    varied = f"'day-var-' || {day}" if scaled else f"'day-var-' || city || '-' || {day}"
    raised = "base * greatest(mult, 1.0::DOUBLE)"
    raised = f"trunc({raised})" if scaled and not cap_after else raised
    change = sql_uniform(varied, "0.85::DOUBLE", "1.15::DOUBLE")
    count = f"least(trunc({raised} * {change}), cap)" if cap_after else f"trunc(least(cap, {raised}) * {change})"
    seed = f"ride_id || '-' || {day}" if scaled else f"{day} || '-' || city || '-' || n"
    wait = f"round({sql_uniform("'ride-wait-' || seed", '2.0::DOUBLE', '12.0::DOUBLE')}, 1)"
    if scaled:
        wait = f"CASE WHEN mult > 1 THEN round({sql_uniform("'ride-wait-' || seed", '5.0::DOUBLE', '20.0::DOUBLE')}, 1) ELSE {wait} END"
    hour = _weighted("'ride-hr-' || seed", list(range(24)), values.HOUR_REQUEST_WEIGHTS, scaled, values.HOUR_REQUEST_MODULUS)
    live = _weighted("'ride-st-' || seed", ["'completed'", "'in_progress'", "'cancelled'"], [7, 2, 1], scaled)
    past = _weighted("'ride-st-' || seed", ["'completed'", "'cancelled'"], [95, 5], True) if scaled else f"CASE WHEN {sql_hash("'ride-st-' || seed")} % 20 = 0 THEN 'cancelled' ELSE 'completed' END"
    trip = "miles * speed" if scaled else "round(miles * speed, 1)"
    later = "to_microseconds(CAST(round(({0}) * 60 * 1000000) AS BIGINT))" if scaled else "to_minutes(CAST(trunc({0}) AS BIGINT))"
    names = _case("city", {c: repr(v).replace('"', "'") for c, v in _FLEET.items()})
    stops = _case("city", {c: repr(v).replace('"', "'") for c, v in _STOPS.items()})
    return with_cte(
        "venue_events",
        f"""SELECT ride_id, vehicle_id, city, pickup_zone, strftime(t0, '%Y-%m-%d %H:%M:%S') AS request_time,
               strftime(t0 + {later.format("wait")}, '%Y-%m-%d %H:%M:%S') AS pickup_time,
               strftime(t0 + {later.format(f"wait + {trip}")}, '%Y-%m-%d %H:%M:%S') AS dropoff_time, wait AS wait_time_min, miles AS distance_miles,
               CASE WHEN d >= DATE '{_PAID}' THEN fare ELSE 0.0::DOUBLE END AS fare_usd,
               CASE WHEN d = DATE '{_AS_OF}' {"AND hour(t0) >= 10" if scaled else ""} THEN {live} ELSE {past} END AS ride_status
        FROM (SELECT *, d::TIMESTAMP + to_hours(({hour})::BIGINT) + to_minutes(({_index("'ride-min-' || seed", "60", scaled)})::BIGINT)
                        + to_seconds(({_index("'ride-sec-' || seed", "60", scaled)})::BIGINT) AS t0,
                     ({names})[{_index("'ride-veh-' || seed", f"len({names})", scaled)} + 1] AS vehicle_id,
                     ({stops})[{_index("'ride-pu-' || seed", f"len({stops})", scaled)} + 1] AS pickup_zone,
                     {wait} AS wait, round({sql_uniform("'ride-dist-' || seed", "1.0::DOUBLE", "15.0::DOUBLE")}, 1) AS miles,
                     {sql_uniform("'ride-speed-' || seed", "2.5::DOUBLE", "5.0::DOUBLE")} AS speed,
                     round({sql_uniform("'ride-fare-' || seed", "2.0::DOUBLE", "15.0::DOUBLE")}, 2) AS fare
              FROM (SELECT *, {seed} AS seed FROM (
                SELECT *, 'RD-' || lpad(rn::VARCHAR, greatest(7, length(rn::VARCHAR))::INT, '0') AS ride_id FROM (
                  SELECT *, row_number() OVER (ORDER BY d, city, n) AS rn FROM (
                    SELECT city, d, mult, CAST(unnest(range(1, CAST({count} AS INT) + 1)) AS INT) AS n FROM (
                      SELECT c.city, g.d, coalesce(m.mult, 1.0::DOUBLE) AS mult, {_case("c.city", _CAPS)} AS cap,
                             CASE WHEN dayofweek(g.d) IN (0, 6) THEN {_case("c.city", {k: v[1] for k, v in _RATES.items()})}
                                  ELSE {_case("c.city", {k: v[0] for k, v in _RATES.items()})} END AS base
                      FROM (SELECT 'City ' || r_regionkey AS city FROM region) c
                      CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '{_AS_OF}' - {_DAYS}, DATE '{_AS_OF}', INTERVAL 1 DAY)) AS DATE) AS d) g
                      LEFT JOIN (SELECT event_date, city, max(demand_multiplier) AS mult FROM venue_events GROUP BY 1, 2) m
                        ON m.event_date = g.d AND m.city = c.city))))))""",
    )


def _rides(src: Source, mode: str, cap_after: bool = False):
    made = fleet.build_rides(
        src.region.select(domain.text("City ", "r_regionkey").alias("city")),
        domain.venue_events(src), _FLEET, _STOPS, _AS_OF, _DAYS, _RATES, _CAPS, _PAID, mode, cap_after,
    )
    return made.drop("dropoff_zone")


@query("i07_build_rides", _rides_sql(False))
def _(src: Source):
    return _rides(src, "modulo")


@query("i07_build_rides_scaled", _rides_sql(True))
def _(src: Source):
    return _rides(src, "scaled")


@query("i07_build_rides_cap_after", _rides_sql(False, True))
def _(src: Source):
    return _rides(src, "modulo", True)


@query(
    "i02_build_vehicles_scaled",
    f"""
    WITH roster AS (SELECT 'VEH-' || lpad(s_suppkey::VARCHAR, greatest(3, length(s_suppkey::VARCHAR))::INT, '0') AS vehicle_id,
                           CASE WHEN s_nationkey < 12 THEN 'North' ELSE 'South' END AS city FROM supplier)
    SELECT vehicle_id, city, CASE city WHEN 'North' THEN (['N1', 'N2', 'N3'])[{_index("'cur-zone-' || vehicle_id", "3", True)} + 1]
                                  ELSE (['S1', 'S2'])[{_index("'cur-zone-' || vehicle_id", "2", True)} + 1] END AS current_zone,
           {_weighted("'status-' || vehicle_id", [f"'{p}'" for p in values.VEHICLE_STATUS_PICKS], values.VEHICLE_STATUS_WEIGHTS, True)} AS status,
           CAST(20 + {_index("'battery-' || vehicle_id", "81", True)} AS INT) AS battery_pct,
           strftime(DATE '2024-01-30' - 180 + {_index("'commission-' || vehicle_id", "151", True)}, '%Y-%m-%d') AS commissioned
    FROM roster""",
)
def _(src: Source):
    roster = src.supplier.select(
        F.col("s_suppkey").alias("num"), F.when(F.col("s_nationkey") < 12, "North").otherwise("South").alias("city")
    )
    made = fleet.build_vehicles(roster, _ZONES, "2024-01-30", mode="scaled")
    return made.select("vehicle_id", "city", "current_zone", "status", "battery_pct", F.col("commissioned_date").cast("string").alias("commissioned"))
