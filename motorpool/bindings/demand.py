"""Deterministic sampling, table builds, forecasts and rebalancing."""

from itertools import accumulate

from pyspark.sql import functions as F

from motorpool import values
from motorpool.bindings import domain
from motorpool.bindings.domain import sql_round, with_cte
from motorpool.bindings.registry import Source, query
from motorpool.bindings.scalars import sql_hash, sql_uniform
from motorpool.functions import hashing as H
from motorpool.functions.scalars import text_time
from motorpool.operators.joins import grid, left_default
from motorpool.plans import callable as sql_functions
from motorpool.plans import fleet, forecasts, rebalance, regression


@query(
    "i01_hash_uniform",
    f"SELECT o_orderkey, {sql_uniform(chr(39) + 'ride-wait-' + chr(39) + ' || o_orderkey', '2.0::DOUBLE', '12.0::DOUBLE')} AS wait FROM orders",
)
def _(src: Source):
    return src.orders.select("o_orderkey", H.hash_uniform(H.seeded("ride-wait-", "o_orderkey"), 2.0, 12.0).alias("wait"))


@query(
    "i02_hash_picks",
    f"""
    SELECT c_custkey, CAST(20 + {sql_hash("'b-' || c_name")} % 81 AS INT) AS modulo_pick,
           CAST(trunc({sql_uniform("'b-' || c_name", "20.0::DOUBLE", "100.999::DOUBLE")}) AS INT) AS scaled_pick,
           (['a', 'b', 'c'])[CAST(trunc({sql_uniform("'c-' || c_name", "0.0::DOUBLE", "2.999::DOUBLE")}) AS INT) + 1] AS choice,
           strftime(DATE '2001-02-02' + CAST({sql_hash("'d-' || c_name")} % 181 AS INT), '%Y-%m-%d') AS on_day
    FROM customer""",
)
def _(src: Source):
    first = F.lit("2001-02-02").cast("date")
    return src.customer.select(
        "c_custkey",
        H.hash_int(H.seeded("b-", "c_name"), 20, 100).alias("modulo_pick"),
        H.hash_int(H.seeded("b-", "c_name"), 20.0, 100.0, "scaled").alias("scaled_pick"),
        H.hash_choice(H.seeded("c-", "c_name"), ["a", "b", "c"], "scaled").alias("choice"),
        H.hash_date(H.seeded("d-", "c_name"), first, F.date_add(first, 180)).cast("string").alias("on_day"),
    )


_TOTALS = list(accumulate(values.HOUR_REQUEST_WEIGHTS))
_HOUR_SQL = "CASE " + " ".join(f"WHEN p < {t} THEN {h}" for h, t in enumerate(_TOTALS)) + " END"


@query(
    "i03_hash_weighted",
    f"""
    SELECT o_orderkey, CAST({_HOUR_SQL} AS INT) AS hour, CASE WHEN f <= 0.7 THEN 'completed' WHEN f <= 0.9 THEN 'in_progress' ELSE 'cancelled' END AS status
    FROM (SELECT o_orderkey, {sql_hash("'ride-hr-' || o_orderkey")} % {_TOTALS[-1]} AS p,
                 {sql_uniform("'ride-st-' || o_orderkey", "0.0::DOUBLE", "1.0::DOUBLE")} AS f FROM orders)""",
)
def _(src: Source):
    return src.orders.select(
        "o_orderkey",
        H.hash_weighted(H.seeded("ride-hr-", "o_orderkey"), list(range(24)), values.HOUR_REQUEST_WEIGHTS).alias("hour"),
        H.hash_weighted(
            H.seeded("ride-st-", "o_orderkey"), ["completed", "in_progress", "cancelled"], [70, 20, 10], "scaled"
        ).alias("status"),
    )


@query(
    "i04_venue_event_features",
    f"""
    SELECT event_id, lpad(h::VARCHAR, 2, '0') || ':' || lpad(m::VARCHAR, 2, '0') AS start_time,
           lpad(least(h + 3, 23)::VARCHAR, 2, '0') || ':' || lpad(m::VARCHAR, 2, '0') AS end_time,
           {sql_round("least(4.0::DOUBLE, greatest(1.5::DOUBLE, attendance / 10000.0::DOUBLE))", 2)} AS demand_multiplier
    FROM (SELECT event_id, event_type, hour(ts) AS h, minute(ts) AS m, floor(value * 200) AS attendance FROM events)""",
)
def _(src: Source):
    timed = src.events.select(
        "event_id",
        "event_type",
        F.hour("ts").alias("h"),
        F.minute("ts").alias("m"),
        F.floor(F.col("value") * 200).alias("attendance"),
    )
    return fleet.venue_event_features(timed, "event_type", "attendance", "h", "m").select(
        "event_id", "start_time", "end_time", "demand_multiplier"
    )


# Rides per day and nation: base from the zone table, boosted on days with large events.
_VOLUME = f"""
    SELECT zone_id, d, CAST(trunc(least(300.0::DOUBLE, base * greatest(mult, 1.0::DOUBLE)) *
           {sql_uniform("'day-var-' || zone_id || '-' || strftime(d, '%Y-%m-%d')", "0.85::DOUBLE", "1.15::DOUBLE")}) AS INT) AS ride_count
    FROM (SELECT z.zone_id, c.d, z.base_demand_per_hour AS base, coalesce(m.mult, 1.0::DOUBLE) AS mult
          FROM zones z CROSS JOIN (SELECT DISTINCT event_date AS d FROM venue_events) c
          LEFT JOIN (SELECT event_date, zone, max(demand_multiplier) AS mult FROM venue_events GROUP BY 1, 2) m
            ON m.event_date = c.d AND m.zone = z.zone_id)"""


def _volumes(src: Source):
    first = F.lit("2024-01-01").cast("date")
    events = domain.venue_events(src)
    days = grid(domain.zones(src).select("zone_id", "base_demand_per_hour"), d=F.sequence(first, F.date_add(first, 29)))
    boost = forecasts.event_multipliers(events).withColumnRenamed("forecast_date", "d")
    return left_default(days, boost, ["d", "zone_id"], "event_mult", 1.0).withColumn(
        "ride_count",
        fleet.daily_volume(
            "base_demand_per_hour", "event_mult", F.lit(300.0), H.seeded("day-var-", "zone_id", "d")
        ),
    )


@query(
    "i05_daily_volume",
    with_cte("zones venue_events", f"SELECT zone_id, strftime(d, '%Y-%m-%d') AS day, ride_count FROM ({_VOLUME})"),
)
def _(src: Source):
    return _volumes(src).select("zone_id", F.col("d").cast("string").alias("day"), "ride_count")


@query(
    "i06_expand_by_count",
    with_cte(
        "zones venue_events",
        f"""SELECT row_number() OVER (ORDER BY d, zone_id, n) AS rn, zone_id, strftime(d, '%Y-%m-%d') AS day, n AS idx
            FROM (SELECT zone_id, d, CAST(unnest(range(1, ride_count + 1)) AS INT) AS n FROM ({_VOLUME}))""",
    ),
)
def _(src: Source):
    return fleet.numbered_expand(_volumes(src), "ride_count", "d", ["zone_id"]).select(
        "rn", "zone_id", F.col("d").cast("string").alias("day"), "idx"
    )


_TRIPS = f"""
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderdate AS t0,
           round({sql_uniform("'ride-wait-' || o_orderkey", "2.0::DOUBLE", "12.0::DOUBLE")}, 1) AS wait,
           round({sql_uniform("'ride-dist-' || o_orderkey", "1.0::DOUBLE", "15.0::DOUBLE")}, 1) AS miles,
           {sql_uniform("'ride-speed-' || o_orderkey", "2.5::DOUBLE", "5.0::DOUBLE")} AS speed,
           round({sql_uniform("'ride-fare-' || o_orderkey", "2.0::DOUBLE", "15.0::DOUBLE")}, 2) AS fare,
           {sql_hash("'ride-st-' || o_orderkey")} AS sh FROM orders"""


@query(
    "i07_trip_times",
    f"""
    SELECT o_orderkey, wait, strftime(t0 + to_minutes(trunc(wait)::BIGINT), '%Y-%m-%d %H:%M:%S') AS pickup_time,
           strftime(t0 + to_minutes(trunc(wait + round(miles * speed, 1))::BIGINT), '%Y-%m-%d %H:%M:%S') AS dropoff_time,
           CASE WHEN d >= DATE '1998-01-01' THEN fare ELSE 0.0::DOUBLE END AS fare_usd
    FROM ({_TRIPS})""",
)
def _(src: Source):
    seed = F.col("o_orderkey").cast("string")
    drawn = src.orders.withColumns(
        {
            "wait": fleet.wait_minutes(seed),
            "miles": F.round(H.hash_uniform(H.seeded("ride-dist-", seed), 1.0, 15.0), 1),
            "speed": H.hash_uniform(H.seeded("ride-speed-", seed), 2.5, 5.0),
            "fare_usd": fleet.fare_by_regime(F.col("o_orderdate").cast("date"), seed, "1998-01-01"),
        }
    )
    timed = fleet.trip_times(drawn, "o_orderdate", "wait", "miles", "speed")
    return timed.select(
        "o_orderkey",
        "wait",
        text_time("pickup_ts").alias("pickup_time"),
        text_time("dropoff_ts").alias("dropoff_time"),
        "fare_usd",
    )


@query(
    "i08_ride_status",
    f"""
    SELECT o_orderkey, CASE WHEN d = DATE '2001-08-01' THEN CASE WHEN sh % 10 < 7 THEN 'completed' WHEN sh % 10 < 9 THEN 'in_progress' ELSE 'cancelled' END
                            WHEN sh % 20 = 0 THEN 'cancelled' ELSE 'completed' END AS ride_status
    FROM ({_TRIPS})""",
)
def _(src: Source):
    seed = F.col("o_orderkey").cast("string")
    status = fleet.ride_status(F.col("o_orderdate").cast("date"), seed, domain.ORDERS_AS_OF)
    return src.orders.select("o_orderkey", status.alias("ride_status"))


_CURVE = ", ".join(f"({h}, {w}::DOUBLE)" for h, w in enumerate(values.HOUR_DEMAND))
_GRID = f"""
    SELECT z.zone_id, z.city, z.base_demand_per_hour AS base, z.vehicle_capacity AS cap, g.d, g.h, w.weight,
           coalesce(m.mult, 1.0::DOUBLE) AS mult, g.d < DATE '2024-01-23' AS past,
           strftime(g.d, '%Y-%m-%d') || '-' || z.zone_id || '-' || g.h AS seed
    FROM zones z CROSS JOIN
      (SELECT d, h FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-23' - 30, DATE '2024-01-23' + 7, INTERVAL 1 DAY)) AS DATE) AS d) days
       CROSS JOIN (SELECT unnest(range(0, 24)) AS h) hours WHERE d >= DATE '2024-01-23' OR h % 3 = 0) g
    JOIN (VALUES {_CURVE}) AS w(h, weight) ON w.h = g.h
    LEFT JOIN (SELECT event_date, zone, max(demand_multiplier) AS mult FROM venue_events GROUP BY 1, 2) m
      ON m.event_date = g.d AND m.zone = z.zone_id"""
_PREDICTED = f"""
    SELECT *, greatest(1, CAST(trunc(base * weight * greatest(mult, 1.0::DOUBLE) * {sql_uniform("'fc-demand-' || seed", "0.8::DOUBLE", "1.2::DOUBLE")}) AS INT)) AS demand,
           greatest(1, CAST(trunc(cap * {sql_uniform("'fc-supply-' || seed", "0.5::DOUBLE", "1.0::DOUBLE")}) AS INT)) AS supply,
           0.95::DOUBLE - date_diff('day', DATE '2024-01-23', d) * 0.02::DOUBLE AS centre
    FROM ({_GRID})"""
GRID_DAY = "2024-01-23"


def _grid(src: Source):
    return forecasts.forecast_grid(
        domain.zones(src), forecasts.event_multipliers(domain.venue_events(src)), GRID_DAY
    )


@query(
    "i09_forecast_grid",
    with_cte(
        "zones venue_events",
        f"""SELECT row_number() OVER (ORDER BY d, zone_id, h) AS rn, zone_id, strftime(d, '%Y-%m-%d') AS day,
                   CAST(h AS INT) AS hour, mult AS event_mult, weight AS hour_weight FROM ({_GRID})""",
    ),
)
def _(src: Source):
    return _grid(src).select(
        "rn", "zone_id", F.col("forecast_date").cast("string").alias("day"), "hour", "event_mult", "hour_weight"
    )


@query(
    "i10_predict_demand_supply",
    with_cte(
        "zones venue_events",
        f"SELECT seed, demand AS predicted_demand, supply AS predicted_supply FROM ({_PREDICTED})",
    ),
)
def _(src: Source):
    return forecasts.predict_demand_supply(_grid(src)).select("seed", "predicted_demand", "predicted_supply")


@query(
    "i11_demand_score",
    f"""
    SELECT event_id, {sql_round("least(1.0::DOUBLE, CASE WHEN user_id % 3 = 0 THEN share * 1.3::DOUBLE ELSE share END)", 2)} AS demand_score,
           {sql_round("least(1.0::DOUBLE, CASE WHEN user_id % 3 = 0 THEN plain * 1.3::DOUBLE ELSE plain END)", 2)} AS twice_rounded
    FROM (SELECT event_id, user_id, share, {sql_round("least(1.0::DOUBLE, share)", 2)} AS plain
          FROM (SELECT event_id, user_id, value / ((20 + user_id % 30) * 1.5::DOUBLE) AS share FROM events))""",
)
def _(src: Source):
    base = F.col("user_id") % 30 + 20
    mult = F.when(F.col("user_id") % 3 == 0, 2.0).otherwise(1.0)
    return src.events.select(
        "event_id",
        forecasts.demand_score("value", base, mult).alias("demand_score"),
        forecasts.demand_score("value", base, mult, round_first=True).alias("twice_rounded"),
    )


@query(
    "i12_confidence",
    f"""
    SELECT event_id, round(CASE WHEN ahead < 0 THEN {sql_uniform("'fc-conf-' || event_id", "0.70::DOUBLE", "0.98::DOUBLE")}
           ELSE {sql_uniform("'fc-conf-' || event_id", "greatest(0.70::DOUBLE, centre - 0.10::DOUBLE)", "least(0.98::DOUBLE, centre + 0.03::DOUBLE)")} END, 2) AS confidence
    FROM (SELECT event_id, date_diff('day', DATE '2024-01-16', CAST(ts AS DATE)) AS ahead,
                 0.95::DOUBLE - date_diff('day', DATE '2024-01-16', CAST(ts AS DATE)) * 0.02::DOUBLE AS centre FROM events)""",
)
def _(src: Source):
    seed = H.seeded("fc-conf-", "event_id")
    score = forecasts.confidence(seed, F.col("ts").cast("date"), domain.EVENTS_MIDDLE)
    return src.events.select("event_id", score.alias("confidence"))


@query(
    "i12_build_forecasts",
    with_cte(
        "zones venue_events",
        f"""SELECT 'FC-' || lpad(row_number() OVER (ORDER BY d, zone_id, h)::VARCHAR, 6, '0') AS forecast_id, zone_id, city,
                   strftime(d, '%Y-%m-%d') AS day, CAST(h AS INT) AS hour, demand AS predicted_demand, supply AS predicted_supply,
                   {sql_round("least(1.0::DOUBLE, CASE WHEN mult > 1.0 THEN demand::DOUBLE / (base * 1.5::DOUBLE) * 1.3::DOUBLE ELSE demand::DOUBLE / (base * 1.5::DOUBLE) END)", 2)} AS demand_score,
                   round(CASE WHEN past THEN {sql_uniform("'fc-conf-' || seed", "0.70::DOUBLE", "0.98::DOUBLE")}
                         ELSE {sql_uniform("'fc-conf-' || seed", "greatest(0.70::DOUBLE, centre - 0.10::DOUBLE)", "least(0.98::DOUBLE, centre + 0.03::DOUBLE)")} END, 2) AS confidence
            FROM ({_PREDICTED})""",
    ),
)
def _(src: Source):
    made = forecasts.build_forecasts(domain.zones(src), domain.venue_events(src), GRID_DAY)
    return made.withColumn("day", F.col("forecast_date").cast("string")).drop("forecast_date", "model_version")


# Rides at the hour of the events table, by the zone of the user.
_DEMAND = """
    SELECT z.zone_id, z.city, g.d, g.h, coalesce(r.n, 0) * 1.0::DOUBLE / k.same_days * greatest(coalesce(m.mult, 1.0::DOUBLE), 1.0::DOUBLE) AS expected,
           coalesce(m.mult, 1.0::DOUBLE) AS mult, z.base_demand_per_hour AS base
    FROM zones z CROSS JOIN
      (SELECT d, h, dayofweek(d) AS dow FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-23', DATE '2024-01-26', INTERVAL 1 DAY)) AS DATE) AS d) days
       CROSS JOIN (SELECT unnest(range(0, 24)) AS h) hours) g
    JOIN (SELECT dayofweek(c) AS dow, count(*) AS same_days
          FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-23' - 21, DATE '2024-01-23' - 1, INTERVAL 1 DAY)) AS DATE) AS c) GROUP BY 1) k ON k.dow = g.dow
    LEFT JOIN (SELECT 'Z' || (user_id % 25) AS zone, dayofweek(ts) AS dow, hour(ts) AS h, count(*) AS n FROM events
               WHERE ts >= DATE '2024-01-23' - 21 AND ts < DATE '2024-01-23' GROUP BY 1, 2, 3) r
      ON r.zone = z.zone_id AND r.dow = g.dow AND r.h = g.h
    LEFT JOIN (SELECT event_date, zone, max(demand_multiplier) AS mult FROM venue_events GROUP BY 1, 2) m
      ON m.event_date = g.d AND m.zone = z.zone_id"""


def _history(src: Source):
    return src.events.select(domain.text("Z", F.col("user_id") % 25).alias("pickup_zone"), F.col("ts").alias("request_ts"))


def _demand(src: Source):
    rides = _history(src)
    return forecasts.predict_demand(domain.zones(src), rides, domain.venue_events(src), GRID_DAY, 21, 3)


@query(
    "i15_predict_demand",
    with_cte(
        "zones venue_events",
        f"""SELECT zone_id, city, strftime(d, '%Y-%m-%d') AS day, CAST(h AS INT) AS hour, round(expected, 4) AS expected_rides,
                   {sql_round("least(1.0::DOUBLE, CASE WHEN mult > 1.0 THEN expected / (base * 1.5::DOUBLE) * 1.3::DOUBLE ELSE expected / (base * 1.5::DOUBLE) END)", 2)} AS demand_score,
                   CAST(ceil(round(expected / 2.0::DOUBLE, 6)) AS INT) AS vehicle_count
            FROM ({_DEMAND})""",
    ),
)
def _(src: Source):
    return _demand(src).withColumn("day", F.col("forecast_date").cast("string")).drop("forecast_date")


@query(
    "i16_optimize_rebalancing",
    with_cte(
        "zones vehicles venue_events",
        """, supply AS (SELECT city, current_zone AS zone_id, count(*) AS vehicles FROM vehicles WHERE battery_pct >= 20 GROUP BY 1, 2),
        demand AS (SELECT z.city, z.zone_id, count(*) * (SELECT sum(vehicles)::BIGINT FROM supply) // (SELECT count(*) FROM venue_events) AS needed
                   FROM venue_events e JOIN zones z ON z.zone_id = e.zone GROUP BY 1, 2),
        balance AS (SELECT city, zone_id, coalesce(vehicles, 0) - coalesce(needed, 0) AS spare FROM supply FULL JOIN demand USING (city, zone_id)),
        line AS (SELECT city, zone_id, spare > 0 AS gives, abs(spare) AS n,
                        sum(abs(spare)) OVER (PARTITION BY city, spare > 0 ORDER BY abs(spare) DESC, zone_id) AS reach
                 FROM balance WHERE spare <> 0)
        SELECT g.city, g.zone_id AS from_zone, t.zone_id AS to_zone,
               CAST(least(g.reach, t.reach) - greatest(g.reach - g.n, t.reach - t.n) AS BIGINT) AS vehicle_count
        FROM line g JOIN line t ON g.city = t.city AND g.gives AND NOT t.gives
        WHERE least(g.reach, t.reach) > greatest(g.reach - g.n, t.reach - t.n)""",
    ).replace("\n, supply", ", supply"),
)
def _(src: Source):
    events = domain.venue_events(src).drop("city").join(domain.zones(src).select("zone_id", "city"), F.col("zone") == F.col("zone_id"))
    # The fleet is to be spread over the zones as their events are.
    supply = rebalance.zone_supply(domain.vehicles(src), 20)
    fleet_size = supply.agg(F.sum("vehicles")).scalar()
    all_events = src.events.agg(F.count(F.lit(1))).scalar()
    needed = (
        events.groupBy("city", "zone_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("city", "zone_id", F.floor(F.col("n") * fleet_size / all_events).alias("needed"))
    )
    return rebalance.optimize_rebalancing(supply, needed)


@query(
    "l02_demand_moves",
    with_cte(
        "zones vehicles venue_events",
        f""", wanted AS (SELECT city, zone_id, sum(CAST(ceil(round(expected / 2.0::DOUBLE, 6)) AS INT)) // 24 AS needed FROM ({_DEMAND}) GROUP BY 1, 2),
        supply AS (SELECT city, current_zone AS zone_id, count(*) AS vehicles FROM vehicles GROUP BY 1, 2),
        balance AS (SELECT city, zone_id, coalesce(vehicles, 0) - coalesce(needed, 0) AS spare FROM supply FULL JOIN wanted USING (city, zone_id))
        SELECT city, CAST(least(sum(CASE WHEN spare > 0 THEN spare ELSE 0 END), sum(CASE WHEN spare < 0 THEN -spare ELSE 0 END)) AS BIGINT) AS moved
        FROM balance GROUP BY city
        HAVING least(sum(CASE WHEN spare > 0 THEN spare ELSE 0 END), sum(CASE WHEN spare < 0 THEN -spare ELSE 0 END)) > 0""",
    ).replace("\n, wanted", ", wanted"),
)
def _(src: Source):
    needed = _demand(src).groupBy("city", "zone_id").agg(F.floor(F.sum("vehicle_count") / 24).alias("needed"))
    moves = rebalance.optimize_rebalancing(rebalance.zone_supply(domain.vehicles(src)), needed)
    return moves.groupBy("city").agg(F.sum("vehicle_count").alias("moved"))


@query(
    "i15_demand_sums",
    with_cte(
        "zones venue_events",
        """, hours AS (
            SELECT z.zone_id, g.d, g.h, coalesce(r.n, 0) AS y, dayofweek(g.d) AS dow, greatest(coalesce(m.mult, 1.0::DOUBLE), 1.0::DOUBLE) - 1.0::DOUBLE AS ev,
                   g.d - (DATE '2024-01-23' - 21) AS t
            FROM zones z CROSS JOIN (SELECT d, h FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-23' - 21, DATE '2024-01-22', INTERVAL 1 DAY)) AS DATE) AS d) days
                                     CROSS JOIN (SELECT unnest(range(0, 24)) AS h) hh) g
            LEFT JOIN (SELECT 'Z' || (user_id % 25) AS zone, CAST(ts AS DATE) AS d, hour(ts) AS h, count(*) AS n FROM events GROUP BY 1, 2, 3) r
              ON r.zone = z.zone_id AND r.d = g.d AND r.h = g.h
            LEFT JOIN (SELECT event_date, zone, max(demand_multiplier) AS mult FROM venue_events GROUP BY 1, 2) m ON m.event_date = g.d AND m.zone = z.zone_id),
        f AS (SELECT zone_id, d, h, h AS i, 1.0::DOUBLE AS x FROM hours
              UNION ALL SELECT zone_id, d, h, dow + 23, 1.0 FROM hours WHERE dow > 0
              UNION ALL SELECT zone_id, d, h, 30, ev FROM hours WHERE ev > 0
              UNION ALL SELECT zone_id, d, h, 31, t FROM hours WHERE t > 0
              UNION ALL SELECT zone_id, d, h, 32, y FROM hours)
        SELECT a.zone_id, CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, round(sum(a.x * b.x), 4) AS total
        FROM f a JOIN f b ON a.zone_id = b.zone_id AND a.d = b.d AND a.h = b.h AND a.i <= b.i GROUP BY 1, 2, 3""",
    ).replace("\n, hours", ", hours"),
)
def _(src: Source):
    sums = regression.normal_equations(domain.zones(src), _history(src), domain.venue_events(src), GRID_DAY, 21)
    return sums.withColumn("total", F.round("total", 4))


# No SQL states a least squares solution of 32 unknowns; tests hold it against numpy.
@query("i15_fitted_demand")
def _(src: Source):
    here = rebalance.zone_supply(domain.vehicles(src))
    fitted = regression.predict_fitted(domain.zones(src), _history(src), domain.venue_events(src), here, GRID_DAY, 21, 3)
    return fitted.withColumn("day", F.col("forecast_date").cast("string")).drop("forecast_date")


# No SQL states the least total distance; tests hold it against all plans of small cities.
@query("i16_cheapest_moves")
def _(src: Source):
    needed = _demand(src).groupBy("city", "zone_id").agg(F.floor(F.sum("vehicle_count") / 24).alias("needed"))
    return rebalance.cheapest_rebalancing(rebalance.zone_supply(domain.vehicles(src)), needed, domain.zones(src))


@query(
    "l02_sql_functions",
    with_cte(
        "zones vehicles venue_events",
        f""", demand AS (SELECT zone_id, city, d, h, CAST(ceil(round(expected / 2.0::DOUBLE, 6)) AS INT) AS n FROM ({_DEMAND})),
        supply AS (SELECT city, current_zone AS zone_id, count(*) AS vehicles FROM vehicles GROUP BY 1, 2),
        wanted AS (SELECT city, zone_id, sum(n) // 24 AS needed FROM demand GROUP BY 1, 2),
        balance AS (SELECT city, zone_id, coalesce(vehicles, 0) - coalesce(needed, 0) AS spare FROM supply FULL JOIN wanted USING (city, zone_id)),
        line AS (SELECT city, zone_id, spare > 0 AS gives, abs(spare) AS n,
                        sum(abs(spare)) OVER (PARTITION BY city, spare > 0 ORDER BY abs(spare) DESC, zone_id) AS reach
                 FROM balance WHERE spare <> 0)
        SELECT 'demand' AS kind, zone_id AS a, strftime(d, '%Y-%m-%d') AS b, CAST(sum(n) AS BIGINT) AS vehicles, max(n) FILTER (WHERE h = 8) AS at_eight
        FROM demand WHERE d >= DATE '2024-01-24' AND d < DATE '2024-01-26' GROUP BY zone_id, d
        UNION ALL
        SELECT 'move', g.zone_id, t.zone_id, CAST(least(g.reach, t.reach) - greatest(g.reach - g.n, t.reach - t.n) AS BIGINT), NULL
        FROM line g JOIN line t ON g.city = t.city AND g.gives AND NOT t.gives
        WHERE least(g.reach, t.reach) > greatest(g.reach - g.n, t.reach - t.n)""",
    ).replace("\n, demand", ", demand"),
)
def _(src: Source):
    demand = _demand(src)
    needed = demand.groupBy("city", "zone_id").agg(F.floor(F.sum("vehicle_count") / 24).alias("needed"))
    moves = rebalance.optimize_rebalancing(rebalance.zone_supply(domain.vehicles(src)), needed)
    sql_functions.register_functions(src.spark, demand, moves)
    domain.zones(src).createOrReplaceTempView("motorpool_zones")
    return src.spark.sql(
        """
        SELECT 'demand' AS kind, z.zone_id AS a, CAST(p.forecast_date AS STRING) AS b, sum(p.vehicle_count) AS vehicles,
               max(CASE WHEN p.hour = 8 THEN vehicles_needed(z.zone_id, p.forecast_date, 8) END) AS at_eight
        FROM motorpool_zones z, LATERAL predict_demand(z.zone_id, DATE '2024-01-24', 2) p
        GROUP BY z.zone_id, p.forecast_date
        UNION ALL
        SELECT 'move', m.from_zone, m.to_zone, m.vehicle_count, NULL
        FROM (SELECT DISTINCT city FROM motorpool_zones) c, LATERAL optimize_rebalancing(c.city) m"""
    )
