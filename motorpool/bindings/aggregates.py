"""Aggregations and KPI rows."""

from pyspark.sql import functions as F

from motorpool.bindings import domain
from motorpool.bindings.domain import with_cte
from motorpool.bindings.registry import Source, query
from motorpool.operators import aggregates as A
from motorpool.operators.filters import filter_since
from motorpool.plans import dashboard


@query(
    "d01_conditional_share",
    """
    SELECT round(100.0::DOUBLE * sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) / nullif(count(*), 0), 1) AS active_pct
    FROM lineitem""",
)
def _(src: Source):
    return A.conditional_share(src.lineitem, F.col("l_returnflag") == "A", "active_pct")


@query(
    "d02_filtered_avg",
    with_cte(
        "rides",
        "SELECT round(avg(wait_time_min), 1) AS avg_wait FROM rides WHERE ride_status = 'completed' AND request_time >= '2001-09-24'",
    ),
)
def _(src: Source):
    recent = (F.col("ride_status") == "completed") & (F.col("request_time") >= "2001-09-24")
    return A.filtered_avg(domain.rides(src), "wait_time_min", recent, "avg_wait")


@query(
    "d03_per_entity_per_day",
    """SELECT round(count(*) / 30.0::DOUBLE / (SELECT count(*) FROM supplier), 1) AS per_day FROM events""",
)
def _(src: Source):
    return A.per_entity_per_day(src.events, src.supplier, 30, "per_day")


@query(
    "d04_weighted_share",
    with_cte(
        "rides",
        """SELECT ride_status, round(100.0::DOUBLE * sum(CASE WHEN pickup_zone <> dropoff_zone THEN distance_miles ELSE 0 END)
                  / nullif(sum(distance_miles), 0), 1) AS cross_zone_mile_pct
           FROM rides GROUP BY ride_status""",
    ),
)
def _(src: Source):
    cross = F.col("pickup_zone") != F.col("dropoff_zone")
    return domain.rides(src).groupBy("ride_status").agg(
        A.weighted_share("distance_miles", cross).alias("cross_zone_mile_pct")
    )


@query("d05_count_by", "SELECT l_returnflag, l_linestatus, count(*) AS cnt FROM lineitem GROUP BY 1, 2")
def _(src: Source):
    return A.count_by(src.lineitem, ["l_returnflag", "l_linestatus"])


@query(
    "d06_group_stats",
    with_cte(
        "rides",
        "SELECT pickup_zone, count(*) AS ride_count, round(avg(wait_time_min), 6) AS avg_wait FROM rides GROUP BY 1",
    ),
)
def _(src: Source):
    stats = A.group_stats(domain.rides(src), ["pickup_zone"], "wait_time_min", "ride_count", "avg_wait")
    return stats.withColumn("avg_wait", F.round("avg_wait", 6))


@query(
    "d07_group_max",
    with_cte(
        "venue_events",
        """SELECT strftime(event_date, '%Y-%m-%d') AS day, zone, max(demand_multiplier) AS event_mult
           FROM venue_events GROUP BY 1, 2""",
    ),
)
def _(src: Source):
    best = A.group_max(domain.venue_events(src), ["event_date", "zone"], "demand_multiplier", "event_mult")
    return best.select(F.col("event_date").cast("string").alias("day"), "zone", "event_mult")


@query(
    "d08_summary_row",
    """
    SELECT count(*) AS total, round(avg(l_quantity), 1) AS avg_quantity,
           round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE), 2) AS total_revenue
    FROM lineitem""",
)
def _(src: Source):
    return A.summary_row(
        src.lineitem,
        total=F.count(F.lit(1)),
        avg_quantity=F.round(F.avg("l_quantity"), 1),
        total_revenue=F.round(A.exact_sum("l_extendedprice"), 2),
    )


@query(
    "d08_yesterday_row",
    with_cte(
        "rides",
        """SELECT count(*) AS total_rides, round(avg(wait_time_min), 1) AS avg_wait_min,
                  round(CAST(sum(CAST(fare_usd AS DECIMAL(18, 2))) AS DOUBLE), 2) AS total_revenue
           FROM rides WHERE ride_status = 'completed'
             AND CAST(request_time AS TIMESTAMP) >= DATE '2001-10-01' - 1 AND CAST(request_time AS TIMESTAMP) < DATE '2001-10-01'""",
    ),
)
def _(src: Source):
    rides = domain.rides(src).withColumn("request_ts", F.col("request_time").cast("timestamp_ntz"))
    return dashboard.yesterday_row(rides, domain.RIDES_AS_OF)


@query(
    "d09_count_where",
    """
    SELECT count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value > 100) AS large,
           count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-30') AS last_day
    FROM events""",
)
def _(src: Source):
    return A.count_where(
        src.events,
        errors=F.col("event_type") == "error",
        large=F.col("value") > 100,
        last_day=F.col("ts") >= F.lit("2024-01-30").cast("timestamp_ntz"),
    )


@query(
    "d10_sum_at_latest",
    with_cte(
        "inventory",
        """SELECT round(sum(quantity_on_hand), 0) AS total_inventory FROM inventory
           WHERE snapshot_date = (SELECT max(snapshot_date) FROM inventory)""",
    ),
)
def _(src: Source):
    return dashboard.sum_at_latest(domain.inventory(src), "snapshot_date", "quantity_on_hand", "total_inventory")


@query(
    "d11_distinct_values",
    """
    SELECT DISTINCT 'c_mktsegment' AS name, c_mktsegment AS value FROM customer WHERE c_mktsegment <> ''
    UNION ALL SELECT DISTINCT 'c_nationkey', c_nationkey::VARCHAR FROM customer""",
)
def _(src: Source):
    return A.distinct_values(src.customer, ["c_mktsegment", "c_nationkey"])


@query(
    "d11_filter_lists",
    with_cte(
        "zones vehicles venue_events",
        """SELECT DISTINCT 'city' AS name, city AS value FROM vehicles
           UNION ALL SELECT DISTINCT 'status', status FROM vehicles
           UNION ALL SELECT DISTINCT 'zone_id', zone_id FROM zones
           UNION ALL SELECT DISTINCT 'venue', venue FROM venue_events
           UNION ALL SELECT DISTINCT 'event_type', event_type FROM venue_events""",
    ),
)
def _(src: Source):
    return dashboard.filter_lists(domain.vehicles(src), domain.zones(src), domain.venue_events(src))


@query(
    "d12_pivot_counts",
    with_cte(
        "vehicles",
        """SELECT city, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'idle') AS idle,
                  count(*) FILTER (WHERE status = 'charging') AS charging, count(*) FILTER (WHERE status = 'parked') AS parked
           FROM vehicles GROUP BY city""",
    ),
)
def _(src: Source):
    return A.pivot_counts(domain.vehicles(src), ["city"], "status", ["active", "idle", "charging", "parked"])


@query(
    "d12_status_map",
    """
    SELECT string_agg(k || '=' || n, ',' ORDER BY k = 'other', k) AS counts
    FROM (SELECT CASE WHEN event_type IN ('view', 'click', 'error', 'refund') THEN event_type ELSE 'other' END AS k, count(*) AS n
          FROM events GROUP BY 1)""",
)
def _(src: Source):
    counts = A.status_map(src.events, "event_type", ["view", "click", "error", "refund"])
    pairs = F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return counts.select(F.array_join(pairs, ",").alias("counts"))


_FLEET_KPIS = with_cte(
    "vehicles rides surge_alerts fleet_actions",
    """, done AS (SELECT * FROM rides WHERE ride_status = 'completed' AND request_time >= '2001-09-24')
    SELECT (SELECT round(100.0::DOUBLE * sum(CASE WHEN status = 'active' THEN 1 ELSE 0 END) / count(*), 1) FROM vehicles) AS fleet_utilization_pct,
           (SELECT round(avg(wait_time_min), 1) FROM done) AS avg_wait_time_min,
           (SELECT round(count(*) / 7.0::DOUBLE / (SELECT count(*) FROM vehicles), 1) FROM done) AS rides_per_vehicle_day,
           (SELECT round(100.0::DOUBLE * sum(CASE WHEN pickup_zone <> dropoff_zone THEN distance_miles ELSE 0 END) / nullif(sum(distance_miles), 0), 1) FROM done) AS cross_zone_mile_pct,
           (SELECT count(*) FROM surge_alerts WHERE status = 'open') AS open_surge_alerts,
           (SELECT count(*) FROM fleet_actions WHERE status = 'pending') AS pending_fleet_actions""",
).replace("\n, done", ", done")


@query("d13_kpi_row", _FLEET_KPIS)
def _(src: Source):
    return dashboard.fleet_metrics(
        domain.vehicles(src), domain.rides(src), domain.surge_alerts(src), domain.fleet_actions(src), domain.RIDES_AS_OF
    )


@query(
    "d13_supply_kpis",
    with_cte(
        "shipments inventory",
        """, recent AS (SELECT * FROM shipments WHERE ship_date >= DATE '2001-10-01' - 30)
        SELECT (SELECT count(*) FROM recent) AS total_shipments_30d,
               (SELECT CAST(sum(CAST(cost_usd AS DECIMAL(18, 2))) AS DOUBLE) FROM recent) AS total_cost_30d,
               (SELECT round(avg(distance_miles), 0) FROM recent) AS avg_distance,
               (SELECT round(sum(CASE WHEN actual_delivery_date <= expected_delivery_date THEN 1 ELSE 0 END)::DOUBLE / nullif(count(*), 0) * 100, 1)
                FROM shipments WHERE status = 'delivered' AND ship_date >= DATE '2001-10-01' - 90) AS on_time_delivery_pct,
               (SELECT count(*) FROM recent WHERE status IN ('delayed', 'cancelled')) AS active_exceptions,
               (SELECT round(avg((o_custkey % 100) / 100.0::DOUBLE) * 100, 1) FROM orders
                WHERE CAST(o_orderdate AS DATE) >= DATE '2001-10-01' - 90) AS avg_fill_rate_pct,
               (SELECT round(sum(quantity_on_hand), 0) FROM inventory
                WHERE snapshot_date = (SELECT max(snapshot_date) FROM inventory)) AS total_inventory""",
    ).replace("\n, recent", ", recent"),
)
def _(src: Source):
    orders = src.orders.select(
        F.col("o_orderdate").cast("date").alias("order_date"),
        (F.col("o_custkey") % 100 / F.lit(100.0)).alias("fulfillment_rate"),
    )
    return dashboard.supply_metrics(domain.shipments(src), orders, domain.inventory(src), domain.RIDES_AS_OF)


@query(
    "d13_agent_kpis",
    with_cte(
        "workflows surge_alerts",
        """SELECT count(*) FILTER (WHERE status = 'pending_approval') AS pending_approval,
                  count(*) FILTER (WHERE status = 'in_progress') AS in_progress,
                  count(*) FILTER (WHERE status = 'approved' AND completed_at >= TIMESTAMP '2001-08-01' - INTERVAL 7 DAY) AS completed_7d,
                  count(*) FILTER (WHERE created_at >= TIMESTAMP '2001-08-01' - INTERVAL 7 DAY) AS workflows_7d,
                  count(*) FILTER (WHERE status = 'dismissed') AS dismissed, count(*) AS total_workflows,
                  (SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 24 HOUR) AS agent_actions_24h,
                  (SELECT count(*) FROM surge_alerts WHERE status = 'open') AS open_exceptions
           FROM workflows""",
    ),
)
def _(src: Source):
    return dashboard.agent_kpis(
        domain.workflows(src), domain.fleet_actions(src), domain.surge_alerts(src), domain.ORDERS_AS_OF
    )


def _briefing(src: Source):
    # Rides are dated years before the events here; shifted by whole days, both have the same today.
    shift = F.date_diff(F.lit(domain.EVENTS_MIDDLE).cast("date"), F.lit(domain.RIDES_AS_OF).cast("date"))
    rides = domain.rides(src).withColumn(
        "request_ts", F.col("request_time").cast("timestamp_ntz") + F.make_dt_interval(shift)
    )
    return dashboard.daily_briefing(
        domain.venue_events(src), domain.surge_alerts(src), domain.vehicles(src), rides, domain.fleet_actions(src), domain.EVENTS_MIDDLE
    )


@query(
    "d14_briefing_summary",
    with_cte(
        "vehicles rides surge_alerts fleet_actions venue_events",
        """SELECT count(*) AS total_rides, coalesce(round(avg(wait_time_min), 1), 0) AS avg_wait_min,
                  coalesce(round(CAST(sum(CAST(fare_usd AS DECIMAL(18, 2))) AS DOUBLE), 2), 0) AS total_revenue,
                  (SELECT count(*) FROM fleet_actions WHERE status = 'pending') AS pending_actions,
                  (SELECT count(*) FROM surge_alerts WHERE status IN ('open', 'acknowledged')) AS open_alerts,
                  (SELECT count(*) FROM venue_events WHERE event_date BETWEEN DATE '2024-01-16' AND DATE '2024-01-17') AS events_today_tomorrow,
                  (SELECT count(*) FROM vehicles) AS total_vehicles,
                  (SELECT count(*) FROM vehicles WHERE status = 'active') AS active_vehicles,
                  (SELECT round(avg(battery_pct), 0) FROM vehicles) AS avg_battery
           FROM rides WHERE ride_status = 'completed'
             AND CAST(request_time AS TIMESTAMP) >= DATE '2001-10-01' - 1 AND CAST(request_time AS TIMESTAMP) < DATE '2001-10-01'""",
    ),
)
def _(src: Source):
    return _briefing(src)["summary"]


@query(
    "d14_briefing_events",
    with_cte(
        "venue_events",
        """SELECT event_name, venue, city, strftime(event_date, '%Y-%m-%d') AS event_day, start_time,
                  expected_attendance, demand_multiplier
           FROM venue_events WHERE event_date BETWEEN DATE '2024-01-16' AND DATE '2024-01-17'""",
    ),
)
def _(src: Source):
    events = _briefing(src)["todays_events"]
    return events.withColumn("event_day", F.col("event_date").cast("string")).drop("event_date")


@query(
    "d14_briefing_alerts",
    with_cte(
        "surge_alerts",
        """SELECT alert_id, zone_id, severity, status, created_at FROM surge_alerts
           WHERE status IN ('open', 'acknowledged') ORDER BY created_at DESC, alert_id DESC LIMIT 10""",
    ),
)
def _(src: Source):
    return _briefing(src)["open_alerts"].select("alert_id", "zone_id", "severity", "status", "created_at")


@query(
    "d14_briefing_fleet",
    with_cte("vehicles", "SELECT status, count(*) AS cnt FROM vehicles GROUP BY status"),
)
def _(src: Source):
    return _briefing(src)["fleet_status"]


@query(
    "d15_distinct_total",
    """SELECT sum(n)::BIGINT AS total FROM (SELECT event_type, count(*) AS n FROM events
       WHERE ts >= DATE '2024-01-31' - 7 GROUP BY 1)""",
)
def _(src: Source):
    recent = filter_since(src.events, "ts", domain.EVENTS_AS_OF, days=7)
    return A.distinct_total(A.count_by(recent, ["event_type"]), "cnt")
