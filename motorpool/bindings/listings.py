"""Lists, pages and details of the dashboards."""

from pyspark.sql import functions as F

from motorpool.bindings import domain
from motorpool.bindings.demand import _PREDICTED, GRID_DAY
from motorpool.bindings.domain import with_cte
from motorpool.bindings.registry import Source, query
from motorpool.plans import forecasts
from motorpool.plans import listings as L


@query(
    "b01_vehicle_list",
    with_cte("vehicles", "SELECT * FROM vehicles WHERE city = 'ASIA' AND status = 'active' ORDER BY vehicle_id"),
)
def _(src: Source):
    return L.vehicle_list(domain.vehicles(src), city="ASIA", status="active")


@query(
    "b04_upcoming_events",
    with_cte(
        "venue_events",
        """SELECT event_id, event_name, strftime(event_date, '%Y-%m-%d') AS day, start_time FROM venue_events
           WHERE event_date BETWEEN DATE '2024-01-16' AND DATE '2024-01-18' ORDER BY event_date, start_time""",
    ),
)
def _(src: Source):
    return L.upcoming_events(domain.venue_events(src), domain.EVENTS_MIDDLE, 2).select(
        "event_id", "event_name", F.col("event_date").cast("string").alias("day"), "start_time"
    )


@query(
    "b07_demand_list",
    with_cte(
        "zones venue_events",
        f"""SELECT zone_id, strftime(d, '%Y-%m-%d') AS day, CAST(h AS INT) AS hour, demand AS predicted_demand, supply AS predicted_supply
            FROM ({_PREDICTED}) WHERE d >= DATE '{GRID_DAY}' AND h <= 4 AND city = 'ASIA' ORDER BY d, h, zone_id""",
    ),
)
def _(src: Source):
    made = forecasts.build_forecasts(domain.zones(src), domain.venue_events(src), GRID_DAY)
    return L.demand_list(made, GRID_DAY, city="ASIA", horizon="4h").select(
        "zone_id", F.col("forecast_date").cast("string").alias("day"), "hour", "predicted_demand", "predicted_supply"
    )


@query(
    "c01_event_list",
    with_cte(
        "zones venue_events",
        """SELECT e.event_id, e.venue, strftime(e.event_date, '%Y-%m-%d') AS day, z.zone_name, z.latitude, z.longitude
           FROM (SELECT * FROM venue_events WHERE event_type = 'purchase' AND event_date >= DATE '2024-01-16'
                 ORDER BY event_date DESC, event_id LIMIT 200) e LEFT JOIN zones z ON e.zone = z.zone_id""",
    ),
)
def _(src: Source):
    listed = L.event_list(
        domain.venue_events(src), domain.zones(src), domain.EVENTS_MIDDLE, event_type="purchase", upcoming_only=True
    )
    return listed.select(
        "event_id", "venue", F.col("event_date").cast("string").alias("day"), "zone_name", "latitude", "longitude"
    )


@query(
    "c09_live_positions",
    with_cte(
        "telemetry",
        """SELECT t.* FROM telemetry t JOIN (SELECT vehicle_id, max("timestamp") AS top FROM telemetry
             WHERE "timestamp" >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 60 MINUTE GROUP BY 1) m
             ON t.vehicle_id = m.vehicle_id AND t."timestamp" = m.top""",
    ),
)
def _(src: Source):
    return L.live_positions(domain.telemetry(src), "2024-01-30 12:00:00", 60)


# Rides lie years before the events; whole days bring the last of them into the same month.
_SHIFT = "DATE '2024-01-16' - DATE '2001-10-01'"


@query(
    "c13_event_detail",
    with_cte(
        "rides venue_events",
        f""", moved AS (SELECT CAST(request_time AS TIMESTAMP) + to_days(CAST({_SHIFT} AS INT)) AS request_ts, pickup_zone, wait_time_min FROM rides),
        spans AS (SELECT event_id, CAST(strftime(event_date, '%Y-%m-%d') || ' ' || start_time || ':00' AS TIMESTAMP) AS s,
                         CAST(strftime(event_date, '%Y-%m-%d') || ' ' || end_time || ':00' AS TIMESTAMP) AS e FROM venue_events),
        stats AS (SELECT event_id, pickup_zone, count(*) AS n FROM spans JOIN moved ON request_ts >= s AND request_ts < e GROUP BY 1, 2)
        SELECT event_id, coalesce(string_agg(pickup_zone || '=' || n, ',' ORDER BY n DESC, pickup_zone), '') AS patterns
        FROM spans LEFT JOIN stats USING (event_id) GROUP BY 1""",
    ).replace("\n, moved", ", moved"),
)
def _(src: Source):
    shift = F.date_diff(F.lit(domain.EVENTS_MIDDLE).cast("date"), F.lit(domain.RIDES_AS_OF).cast("date"))
    rides = domain.rides(src).withColumn(
        "request_ts", F.col("request_time").cast("timestamp_ntz") + F.make_dt_interval(shift)
    )
    shown = F.transform("ride_patterns", lambda p: F.concat_ws("=", p["pickup_zone"], p["ride_count"].cast("string")))
    return L.event_detail(domain.venue_events(src), rides).select(
        "event_id", F.coalesce(F.array_join(shown, ","), F.lit("")).alias("patterns")
    )


@query(
    "f01_alert_list",
    with_cte(
        "surge_alerts",
        """SELECT alert_id, zone_id, CAST(predicted_demand_score AS DOUBLE) AS score, created_at FROM surge_alerts
           WHERE status = 'open' AND severity = 'high' ORDER BY created_at DESC, alert_id DESC LIMIT 50""",
    ),
)
def _(src: Source):
    return L.alert_list(domain.surge_alerts(src), status="open", severity="high").select(
        "alert_id", "zone_id", F.col("predicted_demand_score").cast("double").alias("score"), "created_at"
    )


@query(
    "f01_action_list",
    with_cte(
        "fleet_actions",
        """SELECT action_id, action_type, from_zone, to_zone, vehicle_count, priority, created_at FROM fleet_actions
           WHERE status = 'pending' AND city = 'City 3' ORDER BY created_at DESC, action_id DESC LIMIT 50""",
    ),
)
def _(src: Source):
    return L.action_list(domain.fleet_actions(src), status="pending", city="City 3").select(
        "action_id", "action_type", "from_zone", "to_zone", "vehicle_count", "priority", "created_at"
    )


@query(
    "f01_override_list",
    with_cte(
        "dispatch_overrides",
        "SELECT override_id, vehicle_id, from_zone, to_zone, status FROM dispatch_overrides ORDER BY created_at DESC, override_id DESC LIMIT 50",
    ),
)
def _(src: Source):
    return L.override_list(domain.dispatch_overrides(src)).select(
        "override_id", "vehicle_id", "from_zone", "to_zone", "status"
    )


@query(
    "f02_ride_page",
    with_cte(
        "rides",
        """, listed AS (SELECT ride_id, vehicle_id, request_time, fare_usd FROM rides
             WHERE city = 'City 2' AND ride_status = 'completed' AND request_time >= '2001-01-01' AND request_time <= '2001-06-30 23:59:59')
        SELECT *, (SELECT count(*) FROM listed) AS total FROM listed ORDER BY request_time DESC, ride_id LIMIT 25 OFFSET 25""",
    ).replace("\n, listed", ", listed"),
)
def _(src: Source):
    page = L.ride_page(
        domain.rides(src), 2, 25, city="City 2", ride_status="completed", date_from="2001-01-01", date_to="2001-06-30"
    )
    return page.select("ride_id", "vehicle_id", "request_time", "fare_usd", "total")


def _facilities(src: Source):
    return src.supplier.select(F.col("s_suppkey").alias("facility_id"), F.col("s_name").alias("facility_name"))


def _products(src: Source):
    return src.part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("product_category"),
    )


@query(
    "f03_shipment_page",
    with_cte(
        "shipments",
        """, listed AS (SELECT shipment_id, cost_usd, o.s_name AS origin_name, d.s_name AS dest_name, p_name AS product_name
             FROM shipments JOIN supplier o ON origin_facility_id = o.s_suppkey JOIN supplier d ON destination_facility_id = d.s_suppkey
             JOIN part ON product_id = p_partkey
             WHERE status = 'delayed' AND transport_mode = 'rail' AND temp_min_f IS NOT NULL AND p_type = 'PROMO')
        SELECT *, (SELECT count(*) FROM listed) AS total FROM listed ORDER BY cost_usd, shipment_id LIMIT 40""",
    ).replace("\n, listed", ", listed"),
)
def _(src: Source):
    page = L.shipment_page(
        domain.shipments(src),
        _facilities(src),
        _products(src),
        sort="cost_usd",
        order="asc",
        per_page=40,
        cold_only=True,
        product_category="PROMO",
        status="delayed",
        transport_mode="rail",
    )
    return page.select("shipment_id", "cost_usd", "origin_name", "dest_name", "product_name", "total")


@query(
    "c03_inventory_list",
    with_cte(
        "inventory",
        """SELECT facility_id, product_id, s_name AS facility_name, p_name AS product_name, days_of_supply
           FROM inventory JOIN supplier ON facility_id = s_suppkey JOIN part ON product_id = p_partkey
           WHERE snapshot_date = (SELECT max(snapshot_date) FROM inventory) AND below_reorder""",
    ),
)
def _(src: Source):
    return L.inventory_list(domain.inventory(src), _facilities(src), _products(src), below_reorder_only=True).select(
        "facility_id", "product_id", "facility_name", "product_name", "days_of_supply"
    )


@query(
    "f01_inventory_alerts",
    with_cte(
        "inventory",
        """SELECT facility_id, product_id, days_of_supply FROM inventory
           WHERE snapshot_date = (SELECT max(snapshot_date) FROM inventory) AND below_reorder
           ORDER BY days_of_supply, facility_id, product_id LIMIT 5""",
    ),
)
def _(src: Source):
    return L.inventory_alerts(domain.inventory(src), _facilities(src), _products(src), 5).select(
        "facility_id", "product_id", "days_of_supply"
    )


@query(
    "j07_workflow_list",
    with_cte(
        "workflows",
        """SELECT workflow_id, severity, summary AS enriched_summary, created_at FROM workflows
           WHERE status = 'pending_approval' ORDER BY created_at DESC, workflow_id DESC LIMIT 20""",
    ),
)
def _(src: Source):
    return L.workflow_list(domain.workflows(src), "pending_approval").select(
        "workflow_id", "severity", "enriched_summary", "created_at"
    )
