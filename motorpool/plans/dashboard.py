"""Dashboard reads: KPI rows, briefing, overviews, filter lists and detail views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorpool.functions.scalars import before, day
from motorpool.operators import aggregates as agg
from motorpool.operators.activity import enrich_workflows
from motorpool.operators.filters import filter_day, filter_in, filter_next_days, filter_since
from motorpool.operators.joins import attach_children, attach_group_stats
from motorpool.operators.ordering import top_k
from motorpool.sources.tables import union_all


def fleet_metrics(vehicles: DataFrame, rides: DataFrame, alerts: DataFrame, actions: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Six fleet KPIs in one row. ``rides`` has text request times, compared as text: the
    whole first day counts. The three ride KPIs share one scan."""
    start = F.date_sub(day(as_of), days).cast("string")
    done = rides.filter((F.col("ride_status") == "completed") & (F.col("request_time") >= start))
    cross = F.col("pickup_zone") != F.col("dropoff_zone")
    fleet = vehicles.agg(
        agg.share_where(F.col("status") == "active").alias("fleet_utilization_pct"),
        F.count(F.lit(1)).alias("__vehicles"),
    )
    ride = done.agg(
        F.round(F.avg("wait_time_min"), 1).alias("avg_wait_time_min"),
        F.count(F.lit(1)).alias("__rides"),
        agg.weighted_share("distance_miles", cross).alias("cross_zone_mile_pct"),
    )
    spark = vehicles.sparkSession
    parts = [
        (fleet, {"fleet_utilization_pct": 0.0, "__vehicles": 0}),
        (ride, {"avg_wait_time_min": 0.0, "__rides": 0, "cross_zone_mile_pct": 0.0}),
        (agg.count_where(alerts, open_surge_alerts=F.col("status") == "open"), {"open_surge_alerts": 0}),
        (agg.count_where(actions, pending_fleet_actions=F.col("status") == "pending"), {"pending_fleet_actions": 0}),
    ]
    per_day = F.round(F.col("__rides") / F.lit(float(days)) / F.nullif("__vehicles", F.lit(0)), 1)
    return agg.kpi_row(spark, parts).select(
        "fleet_utilization_pct",
        "avg_wait_time_min",
        F.coalesce(per_day, F.lit(0.0)).alias("rides_per_vehicle_day"),
        "cross_zone_mile_pct",
        "open_surge_alerts",
        "pending_fleet_actions",
    )


def supply_metrics(shipments: DataFrame, orders: DataFrame, inventory: DataFrame, as_of) -> DataFrame:
    """Seven supply-chain KPIs in one row; shipments are scanned once for four of them.

    ``shipments``: ship_date, cost_usd, distance_miles, status, expected_delivery_date,
    actual_delivery_date. ``orders``: order_date, fulfillment_rate. ``inventory``:
    snapshot_date, quantity_on_hand.
    """
    today = day(as_of)
    since30 = F.col("ship_date") >= F.date_sub(today, 30)
    delivered = F.col("status") == "delivered"
    on_time = F.col("actual_delivery_date") <= F.col("expected_delivery_date")
    ship = shipments.filter(F.col("ship_date") >= F.date_sub(today, 90)).agg(
        F.count_if(since30).alias("total_shipments_30d"),
        agg.exact_sum(F.when(since30, F.col("cost_usd"))).alias("total_cost_30d"),
        F.round(F.avg(F.when(since30, F.col("distance_miles"))), 0).alias("avg_distance"),
        F.round(
            F.count_if(delivered & on_time) / F.nullif(F.count_if(delivered), F.lit(0)) * F.lit(100), 1
        ).alias("on_time_delivery_pct"),
        F.count_if(since30 & F.col("status").isin("delayed", "cancelled")).alias("active_exceptions"),
    )
    filled = orders.filter(F.col("order_date") >= F.date_sub(today, 90)).agg(
        F.round(F.avg("fulfillment_rate") * F.lit(100), 1).alias("avg_fill_rate_pct")
    )
    stock = sum_at_latest(inventory, "snapshot_date", "quantity_on_hand", "total_inventory")
    return agg.kpi_row(
        shipments.sparkSession,
        [
            (
                ship,
                {
                    "total_shipments_30d": 0,
                    "total_cost_30d": 0.0,
                    "avg_distance": 0.0,
                    "on_time_delivery_pct": 0.0,
                    "active_exceptions": 0,
                },
            ),
            (filled, {"avg_fill_rate_pct": 0.0}),
            (stock, {"total_inventory": 0.0}),
        ],
    )


def sum_at_latest(df: DataFrame, date: str, value: str, name: str, digits: int = 0) -> DataFrame:
    """The total at the last snapshot. One pass: totals per date fold small, the newest is kept."""
    per_date = df.groupBy(date).agg(agg.exact_sum(value).alias("__sum"))
    return per_date.agg(F.round(F.max_by("__sum", date), digits).alias(name))


def agent_kpis(workflows: DataFrame, agent_actions: DataFrame, exceptions: DataFrame, as_of) -> DataFrame:
    """Counts of the agent page in one row, one scan per table."""
    status = F.col("status")
    week, last_day = before(as_of, days=7), before(as_of, hours=24)
    return agg.kpi_row(
        workflows.sparkSession,
        [
            (
                agg.count_where(
                    workflows,
                    pending_approval=status == "pending_approval",
                    in_progress=status == "in_progress",
                    completed_7d=(status == "approved") & (F.col("completed_at") >= week),
                    workflows_7d=F.col("created_at") >= week,
                    dismissed=status == "dismissed",
                    total_workflows=F.lit(True),
                ),
                {
                    "pending_approval": 0,
                    "in_progress": 0,
                    "completed_7d": 0,
                    "workflows_7d": 0,
                    "dismissed": 0,
                    "total_workflows": 0,
                },
            ),
            (
                agg.count_where(agent_actions, agent_actions_24h=F.col("created_at") >= last_day),
                {"agent_actions_24h": 0},
            ),
            (agg.count_where(exceptions, open_exceptions=status == "open"), {"open_exceptions": 0}),
        ],
    )


def yesterday_row(rides: DataFrame, as_of) -> DataFrame:
    """Completed rides of the day before; ``rides`` needs request_ts."""
    done = filter_day(rides, "request_ts", F.date_sub(day(as_of), 1)).filter(F.col("ride_status") == "completed")
    return agg.summary_row(
        done,
        total_rides=F.count(F.lit(1)),
        avg_wait_min=F.round(F.avg("wait_time_min"), 1),
        total_revenue=F.round(agg.exact_sum("fare_usd"), 2),
    )


def agent_overview(workflows: DataFrame, agent_actions: DataFrame, as_of, recent: int = 50, actions: int = 20) -> dict[str, DataFrame]:
    """The agent page: counts by status and, of the last 7 days, by type; the newest workflows,
    enriched after the cut, and the newest actions."""
    return {
        "workflow_status": agg.count_by(workflows, ["status"]),
        "action_status": agg.count_by(agent_actions, ["status"]),
        "workflow_types": agg.count_by(filter_since(workflows, "created_at", as_of, hours=7 * 24), ["workflow_type"]),
        "workflows": enrich_workflows(top_k(workflows, [F.col("created_at").desc(), F.col("workflow_id").desc()], recent)),
        "actions": top_k(agent_actions, [F.col("created_at").desc(), F.col("action_id").desc()], actions),
    }


def briefing_context(exceptions: DataFrame, workflows: DataFrame, agent_actions: DataFrame, vehicles: DataFrame, events: DataFrame, alerts: DataFrame, fleet_actions: DataFrame, as_of, k: int = 5) -> dict[str, DataFrame]:
    """What a briefing is written from: open exceptions by severity, workflows by status, the
    fleet and the open counts in one row, and the next ``k`` events."""
    status = F.col("status")
    fleet = vehicles.agg(
        F.count(F.lit(1)).alias("total_vehicles"), F.count_if(status == "active").alias("active"), F.avg("battery_pct").alias("avg_battery")
    )
    day_before = before(as_of, hours=24)
    counts = agg.kpi_row(
        vehicles.sparkSession,
        [
            (fleet, {"total_vehicles": 0, "active": 0, "avg_battery": 0.0}),
            (agg.count_where(agent_actions, agent_actions_24h=F.col("created_at") >= day_before), {"agent_actions_24h": 0}),
            (agg.count_where(alerts, open_alerts=status == "open"), {"open_alerts": 0}),
            (agg.count_where(fleet_actions, pending_actions=status == "pending"), {"pending_actions": 0}),
        ],
    )
    coming = filter_next_days(events, "event_date", as_of)
    return {
        "exceptions": agg.count_by(exceptions.filter(status == "open"), ["severity"]),
        "workflows": agg.count_by(workflows, ["status"]),
        "counts": counts,
        "events": top_k(coming, ["event_date", "start_time", "event_id"], k).select(
            "event_id", "event_name", "venue", "event_date", "expected_attendance", "demand_multiplier"
        ),
    }


def zone_overview(zones: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Every zone with its vehicles of any status and their mean level, 0 where it has none."""
    stats = [F.count(F.lit(1)).alias("current_vehicles"), F.avg("battery_pct").alias("avg_battery")]
    return attach_group_stats(zones, vehicles, ("zone_id", "current_zone"), stats).orderBy("zone_id")


def daily_briefing(events: DataFrame, alerts: DataFrame, vehicles: DataFrame, rides: DataFrame, actions: DataFrame, as_of, k: int = 10) -> dict[str, DataFrame]:
    """The parts of the morning briefing, each by name, and a one-row summary; ``k`` open alerts."""
    coming = filter_next_days(events, "event_date", as_of, 1)
    open_alerts = filter_in(alerts, "status", ["open", "acknowledged"])
    yesterday = yesterday_row(rides, as_of)
    pending = agg.count_where(actions, pending_actions=F.col("status") == "pending")
    spark = events.sparkSession
    summary = agg.kpi_row(
        spark,
        [
            (yesterday, {"total_rides": 0, "avg_wait_min": 0.0, "total_revenue": 0.0}),
            (pending, {"pending_actions": 0}),
            (agg.summary_row(open_alerts, open_alerts=F.count(F.lit(1))), {"open_alerts": 0}),
            (agg.summary_row(coming, events_today_tomorrow=F.count(F.lit(1))), {"events_today_tomorrow": 0}),
            (
                agg.summary_row(
                    vehicles,
                    total_vehicles=F.count(F.lit(1)),
                    active_vehicles=F.count_if(F.col("status") == "active"),
                    avg_battery=F.round(F.avg("battery_pct"), 0),
                ),
                {"total_vehicles": 0, "active_vehicles": 0, "avg_battery": 0.0},
            ),
        ],
    )
    return {
        "todays_events": coming.select(
            "event_name",
            "venue",
            "city",
            "event_date",
            "start_time",
            "expected_attendance",
            "demand_multiplier",
        ).orderBy("event_date", "start_time"),
        "open_alerts": top_k(open_alerts, [F.col("created_at").desc(), F.col("alert_id").desc()], k),
        "fleet_status": agg.count_by(vehicles, ["status"]),
        "summary": summary,
    }


def filter_lists(vehicles: DataFrame, zones: DataFrame, events: DataFrame) -> DataFrame:
    """Values of the filter controls as (name, value) rows."""
    return union_all(
        agg.distinct_values(vehicles, ["city", "status"]),
        agg.distinct_values(zones, ["zone_id"]),
        agg.distinct_values(events, ["venue", "event_type"]),
    )


def supply_filter_lists(facilities: DataFrame, products: DataFrame, shipments: DataFrame) -> DataFrame:
    """Values of the supply-chain controls as (name, value) rows."""
    return union_all(
        agg.distinct_values(facilities, ["division", "region", "facility_type"]),
        agg.distinct_values(products, ["product_category"]),
        agg.distinct_values(shipments, ["carrier", "transport_mode", "status"]),
    )


def vehicle_detail(vehicles: DataFrame, notes: DataFrame, rides: DataFrame, n_notes: int = 10, n_rides: int = 20) -> DataFrame:
    """Every vehicle with its newest notes and rides."""
    own = notes.filter(F.col("entity_type") == "vehicle")
    with_notes = attach_children(
        vehicles,
        own,
        ("vehicle_id", "entity_id"),
        [F.col("created_at").desc(), F.col("note_id").desc()],
        n_notes,
        ["note_id", "note_text", "author", "created_at"],
        "notes",
    )
    return attach_children(
        with_notes,
        rides,
        ("vehicle_id", "vehicle_id"),
        [F.col("request_time").desc(), F.col("ride_id").desc()],
        n_rides,
        ["ride_id", "request_time", "pickup_zone", "dropoff_zone", "fare_usd", "ride_status"],
        "recent_rides",
    )
