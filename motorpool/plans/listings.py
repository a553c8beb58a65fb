"""Lists, pages and details as the dashboards read them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorpool.operators import filters as flt
from motorpool.operators.activity import enrich_workflows
from motorpool.operators.joins import enrich_left, event_bounds, latest_per_key, range_stats, star_join
from motorpool.operators.ordering import paginate, top_k, whitelisted_order


# --- fleet -------------------------------------------------------------------------


def vehicle_list(vehicles: DataFrame, city=None, status=None, zone=None) -> DataFrame:
    return flt.filter_equals(vehicles, city=city, status=status, current_zone=zone).orderBy("vehicle_id")


def live_positions(telemetry: DataFrame, as_of, minutes: int = 5) -> DataFrame:
    """The newest reading of every vehicle heard of within the lookback."""
    return latest_per_key(telemetry, "vehicle_id", "timestamp", as_of, minutes).orderBy("vehicle_id")


def event_list(events: DataFrame, zones: DataFrame, as_of, city=None, venue=None, event_type=None, upcoming_only: bool = False, k: int = 200) -> DataFrame:
    """Newest events with their zone. Zones join after the cut, so only ``k`` rows meet them."""
    listed = flt.filter_equals(events, city=city, venue=venue, event_type=event_type)
    if upcoming_only:
        listed = flt.filter_next_days(listed, "event_date", as_of)
    order = [F.col("event_date").desc(), F.col("event_id")]
    return enrich_left(
        top_k(listed, order, k), zones, ("zone", "zone_id"), ["latitude", "longitude", "zone_name"]
    ).orderBy(*order)


def upcoming_events(events: DataFrame, as_of, days: int = 7) -> DataFrame:
    return flt.filter_next_days(events, "event_date", as_of, days).orderBy("event_date", "start_time")


def event_detail(events: DataFrame, rides: DataFrame) -> DataFrame:
    """Events with the rides requested while they last, per pickup zone, busiest first.

    Rides of every city count. ``rides`` needs request_ts, pickup_zone and wait_time_min.
    Narrow ``events`` first for the detail of one. The list of zones is made once for every
    span of time, of which there are far fewer than events, and events then meet their span's.
    """
    bounded = event_bounds(events, "event_date", "start_time", "end_time")
    span = F.struct("window_start", "window_end")
    spans = bounded.select("window_start", "window_end").distinct().withColumn("__span", span)
    stats = range_stats(
        rides, spans, "request_ts", "window_start", "window_end", ["pickup_zone"], "wait_time_min", "__span"
    )
    packed = stats.groupBy("__span").agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("n")).alias("__order"), "pickup_zone", F.col("n").alias("ride_count"), F.col("mean").alias("avg_wait")))
        ).alias("ride_patterns")
    )
    patterns = packed.select("__span", F.transform("ride_patterns", lambda p: p.dropFields("__order")).alias("ride_patterns"))
    return bounded.withColumn("__span", span).join(patterns, "__span", "left").select(*events.columns, "ride_patterns")


def demand_list(forecasts: DataFrame, as_of, city=None, zone=None, horizon: str = "24h", mode: str = "clock_hour") -> DataFrame:
    listed = flt.filter_equals(forecasts, city=city, zone_id=zone)
    return flt.filter_horizon(listed, "forecast_date", "hour", as_of, horizon, mode).orderBy(
        "forecast_date", "hour", "zone_id"
    )


def ride_page(rides: DataFrame, page: int = 1, per_page: int = 25, city=None, pickup_zone=None, ride_status=None, date_from=None, date_to=None) -> DataFrame:
    """A page of rides, newest first, with the total; text request times compare as text."""
    listed = flt.filter_equals(rides, city=city, pickup_zone=pickup_zone, ride_status=ride_status)
    listed = flt.filter_between(listed, "request_time", date_from, date_to)
    return paginate(listed, [F.col("request_time").desc(), F.col("ride_id")], page, per_page)


# --- operational tables ----------------------------------------------------------------


def newest(table: DataFrame, key: str, k: int = 50, **wanted) -> DataFrame:
    """The newest rows of an operational table that match optional filters."""
    return top_k(flt.filter_equals(table, **wanted), [F.col("created_at").desc(), F.col(key).desc()], k)


def alert_list(alerts: DataFrame, status=None, severity=None) -> DataFrame:
    return newest(alerts, "alert_id", status=status, severity=severity)


def action_list(actions: DataFrame, status=None, city=None) -> DataFrame:
    return newest(actions, "action_id", status=status, city=city)


def override_list(overrides: DataFrame) -> DataFrame:
    return newest(overrides, "override_id")


def exception_list(exceptions: DataFrame, status=None, severity=None, limit: int = 50) -> DataFrame:
    if not 1 <= limit <= 200:
        raise ValueError("limit must be from 1 to 200")
    return newest(exceptions, "exception_id", limit, status=status, severity=severity)


def workflow_list(workflows: DataFrame, status=None, limit: int = 20) -> DataFrame:
    """The newest workflows, enriched after the cut."""
    return enrich_workflows(newest(workflows, "workflow_id", limit, status=status))


def agent_action_list(actions: DataFrame, status=None, limit: int = 20) -> DataFrame:
    return newest(actions, "action_id", limit, status=status)


def workflow_detail(workflows: DataFrame, workflow_id: int) -> DataFrame:
    return enrich_workflows(flt.lookup(workflows, "workflow_id", workflow_id))


# --- supply chain ------------------------------------------------------------------------

SHIPMENT_SORTS = ("ship_date", "cost_usd", "distance_miles", "quantity", "status")


def _shipment_roles(facilities: DataFrame, products: DataFrame) -> list:
    return [
        (facilities, ("origin_facility_id", "facility_id"), {"facility_name": "origin_name"}, "origin_"),
        (facilities, ("destination_facility_id", "facility_id"), {"facility_name": "dest_name"}, "dest_"),
        (products, ("product_id", "product_id"), ["product_name", "product_category"], ""),
    ]


def shipment_page(
    shipments: DataFrame,
    facilities: DataFrame,
    products: DataFrame,
    sort: str = "ship_date",
    order: str = "DESC",
    page: int = 1,
    per_page: int = 25,
    cold_only: bool = False,
    product_category=None,
    **wanted,
) -> DataFrame:
    """A page of shipments with both facilities and the product. Shipment filters come first."""
    listed = flt.filter_equals(shipments, **wanted)
    if cold_only:
        listed = flt.filter_present(listed, "temp_min_f")
    joined = star_join(listed, _shipment_roles(facilities, products))
    joined = flt.filter_equals(joined, product_category=product_category)
    ranked = whitelisted_order(sort, order, SHIPMENT_SORTS, "ship_date", ["shipment_id"])
    return paginate(joined, ranked, page, per_page)


def shipment_detail(shipments: DataFrame, facilities: DataFrame, products: DataFrame, shipment_id: str) -> DataFrame:
    return star_join(flt.lookup(shipments, "shipment_id", shipment_id), _shipment_roles(facilities, products))


def tracking_list(tracking: DataFrame, shipment_id: str) -> DataFrame:
    return flt.lookup(tracking, "shipment_id", shipment_id).orderBy("created_at")


def purchase_order_list(orders: DataFrame, status=None) -> DataFrame:
    """Every order, or those of one status, newest first."""
    return flt.filter_equals(orders, status=status).orderBy(F.col("created_at").desc(), F.col("po_id").desc())


def shipment_exception_list(exceptions: DataFrame, status=None) -> DataFrame:
    return flt.filter_equals(exceptions, status=status).orderBy(F.col("created_at").desc(), F.col("exception_id").desc())


def inventory_list(inventory: DataFrame, facilities: DataFrame, products: DataFrame, facility_id=None, product_category=None, below_reorder_only: bool = False) -> DataFrame:
    """Stock at the last snapshot, the shortest supply first."""
    latest = flt.at_latest_snapshot(inventory, "snapshot_date")
    listed = flt.filter_equals(latest, facility_id=facility_id)
    if below_reorder_only:
        listed = flt.filter_flag(listed, "below_reorder")
    joined = star_join(
        listed,
        [
            (facilities, ("facility_id", "facility_id"), ["facility_name"], ""),
            (products, ("product_id", "product_id"), ["product_name", "product_category"], ""),
        ],
    )
    return flt.filter_equals(joined, product_category=product_category).orderBy("days_of_supply")


def inventory_alerts(inventory: DataFrame, facilities: DataFrame, products: DataFrame, k: int = 50) -> DataFrame:
    """The most urgent items below their reorder point."""
    low = inventory_list(inventory, facilities, products, below_reorder_only=True)
    return top_k(low, ["days_of_supply", "facility_id", "product_id"], k)
