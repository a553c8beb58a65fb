"""Fleet-shaped frames derived from the source tables, and the same in SQL.

Each frame takes every row of its table; :func:`with_cte` puts the SQL twins before a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorpool.bindings.registry import Source
from motorpool.functions.hashing import pick
from motorpool.functions.scalars import case_map, clock_text, plus_minutes, text_time
from motorpool.operators.joins import star_join
from motorpool.plans.fleet import demand_multiplier

EVENTS_AS_OF = "2024-01-31"
EVENTS_MIDDLE = "2024-01-16"
ORDERS_AS_OF = "2001-08-01"
RIDES_AS_OF = "2001-10-01"

CTE: dict[str, str] = {}


def with_cte(names: str, body: str) -> str:
    """``WITH`` the named twins (in order) and the query."""
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in names.split()) + "\n" + body


def sql_round(x: str, digits: int) -> str:
    """Half-up rounding of a DOUBLE by its printed digits, as Spark rounds."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE)"


def text(prefix: str, column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.concat(F.lit(prefix), column.cast("string"))


def zones(src: Source) -> DataFrame:
    placed = star_join(src.nation, [(src.region, ("n_regionkey", "r_regionkey"), {"r_name": "city"}, "")])
    n = F.col("n_nationkey")
    return placed.select(
        text("Z", n).alias("zone_id"),
        F.col("n_name").alias("zone_name"),
        "city",
        (n + 20).alias("base_demand_per_hour"),
        (n % 9 + 4).alias("vehicle_capacity"),
        (F.lit(36.0) + n / F.lit(100.0)).alias("latitude"),
        (F.lit(-115.0) - n / F.lit(100.0)).alias("longitude"),
    )


CTE["zones"] = """
    SELECT 'Z' || n_nationkey AS zone_id, n_name AS zone_name, r_name AS city,
           n_nationkey + 20 AS base_demand_per_hour, n_nationkey % 9 + 4 AS vehicle_capacity,
           36.0::DOUBLE + n_nationkey / 100.0::DOUBLE AS latitude,
           -115.0::DOUBLE - n_nationkey / 100.0::DOUBLE AS longitude
    FROM nation JOIN region ON n_regionkey = r_regionkey"""


def vehicles(src: Source) -> DataFrame:
    homes = star_join(
        src.supplier,
        [
            (src.nation, ("s_nationkey", "n_nationkey"), {"n_regionkey": "regionkey"}, ""),
            (src.region, ("regionkey", "r_regionkey"), {"r_name": "city"}, ""),
        ],
    )
    key = F.col("s_suppkey")
    return homes.select(
        text("V-", key).alias("vehicle_id"),
        F.lit("Robotaxi").alias("model"),
        "city",
        text("Z", "s_nationkey").alias("current_zone"),
        pick(key % 7, ["active", "active", "active", "idle", "charging", "maintenance", "en_route"]).alias("status"),
        F.greatest(F.lit(0), F.floor(F.col("s_acctbal") / 100)).cast("int").alias("battery_pct"),
        (key % 26).cast("int").alias("rides_today"),
    )


CTE["vehicles"] = """
    SELECT 'V-' || s_suppkey AS vehicle_id, 'Robotaxi' AS model, r_name AS city,
           'Z' || s_nationkey AS current_zone,
           (['active', 'active', 'active', 'idle', 'charging', 'maintenance', 'en_route'])[(s_suppkey % 7 + 1)::INT] AS status,
           CAST(greatest(0, floor(s_acctbal / 100)) AS INT) AS battery_pct,
           CAST(s_suppkey % 26 AS INT) AS rides_today
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def rides(src: Source) -> DataFrame:
    request = plus_minutes("l_shipdate", F.col("l_orderkey") * 7 % 1440)
    return src.lineitem.select(
        F.concat_ws("-", F.lit("RD"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ride_id"),
        text("V-", "l_suppkey").alias("vehicle_id"),
        text("City ", F.col("l_suppkey") % 5).alias("city"),
        text("Z", F.col("l_suppkey") % 25).alias("pickup_zone"),
        text("Z", F.col("l_partkey") % 25).alias("dropoff_zone"),
        text_time(request).alias("request_time"),
        F.round(F.lit(2.0) + F.col("l_tax") * 100, 1).alias("wait_time_min"),
        F.col("l_quantity").alias("distance_miles"),
        F.col("l_extendedprice").alias("fare_usd"),
        case_map("l_returnflag", {"A": "completed", "R": "cancelled"}, "in_progress").alias("ride_status"),
    )


CTE["rides"] = """
    SELECT 'RD-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS ride_id,
           'V-' || l_suppkey AS vehicle_id, 'City ' || (l_suppkey % 5) AS city, 'Z' || (l_suppkey % 25) AS pickup_zone,
           'Z' || (l_partkey % 25) AS dropoff_zone,
           strftime(l_shipdate + to_minutes(l_orderkey * 7 % 1440), '%Y-%m-%d %H:%M:%S') AS request_time,
           round(2.0::DOUBLE + l_tax * 100, 1) AS wait_time_min, l_quantity AS distance_miles,
           l_extendedprice AS fare_usd,
           CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'R' THEN 'cancelled' ELSE 'in_progress' END AS ride_status
    FROM lineitem"""


def venue_events(src: Source) -> DataFrame:
    zone = text("Z", F.col("user_id") % 25)
    attendance = F.floor(F.col("value") * 200).cast("int")
    hour, minute = F.hour("ts"), F.minute("ts")
    return src.events.select(
        text("EVT-", "event_id").alias("event_id"),
        text("Venue ", F.col("user_id") % 40).alias("venue"),
        F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("event_name"),
        "event_type",
        text("City ", F.col("user_id") % 5).alias("city"),
        zone.alias("zone"),
        attendance.alias("expected_attendance"),
        F.col("ts").cast("date").alias("event_date"),
        clock_text(hour, minute).alias("start_time"),
        clock_text(F.least(hour + 3, F.lit(23)), minute).alias("end_time"),
        demand_multiplier(attendance).alias("demand_multiplier"),
    )


CTE["venue_events"] = f"""
    SELECT 'EVT-' || event_id AS event_id, 'Venue ' || (user_id % 40) AS venue,
           event_type || ' ' || user_id AS event_name, event_type, 'City ' || (user_id % 5) AS city, 'Z' || (user_id % 25) AS zone,
           CAST(floor(value * 200) AS INT) AS expected_attendance, CAST(ts AS DATE) AS event_date,
           lpad(hour(ts)::VARCHAR, 2, '0') || ':' || lpad(minute(ts)::VARCHAR, 2, '0') AS start_time,
           lpad(least(hour(ts) + 3, 23)::VARCHAR, 2, '0') || ':' || lpad(minute(ts)::VARCHAR, 2, '0') AS end_time,
           {sql_round("least(4.0::DOUBLE, greatest(1.5::DOUBLE, floor(value * 200) / 10000.0::DOUBLE))", 2)} AS demand_multiplier
    FROM events"""


def telemetry(src: Source) -> DataFrame:
    return src.events.select(
        text("V-", "user_id").alias("vehicle_id"),
        F.col("ts").alias("timestamp"),
        F.least(F.lit(100), F.floor("value")).cast("int").alias("battery_pct"),
        F.round(F.col("value") / 10, 1).alias("speed_mph"),
        (F.col("event_id") % 4).cast("int").alias("passenger_count"),
        text("Z", F.col("user_id") % 25).alias("zone"),
    )


CTE["telemetry"] = f"""
    SELECT 'V-' || user_id AS vehicle_id, ts AS "timestamp",
           CAST(least(100, floor(value)) AS INT) AS battery_pct, {sql_round("value / 10", 1)} AS speed_mph,
           CAST(event_id % 4 AS INT) AS passenger_count, 'Z' || (user_id % 25) AS zone
    FROM events"""


PRIORITY = {"1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "medium"}
_PRIORITY_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END"


def fleet_actions(src: Source) -> DataFrame:
    key, done = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
    return src.orders.select(
        key.alias("action_id"),
        pick(key % 5, ["rebalance", "surge_deploy", "recall", "charge_dispatch", "maintenance_pull"]).alias("action_type"),
        text("Z", F.col("o_custkey") % 25).alias("from_zone"),
        text("Z", key % 25).alias("to_zone"),
        (key % 4 + 1).cast("int").alias("vehicle_count"),
        text("City ", F.col("o_custkey") % 5).alias("city"),
        F.col("o_orderpriority").alias("reason"),
        case_map("o_orderpriority", PRIORITY, "low").alias("priority"),
        case_map("o_orderstatus", {"O": "pending", "P": "approved"}, "executed").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.when(done, F.col("o_orderdate") + F.make_dt_interval(F.lit(1))).alias("executed_at"),
    )


CTE["fleet_actions"] = f"""
    SELECT o_orderkey AS action_id,
           (['rebalance', 'surge_deploy', 'recall', 'charge_dispatch', 'maintenance_pull'])[(o_orderkey % 5 + 1)::INT] AS action_type,
           'Z' || (o_custkey % 25) AS from_zone, 'Z' || (o_orderkey % 25) AS to_zone,
           CAST(o_orderkey % 4 + 1 AS INT) AS vehicle_count, 'City ' || (o_custkey % 5) AS city,
           o_orderpriority AS reason, {_PRIORITY_SQL} AS priority,
           CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'approved' ELSE 'executed' END AS status,
           o_orderdate AS created_at,
           CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY END AS executed_at
    FROM orders"""

ALERT_STATUS = {"click": "open", "view": "acknowledged", "signup": "resolved", "purchase": "dismissed"}


def surge_alerts(src: Source) -> DataFrame:
    value, closed = F.col("value"), F.col("event_type").isin("signup", "purchase")
    return src.events.select(
        F.col("event_id").alias("alert_id"),
        text("Z", F.col("user_id") % 25).alias("zone_id"),
        text("City ", F.col("user_id") % 5).alias("city"),
        F.col("event_type").alias("event_name"),
        value.cast("decimal(5,2)").alias("predicted_demand_score"),
        (F.col("user_id") % 10).cast("int").alias("current_supply"),
        F.when(value < 20, "low").when(value < 60, "medium").when(value < 120, "high").otherwise("critical").alias("severity"),
        case_map("event_type", ALERT_STATUS, "open").alias("status"),
        F.lit("deploy").alias("recommended_action"),
        F.col("ts").alias("created_at"),
        F.when(closed, F.col("ts")).alias("resolved_at"),
    )


CTE["surge_alerts"] = """
    SELECT event_id AS alert_id, 'Z' || (user_id % 25) AS zone_id, 'City ' || (user_id % 5) AS city,
           event_type AS event_name, CAST(value AS DECIMAL(5, 2)) AS predicted_demand_score,
           CAST(user_id % 10 AS INT) AS current_supply,
           CASE WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'medium' WHEN value < 120 THEN 'high' ELSE 'critical' END AS severity,
           CASE event_type WHEN 'view' THEN 'acknowledged' WHEN 'signup' THEN 'resolved' WHEN 'purchase' THEN 'dismissed' ELSE 'open' END AS status,
           'deploy' AS recommended_action, ts AS created_at,
           CASE WHEN event_type IN ('signup', 'purchase') THEN ts END AS resolved_at
    FROM events"""


def dispatch_overrides(src: Source) -> DataFrame:
    key = F.col("c_custkey")
    return src.customer.select(
        key.alias("override_id"),
        text("V-", key % 100).alias("vehicle_id"),
        text("Z", "c_nationkey").alias("from_zone"),
        text("Z", key % 25).alias("to_zone"),
        text("City ", key % 5).alias("city"),
        F.col("c_mktsegment").alias("reason"),
        F.lit("operator").alias("override_by"),
        pick(key % 3, ["pending", "executed", "cancelled"]).alias("status"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"),
    )


CTE["dispatch_overrides"] = """
    SELECT c_custkey AS override_id, 'V-' || (c_custkey % 100) AS vehicle_id, 'Z' || c_nationkey AS from_zone,
           'Z' || (c_custkey % 25) AS to_zone, 'City ' || (c_custkey % 5) AS city, c_mktsegment AS reason,
           'operator' AS override_by, (['pending', 'executed', 'cancelled'])[(c_custkey % 3 + 1)::INT] AS status,
           TIMESTAMP '2024-01-01' AS created_at
    FROM customer"""


def workflows(src: Source) -> DataFrame:
    key, kind = F.col("o_orderkey"), F.col("o_orderkey") % 3
    closed = F.col("o_orderstatus") == "F"
    step = F.concat(
        F.lit('[{"step": 1, "tool": "scan", "label": "Order", "output": "'),
        key.cast("string"),
        F.lit('", "status": "completed"}]'),
    )
    return src.orders.select(
        key.alias("workflow_id"),
        pick(key % 4, ["rebalancing_request", "surge_response", "dispatch_override", "fleet_audit"]).alias("workflow_type"),
        pick(F.col("o_custkey") % 3, ["monitor", "chat", "manual"]).alias("trigger_source"),
        case_map("o_orderpriority", PRIORITY, "low").alias("severity"),
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"), F.lit(" asked with "), "o_orderpriority").alias("summary"),
        F.when(kind == 0, "[]").when(kind == 1, step).otherwise("not json").alias("reasoning_chain"),
        F.when(key % 2 == 0, "zone").alias("entity_type"),
        F.when(key % 7 == 0, "none").otherwise(F.col("o_custkey").cast("string")).alias("entity_id"),
        case_map("o_orderstatus", {"O": "pending_approval", "P": "in_progress"}, "approved").alias("status"),
        F.lit(None).cast("string").alias("result_data"),
        F.col("o_orderdate").alias("created_at"),
        F.when(closed, F.col("o_orderdate") + F.make_dt_interval(F.lit(1))).alias("completed_at"),
        F.lit(None).cast("long").alias("result_exception_id"),
        F.when(key % 11 == 0, "Set by hand").alias("headline"),
        F.lit(None).cast("string").alias("enriched_summary"),
    )


CTE["workflows"] = f"""
    SELECT o_orderkey AS workflow_id,
           (['rebalancing_request', 'surge_response', 'dispatch_override', 'fleet_audit'])[(o_orderkey % 4 + 1)::INT] AS workflow_type,
           (['monitor', 'chat', 'manual'])[(o_custkey % 3 + 1)::INT] AS trigger_source, {_PRIORITY_SQL} AS severity,
           'Customer ' || o_custkey || ' asked with ' || o_orderpriority AS summary,
           CASE o_orderkey % 3 WHEN 0 THEN '[]'
                WHEN 1 THEN '[{{"step": 1, "tool": "scan", "label": "Order", "output": "' || o_orderkey || '", "status": "completed"}}]'
                ELSE 'not json' END AS reasoning_chain,
           CASE WHEN o_orderkey % 2 = 0 THEN 'zone' END AS entity_type,
           CASE WHEN o_orderkey % 7 = 0 THEN 'none' ELSE o_custkey::VARCHAR END AS entity_id,
           CASE o_orderstatus WHEN 'O' THEN 'pending_approval' WHEN 'P' THEN 'in_progress' ELSE 'approved' END AS status,
           o_orderdate AS created_at,
           CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY END AS completed_at,
           CASE WHEN o_orderkey % 11 = 0 THEN 'Set by hand' END AS headline
    FROM orders"""


def notes(src: Source) -> DataFrame:
    key = F.col("conv_id") * 100 + F.col("turn")
    return src.conversations.select(
        key.alias("note_id"),
        F.when(F.col("role") == "system", "zone").otherwise("vehicle").alias("entity_type"),
        text("V-", F.col("conv_id") % 40).alias("entity_id"),
        F.col("text").alias("note_text"),
        F.col("role").alias("author"),
        plus_minutes(F.lit("2024-01-01").cast("timestamp_ntz"), key % 100000).alias("created_at"),
    )


CTE["notes"] = """
    SELECT conv_id * 100 + turn AS note_id, CASE WHEN role = 'system' THEN 'zone' ELSE 'vehicle' END AS entity_type,
           'V-' || (conv_id % 40) AS entity_id, "text" AS note_text, role AS author,
           TIMESTAMP '2024-01-01' + to_minutes((conv_id * 100 + turn) % 100000) AS created_at
    FROM conversations"""


def shipments(src: Source) -> DataFrame:
    shipped = F.col("l_shipdate").cast("date")
    return src.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("shipment_id"),
        shipped.alias("ship_date"),
        F.col("l_extendedprice").alias("cost_usd"),
        F.col("l_quantity").alias("distance_miles"),
        case_map("l_returnflag", {"A": "delivered", "R": "delayed"}, "in_transit").alias("status"),
        F.date_add(shipped, F.col("l_linenumber") % 3 + 3).alias("expected_delivery_date"),
        F.date_add(shipped, (F.col("l_partkey") % 5 + 1).cast("int")).alias("actual_delivery_date"),
        F.col("l_suppkey").alias("origin_facility_id"),
        (F.col("l_partkey") % 10).alias("destination_facility_id"),
        F.col("l_partkey").alias("product_id"),
        pick(F.col("l_orderkey") % 3, ["road", "rail", "air"]).alias("transport_mode"),
        F.when(F.col("l_tax") > 0.04, F.col("l_discount") * 100).alias("temp_min_f"),
    )


CTE["shipments"] = """
    SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS shipment_id,
           CAST(l_shipdate AS DATE) AS ship_date, l_extendedprice AS cost_usd, l_quantity AS distance_miles,
           CASE l_returnflag WHEN 'A' THEN 'delivered' WHEN 'R' THEN 'delayed' ELSE 'in_transit' END AS status,
           CAST(l_shipdate AS DATE) + CAST(l_linenumber % 3 + 3 AS INT) AS expected_delivery_date,
           CAST(l_shipdate AS DATE) + CAST(l_partkey % 5 + 1 AS INT) AS actual_delivery_date,
           l_suppkey AS origin_facility_id, l_partkey % 10 AS destination_facility_id, l_partkey AS product_id,
           (['road', 'rail', 'air'])[(l_orderkey % 3 + 1)::INT] AS transport_mode,
           CASE WHEN l_tax > 0.04 THEN l_discount * 100 END AS temp_min_f
    FROM lineitem"""


def inventory(src: Source) -> DataFrame:
    return src.lineitem.select(
        F.col("l_shipdate").cast("date").alias("snapshot_date"),
        F.col("l_suppkey").alias("facility_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").alias("quantity_on_hand"),
        (F.col("l_quantity") < 20).alias("below_reorder"),
        F.round(F.col("l_quantity") / 7, 2).alias("days_of_supply"),
    )


CTE["inventory"] = """
    SELECT CAST(l_shipdate AS DATE) AS snapshot_date, l_suppkey AS facility_id, l_partkey AS product_id,
           l_quantity AS quantity_on_hand, l_quantity < 20 AS below_reorder, round(l_quantity / 7, 2) AS days_of_supply
    FROM lineitem"""
