"""The supply-chain tables, chat sessions, and the page lists that read them."""

from pyspark.sql import functions as F

from motorpool.bindings import domain
from motorpool.bindings.changes import _SEQ, _seq
from motorpool.bindings.domain import with_cte
from motorpool.bindings.registry import Source, query
from motorpool.functions.scalars import case_map
from motorpool.operators.activity import supply_workflows
from motorpool.operators.aggregates import count_by, weighted_share
from motorpool.operators.ordering import page_after, paginate
from motorpool.plans import dashboard, listings
from motorpool.plans import operations as ops
from motorpool.schemas import OPS_TABLES
from motorpool.sources.tables import literal_rows

_TYPES = {"1-URGENT": "cold_chain", "2-HIGH": "delay", "3-MEDIUM": "damage", "4-NOT SPECIFIED": "customs"}


def purchase_orders(src: Source):
    """One order per customer order, half of them drafts."""
    key = F.col("o_orderkey")
    rows = src.orders.select(
        key.alias("po_id"),
        domain.text("PO-", key).alias("po_number"),
        (F.col("o_custkey") % 10).alias("supplier_facility_id"),
        (F.col("o_custkey") % 7).alias("destination_facility_id"),
        (F.col("o_custkey") % 100).alias("product_id"),
        (key % 50).cast("int").alias("quantity"),
        F.col("o_totalprice").alias("unit_cost_usd"),
        F.col("o_orderdate").cast("date").alias("requested_date"),
        F.lit(None).cast("date").alias("expected_date"),
        F.lit("agent").alias("created_by"),
        F.when(key % 2 == 0, "draft").otherwise("submitted").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
    )
    return rows


domain.CTE["purchase_orders"] = """
    SELECT o_orderkey AS po_id, 'PO-' || o_orderkey AS po_number, (o_orderkey % 50)::INT AS quantity, CAST(NULL AS DATE) AS expected_date,
           CASE WHEN o_orderkey % 2 = 0 THEN 'draft' ELSE 'submitted' END AS status, o_orderdate AS created_at, o_orderdate AS updated_at
    FROM orders"""


def shipment_exceptions(src: Source):
    key = F.col("o_orderkey")
    return src.orders.select(
        key.alias("exception_id"),
        domain.text("S-", "o_custkey").alias("shipment_id"),
        case_map("o_orderpriority", _TYPES, "other").alias("exception_type"),
        F.lit("medium").alias("severity"),
        F.col("o_orderpriority").alias("description"),
        F.lit(None).cast("string").alias("assigned_to"),
        F.lit("open").alias("status"),
        F.lit(None).cast("string").alias("resolution"),
        F.col("o_orderdate").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
    )


def _new_rows(src: Source, table: str):
    return literal_rows(src.spark, [], OPS_TABLES[table])


@query(
    "j01_purchase_orders",
    """
    SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS po_id, 'PO-' || l_orderkey || '-' || l_linenumber AS po_number,
           l_partkey AS product_id, 'draft' AS status, TIMESTAMP '2001-10-01' AS created_at FROM lineitem WHERE l_linenumber IS NOT NULL""",
)
def _(src: Source):
    rows = src.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.concat(F.lit("PO-"), F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("po_number"),
        F.col("l_partkey").alias("product_id"),
    )
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    made = ops.insert_checked("purchase_orders", _new_rows(src, "purchase_orders"), rows, order, domain.RIDES_AS_OF)
    return made.rows.select("po_id", "po_number", "product_id", "status", "created_at")


@query(
    "j01_tracking",
    """
    SELECT row_number() OVER (ORDER BY event_id) AS tracking_id, 'S-' || user_id AS shipment_id, event_type AS status,
           value AS temperature_f, TIMESTAMP '2024-01-31' AS created_at FROM events WHERE event_type <> 'error'""",
)
def _(src: Source):
    rows = src.events.select(
        "event_id",
        domain.text("S-", "user_id").alias("shipment_id"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("status"),
        F.col("value").alias("temperature_f"),
    )
    made = ops.insert_checked("shipment_tracking", _new_rows(src, "shipment_tracking"), rows, ["event_id"], domain.EVENTS_AS_OF)
    return made.rows.select("tracking_id", "shipment_id", "status", "temperature_f", "created_at")


_NEW_EXCEPTIONS = """
    SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'extreme' END AS severity,
           CASE WHEN o_custkey % 3 = 0 THEN '' WHEN o_custkey % 3 = 1 THEN 'desk' END AS assigned_to FROM orders"""


@query(
    "j01_shipment_exceptions",
    f"""
    SELECT coalesce(severity, 'medium') AS severity, 'open' AS status, nullif(assigned_to, '') AS assigned_to, count(*) AS rows, min(o_orderkey) AS first_key
    FROM ({_NEW_EXCEPTIONS}) WHERE coalesce(severity, '') <> 'extreme' GROUP BY 1, 3""",
)
def _(src: Source):
    rows = src.orders.select(
        "o_orderkey",
        domain.text("S-", "o_custkey").alias("shipment_id"),
        F.lit("delay").alias("exception_type"),
        case_map("o_orderpriority", {"1-URGENT": "high", "2-HIGH": "extreme"}).alias("severity"),
        F.when(F.col("o_custkey") % 3 == 0, "").when(F.col("o_custkey") % 3 == 1, "desk").alias("assigned_to"),
    )
    ok, _ = ops.check_new("shipment_exceptions", _new_rows(src, "shipment_exceptions"), rows)
    return ok.groupBy("severity", "status", "assigned_to").agg(F.count(F.lit(1)).alias("rows"), F.min("o_orderkey").alias("first_key"))


_LAST = f"""
    SELECT l_orderkey AS k, arg_max(s, seq) FILTER (WHERE s IS NOT NULL) AS status, arg_max(r, seq) FILTER (WHERE r IS NOT NULL) AS resolution,
           bool_or(s = 'resolved') AS resolved, count(*) FILTER (WHERE s IS NOT NULL OR r IS NOT NULL) AS n
    FROM (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'resolved' WHEN 'R' THEN 'acknowledged' END AS s,
                 CASE WHEN l_linestatus = 'F' THEN 'seen' END AS r, {_SEQ} AS seq FROM lineitem) GROUP BY 1"""


@query(
    "j04_patch_stamps",
    f"""
    SELECT o_orderkey AS exception_id, coalesce(c.status, 'open') AS status, c.resolution,
           CASE WHEN c.resolved THEN TIMESTAMP '2001-10-01' END AS resolved_at
    FROM orders LEFT JOIN ({_LAST}) c ON c.k = o_orderkey""",
)
def _(src: Source):
    commands = src.lineitem.select(
        F.col("l_orderkey").alias("exception_id"),
        case_map("l_returnflag", {"A": "resolved", "R": "acknowledged"}, "").alias("status"),
        F.when(F.col("l_linestatus") == "F", "seen").alias("resolution"),
        F.lit("").alias("assigned_to"),
        _seq().alias("seq"),
    )
    updated, _ = ops.patch("shipment_exceptions", shipment_exceptions(src), commands, "seq", domain.RIDES_AS_OF)
    return updated.select("exception_id", "status", "resolution", "resolved_at")


@query(
    "j04_purchase_orders",
    with_cte(
        "purchase_orders",
        f"""SELECT po_id, coalesce(c.s, status) AS status, strftime(c.d, '%Y-%m-%d') AS expected_day,
                   CASE WHEN c.k IS NOT NULL THEN TIMESTAMP '2001-10-01' ELSE updated_at END AS updated_at
            FROM purchase_orders LEFT JOIN (
              SELECT l_orderkey AS k, arg_max(s, seq) FILTER (WHERE s IS NOT NULL) AS s, arg_max(d, seq) FILTER (WHERE d IS NOT NULL) AS d
              FROM (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'received' WHEN 'R' THEN 'cancelled' END AS s,
                           CASE WHEN l_linestatus = 'O' THEN CAST(l_shipdate AS DATE) END AS d, {_SEQ} AS seq FROM lineitem)
              WHERE s IS NOT NULL OR d IS NOT NULL GROUP BY 1) c ON c.k = po_id""",
    ),
)
def _(src: Source):
    commands = src.lineitem.select(
        F.col("l_orderkey").alias("po_id"),
        case_map("l_returnflag", {"A": "received", "R": "cancelled"}).alias("status"),
        F.when(F.col("l_linestatus") == "O", F.col("l_shipdate").cast("date")).alias("expected_date"),
        _seq().alias("seq"),
    )
    updated, _ = ops.patch("purchase_orders", purchase_orders(src), commands, "seq", domain.RIDES_AS_OF)
    return updated.select("po_id", "status", F.col("expected_date").cast("string").alias("expected_day"), "updated_at")


@query("f04_purchase_order_list", with_cte("purchase_orders", "SELECT po_id, po_number, status, created_at FROM purchase_orders WHERE status = 'draft'"))
def _(src: Source):
    return listings.purchase_order_list(purchase_orders(src), "draft").select("po_id", "po_number", "status", "created_at")


@query("f04_shipment_exception_list", "SELECT o_orderkey AS exception_id, o_orderpriority AS description, 'open' AS status FROM orders")
def _(src: Source):
    return listings.shipment_exception_list(shipment_exceptions(src), "open").select("exception_id", "description", "status")


_SESSIONS = """
    SELECT conv_id::VARCHAR AS session_id, 'Talk ' || conv_id AS title, TIMESTAMP '2024-01-01' + to_minutes(max(turn)) AS updated_at
    FROM conversations GROUP BY conv_id"""


def _sessions(src: Source):
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), F.max("turn").cast("int"))
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    return src.conversations.groupBy("conv_id").agg((start + minutes).alias("updated_at")).select(
        F.col("conv_id").cast("string").alias("session_id"),
        domain.text("Talk ", "conv_id").alias("title"),
        start.alias("created_at"),
        "updated_at",
    )


@query(
    "j05_open_sessions",
    f"""
    SELECT session_id, title, updated_at FROM ({_SESSIONS})
    UNION ALL SELECT DISTINCT doc_id::VARCHAR, 'New conversation', TIMESTAMP '2024-01-31' FROM documents
    WHERE doc_id::VARCHAR NOT IN (SELECT session_id FROM ({_SESSIONS}))""",
)
def _(src: Source):
    wanted = src.documents.select(F.col("doc_id").cast("string").alias("session_id"))
    return ops.open_sessions(_sessions(src), wanted, domain.EVENTS_AS_OF).select("session_id", "title", "updated_at")


@query("j10_newest_session", f"SELECT session_id, title FROM ({_SESSIONS}) ORDER BY updated_at DESC, session_id LIMIT 1")
def _(src: Source):
    return ops.newest_session(_sessions(src)).select("session_id", "title")


_SUPPLY_KINDS = "(['auto_reorder', 'delay_response', 'cold_chain_escalation', 'fleet_audit'])[(workflow_id % 4 + 1)::INT]"


@query(
    "j07_supply_workflows",
    with_cte(
        "workflows",
        f"""SELECT workflow_id, CASE kind WHEN 'auto_reorder' THEN coalesce('Auto-Reorder: ' || entity, 'Auto-Reorder Triggered')
                     WHEN 'delay_response' THEN coalesce('Delay Response: Shipment ' || entity, 'Delay Response')
                     WHEN 'cold_chain_escalation' THEN coalesce('Cold Chain Alert: ' || entity, 'Cold Chain Alert')
                     ELSE left(summary, 80) END AS headline,
                   CASE WHEN workflow_id % 3 = 1 THEN 1 ELSE 0 END AS steps
            FROM (SELECT *, {_SUPPLY_KINDS} AS kind, CASE WHEN workflow_id % 5 <> 0 THEN entity_id END AS entity FROM workflows)""",
    ),
)
def _(src: Source):
    kinds = F.array(*map(F.lit, ["auto_reorder", "delay_response", "cold_chain_escalation", "fleet_audit"]))
    typed = domain.workflows(src).withColumns(
        {
            "workflow_type": F.element_at(kinds, (F.col("workflow_id") % 4 + 1).cast("int")),
            "entity_id": F.when(F.col("workflow_id") % 5 != 0, F.col("entity_id")).otherwise(""),
        }
    )
    return supply_workflows(typed).select("workflow_id", "headline", F.size("reasoning_chain").alias("steps"))


def _overview(src: Source):
    return dashboard.agent_overview(domain.workflows(src), domain.fleet_actions(src), domain.ORDERS_AS_OF)


@query(
    "d12_agent_counts",
    with_cte(
        "workflows fleet_actions",
        """SELECT 'workflow_status' AS part, status AS name, count(*) AS cnt FROM workflows GROUP BY status
           UNION ALL SELECT 'action_status', status, count(*) FROM fleet_actions GROUP BY status
           UNION ALL SELECT 'workflow_types', workflow_type, count(*) FROM workflows WHERE created_at >= TIMESTAMP '2001-08-01' - INTERVAL 7 DAY GROUP BY 2""",
    ),
)
def _(src: Source):
    parts = _overview(src)
    frames = [parts[p].toDF("name", "cnt").select(F.lit(p).alias("part"), "name", "cnt") for p in ("workflow_status", "action_status", "workflow_types")]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query(
    "f01_agent_workflows",
    with_cte("workflows", "SELECT workflow_id, summary AS enriched_summary, created_at FROM workflows ORDER BY created_at DESC, workflow_id DESC LIMIT 50"),
)
def _(src: Source):
    return _overview(src)["workflows"].select("workflow_id", "enriched_summary", "created_at")


@query(
    "f01_agent_actions",
    with_cte("fleet_actions", "SELECT action_id, status, created_at FROM fleet_actions WHERE status = 'pending' ORDER BY created_at DESC, action_id DESC LIMIT 20"),
)
def _(src: Source):
    return listings.agent_action_list(domain.fleet_actions(src), "pending").select("action_id", "status", "created_at")


def _context(src: Source):
    return dashboard.briefing_context(
        domain.surge_alerts(src), domain.workflows(src), domain.fleet_actions(src), domain.vehicles(src), domain.venue_events(src),
        domain.surge_alerts(src), domain.fleet_actions(src), domain.EVENTS_MIDDLE,
    )


@query(
    "d14_context_counts",
    with_cte(
        "vehicles surge_alerts fleet_actions",
        """SELECT count(*) AS total_vehicles, count(*) FILTER (WHERE status = 'active') AS active, round(avg(battery_pct), 6) AS avg_battery,
                  (SELECT count(*) FROM fleet_actions WHERE created_at >= TIMESTAMP '2024-01-16' - INTERVAL 24 HOUR) AS agent_actions_24h,
                  (SELECT count(*) FROM surge_alerts WHERE status = 'open') AS open_alerts,
                  (SELECT count(*) FROM fleet_actions WHERE status = 'pending') AS pending_actions FROM vehicles""",
    ),
)
def _(src: Source):
    return _context(src)["counts"].withColumn("avg_battery", F.round("avg_battery", 6))


@query(
    "d14_context_open",
    with_cte(
        "surge_alerts workflows",
        """SELECT 'exceptions' AS part, severity AS name, count(*) AS cnt FROM surge_alerts WHERE status = 'open' GROUP BY severity
           UNION ALL SELECT 'workflows', status, count(*) FROM workflows GROUP BY status""",
    ),
)
def _(src: Source):
    parts = _context(src)
    one, two = (parts[p].toDF("name", "cnt").select(F.lit(p).alias("part"), "name", "cnt") for p in ("exceptions", "workflows"))
    return one.unionByName(two)


@query(
    "d14_context_events",
    with_cte(
        "venue_events",
        """SELECT event_id, event_name, strftime(event_date, '%Y-%m-%d') AS event_day, expected_attendance, demand_multiplier
           FROM venue_events WHERE event_date >= DATE '2024-01-16' ORDER BY event_date, start_time, event_id LIMIT 5""",
    ),
)
def _(src: Source):
    events = _context(src)["events"].withColumn("event_day", F.col("event_date").cast("string"))
    return events.select("event_id", "event_name", "event_day", "expected_attendance", "demand_multiplier")


@query(
    "d11_supply_filters",
    """
    SELECT 'division' AS name, s_name[1:10] AS value FROM supplier UNION SELECT 'region', s_nationkey::VARCHAR FROM supplier
    UNION SELECT 'facility_type', CASE WHEN s_acctbal > 0 THEN 'plant' ELSE 'depot' END FROM supplier
    UNION SELECT 'product_category', p_brand FROM part UNION SELECT 'carrier', l_returnflag FROM lineitem
    UNION SELECT 'transport_mode', (['road', 'rail', 'air'])[(l_orderkey % 3 + 1)::INT] FROM lineitem
    UNION SELECT 'status', CASE l_returnflag WHEN 'A' THEN 'delivered' WHEN 'R' THEN 'delayed' ELSE 'in_transit' END FROM lineitem""",
)
def _(src: Source):
    facilities = src.supplier.select(
        F.left("s_name", F.lit(10)).alias("division"),
        F.col("s_nationkey").alias("region"),
        F.when(F.col("s_acctbal") > 0, "plant").otherwise("depot").alias("facility_type"),
    )
    products = src.part.select(F.col("p_brand").alias("product_category"))
    carriers = case_map("status", {"delivered": "A", "delayed": "R"}, "N").alias("carrier")
    return dashboard.supply_filter_lists(facilities, products, domain.shipments(src).select("*", carriers))


@query("d11_zone_pairs", with_cte("zones", "SELECT DISTINCT zone_id, city FROM zones"))
def _(src: Source):
    return domain.zones(src).select("zone_id", "city").distinct()


@query(
    "c12_zone_overview",
    with_cte(
        "zones vehicles",
        """SELECT zone_id, zone_name, coalesce(n, 0) AS current_vehicles, round(coalesce(b, 0), 6) AS avg_battery
           FROM zones LEFT JOIN (SELECT current_zone, count(*) AS n, avg(battery_pct) AS b FROM vehicles GROUP BY 1) ON current_zone = zone_id""",
    ),
)
def _(src: Source):
    zones = dashboard.zone_overview(domain.zones(src), domain.vehicles(src))
    return zones.select("zone_id", "zone_name", "current_vehicles", F.round("avg_battery", 6).alias("avg_battery"))


_ORDERED = "SELECT event_id, ts, value, count(*) OVER () AS total FROM events ORDER BY ts DESC, event_id"


@query("f02_deep_page", f"{_ORDERED} LIMIT 40 OFFSET 4960")
def _(src: Source):
    rows = src.events.select("event_id", "ts", "value")
    return paginate(rows, [F.col("ts").desc(), F.col("event_id")], 125, 40)


@query("f02_page_after", "SELECT event_id, value FROM events WHERE event_id > 4000 ORDER BY event_id LIMIT 40")
def _(src: Source):
    return page_after(src.events.select("event_id", "value"), [("event_id", False)], [4000], 40)


@query("d04_weighted_share_digits", "SELECT round(100.0::DOUBLE * sum(CASE WHEN event_type = 'click' THEN CAST(value AS DECIMAL(18, 2)) END) / sum(CAST(value AS DECIMAL(18, 2))), 1) AS pct FROM events")
def _(src: Source):
    small = src.events.withColumn("weight", (F.col("value").cast("decimal(18,2)") / 10000).cast("double"))
    return small.agg(weighted_share("weight", F.col("event_type") == "click").alias("pct"))


@query("j02_new_rejects", f"SELECT 'severity is known' AS rule, count(*) AS cnt FROM ({_NEW_EXCEPTIONS}) WHERE severity = 'extreme'")
def _(src: Source):
    rows = src.orders.select(
        domain.text("S-", "o_custkey").alias("shipment_id"),
        F.lit("delay").alias("exception_type"),
        case_map("o_orderpriority", {"1-URGENT": "high", "2-HIGH": "extreme"}).alias("severity"),
    )
    _, rejects = ops.check_new("shipment_exceptions", _new_rows(src, "shipment_exceptions"), rows)
    return count_by(rejects.select(F.explode("broken_rules").alias("rule")), ["rule"])
