"""Joins."""

from pyspark.sql import functions as F

from motorpool.bindings import domain
from motorpool.bindings.domain import with_cte
from motorpool.bindings.registry import Source, query
from motorpool.functions.hashing import hash_int
from motorpool.operators import joins as J
from motorpool.operators.aggregates import ratio_to_table_count
from motorpool.operators.filters import at_latest_snapshot
from motorpool.plans.dashboard import vehicle_detail
from motorpool.schemas import struct
from motorpool.session import scratch_path
from motorpool.sources import keyed
from motorpool.sources.tables import inline_table


@query(
    "c01_enrich_left",
    with_cte(
        "zones venue_events",
        """SELECT e.event_id, e.zone, z.zone_name, z.latitude, z.longitude
           FROM venue_events e LEFT JOIN zones z ON e.zone = z.zone_id""",
    ),
)
def _(src: Source):
    return J.enrich_left(
        domain.venue_events(src), domain.zones(src), ("zone", "zone_id"), ["zone_name", "latitude", "longitude"]
    ).select("event_id", "zone", "zone_name", "latitude", "longitude")


@query(
    "c02_star_join",
    """
    SELECT ns.n_name AS origin_name, nc.n_name AS dest_name, p_type, count(*) AS shipments,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS cost
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
    JOIN nation ns ON s_nationkey = ns.n_nationkey JOIN nation nc ON c_nationkey = nc.n_nationkey
    GROUP BY 1, 2, 3""",
)
def _(src: Source):
    lines = J.star_join(
        src.lineitem.select("l_orderkey", "l_suppkey", "l_partkey", "l_extendedprice"),
        [
            (src.supplier, ("l_suppkey", "s_suppkey"), {"s_nationkey": "from_key"}, ""),
            (src.part, ("l_partkey", "p_partkey"), ["p_type"], ""),
            (src.orders, ("l_orderkey", "o_orderkey"), {"o_custkey": "custkey"}, ""),
            (src.customer, ("custkey", "c_custkey"), {"c_nationkey": "to_key"}, ""),
            (src.nation, ("from_key", "n_nationkey"), {"n_name": "origin_name"}, "o_"),
            (src.nation, ("to_key", "n_nationkey"), {"n_name": "dest_name"}, "d_"),
        ],
    )
    return lines.groupBy("origin_name", "dest_name", "p_type").agg(
        F.count(F.lit(1)).alias("shipments"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("cost"),
    )


@query(
    "c03_snapshot_join",
    with_cte(
        "inventory",
        """SELECT facility_id, s_name AS facility_name, product_id, p_name AS product_name, quantity_on_hand, days_of_supply
           FROM inventory JOIN supplier ON facility_id = s_suppkey JOIN part ON product_id = p_partkey
           WHERE snapshot_date = (SELECT max(snapshot_date) FROM inventory)""",
    ),
)
def _(src: Source):
    latest = at_latest_snapshot(domain.inventory(src), "snapshot_date")
    return J.star_join(
        latest,
        [
            (src.supplier, ("facility_id", "s_suppkey"), {"s_name": "facility_name"}, ""),
            (src.part, ("product_id", "p_partkey"), {"p_name": "product_name"}, ""),
        ],
    ).select("facility_id", "facility_name", "product_id", "product_name", "quantity_on_hand", "days_of_supply")


# Windows are the error events with text bounds; points are all the other events.
_WINDOWS = """
    SELECT event_id AS window_id, strptime(strftime(ts, '%Y-%m-%d %H:%M'), '%Y-%m-%d %H:%M') AS start_ts,
           strptime(strftime(ts, '%Y-%m-%d ') || lpad(least(hour(ts) + 3, 23)::VARCHAR, 2, '0') || strftime(ts, ':%M'), '%Y-%m-%d %H:%M') AS end_ts
    FROM events WHERE event_type = 'error'"""


def _windows(src: Source):
    errors = domain.venue_events(src).filter("event_type = 'error'")
    return J.event_bounds(errors, "event_date", "start_time", "end_time").select(
        F.substring("event_id", 5, 20).cast("long").alias("window_id"), "window_start", "window_end"
    )


def _points(src: Source):
    return src.events.filter("event_type != 'error'").withColumn("zone", (F.col("user_id") % 25).cast("int"))


@query(
    "c04_range_stats",
    f"""
    SELECT w.window_id, CAST(p.user_id % 25 AS INT) AS zone, count(*) AS n,
           CAST(sum(CAST(p.value AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS mean
    FROM ({_WINDOWS}) w JOIN events p ON p.ts >= w.start_ts AND p.ts < w.end_ts
    WHERE p.event_type <> 'error' GROUP BY 1, 2""",
)
def _(src: Source):
    return J.range_stats(
        _points(src), _windows(src), "ts", "window_start", "window_end", ["zone"], "value", "window_id"
    )


@query(
    "c04_range_join_inner",
    f"""
    SELECT p.event_id, CAST(p.user_id % 25 AS INT) AS zone, w.window_id FROM ({_WINDOWS}) w
    JOIN events p ON p.ts >= w.start_ts AND p.ts < w.end_ts WHERE p.event_type <> 'error'""",
)
def _(src: Source):
    joined = J.range_join(_points(src), _windows(src), "ts", "window_start", "window_end")
    return joined.select("event_id", "zone", "window_id")


_ZONED = f"SELECT w.*, CAST(e.user_id % 25 AS INT) AS zone FROM ({_WINDOWS}) w JOIN events e ON e.event_id = w.window_id"


def _zoned_windows(src: Source):
    return _windows(src).join(
        src.events.select(F.col("event_id").alias("window_id"), (F.col("user_id") % 25).cast("int").alias("zone")), "window_id"
    )


@query(
    "c04_range_join_keys",
    f"""
    SELECT p.event_id, w.zone, w.window_id FROM ({_ZONED}) w
    JOIN events p ON p.ts >= w.start_ts AND p.ts < w.end_ts AND p.user_id % 25 = w.zone WHERE p.event_type <> 'error'""",
)
def _(src: Source):
    joined = J.range_join(_points(src), _zoned_windows(src), "ts", "window_start", "window_end", ["zone"])
    return joined.select("event_id", "zone", "window_id")


@query(
    "c04_range_join_left",
    f"""
    SELECT p.event_id, CAST(p.user_id % 25 AS INT) AS zone, w.window_id FROM events p
    LEFT JOIN ({_ZONED}) w ON p.ts >= w.start_ts AND p.ts < w.end_ts AND p.user_id % 25 = w.zone WHERE p.event_type <> 'error'""",
)
def _(src: Source):
    joined = J.range_join(_points(src), _zoned_windows(src), "ts", "window_start", "window_end", ["zone"], how="left")
    return joined.select("event_id", "zone", "window_id")


# Four digits after the point: the mean of 0.0004 and 0.0002 is not 0.
@query(
    "c04_range_stats_digits",
    f"""
    SELECT w.window_id, CAST(sum(CAST(p.value AS DECIMAL(18, 2)) * CAST(0.0001 AS DECIMAL(6, 4))) AS DOUBLE) / count(p.value) AS mean, count(*) AS n
    FROM ({_WINDOWS}) w JOIN events p ON p.ts >= w.start_ts AND p.ts < w.end_ts WHERE p.event_type <> 'error' GROUP BY 1""",
)
def _(src: Source):
    fine = _points(src).withColumn("fine", (F.col("value").cast("decimal(18,2)") / 10000).cast("double"))
    return J.range_stats(fine, _windows(src), "ts", "window_start", "window_end", [], "fine", "window_id")


@query(
    "c04_points_in_windows",
    f"""
    SELECT p.event_id, p.ts FROM events p
    WHERE p.event_type <> 'error' AND EXISTS (SELECT 1 FROM ({_WINDOWS}) w WHERE p.ts >= w.start_ts AND p.ts < w.end_ts)""",
)
def _(src: Source):
    inside = J.range_join(_points(src), _windows(src), "ts", "window_start", "window_end", how="semi")
    return inside.select("event_id", "ts")


@query(
    "c05_grid",
    """
    SELECT s_suppkey, strftime(d, '%Y-%m-%d') AS day, CAST(h AS INT) AS hour
    FROM supplier, (SELECT CAST(unnest(generate_series(DATE '2024-01-16', DATE '2024-01-19', INTERVAL 1 DAY)) AS DATE) AS d),
         (SELECT unnest(range(0, 24, 3)) AS h)""",
)
def _(src: Source):
    first = F.lit(domain.EVENTS_MIDDLE).cast("date")
    cells = J.grid(
        src.supplier, day=F.sequence(first, F.date_add(first, 3)), hour=F.sequence(F.lit(0), F.lit(21), F.lit(3))
    )
    return cells.select("s_suppkey", F.col("day").cast("string").alias("day"), "hour")


@query(
    "c06_left_default",
    """
    SELECT s_suppkey, strftime(c.d, '%Y-%m-%d') AS day, coalesce(m.top, 1.0::DOUBLE) AS top
    FROM supplier CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '2024-01-16', DATE '2024-01-19', INTERVAL 1 DAY)) AS DATE) AS d) c
    LEFT JOIN (SELECT user_id, CAST(ts AS DATE) AS d, max(value) AS top FROM events GROUP BY 1, 2) m
      ON m.user_id = s_suppkey AND m.d = c.d""",
)
def _(src: Source):
    first = F.lit(domain.EVENTS_MIDDLE).cast("date")
    cells = J.grid(src.supplier.select("s_suppkey"), d=F.sequence(first, F.date_add(first, 3)))
    best = src.events.groupBy(F.col("user_id").alias("s_suppkey"), F.col("ts").cast("date").alias("d")).agg(
        F.max("value").alias("top")
    )
    return J.left_default(cells, best, ["s_suppkey", "d"], "top", 1.0).select(
        "s_suppkey", F.col("d").cast("string").alias("day"), "top"
    )


_LISTS = [
    ("click", 1, "map"),
    ("click", 2, "menu"),
    ("view", 1, "page"),
    ("view", 2, "card"),
    ("view", 3, "list"),
    ("signup", 1, "form"),
    ("purchase", 1, "ride"),
    ("purchase", 2, "pass"),
    ("error", 1, "timeout"),
]


@query(
    "c07_pick_from_list",
    f"""
    WITH items(event_type, idx, label) AS (VALUES {", ".join(str(r) for r in _LISTS)}),
    sizes AS (SELECT event_type, max(idx) AS n FROM items GROUP BY 1)
    SELECT e.event_id, i.label
    FROM events e JOIN sizes s ON s.event_type = e.event_type
    JOIN items i ON i.event_type = e.event_type
     AND i.idx = ('0x' || substr(sha256('pick-' || e.event_id), 1, 8))::BIGINT % s.n + 1""",
)
def _(src: Source):
    items = inline_table(src.spark, _LISTS, struct("event_type:str idx:int label:str"))
    sizes = F.broadcast(items.groupBy("event_type").agg(F.max("idx").alias("n")))
    drawn = src.events.join(sizes, "event_type").withColumn(
        "idx", hash_int(domain.text("pick-", "event_id"), F.lit(1), F.col("n"))
    )
    return J.pick_from_list(drawn, items, ["event_type", "idx"]).select("event_id", "label")


@query(
    "c08_first_match",
    """
    SELECT c_custkey, coalesce(CASE WHEN c_mktsegment = 'BUILDING' THEN n.n_name END,
                               CASE WHEN c_mktsegment = 'FURNITURE' THEN r.r_name END) AS label
    FROM customer
    LEFT JOIN nation n ON c_mktsegment = 'BUILDING' AND n.n_nationkey = c_nationkey
    LEFT JOIN region r ON c_mktsegment = 'FURNITURE' AND r.r_regionkey = c_nationkey""",
)
def _(src: Source):
    dims = {
        "BUILDING": src.nation.select("n_nationkey", "n_name"),
        "FURNITURE": src.region.select("r_regionkey", "r_name"),
    }
    people = src.customer.withColumnRenamed("c_nationkey", "idx")
    return J.first_match(people, dims, "c_mktsegment", "idx", "label").select("c_custkey", "label")


@query(
    "c09_latest_per_key_all",
    with_cte(
        "telemetry",
        """SELECT t.vehicle_id, t."timestamp" AS at, t.battery_pct FROM telemetry t
           JOIN (SELECT vehicle_id, max("timestamp") AS top FROM telemetry
                 WHERE "timestamp" >= TIMESTAMP '2024-01-31' - INTERVAL 2880 MINUTE GROUP BY 1) m
             ON t.vehicle_id = m.vehicle_id AND t."timestamp" = m.top""",
    ),
)
def _(src: Source):
    return J.latest_per_key(
        domain.telemetry(src), "vehicle_id", "timestamp", domain.EVENTS_AS_OF, minutes=2880, ties="all"
    ).select("vehicle_id", F.col("timestamp").alias("at"), "battery_pct")


@query(
    "c09_latest_per_key_one",
    """
    SELECT o_custkey, o_orderkey, o_orderdate FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def _(src: Source):
    return J.latest_per_key(
        src.orders, "o_custkey", "o_orderdate", ties="one", tie_break=[F.col("o_orderkey").desc()]
    ).select("o_custkey", "o_orderkey", "o_orderdate")


@query(
    "c10_at_latest_snapshot",
    "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_shipdate = (SELECT max(l_shipdate) FROM lineitem)",
)
def _(src: Source):
    return at_latest_snapshot(src.lineitem, "l_shipdate").select("l_orderkey", "l_partkey", "l_quantity")


@query(
    "c11_ratio_to_table_count",
    "SELECT round(count(*) / 7.0::DOUBLE / (SELECT count(*) FROM supplier), 1) AS per_supplier FROM lineitem",
)
def _(src: Source):
    return ratio_to_table_count(src.lineitem, src.supplier, "per_supplier", 7.0)


@query(
    "c12_attach_group_stats",
    with_cte(
        "zones vehicles",
        """SELECT z.zone_id, z.zone_name, coalesce(v.n, 0) AS current_vehicles, round(coalesce(v.b, 0), 6) AS avg_battery
           FROM (SELECT zone_id, zone_name FROM zones UNION ALL SELECT 'Z-new', 'no vehicle yet') z
           LEFT JOIN (SELECT current_zone, count(*) AS n, avg(battery_pct) AS b FROM vehicles GROUP BY 1) v
             ON v.current_zone = z.zone_id""",
    ),
)
def _(src: Source):
    planned = inline_table(src.spark, [("Z-new", "no vehicle yet")], struct("zone_id:str zone_name:str"))
    return J.attach_group_stats(
        domain.zones(src).select("zone_id", "zone_name").unionByName(planned),
        domain.vehicles(src),
        ("zone_id", "current_zone"),
        [F.count(F.lit(1)).alias("current_vehicles"), F.round(F.avg("battery_pct"), 6).alias("avg_battery")],
    ).select("zone_id", "zone_name", "current_vehicles", "avg_battery")


@query(
    "c13_attach_children",
    with_cte(
        "vehicles notes rides",
        """SELECT v.vehicle_id, coalesce(n.ids, '') AS note_ids, coalesce(r.ids, '') AS ride_ids
           FROM vehicles v
           LEFT JOIN (SELECT entity_id, string_agg(note_id::VARCHAR, ',' ORDER BY created_at DESC, note_id DESC) AS ids
                      FROM (SELECT * FROM notes WHERE entity_type = 'vehicle'
                            QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, note_id DESC) <= 10)
                      GROUP BY 1) n ON n.entity_id = v.vehicle_id
           LEFT JOIN (SELECT vehicle_id, string_agg(ride_id, ',' ORDER BY request_time DESC, ride_id DESC) AS ids
                      FROM (SELECT * FROM rides
                            QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY request_time DESC, ride_id DESC) <= 20)
                      GROUP BY 1) r ON r.vehicle_id = v.vehicle_id""",
    ),
)
def _(src: Source):
    detail = vehicle_detail(domain.vehicles(src), domain.notes(src), domain.rides(src))

    def ids(name, field):
        return F.array_join(F.transform(name, lambda x: x[field].cast("string")), ",")

    return detail.select(
        "vehicle_id", ids("notes", "note_id").alias("note_ids"), ids("recent_rides", "ride_id").alias("ride_ids")
    )


@query(
    "c14_insert_if_absent",
    """
    SELECT n_nationkey AS id, n_name AS name FROM nation
    UNION ALL
    SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT n_nationkey FROM nation)""",
)
def _(src: Source):
    target = src.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    new = src.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return J.insert_if_absent(target, new, ["id"])


def _keyed_orders(src: Source):
    rows = src.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_totalprice").alias("price"))
    return keyed.create_keyed(rows, scratch_path(src.spark, "keyed"), "id", 64)


def _new_lines(src: Source):
    return src.lineitem.select(
        (F.col("l_orderkey") * 2).alias("id"),
        F.col("l_suppkey").alias("owner"),
        F.col("l_extendedprice").alias("price"),
        "l_shipdate",
        "l_linenumber",
    )


@query(
    "c14_keyed_upsert",
    """
    WITH last AS (SELECT l_orderkey * 2 AS id, l_suppkey AS owner, l_extendedprice AS price FROM lineitem
                  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) = 1)
    SELECT id, owner, price FROM last
    UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT id FROM last)""",
)
def _(src: Source):
    table = _keyed_orders(src)
    keyed.upsert(src.spark, table, _new_lines(src), ["l_shipdate", "l_linenumber"])
    return keyed.read_keyed(src.spark, table)


@query(
    "c14_keyed_insert",
    """
    SELECT o_orderkey AS id, o_custkey AS owner, o_totalprice AS price FROM orders
    UNION ALL SELECT l_orderkey * 2, min(l_suppkey), NULL FROM lineitem WHERE l_orderkey * 2 NOT IN (SELECT o_orderkey FROM orders) GROUP BY 1""",
)
def _(src: Source):
    table = _keyed_orders(src)
    new = _new_lines(src).select("id", "owner", F.lit(None).cast("double").alias("price"))
    keyed.insert_missing(src.spark, table, new, ["owner"])
    return keyed.read_keyed(src.spark, table)


@query(
    "c15_orphans",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def _(src: Source):
    return J.orphans(src.orders, src.lineitem, ("o_orderkey", "l_orderkey")).select("o_orderkey", "o_custkey")


@query(
    "c16_delete_cascade",
    """
    SELECT 'customer' AS kept, count(*) AS row_count, sum(c_custkey)::BIGINT AS key_sum FROM customer WHERE c_acctbal >= 0
    UNION ALL
    SELECT 'orders', count(*), sum(o_orderkey)::BIGINT FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
)
def _(src: Source):
    customers, orders = J.delete_cascade(
        src.customer, src.orders, ("o_custkey", "c_custkey"), src.customer.filter("c_acctbal < 0")
    )

    def tally(df, name, key):
        return df.agg(F.count(F.lit(1)).alias("row_count"), F.sum(key).alias("key_sum")).select(
            F.lit(name).alias("kept"), "row_count", "key_sum"
        )

    return tally(customers, "customer", "c_custkey").unionByName(tally(orders, "orders", "o_orderkey"))
