"""Filters and predicates."""

from pyspark.sql import functions as F

from motorpool import values
from motorpool.bindings import domain
from motorpool.bindings.domain import with_cte
from motorpool.bindings.registry import Source, query
from motorpool.functions.scalars import case_map
from motorpool.operators import filters as O
from motorpool.operators.joins import star_join
from motorpool.plans.fleet import base_rate


@query(
    "b01_filter_equals",
    "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'",
)
def _(src: Source):
    return O.filter_equals(src.lineitem, l_returnflag="R", l_linestatus="F", l_linenumber=None).select(
        "l_orderkey", "l_partkey", "l_quantity"
    )


@query(
    "b02_safe_values",
    r"""
    SELECT lang, count(*) AS texts,
           count(*) FILTER (WHERE regexp_full_match("text", '[\p{L}\p{N}_\s\p{Z}\-.,#&''()/%]+')) AS safe
    FROM documents GROUP BY lang""",
)
def _(src: Source):
    return src.documents.groupBy("lang").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(O.is_safe_text("text")).alias("safe")
    )


@query(
    "b03_filter_since_hours",
    "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR",
)
def _(src: Source):
    return O.filter_since(src.events, "ts", domain.EVENTS_AS_OF, hours=24).select("event_id", "ts")


@query(
    "b03_filter_since_days",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= DATE '2001-08-01' - 30",
)
def _(src: Source):
    return O.filter_since(src.orders, "o_orderdate", domain.ORDERS_AS_OF, days=30).select("o_orderkey", "o_orderdate")


@query(
    "b04_filter_next_days",
    with_cte(
        "venue_events",
        """SELECT event_id, strftime(event_date, '%Y-%m-%d') AS event_day, start_time FROM venue_events
           WHERE event_date >= DATE '2024-01-16' AND event_date <= DATE '2024-01-16' + 7""",
    ),
)
def _(src: Source):
    return O.filter_next_days(domain.venue_events(src), "event_date", domain.EVENTS_MIDDLE, 7).select(
        "event_id", F.col("event_date").cast("string").alias("event_day"), "start_time"
    )


@query(
    "b05_filter_day",
    "SELECT event_id, ts, value FROM events WHERE ts >= DATE '2024-01-16' - 1 AND ts < DATE '2024-01-16'",
)
def _(src: Source):
    yesterday = F.date_sub(F.lit(domain.EVENTS_MIDDLE).cast("date"), 1)
    return O.filter_day(src.events, "ts", yesterday).select("event_id", "ts", "value")


@query(
    "b06_filter_between",
    """SELECT event_id, ts FROM events
       WHERE strftime(ts, '%Y-%m-%d %H:%M:%S') BETWEEN '2024-01-03' AND '2024-01-05 23:59:59'""",
)
def _(src: Source):
    return O.filter_between(src.events, "ts", "2024-01-03", "2024-01-05").select("event_id", "ts")


def _by_hour(src: Source):
    return src.events.select(
        "event_id", F.col("ts").cast("date").alias("forecast_date"), F.hour("ts").alias("hour")
    )


@query(
    "b07_filter_horizon_clock",
    "SELECT event_id, CAST(hour(ts) AS INT) AS hour FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-16' AND hour(ts) <= 4",
)
def _(src: Source):
    return O.filter_horizon(_by_hour(src), "forecast_date", "hour", domain.EVENTS_MIDDLE, "4h").select("event_id", "hour")


@query(
    "b07_filter_horizon_elapsed",
    """SELECT event_id, CAST(hour(ts) AS INT) AS hour FROM events
       WHERE date_trunc('hour', ts) BETWEEN TIMESTAMP '2024-01-16' AND TIMESTAMP '2024-01-17'""",
)
def _(src: Source):
    return O.filter_horizon(
        _by_hour(src), "forecast_date", "hour", domain.EVENTS_MIDDLE, "any", mode="elapsed"
    ).select("event_id", "hour")


@query(
    "b08_filter_in",
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
)
def _(src: Source):
    return O.filter_in(src.orders, "o_orderpriority", ["1-URGENT", "2-HIGH"]).select("o_orderkey", "o_orderpriority")


@query(
    "b09_filter_flag",
    with_cte(
        "inventory",
        "SELECT facility_id, count(*) AS low_items FROM inventory WHERE below_reorder GROUP BY facility_id",
    ),
)
def _(src: Source):
    return (
        O.filter_flag(domain.inventory(src), "below_reorder")
        .groupBy("facility_id")
        .agg(F.count(F.lit(1)).alias("low_items"))
    )


@query(
    "b09_filter_present",
    with_cte("fleet_actions", "SELECT action_id, executed_at FROM fleet_actions WHERE executed_at IS NOT NULL"),
)
def _(src: Source):
    return O.filter_present(domain.fleet_actions(src), "executed_at").select("action_id", "executed_at")


@query("b10_lookup", "SELECT * FROM part WHERE p_name = 'red widget'")
def _(src: Source):
    return O.lookup(src.part, "p_name", "red widget")


@query(
    "b11_columns_differ",
    """
    SELECT s_nationkey AS from_nation, c_nationkey AS to_nation, count(*) AS lines
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey
    WHERE s_nationkey <> c_nationkey GROUP BY 1, 2""",
)
def _(src: Source):
    lines = star_join(
        src.lineitem.select("l_orderkey", "l_suppkey"),
        [
            (src.supplier, ("l_suppkey", "s_suppkey"), {"s_nationkey": "from_nation"}, ""),
            (src.orders, ("l_orderkey", "o_orderkey"), {"o_custkey": "custkey"}, ""),
            (src.customer, ("custkey", "c_custkey"), {"c_nationkey": "to_nation"}, ""),
        ],
    )
    return (
        O.filter_columns_differ(lines, "from_nation", "to_nation")
        .groupBy("from_nation", "to_nation")
        .agg(F.count(F.lit(1)).alias("lines"))
    )


@query(
    "b12_case_map",
    """
    SELECT event_id, CAST(CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 2 WHEN 'signup' THEN 8 WHEN 'purchase' THEN 4 ELSE 5 END AS INT) AS hours
    FROM events""",
)
def _(src: Source):
    hours = case_map("event_type", {"click": 3, "view": 2, "signup": 8, "purchase": 4}, 5)
    return src.events.select("event_id", hours.alias("hours"))


@query(
    "b13_base_rate",
    """
    SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'O' THEN CASE WHEN dayofweek(o_orderdate) IN (0, 6) THEN 180 ELSE 150 END
                                 ELSE CASE WHEN dayofweek(o_orderdate) IN (0, 6) THEN 130 ELSE 100 END END AS INT) AS rides
    FROM orders""",
)
def _(src: Source):
    (_, first), (_, second) = values.CITY_BASE_RIDES.items()
    return src.orders.select("o_orderkey", base_rate("o_orderstatus", "o_orderdate", {"O": first, "F": second, "P": second}).alias("rides"))
