"""The operational tables under their own rules."""

from pyspark.sql import functions as F

from motorpool.bindings import domain
from motorpool.bindings.changes import _SEQ, _seq
from motorpool.bindings.domain import with_cte
from motorpool.bindings.registry import Source, query
from motorpool.functions.scalars import case_map, plus_minutes
from motorpool.operators.aggregates import count_by
from motorpool.plans import operations as ops


def _new_actions(src: Source):
    return src.customer.select(
        F.col("c_custkey"),
        case_map("c_mktsegment", {"BUILDING": "rebalance", "FURNITURE": "recall", "MACHINERY": "wash"}).alias("action_type"),
        domain.text("Z", "c_nationkey").alias("from_zone"),
        F.when(F.col("c_acctbal") > 0, domain.text("Z", F.col("c_custkey") % 25)).alias("to_zone"),
        F.col("c_mktsegment").alias("city"),
        F.when(F.col("c_custkey") % 2 == 0, "high").alias("priority"),
    )


def _insert(src: Source):
    return ops.insert_checked("fleet_actions", domain.fleet_actions(src), _new_actions(src), ["c_custkey"], domain.ORDERS_AS_OF)


_NEW_ACTIONS = """
    SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'rebalance' WHEN 'FURNITURE' THEN 'recall' WHEN 'MACHINERY' THEN 'wash' END AS action_type,
           CASE WHEN c_acctbal > 0 THEN 'Z' || (c_custkey % 25) END AS to_zone, c_mktsegment AS city,
           CASE WHEN c_custkey % 2 = 0 THEN 'high' ELSE 'medium' END AS priority FROM customer"""


@query(
    "j01_insert_checked",
    f"""
    SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY c_custkey) AS action_id, action_type, to_zone, city, priority,
           1 AS vehicle_count, 'pending' AS status, TIMESTAMP '2001-08-01' AS created_at
    FROM ({_NEW_ACTIONS}) WHERE action_type IN ('rebalance', 'recall') AND to_zone IS NOT NULL""",
)
def _(src: Source):
    return _insert(src).rows.select(
        "action_id", "action_type", "to_zone", "city", "priority", "vehicle_count", "status", "created_at"
    )


@query(
    "j02_table_rules",
    f"""
    SELECT rule, count(*) AS broken FROM (
      SELECT unnest(list_filter([CASE WHEN action_type IS NULL THEN 'action_type is filled' END, CASE WHEN to_zone IS NULL THEN 'to_zone is filled' END,
                                 CASE WHEN action_type = 'wash' THEN 'action_type is known' END], lambda x: x IS NOT NULL)) AS rule FROM ({_NEW_ACTIONS}))
    GROUP BY rule""",
)
def _(src: Source):
    _, rejects = ops.check_new("fleet_actions", domain.fleet_actions(src), _new_actions(src))
    return count_by(rejects.select(F.explode("broken_rules").alias("rule")), ["rule"], "broken")


def _commands(src: Source, key: str, mapping: dict, **extra):
    return src.lineitem.select(
        F.col("l_orderkey").alias(key), case_map("l_returnflag", mapping).alias("status"), _seq().alias("seq"), *[c.alias(n) for n, c in extra.items()]
    )


def _last_sql(a: str, r: str, n: str) -> str:
    return f"""SELECT l_orderkey AS k, arg_max(CASE l_returnflag WHEN 'A' THEN '{a}' WHEN 'R' THEN '{r}' ELSE '{n}' END, {_SEQ}) AS s,
                      arg_max(l_linestatus, {_SEQ}) AS note, bool_or(l_returnflag = 'A') AS any_first FROM lineitem GROUP BY 1"""


@query(
    "j03_fleet_actions",
    with_cte(
        "fleet_actions",
        f"""SELECT action_id, coalesce(c.s, status) AS status,
                   CASE WHEN c.any_first THEN TIMESTAMP '2001-10-01' ELSE executed_at END AS executed_at
            FROM fleet_actions LEFT JOIN ({_last_sql('approved', 'dismissed', 'failed')}) c ON c.k = action_id""",
    ),
)
def _(src: Source):
    commands = _commands(src, "action_id", {"A": "approved", "R": "dismissed", "N": "failed"})
    updated, _ = ops.set_status("fleet_actions", domain.fleet_actions(src), commands, "seq", domain.RIDES_AS_OF)
    return updated.select("action_id", "status", "executed_at")


@query(
    "j03_workflows",
    with_cte(
        "workflows",
        f"""SELECT workflow_id, coalesce(c.s, status) AS status,
                   CASE WHEN c.s IS NOT NULL THEN TIMESTAMP '2001-10-01' ELSE completed_at END AS completed_at
            FROM workflows LEFT JOIN (SELECT l_orderkey AS k, arg_max(CASE l_returnflag WHEN 'A' THEN 'approved' ELSE 'dismissed' END, {_SEQ}) AS s
                                      FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) c ON c.k = workflow_id""",
    ),
)
def _(src: Source):
    commands = _commands(src, "workflow_id", {"A": "approved", "R": "dismissed", "N": "in_progress"})
    updated, _ = ops.set_status("workflows", domain.workflows(src), commands, "seq", domain.RIDES_AS_OF)
    return updated.select("workflow_id", "status", "completed_at")


@query(
    "j03_exceptions",
    f"""
    SELECT o_orderkey AS exception_id, coalesce(c.s, 'open') AS status, c.note AS resolution,
           CASE WHEN c.s IN ('resolved', 'cancelled') THEN TIMESTAMP '2001-10-01' END AS resolved_at
    FROM orders LEFT JOIN ({_last_sql('resolved', 'escalated', 'cancelled')}) c ON c.k = o_orderkey""",
)
def _(src: Source):
    table = src.orders.select(
        F.col("o_orderkey").alias("exception_id"),
        F.lit("open").alias("status"),
        F.lit(None).cast("string").alias("resolution"),
        F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
    )
    commands = _commands(
        src, "exception_id", {"A": "resolved", "R": "escalated", "N": "cancelled"}, resolution=F.col("l_linestatus")
    )
    updated, _ = ops.set_status("exceptions", table, commands, "seq", domain.RIDES_AS_OF)
    return updated


@query(
    "j05_save_messages",
    """
    SELECT c.conv_id::VARCHAR AS session_id, CASE WHEN c.conv_id % 3 = 0 THEN 'Kept title' ELSE coalesce(u.title, 'New conversation') END AS title,
           TIMESTAMP '2024-01-01' + to_minutes(c.last_turn) AS updated_at
    FROM (SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY 1) c
    LEFT JOIN (SELECT conv_id, CASE WHEN length(t) > 100 THEN substr(t, 1, 100) || '...' ELSE t END AS title
               FROM (SELECT conv_id, arg_min("text", turn) AS t FROM conversations WHERE role = 'user' GROUP BY 1)) u USING (conv_id)""",
)
def _(src: Source):
    begin = F.lit("2024-01-01").cast("timestamp_ntz")
    messages = src.conversations.select(
        F.col("conv_id").cast("string").alias("session_id"),
        "role",
        F.col("text").alias("content"),
        plus_minutes(begin, F.col("turn")).alias("created_at"),
    )
    sessions = src.conversations.groupBy("conv_id").agg(F.lit(1)).select(
        F.col("conv_id").cast("string").alias("session_id"),
        F.when(F.col("conv_id") % 3 == 0, "Kept title").otherwise("New conversation").alias("title"),
        begin.alias("updated_at"),
    )
    return ops.save_messages(sessions, messages)
