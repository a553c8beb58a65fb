"""Change batches against operational tables."""

from pyspark.sql import functions as F

from motorpool import values
from motorpool.bindings import domain
from motorpool.bindings.domain import with_cte
from motorpool.bindings.registry import Source, query
from motorpool.functions.scalars import case_map
from motorpool.operators import changes as C
from motorpool.operators.aggregates import count_by, kpi_row
from motorpool.session import scratch_path
from motorpool.sources import keyed


@query(
    "j01_apply_inserts",
    with_cte(
        "notes",
        """SELECT (SELECT max(note_id) FROM notes) + row_number() OVER (ORDER BY doc_id) AS note_id, 'document' AS entity_type,
                  doc_id::VARCHAR AS entity_id, "text" AS note_text, CASE WHEN lang = 'en' THEN source ELSE 'system' END AS author,
                  TIMESTAMP '2024-01-31' AS created_at
           FROM documents""",
    ),
)
def _(src: Source):
    new = src.documents.select(
        "doc_id",
        F.lit("document").alias("entity_type"),
        F.col("doc_id").cast("string").alias("entity_id"),
        F.col("text").alias("note_text"),
        F.when(F.col("lang") == "en", F.col("source")).alias("author"),
    )
    _, inserted = C.apply_inserts(
        domain.notes(src),
        new,
        "note_id",
        ["doc_id"],
        {"author": "system"},
        domain.EVENTS_AS_OF,
    )
    return inserted


def _rules():
    return {
        "role": C.in_enum("role", values.MESSAGE_ROLES),
        "content": C.required("text"),
        "turn": C.not_null("turn") & (F.col("turn") < 7),
    }


@query(
    "j02_check_rows",
    """
    SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN role NOT IN ('user', 'assistant') THEN 'role' END,
             CASE WHEN coalesce("text", '') = '' THEN 'content' END, CASE WHEN turn IS NULL OR turn >= 7 THEN 'turn' END], lambda x: x IS NOT NULL), ',') AS broken
    FROM conversations
    WHERE role NOT IN ('user', 'assistant') OR coalesce("text", '') = '' OR turn IS NULL OR turn >= 7""",
)
def _(src: Source):
    _, rejects = C.check_rows(src.conversations, _rules())
    return rejects.select("conv_id", "turn", F.array_join("broken_rules", ",").alias("broken"))


@query(
    "j02_check_rows_kept",
    """SELECT role, count(*) AS kept FROM conversations
       WHERE role IN ('user', 'assistant') AND coalesce("text", '') <> '' AND turn < 7 GROUP BY role""",
)
def _(src: Source):
    ok, _ = C.check_rows(src.conversations, _rules())
    return count_by(ok, ["role"], "kept")


# Commands come from line items: the key is the order, the sequence is unique per line.
_SEQ = "strftime(l_shipdate, '%Y-%m-%d') || '/' || l_linenumber || '/' || lpad(l_partkey::VARCHAR, 12, '0') || '/' || lpad(l_suppkey::VARCHAR, 12, '0')"
_COMMANDS = f"""
    SELECT l_orderkey AS alert_id, CASE l_returnflag WHEN 'A' THEN 'acknowledged' WHEN 'R' THEN 'resolved' ELSE 'reopened' END AS status,
           {_SEQ} AS seq FROM lineitem"""


def _seq():
    return F.concat_ws(
        "/",
        F.col("l_shipdate").cast("date").cast("string"),
        F.col("l_linenumber").cast("string"),
        F.lpad(F.col("l_partkey").cast("string"), 12, "0"),
        F.lpad(F.col("l_suppkey").cast("string"), 12, "0"),
    )


def _transition(src: Source):
    commands = src.lineitem.select(
        F.col("l_orderkey").alias("alert_id"),
        case_map("l_returnflag", {"A": "acknowledged", "R": "resolved"}, "reopened").alias("status"),
        _seq().alias("seq"),
    )
    return C.transition_status(
        domain.surge_alerts(src),
        commands,
        "alert_id",
        "seq",
        values.ALERT_TARGETS,
        domain.EVENTS_AS_OF,
        stamp="resolved_at",
        stamped=values.ALERT_CLOSED,
        reset=True,
    )


@query(
    "j03_transition_status",
    with_cte(
        "surge_alerts",
        f"""SELECT a.alert_id, coalesce(c.status, a.status) AS status,
                   CASE WHEN c.status IN ('resolved', 'dismissed') THEN TIMESTAMP '2024-01-31' WHEN c.status IS NOT NULL THEN NULL ELSE a.resolved_at END AS resolved_at
            FROM surge_alerts a LEFT JOIN (SELECT alert_id, arg_max(status, seq) AS status FROM ({_COMMANDS})
                                           WHERE status IN ('acknowledged', 'resolved', 'dismissed') GROUP BY 1) c USING (alert_id)""",
    ),
)
def _(src: Source):
    updated, _ = _transition(src)
    return updated.select("alert_id", "status", "resolved_at")


@query(
    "j03_keyed_transition",
    with_cte(
        "surge_alerts",
        f"""SELECT a.alert_id, coalesce(c.status, a.status) AS status
            FROM surge_alerts a LEFT JOIN (SELECT alert_id, arg_max(status, seq) AS status FROM ({_COMMANDS})
                                           WHERE status IN ('acknowledged', 'resolved', 'dismissed') AND alert_id % 5 = 0 GROUP BY 1) c USING (alert_id)""",
    ),
)
def _(src: Source):
    commands = src.lineitem.filter(F.col("l_orderkey") % 5 == 0).select(
        F.col("l_orderkey").alias("alert_id"),
        case_map("l_returnflag", {"A": "acknowledged", "R": "resolved"}, "reopened").alias("status"),
        _seq().alias("seq"),
    )
    table = keyed.create_keyed(domain.surge_alerts(src), scratch_path(src.spark, "alerts"), "alert_id", 64)

    def change(held):
        return C.transition_status(held, commands, "alert_id", "seq", values.ALERT_TARGETS, domain.EVENTS_AS_OF)[0]

    keyed.rewrite_touched(src.spark, table, commands.select("alert_id"), change)
    return keyed.read_keyed(src.spark, table).select("alert_id", "status")


@query(
    "j03_transition_rejects",
    with_cte(
        "surge_alerts",
        f"""SELECT CASE WHEN status = 'reopened' THEN 'status not allowed' ELSE 'unknown key' END AS reason, count(*) AS commands
            FROM ({_COMMANDS}) WHERE status = 'reopened' OR alert_id NOT IN (SELECT alert_id FROM surge_alerts) GROUP BY 1""",
    ),
)
def _(src: Source):
    _, rejects = _transition(src)
    return count_by(rejects, ["reason"], "commands")


_PATCHES = f"""
    SELECT l_orderkey * 2 AS po_id, CASE l_returnflag WHEN 'R' THEN 'submitted' WHEN 'A' THEN '' END AS status,
           CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) END AS expected_date, {_SEQ} AS seq FROM lineitem"""


def _patch(src: Source):
    table = src.orders.select(
        F.col("o_orderkey").alias("po_id"),
        F.lit("draft").alias("status"),
        F.lit(None).cast("date").alias("expected_date"),
        F.col("o_orderdate").alias("updated_at"),
    )
    commands = src.lineitem.select(
        (F.col("l_orderkey") * 2).alias("po_id"),
        F.when(F.col("l_returnflag") == "R", "submitted").when(F.col("l_returnflag") == "A", "").alias("status"),
        F.when(F.col("l_linestatus") == "F", F.col("l_shipdate").cast("date")).alias("expected_date"),
        _seq().alias("seq"),
    )
    return C.patch_rows(table, commands, "po_id", "seq", ["status", "expected_date"], domain.RIDES_AS_OF)


# A tenth of the commands name no alert, and are refused.
_SOME_WITHOUT_KEY = f"SELECT CASE WHEN right(seq, 1) <> '0' THEN alert_id END AS alert_id, status, seq FROM ({_COMMANDS})"


@query(
    "j03_commands_accounted",
    with_cte(
        "surge_alerts",
        f"""SELECT count(*) AS commands,
                   count(*) FILTER (WHERE status <> 'reopened' AND alert_id IN (SELECT alert_id FROM surge_alerts)) AS applied,
                   count(*) FILTER (WHERE status = 'reopened' OR alert_id IS NULL OR alert_id NOT IN (SELECT alert_id FROM surge_alerts)) AS refused
            FROM ({_SOME_WITHOUT_KEY})""",
    ),
)
def _(src: Source):
    commands = src.lineitem.select(
        F.when(F.right(_seq(), F.lit(1)) != "0", F.col("l_orderkey")).alias("alert_id"),
        case_map("l_returnflag", {"A": "acknowledged", "R": "resolved"}, "reopened").alias("status"),
        _seq().alias("seq"),
    )
    alerts = domain.surge_alerts(src)
    _, refused = C.transition_status(alerts, commands, "alert_id", "seq", values.ALERT_TARGETS, domain.EVENTS_AS_OF)
    applied = commands.filter(F.col("status").isin(*values.ALERT_TARGETS)).join(alerts.select("alert_id"), "alert_id", "left_semi")
    parts = [(frame.agg(F.count(F.lit(1)).alias(name)), {name: 0}) for name, frame in (("commands", commands), ("applied", applied), ("refused", refused))]
    return kpi_row(src.spark, parts)


@query(
    "j04_patch_rows",
    f"""
    SELECT o_orderkey AS po_id, coalesce(c.status, 'draft') AS status, strftime(c.expected_date, '%Y-%m-%d') AS expected_day,
           CASE WHEN c.po_id IS NOT NULL THEN TIMESTAMP '2001-10-01' ELSE o_orderdate END AS updated_at
    FROM orders LEFT JOIN (SELECT po_id, arg_max(status, seq) FILTER (WHERE status <> '') AS status,
                                  arg_max(expected_date, seq) FILTER (WHERE expected_date IS NOT NULL) AS expected_date
                           FROM ({_PATCHES}) WHERE status <> '' OR expected_date IS NOT NULL GROUP BY 1) c ON c.po_id = o_orderkey""",
)
def _(src: Source):
    updated, _ = _patch(src)
    return updated.withColumn("expected_day", F.col("expected_date").cast("string")).drop("expected_date")


@query(
    "j04_patch_rejects",
    f"""
    SELECT CASE WHEN coalesce(status, '') = '' AND expected_date IS NULL THEN 'nothing to update' ELSE 'unknown key' END AS reason, count(*) AS commands
    FROM ({_PATCHES}) WHERE (coalesce(status, '') = '' AND expected_date IS NULL) OR po_id NOT IN (SELECT o_orderkey FROM orders) GROUP BY 1""",
)
def _(src: Source):
    _, rejects = _patch(src)
    return count_by(rejects, ["reason"], "commands")


@query(
    "j06_cascade_actions",
    with_cte(
        "workflows fleet_actions",
        """SELECT (SELECT max(action_id) FROM fleet_actions) + row_number() OVER (ORDER BY workflow_id) AS action_id, entity_id AS from_zone,
                  'Approved from workflow #' || workflow_id AS reason, severity AS priority, 'approved' AS status, TIMESTAMP '2001-08-01' AS created_at
           FROM workflows WHERE status = 'approved' AND workflow_type = 'rebalancing_request'""",
    ),
)
def _(src: Source):
    _, inserted = C.rebalancing_actions(domain.workflows(src), domain.fleet_actions(src), domain.ORDERS_AS_OF, "City 0")
    return inserted.select("action_id", "from_zone", "reason", "priority", "status", "created_at")


@query(
    "j06_cascade_alerts",
    with_cte(
        "workflows surge_alerts",
        """SELECT alert_id, CASE WHEN hit THEN 'resolved' ELSE status END AS status,
                  CASE WHEN hit THEN TIMESTAMP '2001-08-01' ELSE resolved_at END AS resolved_at
           FROM (SELECT *, alert_id IN (SELECT try_cast(entity_id AS BIGINT) FROM workflows
                                        WHERE status = 'approved' AND workflow_type = 'surge_response' AND try_cast(entity_id AS BIGINT) IS NOT NULL) AS hit
                 FROM surge_alerts)""",
    ),
)
def _(src: Source):
    after = C.resolve_alerts(domain.workflows(src), domain.surge_alerts(src), domain.ORDERS_AS_OF)
    return after.select("alert_id", "status", "resolved_at")


@query(
    "j06_cascade_overrides",
    with_cte(
        "workflows dispatch_overrides",
        """SELECT override_id, CASE WHEN override_id IN (SELECT try_cast(entity_id AS BIGINT) FROM workflows
                  WHERE status = 'approved' AND workflow_type = 'dispatch_override' AND try_cast(entity_id AS BIGINT) IS NOT NULL) THEN 'executed' ELSE status END AS status
           FROM dispatch_overrides""",
    ),
)
def _(src: Source):
    return C.execute_overrides(domain.workflows(src), domain.dispatch_overrides(src)).select("override_id", "status")


@query(
    "j06_purchase_cascade",
    """
    WITH decided AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'dismissed' ELSE 'in_progress' END AS status,
                            CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS po, CASE WHEN o_orderkey % 3 = 1 THEN o_custkey END AS exc FROM orders),
    submitted AS (SELECT DISTINCT po FROM decided WHERE status = 'approved' AND po IS NOT NULL),
    dropped AS (SELECT DISTINCT po FROM decided WHERE status = 'dismissed' AND po IS NOT NULL),
    closed AS (SELECT DISTINCT exc FROM decided WHERE status = 'dismissed' AND exc IS NOT NULL)
    SELECT 'order' AS kind, CASE WHEN c_custkey IN (SELECT po FROM submitted) THEN 'submitted'
                                 WHEN c_custkey IN (SELECT po FROM dropped) AND c_custkey % 2 = 0 THEN 'cancelled'
                                 WHEN c_custkey % 2 = 0 THEN 'draft' ELSE 'sent' END AS status, count(*) AS cnt FROM customer GROUP BY 2
    UNION ALL
    SELECT 'exception', CASE WHEN c_custkey % 3 = 0 AND c_custkey IN (SELECT exc FROM closed) THEN 'cancelled' WHEN c_custkey % 3 = 0 THEN 'open' ELSE 'acknowledged' END, count(*)
    FROM customer GROUP BY 2""",
)
def _(src: Source):
    key = F.col("c_custkey")
    decided = src.orders.select(
        case_map("o_orderstatus", {"F": "approved", "O": "dismissed"}, "in_progress").alias("status"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("result_po_id"),
        F.when(F.col("o_orderkey") % 3 == 1, F.col("o_custkey")).alias("result_exception_id"),
    )
    when = F.lit("2000-01-01").cast("timestamp_ntz")
    purchase_orders = src.customer.select(
        key.alias("po_id"), F.when(key % 2 == 0, "draft").otherwise("sent").alias("status"), when.alias("updated_at")
    )
    exceptions = src.customer.select(
        key.alias("exception_id"),
        F.when(key % 3 == 0, "open").otherwise("acknowledged").alias("status"),
        when.alias("resolved_at"),
    )
    after = C.purchase_cascade(decided, purchase_orders, exceptions, domain.ORDERS_AS_OF)

    def tally(name, kind):
        return count_by(after[name], ["status"]).select(F.lit(kind).alias("kind"), "status", "cnt")

    return tally("purchase_orders", "order").unionByName(tally("exceptions", "exception"))
