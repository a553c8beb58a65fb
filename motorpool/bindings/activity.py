"""Workflow enrichment, notes, cards, chat sessions and follow-ups."""

from pyspark.sql import functions as F

from motorpool.bindings import domain
from motorpool.bindings.domain import with_cte
from motorpool.bindings.registry import Source, query
from motorpool.functions.scalars import case_map
from motorpool.operators import activity as A


@query(
    "j07_enrich_workflows",
    with_cte(
        "workflows",
        """, named AS (SELECT *, trim(coalesce(entity_type, '') || ' ' || coalesce(entity_id, '')) AS entity FROM workflows)
        SELECT workflow_id, CASE WHEN headline IS NOT NULL THEN headline
                 WHEN workflow_type = 'rebalancing_request' THEN 'Fleet Rebalancing: ' || entity
                 WHEN workflow_type = 'surge_response' THEN 'Surge Response: ' || entity
                 WHEN workflow_type = 'dispatch_override' THEN 'Dispatch Override: ' || entity
                 ELSE 'Fleet Audit: ' || entity END AS headline,
               summary AS enriched_summary,
               CASE WHEN workflow_id % 3 = 1 THEN 'Order' WHEN entity_type IS NULL THEN 'Trigger detected>Analyzing situation'
                    ELSE 'Trigger detected>Analyzing situation>Action on ' || entity_type END AS labels
        FROM named""",
    ).replace("\n, named", ", named"),
)
def _(src: Source):
    enriched = A.enrich_workflows(domain.workflows(src))
    labels = F.array_join(F.transform("reasoning_chain", lambda s: s["label"]), ">")
    return enriched.select("workflow_id", "headline", "enriched_summary", labels.alias("labels"))


@query(
    "j08_entity_notes",
    with_cte(
        "notes",
        "SELECT note_id, note_text, author, created_at FROM notes WHERE entity_type = 'vehicle' AND entity_id = 'V-3'",
    ),
)
def _(src: Source):
    return A.entity_notes(domain.notes(src), "vehicle", "V-3").select("note_id", "note_text", "author", "created_at")


@query(
    "j09_recent_cards",
    with_cte(
        "fleet_actions surge_alerts",
        """(SELECT 'fleet_action' AS card_type, action_id::VARCHAR AS entity_id, 'Fleet Action: ' || action_type AS title,
                   'from=' || from_zone || ',to=' || to_zone || ',vehicles=' || vehicle_count || ',priority=' || priority AS details
            FROM fleet_actions WHERE created_at >= TIMESTAMP '2001-08-01' - INTERVAL 3 MINUTE ORDER BY created_at DESC, action_id DESC LIMIT 3)
           UNION ALL
           (SELECT 'surge_alert', alert_id::VARCHAR, 'Surge Alert: ' || zone_id,
                   'zone=' || zone_id || ',severity=' || severity || ',demand=' || predicted_demand_score
            FROM surge_alerts WHERE created_at >= TIMESTAMP '2001-08-01' - INTERVAL 3 MINUTE ORDER BY created_at DESC, alert_id DESC LIMIT 3)""",
    ),
)
def _(src: Source):
    sources = [
        A.CardSource(
            "fleet_actions",
            "fleet_action",
            "action_id",
            ("Fleet Action: ", "action_type"),
            {"from": "from_zone", "to": "to_zone", "vehicles": "vehicle_count", "priority": "priority"},
        ),
        A.CardSource(
            "surge_alerts",
            "surge_alert",
            "alert_id",
            ("Surge Alert: ", "zone_id"),
            {"zone": "zone_id", "severity": "severity", "demand": "predicted_demand_score"},
        ),
    ]
    tables = {"fleet_actions": domain.fleet_actions(src), "surge_alerts": domain.surge_alerts(src)}
    cards = A.recent_cards(tables, sources, domain.ORDERS_AS_OF)
    shown = F.transform(F.map_entries("details"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return cards.withColumn("details", F.array_join(shown, ","))


_SESSIONS = """
    SELECT conv_id, coalesce(CASE WHEN length(first) > 100 THEN substr(first, 1, 100) || '...' ELSE first END, 'New conversation') AS title,
           last_activity, messages
    FROM (SELECT conv_id, arg_min("text", turn) FILTER (WHERE role = 'user') AS first, max(turn) AS last_activity, count(*) AS messages
          FROM conversations GROUP BY conv_id)"""


@query("j10_session_index", _SESSIONS)
def _(src: Source):
    return A.session_index(src.conversations, "conv_id", "turn", "role", "text")


@query("j10_recent_sessions", _SESSIONS + " ORDER BY last_activity DESC, conv_id LIMIT 50")
def _(src: Source):
    return A.session_index(src.conversations, "conv_id", "turn", "role", "text", n=50)


@query("j11_session_history", 'SELECT conv_id, turn, role, "text" FROM conversations ORDER BY conv_id, turn')
def _(src: Source):
    return A.session_history(src.conversations, "conv_id", "turn").select("conv_id", "turn", "role", "text")


@query(
    "j11_context_window",
    """SELECT conv_id, turn, role, CAST(age AS INT) AS age FROM
       (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations) WHERE age <= 3""",
)
def _(src: Source):
    return A.context_window(src.conversations, "conv_id", "turn", 3).select("conv_id", "turn", "role", "age")


@query(
    "j12_followups",
    """
    WITH used AS (SELECT user_id, bool_or(event_type = 'click' AND value > 150) AS w, bool_or(event_type = 'view' AND value > 150) AS r,
                         bool_or(event_type IN ('signup', 'error') AND value > 150) AS f FROM events GROUP BY 1)
    SELECT user_id, 'Check affected items' AS label, 0 AS position FROM used WHERE w
    UNION ALL SELECT user_id, 'Create order', w::INT FROM used WHERE r
    UNION ALL SELECT user_id, 'Plan transfers', w::INT + r::INT FROM used WHERE f""",
)
def _(src: Source):
    names = {"click": "Weather-Lookup", "view": "Reorder_Calculator", "signup": "demand_model", "error": "Forecast"}
    tool = F.when(F.col("value") > 150, case_map("event_type", names, "notebook")).otherwise("notebook")
    calls = src.events.select("user_id", tool.alias("tool"))
    return A.followups_by_keyword(calls, "user_id", "tool").select("user_id", "label", "position")
