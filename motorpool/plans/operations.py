"""The operational tables with their own rules: checked inserts and status changes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorpool import values
from motorpool.functions.scalars import ellipsis, moment
from motorpool.operators import changes as C
from motorpool.operators.activity import TITLE_WIDTH
from motorpool.operators.joins import insert_if_absent
from motorpool.operators.ordering import top_k


@dataclass(frozen=True)
class Lifecycle:
    """Statuses commands may set, and the time column they stamp."""

    key: str
    targets: Sequence[str]
    stamp: str | None = None
    stamped: Sequence[str] = ()
    reset: bool = False
    carry: Sequence[str] = ()


LIFECYCLES = {
    "surge_alerts": Lifecycle("alert_id", values.ALERT_TARGETS, "resolved_at", values.ALERT_CLOSED, reset=True),
    "fleet_actions": Lifecycle(
        "action_id", values.FLEET_ACTION_TARGETS, "executed_at", values.FLEET_ACTION_STAMPED
    ),
    "workflows": Lifecycle(
        "workflow_id", values.WORKFLOW_TARGETS, "completed_at", values.WORKFLOW_TARGETS, reset=True
    ),
    "exceptions": Lifecycle(
        "exception_id", values.EXCEPTION_TARGETS, "resolved_at", values.EXCEPTION_CLOSED, reset=True, carry=["resolution"]
    ),
    "agent_actions": Lifecycle("action_id", values.AGENT_ACTION_STATUSES),
}

KEYS = {
    "fleet_actions": "action_id",
    "surge_alerts": "alert_id",
    "dispatch_overrides": "override_id",
    "workflows": "workflow_id",
    "agent_actions": "action_id",
    "notes": "note_id",
    "exceptions": "exception_id",
    "chat_messages": "message_id",
    "purchase_orders": "po_id",
    "shipment_tracking": "tracking_id",
    "shipment_exceptions": "exception_id",
}


def table_rules(name: str) -> dict[str, Column]:
    """The constraints of an operational table, by the name of what they ask."""
    rules = {f"{c} is filled": C.not_null(c) for c in values.NOT_NULL[name]}
    rules |= {f"{c} is known": C.in_enum(c, allowed) for c, allowed in values.ENUMS[name].items()}
    if name == "exceptions":
        rules |= {f"{c} is given": C.required(c) for c in values.EXCEPTION_REQUIRED}
    return rules


@dataclass(frozen=True)
class Inserted:
    table: DataFrame
    rows: DataFrame
    rejects: DataFrame
    cut: DataFrame


def check_new(name: str, table: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New rows with their defaults: those that keep the table's constraints, and the others.
    Nothing is written."""
    defaults: Mapping[str, object] = values.DEFAULTS[name]
    filled = rows
    for column in {*values.NOT_NULL[name], *defaults}:
        given = F.col(column) if column in rows.columns else F.lit(None).cast(table.schema[column].dataType)
        if column in defaults:
            given = F.coalesce(given, F.lit(defaults[column]).cast(table.schema[column].dataType))
        filled = filled.withColumn(column, given)
    for column in values.EMPTY_IS_NULL.get(name, ()):
        if column in filled.columns:
            filled = filled.withColumn(column, F.nullif(F.col(column), F.lit("")))
    return C.check_rows(filled, table_rules(name))


def insert_checked(name: str, table: DataFrame, rows: DataFrame, order: Sequence[str], as_of, cuts: Mapping[str, int] | None = None) -> Inserted:
    """Fill defaults, keep out rows that break a constraint, insert the others.

    Texts go in whole. A caller that wants them cut, as the reports of exceptions may be
    (``values.EXCEPTION_CUTS``), passes ``cuts`` and finds the rows that were cut in ``cut``.
    """
    ok, rejects = check_new(name, table, rows)
    cuts = {c: n for c, n in (cuts or {}).items() if c in ok.columns}
    shortened = ok.filter(F.greatest(*[F.coalesce(F.length(c) > n, F.lit(False)) for c, n in cuts.items()], F.lit(False))) if cuts else ok.limit(0)
    whole, inserted = C.apply_inserts(table, ok, KEYS[name], order, {}, as_of, cuts=cuts)
    return Inserted(whole, inserted, rejects, shortened)


def set_status(name: str, table: DataFrame, commands: DataFrame, order: str, as_of) -> tuple[DataFrame, DataFrame]:
    """Status commands under the table's life cycle: the new table and the refused commands. An
    empty text that a command carries is no text."""
    cycle = LIFECYCLES[name]
    commands = commands.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in cycle.carry})
    return C.transition_status(
        table,
        commands,
        cycle.key,
        order,
        cycle.targets,
        as_of,
        cycle.stamp,
        cycle.stamped,
        cycle.reset,
        cycle.carry,
    )


#: Fields that a patch may set, the time it touches, and the time that a status stamps.
PATCHES = {
    "purchase_orders": (["status", "expected_date"], "updated_at", {}),
    "shipment_exceptions": (["status", "resolution", "assigned_to"], None, {"resolved_at": ("status", "resolved")}),
}


def patch(name: str, table: DataFrame, commands: DataFrame, order: str, as_of) -> tuple[DataFrame, DataFrame]:
    """Partial updates of a supply table: the new table and the refused commands."""
    fields, touched, stamps = PATCHES[name]
    return C.patch_rows(table, commands, KEYS[name], order, fields, as_of, touched=touched, stamps=stamps)


def open_sessions(sessions: DataFrame, wanted: DataFrame, as_of) -> DataFrame:
    """Chat sessions after some are asked for by ``session_id``: new ones with the placeholder
    title, those that exist unchanged."""
    rows = wanted.select(
        "session_id",
        F.lit(values.NEW_SESSION_TITLE).alias("title"),
        moment(as_of).alias("created_at"),
        moment(as_of).alias("updated_at"),
    )
    return insert_if_absent(sessions, rows.distinct(), ["session_id"])


def newest_session(sessions: DataFrame) -> DataFrame:
    """The session that changed last, the one a user returns to."""
    return top_k(sessions, [F.col("updated_at").desc(), F.col("session_id")], 1)


def save_messages(sessions: DataFrame, messages: DataFrame, as_of_column: str = "created_at") -> DataFrame:
    """Sessions after new messages: last change, and a title from the first user text while
    the title is still the placeholder. Message times order them."""
    start = F.left("content", F.lit(TITLE_WIDTH + 1))
    own = messages.groupBy("session_id").agg(
        F.min_by(start, F.when(F.col("role") == "user", F.col(as_of_column))).alias("__first"),
        F.max(as_of_column).alias("__last"),
    )
    joined = sessions.join(own, "session_id", "left")
    title = ellipsis("__first", TITLE_WIDTH)
    return joined.withColumns(
        {
            "title": F.coalesce(C.replace_placeholder("title", values.NEW_SESSION_TITLE, title), F.col("title")),
            "updated_at": F.coalesce("__last", "updated_at"),
        }
    ).select(*sessions.columns)

