"""Operational tables as change batches: a frame of commands against a frame of rows.

Each operator gives the new table and, where commands can be refused, a rejects frame with a
``reason``. Commands are folded to one row per key before they meet the table, so a key with
very many commands ships one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motorpool import values
from motorpool.functions.scalars import col, moment
from motorpool.operators.ordering import row_number_over


# --- rules ---------------------------------------------------------------------


def not_null(name: str) -> Column:
    return F.col(name).isNotNull()


def required(name: str) -> Column:
    """Present and not empty."""
    return F.coalesce(F.col(name).cast("string") != "", F.lit(False))


def in_enum(name: str, values: Sequence[str]) -> Column:
    """A CHECK constraint: NULL passes, as in SQL."""
    return F.coalesce(F.col(name).isin(*values), F.lit(True))


def check_rows(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep every rule, and the others with the names of the broken ones."""
    marked = flag_rows(df, rules)
    ok = marked.filter(F.size("broken_rules") == 0).drop("broken_rules")
    return ok, marked.filter(F.size("broken_rules") > 0)


def flag_rows(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """All rows with the array of rules they break."""
    marks = [F.when(rule, F.lit(None).cast("string")).otherwise(F.lit(name)) for name, rule in rules.items()]
    return df.withColumn("broken_rules", F.array_compact(F.array(*marks)))


# --- inserts -------------------------------------------------------------------


def apply_inserts(
    table: DataFrame,
    rows: DataFrame,
    key: str,
    order: Sequence[str],
    defaults: Mapping[str, object],
    as_of,
    created: str | None = "created_at",
    cuts: Mapping[str, int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Insert with defaults, a creation time and the next serial keys.

    Gives the new table and the inserted rows. ``order`` fixes which row gets which key. Texts
    go in whole, unless the caller gives ``cuts``, the width of some text columns.
    """
    filled = rows
    for name, value in defaults.items():
        given = F.col(name) if name in rows.columns else F.lit(None)
        filled = filled.withColumn(name, F.coalesce(given, F.lit(value)))
    for name, width in (cuts or {}).items():
        filled = filled.withColumn(name, F.left(F.col(name), F.lit(width)))
    if created:
        filled = filled.withColumn(created, moment(as_of))
    last = table.agg(F.coalesce(F.max(key), F.lit(0))).scalar()
    numbered = row_number_over(filled, order, "__rn").withColumn(key, last + F.col("__rn")).drop("__rn")
    inserted = numbered.select(
        *[
            (F.col(f.name) if f.name in numbered.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in table.schema.fields
        ]
    )
    return table.unionByName(inserted), inserted


# --- status changes ------------------------------------------------------------


def _unknown_key(commands: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Commands for keys the table lacks, NULL among them. Keys are folded before they meet the
    table, so the many commands of a known key stay where they are."""
    missing = (
        commands.select(F.col(key).alias("__key"))
        .distinct()
        .join(table.select(F.col(key).alias("__known")), F.col("__key") == F.col("__known"), "left_anti")
    )
    return commands.join(missing, F.col(key).eqNullSafe(F.col("__key")), "left_semi").withColumn(
        "reason", F.lit("unknown key")
    )


def _place(commands: DataFrame, order: str) -> Column:
    """A command's place among those of its key: its order, and where that is equal the whole
    command, so that the outcome does not hang on the order of tasks."""
    rest = [f.name for f in commands.schema.fields if isinstance(f.dataType, T.AtomicType) and f.name != order]
    return F.struct(F.col(order), *sorted(rest))


def transition_status(
    table: DataFrame,
    commands: DataFrame,
    key: str,
    order: str,
    allowed: Sequence[str],
    as_of,
    stamp: str | None = None,
    stamped: Sequence[str] = (),
    reset: bool = False,
    carry: Sequence[str] = (),
    status: str = "status",
) -> tuple[DataFrame, DataFrame]:
    """Set a status from commands (key, status, order); the last command per key wins.

    Of commands of equal order the greatest by their other columns, taken by name, wins.
    ``stamp`` names a time column set to ``as_of`` by the ``stamped`` statuses, also by one
    that a later command of the batch replaces; with ``reset`` only the last command counts
    and any other status clears it. ``carry`` columns are taken from the last command.
    Refused are a target outside ``allowed`` and a key the table does not hold.
    """
    permitted = F.coalesce(F.col(status).isin(*allowed), F.lit(False))
    valid = commands.filter(permitted)
    last = valid.groupBy(F.col(key).alias("__key")).agg(
        F.max_by(F.struct(F.col(status), *carry), _place(commands, order)).alias("__cmd"),
        F.bool_or(F.col(status).isin(*stamped)).alias("__stamped"),
    )
    joined = table.join(last, F.col(key) == F.col("__key"), "left")
    hit, target = F.col("__key").isNotNull(), F.col(f"__cmd.{status}")
    changes = {status: F.when(hit, target).otherwise(F.col(status))}
    for name in carry:
        changes[name] = F.when(hit, F.col(f"__cmd.{name}")).otherwise(F.col(name))
    if stamp:
        sets = target.isin(*stamped) if reset else F.col("__stamped")
        kept = F.lit(None).cast("timestamp_ntz") if reset else F.col(stamp)
        changes[stamp] = F.when(hit & sets, moment(as_of)).when(hit, kept).otherwise(F.col(stamp))
    updated = joined.withColumns(changes).select(*table.columns)

    refused = commands.filter(~permitted).withColumn("reason", F.lit("status not allowed"))
    return updated, refused.unionByName(_unknown_key(valid, table, key))


def patch_rows(
    table: DataFrame,
    commands: DataFrame,
    key: str,
    order: str,
    fields: Sequence[str],
    as_of,
    touched: str | None = "updated_at",
    stamps: Mapping[str, tuple[str, str]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Partial updates: NULL or empty keeps the old value, later commands overlay earlier ones, and
    of equal order the greatest by their other columns, taken by name.

    A command with nothing to set and one for an unknown key are refused. ``touched`` is set
    to ``as_of`` on every change; ``stamps`` maps a time column to the (field, value) that
    sets it.
    """
    given = {f: F.when(F.col(f).cast("string") != "", F.col(f)) for f in fields}
    sets_any = F.coalesce(*[g.cast("string") for g in given.values()]).isNotNull()
    valid = commands.filter(sets_any)
    stamps = stamps or {}
    merged = valid.groupBy(F.col(key).alias("__key")).agg(
        *[F.max_by(g, F.when(g.isNotNull(), _place(commands, order))).alias(f"__{f}") for f, g in given.items()],
        *[
            F.coalesce(F.bool_or(F.col(f) == F.lit(v)), F.lit(False)).alias(f"__stamp_{name}")
            for name, (f, v) in stamps.items()
        ],
    )
    joined = table.join(merged, F.col(key) == F.col("__key"), "left")
    hit = F.col("__key").isNotNull()
    changes = {f: F.coalesce(F.col(f"__{f}"), F.col(f)) for f in fields}
    for name in stamps:
        changes[name] = F.when(F.col(f"__stamp_{name}"), moment(as_of)).otherwise(F.col(name))
    if touched:
        changes[touched] = F.when(hit, moment(as_of)).otherwise(F.col(touched))
    updated = joined.withColumns(changes).select(*table.columns)

    empty = commands.filter(~sets_any).withColumn("reason", F.lit("nothing to update"))
    return updated, empty.unionByName(_unknown_key(valid, table, key))


def replace_placeholder(current: Column | str, placeholder: str, new: Column | str) -> Column:
    """Keep a value unless it is NULL or still the placeholder."""
    return F.coalesce(F.nullif(col(current), F.lit(placeholder)), col(new))


# --- cascades of a decided workflow ----------------------------------------------


def guarded_update(table: DataFrame, keys: DataFrame, key: str, changes: Mapping[str, Column], guard: Column | None = None) -> DataFrame:
    """Apply ``changes`` to the rows whose key is listed and that pass the guard."""
    listed = keys.select(F.col(keys.columns[0]).cast(table.schema[key].dataType).alias("__key")).distinct()
    joined = table.join(listed, F.col(key) == F.col("__key"), "left")
    hit = F.col("__key").isNotNull()
    if guard is not None:
        hit = hit & F.coalesce(guard, F.lit(False))
    changed = {name: F.when(hit, value).otherwise(F.col(name)) for name, value in changes.items()}
    return joined.withColumns(changed).select(*table.columns)


def _entity_number(workflows: DataFrame, workflow_type: str) -> DataFrame:
    """Numeric entity ids of one type; text that is no number is passed over."""
    return workflows.filter(F.col("workflow_type") == workflow_type).select(
        F.expr("try_cast(entity_id AS BIGINT)").alias("entity")
    ).filter(F.col("entity").isNotNull())


def rebalancing_actions(decided: DataFrame, fleet_actions: DataFrame, as_of, city: str) -> tuple[DataFrame, DataFrame]:
    """An approved rebalancing request becomes an approved fleet action: the new table and the
    inserted rows."""
    approved = decided.filter(F.col("status") == "approved")
    orders = approved.filter(F.col("workflow_type") == "rebalancing_request").select(
        F.lit("rebalance").alias("action_type"),
        F.coalesce("entity_id", F.lit("unknown")).alias("from_zone"),
        F.coalesce("entity_id", F.lit("unknown")).alias("to_zone"),
        F.lit(1).alias("vehicle_count"),
        F.lit(city).alias("city"),
        F.concat(F.lit(values.APPROVED_REASON), F.col("workflow_id").cast("string")).alias("reason"),
        F.coalesce("severity", F.lit("medium")).alias("priority"),
        F.lit("approved").alias("status"),
        F.col("workflow_id"),
    )
    return apply_inserts(fleet_actions, orders, "action_id", ["workflow_id"], {}, as_of)


def resolve_alerts(decided: DataFrame, surge_alerts: DataFrame, as_of) -> DataFrame:
    """An approved surge response resolves its alert."""
    approved = decided.filter(F.col("status") == "approved")
    changes = {"status": F.lit("resolved"), "resolved_at": moment(as_of)}
    return guarded_update(surge_alerts, _entity_number(approved, "surge_response"), "alert_id", changes)


def execute_overrides(decided: DataFrame, dispatch_overrides: DataFrame) -> DataFrame:
    """An approved dispatch override becomes executed."""
    approved = decided.filter(F.col("status") == "approved")
    return guarded_update(dispatch_overrides, _entity_number(approved, "dispatch_override"), "override_id", {"status": F.lit("executed")})


def purchase_cascade(decided: DataFrame, purchase_orders: DataFrame, exceptions: DataFrame, as_of) -> dict[str, DataFrame]:
    """Linked purchase orders are submitted on approval; on dismissal a draft order and an
    open exception are cancelled."""
    approved = decided.filter((F.col("status") == "approved") & F.col("result_po_id").isNotNull())
    dismissed = decided.filter(F.col("status") == "dismissed")
    orders = guarded_update(
        purchase_orders,
        approved.select("result_po_id"),
        "po_id",
        {"status": F.lit("submitted"), "updated_at": moment(as_of)},
    )
    orders = guarded_update(
        orders,
        dismissed.filter(F.col("result_po_id").isNotNull()).select("result_po_id"),
        "po_id",
        {"status": F.lit("cancelled"), "updated_at": moment(as_of)},
        guard=F.col("status") == "draft",
    )
    cancelled = guarded_update(
        exceptions,
        dismissed.filter(F.col("result_exception_id").isNotNull()).select("result_exception_id"),
        "exception_id",
        {"status": F.lit("cancelled"), "resolved_at": moment(as_of)},
        guard=F.col("status") == "open",
    )
    return {"purchase_orders": orders, "exceptions": cancelled}
