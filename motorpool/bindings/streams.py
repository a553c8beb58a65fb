"""Streams over the events table, run to the end of what is there, and their batch twins."""

from pyspark.sql import functions as F

from motorpool.bindings.registry import Source, query
from motorpool.functions.batches import map_batches
from motorpool.operators import changes as C
from motorpool.schemas import SOURCE_TABLES, struct
from motorpool.session import scratch_path
from motorpool.sources.tables import load_table
from motorpool.streaming import stateful
from motorpool.streaming import telemetry as S

EVENTS = SOURCE_TABLES["events"]


def _stream(src: Source):
    # The glob takes the table whether it is one file or a folder of files.
    return S.telemetry_stream(src.spark, f"{src.directory}/events.parquet*", EVENTS)


@query("k01_ingest_telemetry", "SELECT * FROM events")
def _(src: Source):
    path = scratch_path(src.spark, "ingest")
    S.ingest_telemetry(_stream(src), f"{path}/rows.parquet", f"{path}/checkpoint")
    return load_table(src.spark, path, "rows", EVENTS)


@query(
    "k02_latest_positions",
    "SELECT user_id, max(ts) AS ts, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events GROUP BY user_id",
)
def _(src: Source):
    path = scratch_path(src.spark, "positions")
    readings = _stream(src).select("user_id", "ts", "event_id", "value")
    S.latest_positions_stream(readings, f"{path}/rows", f"{path}/checkpoint", "user_id", "ts")
    schema = struct("user_id:long ts:ts event_id:long value:double")
    return S.read_positions(src.spark, f"{path}/rows", schema, "user_id", "ts")


# Keys whose last reading the watermark has left behind by the silence are gone.
@query(
    "k02_latest_positions_timed",
    """SELECT user_id, max(ts) AS ts, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events GROUP BY user_id
       HAVING max(ts) + INTERVAL 20 MINUTE >= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def _(src: Source):
    path = scratch_path(src.spark, "timed")
    readings = _stream(src).select("user_id", "ts", "event_id", "value")
    stateful.write_changes(stateful.latest_positions(readings, "user_id", "ts", "10 minutes", 20), f"{path}/rows", f"{path}/checkpoint")
    schema = struct("user_id:long ts:ts event_id:long value:double gone:bool batch_id:long")
    return stateful.current(src.spark.read.schema(schema).parquet(f"{path}/rows"), "user_id", "ts")


def _rules():
    return {
        "type": C.in_enum("event_type", ["click", "view", "signup", "purchase"]),
        "value": C.not_null("value") & (F.col("value") < 300),
        "props": C.required("props"),
    }


def _checked(src: Source):
    path = scratch_path(src.spark, "checked")
    S.ingest_checked(_stream(src), _rules(), f"{path}/rows", f"{path}/checkpoint")
    return S.read_checked(src.spark, f"{path}/rows", EVENTS)


@query(
    "k03_stream_stats",
    """SELECT event_type, count(*) FILTER (WHERE event_type <> 'error' AND value < 300) AS rows_inserted,
              count(*) FILTER (WHERE event_type = 'error' OR value >= 300) AS errors FROM events GROUP BY 1""",
)
def _(src: Source):
    return S.ingest_stats(_checked(src), ["event_type"])


@query(
    "k03_stream_status",
    """SELECT 'events' AS stream, 1 AS batches, count(*) FILTER (WHERE event_type <> 'error' AND value < 300) AS rows_inserted,
              count(*) FILTER (WHERE event_type = 'error' OR value >= 300) AS errors FROM events""",
)
def _(src: Source):
    return S.stream_status(_checked(src), "events").drop("last_insert")


@query(
    "k03_measured_status",
    """SELECT 'events' AS stream, 1 AS batches, count(*) FILTER (WHERE event_type <> 'error' AND value < 300) AS rows_inserted,
              count(*) FILTER (WHERE event_type = 'error' OR value >= 300) AS errors FROM events""",
)
def _(src: Source):
    path = scratch_path(src.spark, "measured")
    S.ingest_checked(_stream(src), _rules(), f"{path}/rows", f"{path}/checkpoint", metrics=f"{path}/metrics")
    return S.measured_status(S.read_metrics(src.spark, f"{path}/metrics"), "events").drop("last_insert")


@query(
    "k05_skip_and_count_errors",
    """SELECT event_id, concat_ws(',', CASE WHEN event_type = 'error' THEN 'type' END, CASE WHEN value >= 300 THEN 'value' END) AS broken
       FROM events WHERE event_type = 'error' OR value >= 300""",
)
def _(src: Source):
    return _checked(src).filter(~F.col("accepted")).select("event_id", F.array_join("broken_rules", ",").alias("broken"))


_CHARGING = """
    SELECT event_id, coalesce(last_value(CASE WHEN value < 10 THEN true WHEN value >= 90 THEN false END IGNORE NULLS)
             OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS charging FROM events"""


@query("k04_charging_state", _CHARGING)
def _(src: Source):
    return S.charging_state(src.events, "user_id", "ts", "value").select("event_id", "charging")


@query("k04_charging_stream", _CHARGING)
def _(src: Source):
    path = scratch_path(src.spark, "charging")
    S.charging_state_stream(_stream(src), path, f"{path}/checkpoint", "user_id", "ts", "value")
    return S.read_charging(src.spark, path, EVENTS).select("event_id", "charging")


@query("k04_charging_stateful", _CHARGING)
def _(src: Source):
    path = scratch_path(src.spark, "stateful")
    marked = stateful.charging_state(_stream(src), "user_id", "ts", "value")
    S.ingest_telemetry(marked, f"{path}/rows.parquet", f"{path}/checkpoint")
    return src.spark.read.parquet(f"{path}/rows.parquet").select("event_id", "charging")


@query(
    "l01_map_batches",
    """SELECT event_id, b AS battery_pct, round(b * 1.2::DOUBLE, 1) AS battery_range_mi
       FROM (SELECT event_id, greatest(5, CAST(trunc(80 - 75 * least(1.0::DOUBLE, value / 500.0::DOUBLE)) AS INT)) AS b
             FROM events WHERE event_type <> 'error')""",
)
def _(src: Source):
    # Defined here, so that it travels to the executors by value.
    def low_battery(batch):
        """No reading for errors; the battery sinks as the value grows."""
        kept = batch[batch["event_type"] != "error"]
        progress = (kept["value"] / 500.0).clip(upper=1.0)
        level = (80 - 75 * progress).astype("int32").clip(lower=5)
        return kept[["event_id"]].assign(battery_pct=level, battery_range_mi=(level * 1.2).round(1))

    return map_batches(
        src.events.select("event_id", "event_type", "value"),
        low_battery,
        struct("event_id:long battery_pct:int battery_range_mi:double"),
    )
