"""Streams over a table split in several files, against the batch operators."""

import datetime
import glob

import pytest
from pyspark.sql import functions as F

from motorpool.operators import changes as C
from motorpool.schemas import SOURCE_TABLES
from motorpool.session import scratch_path
from motorpool.sources.tables import load_table
from motorpool.streaming import stateful
from motorpool.streaming import telemetry as S

EVENTS = SOURCE_TABLES["events"]


@pytest.fixture()
def parts(spark, src):
    """The events in time order as one folder with four files, written one after another."""
    path = scratch_path(spark, "parts")
    for week in range(4):
        piece = src.events.filter(F.floor((F.dayofmonth("ts") - 1) / 8) == week)
        piece.coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, parts):
    return S.telemetry_stream(spark, parts, EVENTS, files_per_trigger=1)


def test_ingest_resumes_from_its_checkpoint(spark, src, parts):
    path = scratch_path(spark, "out")
    query = S.ingest_telemetry(stream(spark, parts), f"{path}/rows.parquet", f"{path}/checkpoint")
    assert query.lastProgress is not None
    assert load_table(spark, path, "rows", EVENTS).count() == src.events.count()
    assert S.recent_batches(query, "telemetry").count() >= 4
    src.events.limit(7).coalesce(1).write.mode("append").parquet(parts)
    S.ingest_telemetry(stream(spark, parts), f"{path}/rows.parquet", f"{path}/checkpoint")
    assert load_table(spark, path, "rows", EVENTS).count() == src.events.count() + 7


def test_replayed_rows_are_dropped(spark, src, parts):
    src.events.filter("dayofmonth(ts) > 24").coalesce(1).write.mode("append").parquet(parts)
    path = scratch_path(spark, "once")
    once = S.without_replays(stream(spark, parts), ["event_id"], "ts", "40 days")
    S.ingest_telemetry(once, f"{path}/rows.parquet", f"{path}/checkpoint")
    assert load_table(spark, path, "rows", EVENTS).count() == src.events.count()


def test_positions_equal_batch(spark, src, parts):
    path = scratch_path(spark, "positions")
    S.latest_positions_stream(stream(spark, parts), f"{path}/rows", f"{path}/checkpoint", "user_id", "ts")
    got = S.read_positions(spark, f"{path}/rows", EVENTS, "user_id", "ts")
    best = src.events.groupBy("user_id").agg(F.max("ts").alias("ts"))
    assert sorted((r.user_id, r.ts) for r in got.select("user_id", "ts").collect()) == sorted(map(tuple, best.collect()))
    fresh = S.read_positions(spark, f"{path}/rows", EVENTS, "user_id", "ts", "2024-01-31", minutes=720)
    assert 0 < fresh.count() < got.count()


def test_bad_rows_are_counted_not_fatal(spark, src, parts):
    path = scratch_path(spark, "checked")
    rules = {"type": C.in_enum("event_type", ["click", "view"])}
    S.ingest_checked(stream(spark, parts), rules, f"{path}/rows", f"{path}/checkpoint")
    checked = S.read_checked(spark, f"{path}/rows", EVENTS)
    per_batch = S.ingest_stats(checked).collect()
    assert len(per_batch) == 4
    assert sum(r.rows_inserted for r in per_batch) == src.events.filter("event_type IN ('click', 'view')").count()
    assert sum(r.rows_inserted + r.errors for r in per_batch) == src.events.count()


def test_charging_stream_carries_state_between_batches(spark, src, parts):
    path = scratch_path(spark, "charging")
    S.charging_state_stream(stream(spark, parts), path, f"{path}/checkpoint", "user_id", "ts", "value", 20, 80)
    got = S.read_charging(spark, path, EVENTS).select("event_id", "charging").collect()
    batch = S.charging_state(src.events, "user_id", "ts", "value", 20, 80).select("event_id", "charging").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch))


def one_by_one(spark, path, rows):
    """Each row a file, so that each is a batch of its own."""
    for row in rows:
        spark.createDataFrame([row], EVENTS).coalesce(1).write.mode("append").parquet(path)


def event(i, minute, user=1, value=0.0, kind="view"):
    return (i, datetime.datetime(2024, 1, 1, 0, minute), user, kind, value, "{}")


def test_status_counts_every_batch_beyond_the_progress_buffer(spark):
    path = scratch_path(spark, "long")
    one_by_one(spark, f"{path}/in", [event(i, i, kind="error" if i == 3 else "view") for i in range(6)])
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 2)
    try:
        query = S.ingest_checked(stream(spark, f"{path}/in"), {"type": C.in_enum("event_type", ["view"])}, f"{path}/rows", f"{path}/checkpoint")
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert S.recent_batches(query, "s").count() <= 2
    status = S.stream_status(S.read_checked(spark, f"{path}/rows", EVENTS), "s").first()
    assert (status.batches, status.rows_inserted, status.errors) == (6, 5, 1) and status.last_insert is not None


def test_folders_do_not_grow_with_batches_and_late_rows_are_told(spark):
    path = scratch_path(spark, "many")
    rows = [event(i, i, user=i % 3, value=5.0) for i in range(13)]
    one_by_one(spark, f"{path}/in", rows)
    S.latest_positions_stream(stream(spark, f"{path}/in"), f"{path}/rows", f"{path}/checkpoint", "user_id", "ts", fold=3)
    assert len(glob.glob(f"{path.removeprefix('file:')}/rows/batch_id=*")) <= 6
    got = S.read_positions(spark, f"{path}/rows", EVENTS, "user_id", "ts").collect()
    assert sorted((r.user_id, r.event_id) for r in got) == [(0, 12), (1, 10), (2, 11)]


def test_a_late_reading_changes_no_state(spark):
    path = scratch_path(spark, "late")
    one_by_one(spark, f"{path}/in", [event(1, 10, value=5.0), event(2, 5, value=95.0), event(3, 20, value=50.0), event(4, 1, user=2, value=95.0)])
    S.charging_state_stream(stream(spark, f"{path}/in"), path, f"{path}/checkpoint", "user_id", "ts", "value", fold=2)
    got = {r.event_id: r.charging for r in S.read_charging(spark, path, EVENTS).collect()}
    assert got == {1: True, 3: True, 4: False}
    assert [r.event_id for r in S.read_late(spark, path, EVENTS).collect()] == [2]


def test_stateful_charging_equals_batch_and_resumes(spark, src, parts):
    """Over four files, then over a fifth by a second run from the same checkpoint."""
    path = scratch_path(spark, "stateful")

    def run():
        marked = stateful.charging_state(stream(spark, parts), "user_id", "ts", "value", 20, 80, "1 hour", 60 * 24 * 60)
        return S.ingest_telemetry(marked, f"{path}/rows.parquet", f"{path}/checkpoint")

    query = run()
    assert stateful.state_rows(query) == src.events.select("user_id").distinct().count()
    later = src.events.filter("event_id % 50 = 0").withColumn("ts", F.expr("ts + INTERVAL 31 DAY")).withColumn("event_id", F.col("event_id") + 1_000_000)
    later.coalesce(1).write.mode("append").parquet(parts)
    run()
    got = spark.read.parquet(f"{path}/rows.parquet")
    assert got.filter("late").count() == 0
    batch = S.charging_state(src.events.unionByName(later), "user_id", "ts", "value", 20, 80)
    pairs = lambda df: sorted(map(tuple, df.select("event_id", "charging").collect()))
    assert pairs(got) == pairs(batch)


def test_stateful_charging_tells_late_readings_and_forgets_silent_keys(spark):
    path = scratch_path(spark, "silent")
    rows = [event(1, 10, value=5.0), event(2, 5, value=95.0), event(3, 20, value=50.0), event(4, 21, user=2, value=5.0)]
    rows += [event(5, 50, user=2, value=50.0), event(6, 51, value=50.0), event(7, 2, user=2, value=50.0)]
    one_by_one(spark, f"{path}/in", rows)
    marked = stateful.charging_state(stream(spark, f"{path}/in"), "user_id", "ts", "value", delay="10 minutes", silence_minutes=15)
    query = S.ingest_telemetry(marked, f"{path}/rows.parquet", f"{path}/checkpoint")
    got = {r.event_id: (r.charging, r.late) for r in spark.read.parquet(f"{path}/rows.parquet").collect()}
    # Key 1 is silent from 00:20 on; at 00:50 the watermark is 00:40 and it is forgotten.
    assert got == {1: (True, False), 2: (None, True), 3: (True, False), 4: (True, False), 5: (True, False), 6: (False, False)}
    assert stateful.dropped_as_late(query) == 1 and stateful.state_rows(query) == 2


def test_silent_keys_leave_the_positions_and_their_state(spark):
    path = scratch_path(spark, "timed")
    one_by_one(spark, f"{path}/in", [event(1, 1, user=1), event(2, 2, user=2), event(3, 30, user=2), event(4, 28, user=2), event(5, 31, user=3)])

    def run():
        changes = stateful.latest_positions(stream(spark, f"{path}/in"), "user_id", "ts", "5 minutes", 10)
        return stateful.write_changes(changes, f"{path}/rows", f"{path}/checkpoint")

    assert stateful.state_rows(run()) == 2
    schema = S._versioned(spark.read.parquet(f"{path}/rows").drop("batch_id").schema)
    read = lambda: spark.read.schema(schema).parquet(f"{path}/rows")
    assert sorted((r.user_id, r.event_id) for r in stateful.current(read(), "user_id", "ts").collect()) == [(2, 3), (3, 5)]
    assert [(r.user_id, r.event_id) for r in read().filter("gone").collect()] == [(1, 1)]
    one_by_one(spark, f"{path}/in", [event(6, 40, user=1), event(7, 59, user=4)])
    assert stateful.state_rows(run()) == 1
    assert [(r.user_id, r.event_id) for r in stateful.current(read(), "user_id", "ts").collect()] == [(4, 7)]


def test_observed_counts_equal_the_reread_ones_after_many_batches(spark, src):
    path, parts = scratch_path(spark, "measured"), scratch_path(spark, "many")
    src.events.limit(520).repartition(104).write.parquet(parts)
    n = len(glob.glob(f"{parts}/*.parquet"))
    rules = {"value": F.col("value") < 60, "type": C.in_enum("event_type", ["click", "view"])}
    S.ingest_checked(stream(spark, parts), rules, f"{path}/rows", f"{path}/checkpoint", metrics=f"{path}/metrics")
    metrics, checked = S.read_metrics(spark, f"{path}/metrics"), S.read_checked(spark, f"{path}/rows", EVENTS)
    assert n > 100 and metrics.count() == n
    columns = ("batch_id", "rows_inserted", "errors")
    reread = sorted(map(tuple, S.ingest_stats(checked).select(*columns).collect()))
    assert sorted(map(tuple, metrics.select(*columns).collect())) == reread
    assert S.measured_status(metrics, "events").first() == S.stream_status(checked, "events").first()
