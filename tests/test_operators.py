"""Invariants, brute-force comparisons, hot keys and edge cases."""

import collections
import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from motorpool import values
from motorpool.bindings import domain
from motorpool.functions import scalars as S
from motorpool.functions.batches import map_batches
from motorpool.operators import aggregates as A
from motorpool.operators import changes as C
from motorpool.operators import filters, ordering
from motorpool.operators import joins as J
from motorpool.schemas import struct
from motorpool.session import scratch_path, shared_dir
from motorpool.sources import tables as T
from motorpool.sources.tables import literal_rows
from motorpool.streaming.telemetry import charging_state

T0 = dt.datetime(2024, 1, 1)


def random_windows(n, longest):
    rng = random.Random(7)
    out = []
    for i in range(n):
        start = T0 + dt.timedelta(minutes=rng.randrange(0, 4000))
        out.append((i, start, start + dt.timedelta(minutes=rng.randrange(0, longest))))
    return out


def hot_points(n):
    """A third of the points in one minute and one group."""
    rng = random.Random(3)
    out = []
    for i in range(n):
        if i % 3 == 0:
            at, group = T0 + dt.timedelta(minutes=777, seconds=rng.random() * 59), "hot"
        else:
            at, group = T0 + dt.timedelta(minutes=rng.random() * 4500), rng.choice("abc")
        out.append((i, at, group, round(rng.random() * 100, 2)))
    return out


@pytest.fixture(scope="module")
def points(spark):
    rows = hot_points(900)
    return rows, literal_rows(spark, rows, struct("id:int ts:ts grp:str amount:double"))


@pytest.mark.parametrize("longest", [30, 3000])
def test_range_stats_equals_brute_force(spark, points, longest):
    rows, df = points
    windows = random_windows(60, longest)
    frame = literal_rows(spark, windows, struct("wid:int s:ts e:ts"))
    expected = {}
    for wid, s, e in windows:
        for _, at, group, amount in rows:
            if s <= at < e:
                expected.setdefault((wid, group), []).append(amount)
    got = J.range_stats(df, frame, "ts", "s", "e", ["grp"], "amount", "wid").collect()
    assert {(r.wid, r.grp): r.n for r in got} == {k: len(v) for k, v in expected.items()}
    for r in got:
        amounts = expected[(r.wid, r.grp)]
        assert r.mean == pytest.approx(sum(amounts) / len(amounts))


def test_range_stats_with_key_and_seconds(spark, points):
    rows, df = points
    windows = [(1, T0, T0 + dt.timedelta(days=9), "hot"), (2, T0, T0 + dt.timedelta(days=9), "a")]
    frame = literal_rows(spark, windows, struct("wid:int s:ts e:ts grp:str"))
    got = J.range_stats(df, frame, "ts", "s", "e", [], "amount", "wid", keys=["grp"]).collect()
    assert {r.wid: r.n for r in got} == {
        1: sum(g == "hot" for _, _, g, _ in rows),
        2: sum(g == "a" for _, _, g, _ in rows),
    }
    odd = literal_rows(spark, [(1, T0, T0 + dt.timedelta(seconds=90))], struct("wid:int s:ts e:ts"))
    with pytest.raises(Exception, match="whole minutes"):
        J.range_stats(df, odd, "ts", "s", "e", ["grp"], "amount", "wid").collect()


@pytest.mark.parametrize("keys", [(), ("grp",)])
def test_range_join_equals_nested_loop(spark, points, keys):
    rows, df = points
    windows = [(*w, random.Random(w[0]).choice(["hot", "a", "b"])) for w in random_windows(40, 500)]
    frame = literal_rows(spark, windows, struct("wid:int s:ts e:ts grp:str"))
    frame = frame if keys else frame.withColumnRenamed("grp", "wanted")
    pairs = {(r.id, r.wid) for r in J.range_join(df, frame, "ts", "s", "e", keys=keys).collect()}
    expected = {
        (i, wid)
        for i, at, group, _ in rows
        for wid, s, e, wanted in windows
        if s <= at < e and (not keys or wanted == group)
    }
    assert pairs == expected
    inside = [r.id for r in J.range_join(df, frame, "ts", "s", "e", keys=keys, how="semi").collect()]
    assert sorted(inside) == sorted({i for i, _ in expected})


def test_event_bounds_end_is_exclusive(spark):
    windows = literal_rows(spark, [(1, "2024-01-01", "20:00", "23:00")], struct("wid:int d:str a:str b:str"))
    bounded = J.event_bounds(windows, "d", "a", "b")
    at = [(1, dt.datetime(2024, 1, 1, 20)), (2, dt.datetime(2024, 1, 1, 22, 59, 59)), (3, dt.datetime(2024, 1, 1, 23))]
    joined = J.range_join(literal_rows(spark, at, struct("id:int ts:ts")), bounded, "ts", "window_start", "window_end")
    assert sorted(r.id for r in joined.collect()) == [1, 2]


def test_latest_per_key_ties(spark):
    rows = [("a", T0, 1), ("a", T0, 2), ("a", T0 - dt.timedelta(1), 3), ("b", T0, 4)]
    df = literal_rows(spark, rows, struct("k:str ts:ts v:int"))
    assert sorted(r.v for r in J.latest_per_key(df, "k", "ts").collect()) == [1, 2, 4]
    one = J.latest_per_key(df, "k", "ts", ties="one", tie_break=[F.col("v").desc()])
    assert sorted(r.v for r in one.collect()) == [2, 4]
    recent = J.latest_per_key(df, "k", "ts", T0 + dt.timedelta(minutes=6), minutes=5)
    assert recent.count() == 0


@pytest.mark.parametrize("partitions", [None, 1, 3, 40])
def test_numbers_are_consecutive(spark, src, partitions):
    df = src.lineitem.withColumn("same", F.lit(1))
    order = ["same", "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = ordering.row_number_over(df, order, partitions=partitions).collect()
    assert sorted(r.rn for r in rows) == list(range(1, len(rows) + 1))
    ordered = sorted(rows, key=lambda r: r.rn)
    keys = [tuple(r[c] for c in order) for r in ordered]
    assert keys == sorted(keys)


def test_pages_make_the_list(src):
    order = [F.col("o_orderdate").desc(), "o_orderkey"]
    listed = [r.o_orderkey for r in src.orders.orderBy(*order).collect()]
    paged, page = [], 1
    while len(paged) < len(listed):
        rows = ordering.paginate(src.orders, order, page, 400).collect()
        assert {r.total for r in rows} == {len(listed)}
        paged += [r.o_orderkey for r in rows]
        page += 1
    assert paged == listed
    assert ordering.paginate(src.orders, order, page + 5, 400).count() == 0
    with pytest.raises(ValueError):
        ordering.paginate(src.orders, order, 0, 10)


def test_padded_ids_do_not_lose_digits(spark):
    df = literal_rows(spark, [(7,), (1234567,)], struct("n:long"))
    assert [r.i for r in df.select(ordering.padded_id("X-", F.col("n"), 4).alias("i")).collect()] == ["X-0007", "X-1234567"]


def test_pivot_sums_to_count(src):
    row = A.pivot_counts(src.orders, [], "o_orderstatus", ["F", "O", "P"]).first()
    assert sum(row) == src.orders.count()


def test_kpis_have_defaults_without_rows(spark, src):
    from motorpool.plans.dashboard import fleet_metrics

    none = F.lit(False)
    row = fleet_metrics(
        domain.vehicles(src).filter(none),
        domain.rides(src).filter(none),
        domain.surge_alerts(src).filter(none),
        domain.fleet_actions(src).filter(none),
        domain.RIDES_AS_OF,
    ).first()
    assert tuple(row) == (0.0, 0.0, 0.0, 0.0, 0, 0)


def test_filters_refuse_unsafe_values(src):
    with pytest.raises(ValueError):
        filters.filter_equals(src.part, p_name="x'; DROP TABLE part")
    assert filters.filter_equals(src.part, p_name=None, p_type="").count() == src.part.count()


def test_time_filters_follow_the_column_type(spark, src):
    times = src.events.select(
        "ts",
        F.col("ts").cast("date").alias("on_day"),
        F.left(F.col("ts").cast("string"), F.lit(19)).alias("clock"),
        F.col("ts").cast("timestamp").alias("zoned"),
    )
    for select in (
        lambda c: filters.filter_since(times, c, "2024-01-31", days=7),
        lambda c: filters.filter_day(times, c, "2024-01-16"),
        lambda c: filters.filter_between(times, c, "2024-01-03", "2024-01-05"),
    ):
        counts = {c: select(c).count() for c in times.columns}
        assert len(set(counts.values())) == 1 and counts["ts"] > 0


def test_unknown_horizon_means_a_day(spark):
    df = literal_rows(spark, [(dt.date(2024, 1, 2), h) for h in range(24)], struct("d:date h:int"))
    assert filters.filter_horizon(df, "d", "h", "2024-01-02", "1h").count() == 2
    assert filters.filter_horizon(df, "d", "h", "2024-01-02", "week").count() == 24
    assert filters.filter_horizon(df, "d", "h", "2024-01-02 22:30:00", "1h", mode="elapsed").count() == 1


def test_children_default_to_an_empty_array(spark):
    parent = literal_rows(spark, [(1,), (2,)], struct("id:int"))
    child = literal_rows(spark, [(1, 5), (1, 9), (1, 7)], struct("pid:int v:int"))
    got = J.attach_children(parent, child, ("id", "pid"), [F.col("v").desc()], 2, ["v"], "kids")
    assert {r.id: [k.v for k in r.kids] for r in got.collect()} == {1: [9, 7], 2: []}


def test_insert_if_absent_takes_one_row_per_key(spark):
    target = literal_rows(spark, [(1, "old")], struct("id:int v:str"))
    new = literal_rows(spark, [(1, "x"), (2, "b"), (2, "a")], struct("id:int v:str"))
    assert sorted(tuple(r) for r in J.insert_if_absent(target, new, ["id"]).collect()) == [(1, "old"), (2, "a")]


# --- change batches ---------------------------------------------------------------


def test_checked_rows_and_rejects_make_the_input(src):
    ok, rejects = C.check_rows(src.conversations, {"role": C.in_enum("role", values.MESSAGE_ROLES)})
    assert ok.count() + rejects.count() == src.conversations.count()
    assert {r.role for r in rejects.select("role").distinct().collect()} == {"system"}


def test_last_command_wins_and_hot_keys_fold(spark):
    table = literal_rows(
        spark, [(1, "open", None), (2, "resolved", T0), (3, "open", None)], struct("id:int status:str resolved_at:ts")
    )
    commands = [(1, "acknowledged", i) for i in range(500)] + [
        (1, "resolved", 900),
        (2, "acknowledged", 1),
        (2, "burnt", 2),
        (9, "resolved", 1),
    ]
    updated, rejects = C.transition_status(
        table,
        literal_rows(spark, commands, struct("id:int status:str seq:int")),
        "id",
        "seq",
        values.ALERT_TARGETS,
        "2024-02-01",
        stamp="resolved_at",
        stamped=values.ALERT_CLOSED,
        reset=True,
    )
    rows = {r.id: (r.status, r.resolved_at) for r in updated.collect()}
    assert rows == {
        1: ("resolved", dt.datetime(2024, 2, 1)),
        2: ("acknowledged", None),
        3: ("open", None),
    }
    assert sorted((r.id, r.reason) for r in rejects.collect()) == [(2, "status not allowed"), (9, "unknown key")]


def test_fleet_action_stamp_is_kept_without_reset(spark):
    table = literal_rows(spark, [(1, "approved", T0)], struct("id:int status:str executed_at:ts"))
    commands = literal_rows(spark, [(1, "failed", 1)], struct("id:int status:str seq:int"))
    updated, _ = C.transition_status(
        table, commands, "id", "seq", values.FLEET_ACTION_TARGETS, "2024-02-01", "executed_at", values.FLEET_ACTION_STAMPED
    )
    assert tuple(updated.first()) == (1, "failed", T0)
    both = literal_rows(spark, [(1, "executed", 1), (1, "failed", 2)], struct("id:int status:str seq:int"))
    updated, _ = C.transition_status(
        table, both, "id", "seq", values.FLEET_ACTION_TARGETS, "2024-02-01", "executed_at", values.FLEET_ACTION_STAMPED
    )
    assert tuple(updated.first()) == (1, "failed", dt.datetime(2024, 2, 1))


def test_exceptions_carry_their_resolution(spark):
    table = literal_rows(
        spark, [(1, "open", None, None)], struct("id:int status:str resolution:str resolved_at:ts")
    )
    commands = literal_rows(spark, [(1, "resolved", "fixed", 1)], struct("id:int status:str resolution:str seq:int"))
    updated, _ = C.transition_status(
        table,
        commands,
        "id",
        "seq",
        values.EXCEPTION_TARGETS,
        "2024-02-01",
        "resolved_at",
        values.EXCEPTION_CLOSED,
        reset=True,
        carry=["resolution"],
    )
    assert tuple(updated.first()) == (1, "resolved", "fixed", dt.datetime(2024, 2, 1))


def test_patches_overlay_in_order(spark):
    table = literal_rows(
        spark, [(1, "a", "x", T0, None), (2, "b", "y", T0, None)], struct("id:int status:str who:str updated_at:ts resolved_at:ts")
    )
    commands = [(1, "resolved", None, 1), (1, None, "z", 2), (2, "", None, 3), (7, "q", None, 4)]
    updated, rejects = C.patch_rows(
        table,
        literal_rows(spark, commands, struct("id:int status:str who:str seq:int")),
        "id",
        "seq",
        ["status", "who"],
        "2024-02-01",
        stamps={"resolved_at": ("status", "resolved")},
    )
    now = dt.datetime(2024, 2, 1)
    assert sorted(tuple(r) for r in updated.collect()) == [(1, "resolved", "z", now, now), (2, "b", "y", T0, None)]
    assert sorted((r.id, r.reason) for r in rejects.collect()) == [(2, "nothing to update"), (7, "unknown key")]


def test_inserts_continue_the_serial(spark):
    table = literal_rows(spark, [(41, "n", "me", T0)], struct("note_id:long note_text:str author:str created_at:ts"))
    rows = literal_rows(spark, [("b", None), ("a", "you")], struct("note_text:str author:str"))
    whole, inserted = C.apply_inserts(table, rows, "note_id", ["note_text"], {"author": "system"}, "2024-02-01")
    assert sorted((r.note_id, r.note_text, r.author) for r in inserted.collect()) == [(42, "a", "you"), (43, "b", "system")]
    assert whole.count() == 3


def test_table_rules_keep_bad_rows_out(spark):
    from motorpool.plans.operations import insert_checked
    from motorpool.schemas import OPS_TABLES

    table = literal_rows(spark, [], OPS_TABLES["exceptions"])
    rows = [
        (1, "vehicle", "V-1", "fault", "x" * 3000, "high"),
        (2, "vehicle", "", "fault", "no id", None),
        (3, "vehicle", "V-2", "fault", "odd", "dire"),
    ]
    new = literal_rows(
        spark, rows, struct("n:int entity_type:str entity_id:str exception_type:str description:str severity:str")
    )
    whole = insert_checked("exceptions", table, new, ["n"], "2024-02-01")
    assert [len(r.description) for r in whole.rows.collect()] == [3000] and whole.cut.count() == 0
    done = insert_checked("exceptions", table, new, ["n"], "2024-02-01", cuts=values.EXCEPTION_CUTS)
    assert [r.n for r in done.cut.collect()] == [1]
    kept = done.rows.collect()
    assert [(r.exception_id, r.status, len(r.description)) for r in kept] == [(1, "open", 2000)]
    broken = {r.n: r.broken_rules for r in done.rejects.collect()}
    assert broken == {2: ["entity_id is given"], 3: ["severity is known"]}


# --- lists and details ----------------------------------------------------------------


def test_details(spark, src):
    from motorpool.bindings.listings import _facilities, _products
    from motorpool.plans import listings as L

    shipments = domain.shipments(src)
    one = shipments.first().shipment_id
    detail = L.shipment_detail(shipments, _facilities(src), _products(src), one).collect()
    assert [r.shipment_id for r in detail] == [one] and detail[0].origin_name.startswith("Supplier")
    tracking = literal_rows(
        spark,
        [("a", T0 + dt.timedelta(1)), ("b", T0), ("a", T0)],
        struct("shipment_id:str created_at:ts"),
    )
    assert [r.created_at for r in L.tracking_list(tracking, "a").collect()] == [T0, T0 + dt.timedelta(1)]
    workflow = L.workflow_detail(domain.workflows(src), 5).collect()
    assert len(workflow) == 1 and workflow[0].headline
    assert L.workflow_detail(domain.workflows(src), -1).count() == 0


def test_exception_list_limits(spark):
    from motorpool.plans import listings as L
    from motorpool.schemas import OPS_TABLES

    table = literal_rows(spark, [], OPS_TABLES["exceptions"])
    assert L.exception_list(table, severity="high", limit=200).count() == 0
    with pytest.raises(ValueError):
        L.exception_list(table, limit=201)


# --- scalars, sources, state --------------------------------------------------------


def test_bad_json_gives_the_default(spark):
    texts = [('[{"step": 1, "tool": "t"}]',), ("[]",), ('{"step": 1}',), ("nope",), (None,)]
    df = literal_rows(spark, texts, struct("j:str"))
    sizes = [r[0] for r in df.select(F.coalesce(F.size(S.parse_steps("j")), F.lit(-1))).collect()]
    assert sizes[:2] == [1, 0] and all(s == -1 for s in sizes[2:])


def test_iso_text_matches_python(spark):
    moments = [T0, dt.datetime(2024, 5, 6, 7, 8, 9, 170000), dt.datetime(2024, 5, 6, 7, 8, 9, 5)]
    df = literal_rows(spark, [(i, m) for i, m in enumerate(moments)], struct("i:int t:ts"))
    got = {r.i: r.t for r in T.normalise_types(df).collect()}
    assert [got[i] for i in range(3)] == [m.isoformat() for m in moments]


def test_heading_quadrants(spark):
    df = literal_rows(spark, [(0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, -1.0)], struct("a:double b:double c:double d:double"))
    assert [r[0] for r in df.select(S.heading("a", "b", "c", "d")).collect()] == [0.0, 270.0]


def test_sample_table_limits(src):
    with pytest.raises(ValueError):
        T.sample_table(src.orders, 101)
    assert T.sample_table(src.orders, 5).count() == 5


def test_written_tables(spark, src):
    path = scratch_path(spark, "test")
    T.append_table(src.nation, path)
    assert T.append_table(src.nation, path).count() == 50
    assert T.replace_table(src.nation, path).count() == 25
    split = T.replace_table(src.nation, f"{path}-split", ["n_regionkey"])
    assert split.columns == src.nation.columns and split.filter("n_regionkey = 1").count() == 5
    T.register_view(src.nation, "places")
    assert spark.table("places").count() == 25
    assert T.drop_view(spark, "places") and not T.drop_view(spark, "places")


class FakeSession:
    """A session as far as the shared folder goes: its setting and its context."""

    def __init__(self, configured, master):
        self.conf, self.sparkContext = self, self
        self.configured, self.master, self.folder = configured, master, None

    def get(self, key, default):
        return self.configured if key == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_folder_comes_from_the_session():
    cluster = FakeSession("hdfs://shared/folder", "yarn")
    assert shared_dir(cluster) == cluster.folder == "hdfs://shared/folder"
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(FakeSession(None, master))


def test_scratch_lies_in_the_application_folder(spark):
    path = scratch_path(spark, "x")
    assert path.startswith(f"{shared_dir(spark)}/motorpool/{spark.sparkContext.applicationId}/x-")


def test_sums_keep_every_digit_or_fail(spark):
    rows = literal_rows(spark, [("a", 0.004), ("b", 0.004), ("b", 0.004)], struct("k:str w:double"))
    assert rows.agg(A.weighted_share("w", F.col("k") == "a").alias("pct")).first().pct == 33.3
    fine = literal_rows(spark, [("a", 0.00000004)], struct("k:str w:double"))
    with pytest.raises(Exception, match="more than 6 digits"):
        fine.agg(A.exact_sum("w")).collect()
    assert fine.agg(A.exact_sum("w", 8).alias("s")).first().s == 0.00000004
    sums = literal_rows(spark, [("a", 0.1 + 0.2)], struct("k:str w:double"))
    assert sums.agg(A.exact_sum("w").alias("s")).first().s == 0.3


def test_every_command_is_applied_or_refused(spark):
    table = literal_rows(spark, [(1, "open"), (2, "open")], struct("k:long status:str"))
    commands = literal_rows(spark, [(1, "closed", 1), (None, "closed", 2), (9, "closed", 3), (2, "odd", 4), (None, "odd", 5)], struct("k:long status:str seq:int"))
    updated, refused = C.transition_status(table, commands, "k", "seq", ["closed"], T0)
    assert sorted(map(tuple, updated.collect())) == [(1, "closed"), (2, "open")]
    assert sorted(r.seq for r in refused.collect()) == [2, 3, 4, 5]
    table = table.withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    updated, refused = C.patch_rows(table, commands, "k", "seq", ["status"], T0)
    assert sorted(r.seq for r in refused.collect()) == [2, 3, 5]


def test_upserts_and_orphans_with_null_keys(spark):
    target = literal_rows(spark, [(1, "a")], struct("k:long v:str"))
    new = literal_rows(spark, [(2, "z"), (2, "b"), (1, "c")], struct("k:long v:str"))
    assert sorted(map(tuple, J.insert_if_absent(target, new, ["k"]).collect())) == [(1, "a"), (2, "b")]
    ordered = new.withColumn("n", F.when(F.col("v") == "z", 1).otherwise(2))
    kept = J.insert_if_absent(target.withColumn("n", F.lit(0)), ordered, ["k"], order=["n"])
    assert sorted(map(tuple, kept.collect())) == [(1, "a", 0), (2, "z", 1)]
    with pytest.raises(Exception, match="k is NULL"):
        J.insert_if_absent(target, literal_rows(spark, [(None, "x")], struct("k:long v:str")), ["k"]).collect()
    child = literal_rows(spark, [(1,), (None,), (5,)], struct("p:long"))
    assert [r.p for r in J.orphans(child, target, ("p", "k")).collect()] == [5]


def test_a_crowded_hour_is_split_among_tasks(spark):
    start = T0.replace(minute=0, second=0)
    points = spark.range(4000).select("id", F.lit(start).cast("timestamp_ntz").alias("ts"))
    windows = literal_rows(spark, [(i, start, start + dt.timedelta(minutes=5)) for i in range(3)], struct("w:int a:ts b:ts"))
    joined = J.range_join(points, windows, "ts", "a", "b")
    assert joined.count() == 12_000 and joined.columns == ["id", "ts", "w", "a", "b"]
    assert J.range_join(points, windows, "ts", "a", "b", how="semi").count() == 4000
    text = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "__salt" in text


@pytest.mark.parametrize("code, words", [("auto-reorder_po", "Auto-Reorder Po"), ("3d_move", "3D Move"), ("", ""), ("ÉTAT_x1y", "État X1Y")])
def test_title_words(spark, code, words):
    df = literal_rows(spark, [(code,)], struct("c:str"))
    assert df.select(S.headline_words("c").alias("w")).first().w == words


def test_deep_pages_are_those_of_shallow_ones(spark, src):
    order = [F.col("ts").desc(), F.col("event_id")]
    rows = src.events.select("event_id", "ts")
    shallow = [tuple(r) for r in ordering.paginate(rows, order, 20, 40).collect()]
    deep = [tuple(r) for r in ordering.paginate(rows, order, 20, 40, shallow=0).collect()]
    assert sorted(deep) == sorted(shallow) and len(deep) == 40
    keys = [("ts", True), ("event_id", False)]
    before = ordering.paginate(rows, order, 19, 40).collect()[-1]
    after = ordering.page_after(rows, keys, [before.ts, before.event_id], 40)
    assert [tuple(r) for r in after.collect()] == [t[:2] for t in shallow]
    assert len(ordering.page_after(rows, keys, None, 40).collect()) == 40


def test_generator_may_skip_all(spark, src):
    assert map_batches(src.events, lambda b: None, "event_id long").count() == 0


@pytest.mark.parametrize("chunk_minutes", [1, 60, 100000])
def test_charging_state_equals_a_loop(spark, chunk_minutes):
    rng = random.Random(11)
    rows = [("hot" if i % 3 else f"v{i % 7}", T0 + dt.timedelta(seconds=10 * i), rng.randrange(0, 100)) for i in range(1500)]
    expected, charging = {}, {}
    for key, at, level in rows:
        on = charging.get(key, False)
        on = level < 90 if on else level < 10
        charging[key] = on
        expected[(key, at)] = on
    df = literal_rows(spark, rows, struct("k:str ts:ts level:int"))
    got = charging_state(df, "k", "ts", "level", chunk_minutes=chunk_minutes).collect()
    assert {(r.k, r.ts): r.charging for r in got} == expected


def test_a_long_window_takes_few_blocks(spark):
    """A window of a year, one of a minute and one of no length, against all pairs."""
    start = dt.datetime(2024, 1, 1)
    windows = literal_rows(
        spark,
        [(1, start, start + dt.timedelta(days=365)), (2, start + dt.timedelta(hours=5), start + dt.timedelta(hours=5, minutes=1)), (3, start, start), (4, dt.datetime(1960, 1, 1), dt.datetime(1960, 3, 1))],
        struct("w:int a:ts b:ts"),
    )
    hours = [(i, start + dt.timedelta(hours=i)) for i in range(-2, 24 * 365 + 2, 5)] + [(-99, dt.datetime(1960, 2, 1, 3, 4, 5))]
    points = literal_rows(spark, hours, struct("id:int ts:ts"))
    joined = J.range_join(points, windows, "ts", "a", "b")
    bounds = {1: (start, start + dt.timedelta(days=365)), 2: (start + dt.timedelta(hours=5), start + dt.timedelta(hours=5, minutes=1)), 4: (dt.datetime(1960, 1, 1), dt.datetime(1960, 3, 1))}
    expected = [(i, w) for i, t in hours for w, (a, b) in bounds.items() if a <= t < b]
    assert sorted((r.id, r.w) for r in joined.collect()) == sorted(expected)
    for days in (1, 30, 365, 3650):
        minutes = days * 1440 + 1
        level = max(0, int(__import__("math").log2(minutes) / 2) - 1)
        assert minutes / 4**level + 1 <= 18


@pytest.mark.parametrize("keys", [(), ("zone",)])
def test_a_window_has_its_points_beside_each_other(spark, keys):
    """Points of a crowded hour come a chunk at a time, all of them, with their NULLs and copies."""
    start = dt.datetime(2024, 1, 1, 5)
    at = [(i if i % 10 else None, start + dt.timedelta(seconds=9 * (i % 400)), i % 2, None) for i in range(3000)]
    points = literal_rows(spark, [*at, *at[:50], (7, None, 0, None), (8, start, None, None)], struct("id:int ts:ts zone:int note:str"))
    spans = [(w, start + dt.timedelta(minutes=w % 90 - 60), start + dt.timedelta(minutes=w % 90 + 30), w % 2) for w in range(180)]
    windows = literal_rows(spark, [*spans, (None, *spans[0][1:])], struct("w:int a:ts b:ts zone:int"))
    windows = windows if keys else windows.drop("zone")
    joined = J.range_join(points, windows, "ts", "a", "b", keys=keys)
    assert joined.columns == ["id", "ts", "zone", "note", "w", "a", "b"]
    got = [(r.id, r.ts, r.zone, r.w) for r in joined.collect()]
    expected = collections.Counter(
        (i, t, z, w)
        for i, t, z, _ in [*at, *at[:50], (8, start, None, None)]
        for w, a, b, zone in [*spans, (None, *spans[0][1:])]
        if a <= t < b and (not keys or z == zone)
    )
    assert collections.Counter(got) == expected
    runs = [len([*same]) for _, same in itertools.groupby(r[3] for r in got)]
    assert len(got) / len(runs) > 32


def test_window_columns_that_points_have_are_refused(spark):
    points = literal_rows(spark, [(1, T0, "p")], struct("id:int ts:ts name:str"))
    windows = literal_rows(spark, [(T0, T0 + dt.timedelta(hours=1), "w")], struct("a:ts b:ts name:str"))
    with pytest.raises(ValueError, match="name"):
        J.range_join(points, windows, "ts", "a", "b")
    assert J.range_join(points, windows, "ts", "a", "b", how="semi").count() == 1


def test_status_map_adds_up(spark):
    df = literal_rows(spark, [("x",), ("y",), (None,), ("x",)], struct("c:str"))
    assert A.status_map(df, "c", ["x", "z"]).first().counts == {"x": 2, "other": 2}
    assert A.status_map(df, "c", []).first().counts == {"other": 4}
    with pytest.raises(ValueError):
        A.status_map(df, "c", ["other"])


def test_commands_of_equal_order_do_not_hang_on_tasks(spark):
    table = literal_rows(spark, [("k", "open", None)], struct("id:str status:str note:str"))
    rows = [("k", "closed", "a", 1), ("k", "held", "b", 1), ("k", "closed", "c", 1)]
    for order in (rows, rows[::-1]):
        commands = literal_rows(spark, order, struct("id:str status:str note:str at:int")).repartition(3)
        updated, _ = C.transition_status(table, commands, "id", "at", ["closed", "held"], "2024-01-01", carry=["note"])
        assert tuple(updated.first()) == ("k", "closed", "c")
        patched, _ = C.patch_rows(table, commands, "id", "at", ["status", "note"], "2024-01-01", touched=None)
        assert tuple(patched.first()) == ("k", "closed", "c")


def test_one_of_equal_times_needs_a_tie_break(spark):
    df = literal_rows(spark, [(1, T0)], struct("k:int ts:ts"))
    with pytest.raises(ValueError, match="tie_break"):
        J.latest_per_key(df, "k", "ts", ties="one")


def test_headlines_agree_with_python_titles(spark):
    codes = ["fleet_audit", "a1b_c", "it's_so", "_x__y", "MIXED_case", "straße_über", "", "x-y_z", "tab\tend", "é_è1é"]
    df = literal_rows(spark, [(c,) for c in codes], struct("c:str"))
    got = {r.c: r.w for r in df.select("c", S.headline_words("c").alias("w")).collect()}
    assert got == {c: "".join(x.lower() if i and w[i - 1].isalpha() else x.upper() for i, x in enumerate(w)) for c in codes for w in [c.replace("_", " ")]}


def test_loose_steps_keep_what_each_step_has(spark):
    texts = [
        ('[{"step": 1, "tool": "a", "label": "l", "output": "o", "status": "s"}]',),
        ('[{"step": "2", "more": [1]}, {"tool": {"deep": 1}}, 5, "x"]',),
        ("[]",), ('{"step": 1}',), ("[broken",), ("",), (None,),
    ]
    rows = literal_rows(spark, texts, struct("t:str")).select("t", S.parse_steps_loosely("t").alias("s")).collect()
    got = {r.t: r.s for r in rows}
    assert [tuple(x)[:5] for x in got[texts[0][0]]] == [(1, "a", "l", "o", "s")]
    mixed = got[texts[1][0]]
    assert [x.step for x in mixed] == [2, None, None, None] and [x.rest for x in mixed] == ['{"more":[1],"step":"2"}', '{"tool":{"deep":1}}', "5", '"x"']
    assert got["[]"] == [] and all(got[t] is None for t in ('{"step": 1}', "[broken", "", None))
