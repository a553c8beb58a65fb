"""Tables laid out by key or by order, and statistics from footers: results, and which files are touched."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from motorpool import values
from motorpool.operators import changes as C
from motorpool.operators.ordering import paginate
from motorpool.schemas import struct
from motorpool.session import scratch_path
from motorpool.sources import keyed, pages
from motorpool.sources.tables import footer_bounds, footer_scan, literal_rows

ROW = struct("id:long label:str price:double")


def rows_of(spark, rows, schema=ROW):
    return literal_rows(spark, rows, schema)


@pytest.fixture()
def table(spark):
    base = spark.range(2000).select("id", F.concat(F.lit("r"), "id").alias("label"), (F.col("id") / 4).alias("price"))
    return keyed.create_keyed(base, scratch_path(spark, "keyed"), "id", 32)


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def content(spark, table):
    return sorted(map(tuple, keyed.read_keyed(spark, table).collect()))


def test_ten_keys_rewrite_only_the_files_that_hold_them(spark, table):
    before, old = files(table.path), content(spark, table)
    batch = rows_of(spark, [(i, "new", 0.5) for i in range(5, 15)])
    touched = keyed.upsert(spark, table, batch, [])
    after = files(table.path)
    gone = {f.split("/")[-2] for f in set(before) - set(after)}
    assert len(before) == 32 and gone == {f"__bucket={b}" for b in touched} and len(gone) <= 10
    assert all(after[f] == t for f, t in before.items() if f in after)
    assert content(spark, table) == [r if not 5 <= r[0] < 15 else (r[0], "new", 0.5) for r in old]


def test_upsert_folds_new_rows_and_is_repeatable(spark, table):
    batch = literal_rows(
        spark,
        [(7, "late", 1.0, 2), (7, "early", 9.0, 1), (9000, "tie a", 1.0, 1), (9000, "tie b", 1.0, 1), (9001, None, None, 1)],
        struct("id:long label:str price:double seq:int"),
    )
    keyed.upsert(spark, table, batch, ["seq"])
    once = content_of(spark, table, [7, 9000, 9001])
    assert once == [(7, "late", 1.0), (9000, "tie b", 1.0), (9001, None, None)]
    keyed.upsert(spark, table, batch, ["seq"])
    assert content_of(spark, table, [7, 9000, 9001]) == once and keyed.read_keyed(spark, table).count() == 2002


def content_of(spark, table, keys):
    return sorted(map(tuple, keyed.lookup(spark, table, keys).collect()))


def test_hot_key_empty_batch_missing_column_and_null_key(spark, table):
    before = files(table.path)
    assert keyed.upsert(spark, table, rows_of(spark, []), []) == [] and files(table.path) == before
    hot = spark.range(5000).select(F.lit(3).cast("long").alias("id"), F.concat(F.lit("x"), "id").alias("label"), F.col("id").alias("seq"))
    assert len(keyed.upsert(spark, table, hot, ["seq"])) == 1
    assert content_of(spark, table, [3]) == [(3, "x4999", None)]
    before = files(table.path)
    with pytest.raises(Exception, match="NULL key"):
        keyed.upsert(spark, table, rows_of(spark, [(None, "a", 1.0)]), [])
    assert files(table.path) == before


def test_insert_missing_leaves_known_keys_and_their_files(spark, table):
    before = files(table.path)
    assert keyed.insert_missing(spark, table, rows_of(spark, [(1, "no", 0.0), (2, "no", 0.0)]), []) == []
    assert files(table.path) == before
    assert len(keyed.insert_missing(spark, table, rows_of(spark, [(1, "no", 0.0), (5000, "b", 2.0), (5000, "a", 3.0)]), ["label"])) == 1
    assert content_of(spark, table, [1, 5000]) == [(1, "r1", 0.25), (5000, "a", 3.0)]


def test_deleting_all_rows_of_a_bucket_removes_it(spark, table):
    bucket = keyed.lookup(spark, table, [4]).select(table.bucket_of("id")).first()[0]
    doomed = keyed.read_keyed(spark, table).filter(table.bucket_of("id") == bucket).select("id")
    doomed = literal_rows(spark, [tuple(r) for r in doomed.collect()], struct("id:long"))
    assert keyed.delete_keys(spark, table, doomed) == [bucket]
    assert not os.path.exists(f"{table.path}/__bucket={bucket}")
    assert keyed.read_keyed(spark, table).count() == 2000 - doomed.count()
    keyed.delete_keys(spark, table, keyed.read_keyed(spark, table).select("id"))
    assert content(spark, table) == [] and keyed.lookup(spark, table, [4]).count() == 0
    keyed.upsert(spark, table, rows_of(spark, [(4, "back", 1.0)]), [])
    assert content(spark, table) == [(4, "back", 1.0)]


def test_a_change_may_not_move_rows_to_other_buckets(spark, table):
    keys = literal_rows(spark, [(1,)], struct("id:long"))
    before = files(table.path)
    with pytest.raises(Exception, match="left the buckets"):
        keyed.rewrite_touched(spark, table, keys, lambda held: held.withColumn("id", F.col("id") + 1))
    assert files(table.path) == before


def test_status_changes_of_a_keyed_table(spark):
    base = spark.range(300).select(F.col("id").alias("alert_id"), F.lit("active").alias("status"), F.lit(None).cast("timestamp_ntz").alias("resolved_at"))
    table = keyed.create_keyed(base, scratch_path(spark, "alerts"), "alert_id", 16)
    commands = literal_rows(spark, [(3, "resolved", 1), (3, "acknowledged", 2), (9, "resolved", 1), (999, "resolved", 1)], struct("alert_id:long status:str seq:int"))

    def change(held):
        return C.transition_status(held, commands, "alert_id", "seq", values.ALERT_TARGETS, "2024-01-31")[0]

    before = files(table.path)
    touched = keyed.rewrite_touched(spark, table, commands.select("alert_id"), change)
    assert len(set(before) - set(files(table.path))) == len(touched) <= 3
    changed = keyed.read_keyed(spark, table).filter("status <> 'active'")
    assert sorted((r.alert_id, r.status) for r in changed.collect()) == [(3, "acknowledged"), (9, "resolved")]


def test_a_lookup_reads_its_buckets_alone(spark, table):
    found = keyed.lookup(spark, table, [4])
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "__bucket" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(found.inputFiles()) == 32 and content_of(spark, table, [4, 10**6]) == [(4, "r4", 1.0)]


def test_reserved_names_are_refused(spark):
    clash = spark.range(3).withColumn("__bucket", F.lit(1))
    with pytest.raises(ValueError):
        keyed.create_keyed(clash, scratch_path(spark, "clash"), "id", 4)
    with pytest.raises(ValueError):
        pages.keep_order(clash.withColumnRenamed("__bucket", "__range"), scratch_path(spark, "clash"), [("id", False)])


# --- kept orders ----------------------------------------------------------------------


def test_every_page_equals_the_sorted_list(spark):
    # A third of the rows share one value, some have none.
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 50 != 1, F.col("id") % 40).alias("v"))
    order = [("v", True), ("id", False)]
    kept = pages.keep_order(df, scratch_path(spark, "kept"), order, 90)
    whole = [tuple(r) for r in df.orderBy(F.col("v").desc(), "id").collect()]
    for page in (1, 2, 9, 17, 30, 31, 40):
        got = pages.kept_page(spark, kept, page, 33).collect()
        assert [(r.id, r.v) for r in got] == whole[(page - 1) * 33 : page * 33] and all(r.total == 1000 for r in got)
    plain = paginate(df, [F.col("v").desc(), "id"], 20, 33, shallow=10).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, pages.kept_page(spark, kept, 20, 33).collect()))


def test_a_deep_page_writes_nothing_and_scans_one_range(spark):
    df = spark.range(5000).select("id")
    kept = pages.keep_order(df, scratch_path(spark, "kept"), [("id", False)], 500)
    before = files(kept.path)
    pages.kept_page(spark, kept, 80, 10).collect()
    page = pages.kept_page(spark, kept, 81, 10)
    scan = page._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in page.collect()] == list(range(800, 810)) and files(kept.path) == before
    assert "(__range#" in scan and " = " in scan.split("PartitionFilters: [isnotnull(__range")[1].split("]")[0]
    assert "Exchange rangepartitioning" not in scan


def test_kept_order_of_nothing(spark):
    kept = pages.keep_order(spark.range(0), scratch_path(spark, "kept"), [("id", False)], 10)
    assert pages.kept_page(spark, kept, 1, 10).collect() == []
    with pytest.raises(ValueError):
        pages.kept_page(spark, kept, 0, 10)


# --- footers --------------------------------------------------------------------------


def test_footers_answer_counts_and_bounds_without_reading_a_column(spark):
    path = scratch_path(spark, "footers")
    spark.range(100).select("id", F.when(F.col("id") % 2 == 0, F.col("id").cast("int")).alias("even")).repartition(3).write.parquet(path)
    bounds = footer_bounds(spark, {"t": (path, "even")})
    assert [tuple(r) for r in bounds.collect()] == [("t", "even", 100, 50, "0", "98")]
    plan = bounds._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), COUNT(even), MIN(even), MAX(even)]" in plan
    assert "ReadSchema: struct<count(*):bigint" in plan
    # The caller's own settings stay.
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList") and spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_footers_of_empty_tables_and_totals_in_other_plans(spark):
    path = scratch_path(spark, "footers")
    spark.range(0).write.parquet(path)
    assert [tuple(r) for r in footer_bounds(spark, {"t": (path, "id")}).collect()] == [("t", "id", 0, 0, None, None)]
    full = scratch_path(spark, "footers")
    spark.range(10).write.parquet(full)
    page = spark.read.parquet(full).orderBy("id").limit(2).withColumn("total", footer_scan(spark, full).agg(F.count(F.lit(1))).scalar())
    assert [tuple(r) for r in page.collect()] == [(0, 10), (1, 10)]
    assert "PushedAggregation: [COUNT(*)]" in page._jdf.queryExecution().executedPlan().toString()
    # A filter is answered by reading the column, and rightly.
    assert footer_scan(spark, full).filter("id > 6").agg(F.count(F.lit(1))).first()[0] == 3
