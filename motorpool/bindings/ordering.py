"""Numbering, top-n, sorting, paging, unions."""

from pyspark.sql import functions as F

from motorpool.bindings import domain
from motorpool.bindings.domain import with_cte
from motorpool.bindings.registry import Source, query
from motorpool.operators import ordering as O
from motorpool.operators.joins import top_n_per_key
from motorpool.schemas import struct
from motorpool.session import scratch_path
from motorpool.sources import pages
from motorpool.sources.tables import inline_table, union_all


@query(
    "e01_row_number",
    "SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS rn FROM events",
)
def _(src: Source):
    return O.row_number_over(src.events.select("event_id", "value"), [F.col("value").desc(), "event_id"]).select(
        "event_id", "rn"
    )


@query(
    "e02_sequential_id",
    """
    SELECT 'ORD-' || lpad(row_number() OVER (ORDER BY o_orderdate, o_orderkey)::VARCHAR, 7, '0') AS order_no, o_orderkey
    FROM orders""",
)
def _(src: Source):
    return O.sequential_id(
        src.orders.select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], "ORD-", 7, "order_no"
    ).select("order_no", "o_orderkey")


@query(
    "e03_top_n_per_key",
    with_cte(
        "rides",
        """SELECT vehicle_id, ride_id, request_time, rank_in_key FROM
           (SELECT *, CAST(row_number() OVER (PARTITION BY vehicle_id ORDER BY request_time DESC, ride_id) AS INT) AS rank_in_key FROM rides)
           WHERE rank_in_key <= 20""",
    ),
)
def _(src: Source):
    order = [F.col("request_time").desc(), F.col("ride_id")]
    return top_n_per_key(domain.rides(src), "vehicle_id", order, 20).select(
        "vehicle_id", "ride_id", "request_time", "rank_in_key"
    )


@query(
    "f01_top_k",
    "SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey LIMIT 50",
)
def _(src: Source):
    return O.top_k(
        src.lineitem.select("l_orderkey", "l_partkey", "l_extendedprice"),
        [F.col("l_extendedprice").desc(), "l_orderkey", "l_partkey"],
        50,
    )


@query(
    "f02_paginate",
    """
    SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total
    FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50""",
)
def _(src: Source):
    listed = src.orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    return O.paginate(listed, [F.col("o_orderdate").desc(), "o_orderkey"], page=3, per_page=25)


@query(
    "f02_kept_page",
    """
    SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders) AS total
    FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 1000""",
)
def _(src: Source):
    kept = pages.keep_order(
        src.orders.select("o_orderkey", "o_orderdate"), scratch_path(src.spark, "kept"), [("o_orderdate", True), ("o_orderkey", False)], 5_000
    )
    return pages.kept_page(src.spark, kept, page=41, per_page=25)


@query(
    "f03_sort_whitelisted",
    "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey",
)
def _(src: Source):
    return O.sort_whitelisted(
        src.part, "p_partkey; --", "down", ["p_size", "p_retailprice"], "p_retailprice", ["p_partkey"]
    ).select("p_partkey", "p_retailprice")


@query("f04_sort_multi", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey, s_acctbal DESC, s_suppkey")
def _(src: Source):
    return O.sort_multi(src.supplier, "s_nationkey", F.col("s_acctbal").desc(), "s_suppkey").select(
        "s_suppkey", "s_nationkey", "s_acctbal"
    )


@query(
    "g01_union_all",
    """
    SELECT 'nation' AS kind, n_nationkey::BIGINT AS id, n_name AS label FROM nation
    UNION ALL SELECT 'region', r_regionkey, r_name FROM region
    UNION ALL SELECT 'part', p_partkey, p_name FROM part""",
)
def _(src: Source):
    def side(df, kind, key, name):
        return df.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.col(name).alias("label"))

    return union_all(
        side(src.nation, "nation", "n_nationkey", "n_name"),
        side(src.region, "region", "r_regionkey", "r_name"),
        side(src.part, "part", "p_partkey", "p_name"),
    )


@query(
    "g02_append_pinned_rows",
    """
    SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier
    UNION ALL VALUES (-1, 'Pinned A', 0, 1.5::DOUBLE), (-2, 'Pinned B', 1, 2.5::DOUBLE)""",
)
def _(src: Source):
    pinned = inline_table(
        src.spark,
        [(-1, "Pinned A", 0, 1.5), (-2, "Pinned B", 1, 2.5)],
        struct("s_suppkey:long s_name:str s_nationkey:int s_acctbal:double"),
    )
    return O.append_pinned_rows(src.supplier, pinned)
