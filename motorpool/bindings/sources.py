"""Scans, generated rows, writes, inventories and previews."""

from pyspark.sql import functions as F

from motorpool.bindings import domain
from motorpool.bindings.registry import Source, query
from motorpool.schemas import SOURCE_TABLES, struct
from motorpool.session import scratch_path
from motorpool.sources import tables as T


@query("a01_load_table", "SELECT * FROM part")
def _(src: Source):
    return src.part


@query(
    "a02_inline_table",
    """
    SELECT p.label, count(*) AS orders, round(avg(o_totalprice), 2) AS mean_price
    FROM orders LEFT JOIN (VALUES ('1-URGENT', 'critical'), ('2-HIGH', 'high'), ('3-MEDIUM', 'medium'), ('4-NOT SPECIFIED', 'none'), ('5-LOW', 'low')) AS p(code, label)
      ON o_orderpriority = p.code
    GROUP BY p.label""",
)
def _(src: Source):
    levels = T.inline_table(
        src.spark,
        [("1-URGENT", "critical"), ("2-HIGH", "high"), ("3-MEDIUM", "medium"), ("4-NOT SPECIFIED", "none"), ("5-LOW", "low")],
        struct("code:str label:str"),
    )
    joined = src.orders.join(levels, F.col("o_orderpriority") == F.col("code"), "left")
    return joined.groupBy("label").agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.avg("o_totalprice"), 2).alias("mean_price")
    )


@query(
    "a03_number_rows",
    """
    SELECT CAST(s.slot AS INT) AS slot, coalesce(e.n, 0) AS readings
    FROM (SELECT unnest(range(0, 24, 3)) AS slot) s
    LEFT JOIN (SELECT hour(ts) - hour(ts) % 3 AS slot, count(*) AS n FROM events GROUP BY 1) e USING (slot)""",
)
def _(src: Source):
    slots = T.number_rows(src.spark, 0, 24, 3, "slot")
    per_slot = src.events.groupBy((F.hour("ts") - F.hour("ts") % 3).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    return slots.join(per_slot, "slot", "left").select("slot", F.coalesce("n", F.lit(0)).alias("readings"))


@query(
    "a04_date_series",
    """
    SELECT strftime(c.d, '%Y-%m-%d') AS day, coalesce(e.n, 0) AS readings
    FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-16' - 20, DATE '2024-01-16' + 20, INTERVAL 1 DAY)) AS DATE) AS d) c
    LEFT JOIN (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1) e USING (d)""",
)
def _(src: Source):
    calendar = T.date_series(src.spark, domain.EVENTS_MIDDLE, 20, 20, "d")
    per_day = src.events.groupBy(F.col("ts").cast("date").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return calendar.join(per_day, "d", "left").select(
        F.col("d").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("readings")
    )


@query("a05_replace_table", "SELECT * FROM customer")
def _(src: Source):
    path = scratch_path(src.spark, "replace")
    T.replace_table(src.customer.filter("c_acctbal < 0"), path)
    return T.replace_table(src.customer, path)


@query("a06_append_table", "SELECT * FROM customer")
def _(src: Source):
    path = scratch_path(src.spark, "append")
    T.append_table(src.customer.filter("c_acctbal < 0"), path)
    return T.append_table(src.customer.filter("c_acctbal >= 0"), path)


@query(
    "a07_insert_select",
    """
    SELECT s_suppkey AS entity_id, s_name AS label, CAST(NULL AS VARCHAR) AS segment FROM supplier
    UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer""",
)
def _(src: Source):
    path, target = scratch_path(src.spark, "insert"), struct("entity_id:long label:str segment:str")
    T.insert_select(src.supplier.select(F.col("s_name").alias("label"), F.col("s_suppkey").alias("entity_id")), path, target)
    return T.insert_select(
        src.customer.select(
            F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("label")
        ),
        path,
        target,
    )


@query(
    "a08_register_view",
    """
    WITH order_days AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1)
    SELECT strftime(d, '%Y-%m-%d') AS day, n FROM order_days WHERE n > (SELECT avg(n) FROM order_days)""",
)
def _(src: Source):
    view = T.register_view(
        src.orders.groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.count(F.lit(1)).alias("n")),
        "order_days",
    )
    return src.spark.sql(
        f"SELECT CAST(d AS STRING) AS day, n FROM {view} WHERE n > (SELECT avg(n) FROM {view})"
    )


@query(
    "a09_table_inventory",
    "\nUNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in SOURCE_TABLES),
)
def _(src: Source):
    return T.table_inventory({t: src[t] for t in SOURCE_TABLES})


_BOUNDED = {"orders": "o_orderkey", "lineitem": "l_linenumber", "customer": "c_custkey", "events": "event_id", "documents": "doc_id", "conversations": "turn"}


@query(
    "a09_footer_bounds",
    "\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count, count({c}) AS filled, min({c})::VARCHAR AS least, max({c})::VARCHAR AS greatest FROM {t}"
        for t, c in _BOUNDED.items()
    ),
)
def _(src: Source):
    return T.footer_bounds(src.spark, {t: (f"{src.directory}/{t}.parquet", c) for t, c in _BOUNDED.items()})


_SQL_TYPES = (
    "CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
    "WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE 'array<float>' END"
)
_DESCRIBED = "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST(row_number() OVER () AS INT) AS ordinal, column_name, {_SQL_TYPES} AS data_type, (SELECT count(*) FROM {t}) AS row_count "
    f"FROM (DESCRIBE {t})"
    for t in SOURCE_TABLES
)


@query("a10_describe_columns", _DESCRIBED)
def _(src: Source):
    # The files' own schemas, not the ones that the program declares.
    frames = {t: src.spark.read.parquet(f"{src.directory}/{t}.parquet") for t in SOURCE_TABLES}
    return (
        T.describe_columns(frames)
        .join(T.table_inventory(frames), "table_name")
        .select("table_name", "ordinal", "column_name", "data_type", "row_count")
    )


_KEYS = [
    ("region", "r_regionkey"),
    ("nation", "n_nationkey"),
    ("customer", "c_custkey"),
    ("supplier", "s_suppkey"),
    ("part", "p_partkey"),
    ("orders", "o_orderkey"),
    ("events", "event_id"),
    ("documents", "doc_id"),
    ("conversations", "conv_id"),
    ("conversations", "turn"),
]


@query(
    "a11_describe_with_keys",
    f"""
    SELECT d.table_name, d.column_name, d.row_count, CASE WHEN k.column_name IS NOT NULL THEN 'PK' END AS key
    FROM ({_DESCRIBED}) d
    LEFT JOIN (VALUES {", ".join(str(k) for k in _KEYS)}) AS k(table_name, column_name)
      ON k.table_name = d.table_name AND k.column_name = d.column_name""",
)
def _(src: Source):
    frames = {t: src[t] for t in SOURCE_TABLES}
    usage = T.inline_table(src.spark, _KEYS, struct("table_name:str column_name:str"))
    return (
        T.describe_with_keys(T.describe_columns(frames), usage)
        .join(T.table_inventory(frames), "table_name")
        .select("table_name", "column_name", "row_count", "key")
    )


@query(
    "a12_sample_table",
    "SELECT *, (SELECT count(*) FROM orders) AS table_rows FROM orders ORDER BY o_orderkey LIMIT 20",
)
def _(src: Source):
    return T.sample_table(src.orders, 20, ["o_orderkey"])


@query(
    "a13_normalise_types",
    """
    SELECT event_id, CASE WHEN ts = date_trunc('second', ts) THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
                          ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS at,
           strftime(ts, '%Y-%m-%d') AS on_day, CAST(CAST(value AS DECIMAL(7, 2)) AS DOUBLE) AS amount
    FROM events""",
)
def _(src: Source):
    return T.normalise_types(
        src.events.select(
            "event_id",
            F.col("ts").alias("at"),
            F.col("ts").cast("date").alias("on_day"),
            F.col("value").cast("decimal(7,2)").alias("amount"),
        )
    )


@query(
    "a13_parse_cells",
    "SELECT o_orderkey, o_totalprice, o_orderstatus = 'O' AS is_open FROM orders",
)
def _(src: Source):
    cells = src.orders.select(
        F.col("o_orderkey").cast("string"),
        F.col("o_totalprice").cast("string"),
        F.when(F.col("o_orderstatus") == "O", "True").otherwise("0").alias("is_open"),
    )
    return T.parse_cells(cells, struct("o_orderkey:long o_totalprice:double is_open:bool"))


@query("a14_read_ops_table", "SELECT * FROM supplier")
def _(src: Source):
    return T.read_ops_table(src.spark, "supplier", snapshot=src.directory)
