"""Scalar functions, each through a projection of a table."""

from pyspark.sql import functions as F

from motorpool.bindings import domain
from motorpool.bindings.domain import with_cte
from motorpool.bindings.registry import Source, query
from motorpool.functions import hashing as H
from motorpool.functions import scalars as S
from motorpool.operators.activity import default_chain
from motorpool.operators.changes import replace_placeholder


def sql_hash(seed: str) -> str:
    """The 32-bit hash of a SQL text expression."""
    return f"('0x' || substr(sha256({seed}), 1, 8))::BIGINT"


def sql_uniform(seed: str, lo: str, hi: str) -> str:
    return f"(({lo}) + {sql_hash(seed)}::DOUBLE / 4294967295.0::DOUBLE * (({hi}) - ({lo})))"


@query("h01_hash32", f"SELECT c_custkey, {sql_hash('c_name')} AS h FROM customer")
def _(src: Source):
    return src.customer.select("c_custkey", H.hash32("c_name").alias("h"))


@query(
    "h02_bucket_pick",
    f"SELECT c_custkey, (['active', 'idle', 'charging', 'maintenance', 'en_route'])[({sql_hash('c_name')} % 5 + 1)::INT] AS status FROM customer",
)
def _(src: Source):
    bucket = H.hash32("c_name") % 5
    return src.customer.select(
        "c_custkey", H.pick(bucket, ["active", "idle", "charging", "maintenance", "en_route"]).alias("status")
    )


@query(
    "h03_text_functions",
    "SELECT 'C-' || lpad(c_custkey::VARCHAR, 6, '0') AS code, substr(c_name, 10, 4) AS part, c_mktsegment || '/' || c_nationkey AS tag FROM customer",
)
def _(src: Source):
    return src.customer.select(
        F.concat(F.lit("C-"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("code"),
        F.substring("c_name", 10, 4).alias("part"),
        F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("tag"),
    )


@query(
    "h04_arrays",
    """
    SELECT s_suppkey, unnest(range(1, (s_suppkey % 4 + 2)::BIGINT))::INT AS slot,
           (['north', 'south', 'east', 'west'])[(s_suppkey % 4 + 1)::INT] AS side
    FROM supplier""",
)
def _(src: Source):
    sides = F.array(*[F.lit(s) for s in ("north", "south", "east", "west")])
    size = (F.col("s_suppkey") % 4).cast("int")
    return src.supplier.select(
        "s_suppkey",
        F.explode(F.sequence(F.lit(1), size + 1)).alias("slot"),
        F.element_at(sides, size + 1).alias("side"),
    )


@query(
    "h05_dates",
    """
    SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + 7, '%Y-%m-%d') AS next_week,
           strftime(CAST(o_orderdate AS DATE) - 30, '%Y-%m-%d') AS month_ago,
           CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') AS INT) AS age_days
    FROM orders""",
)
def _(src: Source):
    d = F.col("o_orderdate").cast("date")
    return src.orders.select(
        "o_orderkey",
        F.date_add(d, 7).cast("string").alias("next_week"),
        F.date_sub(d, 30).cast("string").alias("month_ago"),
        F.date_diff(S.day(domain.ORDERS_AS_OF), d).alias("age_days"),
    )


@query(
    "h06_dayofweek",
    """SELECT CAST(dayofweek(o_orderdate) + 1 AS INT) AS dow, dayofweek(o_orderdate) IN (0, 6) AS weekend, count(*) AS orders
       FROM orders GROUP BY 1, 2""",
)
def _(src: Source):
    return src.orders.groupBy(
        F.dayofweek("o_orderdate").alias("dow"), S.is_weekend("o_orderdate").alias("weekend")
    ).agg(F.count(F.lit(1)).alias("orders"))


@query(
    "h07_time_text",
    with_cte(
        "rides",
        """SELECT ride_id, CAST(request_time AS TIMESTAMP) AS request_ts, substr(request_time, 1, 10) AS day,
                  substr(request_time, 12, 5) AS clock FROM rides""",
    ),
)
def _(src: Source):
    ts = S.parse_time("request_time")
    return domain.rides(src).select(
        "ride_id",
        ts.alias("request_ts"),
        F.date_format(ts, "yyyy-MM-dd").alias("day"),
        S.clock_text(F.hour(ts), F.minute(ts)).alias("clock"),
    )


@query(
    "h08_intervals",
    """
    SELECT event_id, ts - to_hours(user_id % 9) - to_minutes(event_id % 60) AS earlier, ts + to_minutes(trunc(value)::BIGINT) AS later
    FROM events""",
)
def _(src: Source):
    ago = F.make_dt_interval(F.lit(0), (F.col("user_id") % 9).cast("int"), (F.col("event_id") % 60).cast("int"))
    return src.events.select(
        "event_id", (F.col("ts") - ago).alias("earlier"), S.plus_minutes("ts", F.col("value")).alias("later")
    )


@query(
    "h09_clamp",
    """
    SELECT event_id, round(least(4.0::DOUBLE, greatest(1.5::DOUBLE, value / 25.0::DOUBLE)), 2) AS multiplier FROM events""",
)
def _(src: Source):
    return src.events.select("event_id", F.round(S.clamp(F.col("value") / F.lit(25.0), 1.5, 4.0), 2).alias("multiplier"))


@query(
    "h10_nulls",
    """
    SELECT doc_id, coalesce(quality, -1) AS quality, n_chars / nullif(toxic, 0)::DOUBLE AS per_toxic,
           CASE WHEN quality IS NULL THEN 'unlabelled' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS grade
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def _(src: Source):
    return src.documents.select("doc_id", "n_chars").join(src.labels, "doc_id", "left").select(
        "doc_id",
        F.coalesce("quality", F.lit(-1)).alias("quality"),
        (F.col("n_chars") / S.nullif("toxic", 0).cast("double")).alias("per_toxic"),
        F.when(F.col("quality").isNull(), "unlabelled").when(F.col("quality") == 1, "good").otherwise("poor").alias("grade"),
    )


@query("h11_truncate", "SELECT s_suppkey, CAST(trunc(s_acctbal / 7) AS INT) AS cut FROM supplier")
def _(src: Source):
    return src.supplier.select("s_suppkey", S.whole(F.col("s_acctbal") / 7).alias("cut"))


@query(
    "h12_ellipsis",
    """SELECT conv_id, turn, CASE WHEN length("text") > 100 THEN substr("text", 1, 100) || '...' ELSE "text" END AS title FROM conversations""",
)
def _(src: Source):
    return src.conversations.select("conv_id", "turn", S.ellipsis("text").alias("title"))


@query(
    "h13_slug",
    "SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM pages",
)
def _(src: Source):
    return src.pages.select("page_id", S.slug("url").alias("slug"))


@query(
    "h14_headline",
    with_cte(
        "workflows",
        """SELECT workflow_id, array_to_string(list_transform(string_split(workflow_type, '_'),
                  lambda w: upper(w[1]) || w[2:]), ' ') AS words FROM workflows""",
    ),
)
def _(src: Source):
    return domain.workflows(src).select("workflow_id", S.headline_words("workflow_type").alias("words"))


@query(
    "h15_parse_steps",
    with_cte(
        "workflows",
        """SELECT workflow_id, CASE WHEN workflow_id % 3 = 1 THEN 1 WHEN entity_type IS NULL THEN 2 ELSE 3 END AS steps,
                  CASE WHEN workflow_id % 3 = 1 THEN 'scan' ELSE 'monitor' END AS first_tool,
                  CASE WHEN workflow_id % 3 = 1 THEN workflow_id::VARCHAR ELSE trigger_source END AS first_output
           FROM workflows""",
    ),
)
def _(src: Source):
    parsed = S.parse_steps("reasoning_chain")
    chain = F.when(F.size(parsed) > 0, parsed).otherwise(default_chain())
    return domain.workflows(src).withColumn("chain", chain).select(
        "workflow_id",
        F.size("chain").alias("steps"),
        F.col("chain")[0]["tool"].alias("first_tool"),
        F.col("chain")[0]["output"].alias("first_output"),
    )


# Steps that lack fields, have more of them, hold another kind of value, or are no objects.
@query(
    "h15_loose_steps",
    """
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 END AS steps, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS first_step,
           CASE o_orderkey % 4 WHEN 0 THEN 'scan' END AS first_tool, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey::VARCHAR END AS second_output,
           CASE o_orderkey % 4 WHEN 0 THEN '{"extra":{"x":' || o_custkey || '},"step":1,"tool":"scan"}' WHEN 1 THEN '{"step":"2"}' END AS first_rest
    FROM orders""",
)
def _(src: Source):
    key = F.col("o_orderkey").cast("string")
    chain = (
        F.when(
            F.col("o_orderkey") % 4 == 0,
            F.concat(F.lit('[{"step": 1, "tool": "scan", "extra": {"x": '), F.col("o_custkey").cast("string"), F.lit('}}, {"output": '), key, F.lit("}]")),
        )
        .when(F.col("o_orderkey") % 4 == 1, '[{"step": "2"}, 5, null]')
        .when(F.col("o_orderkey") % 4 == 2, "not json")
        .otherwise('{"step": 1}')
    )
    return src.orders.select("o_orderkey", S.parse_steps_loosely(chain).alias("s")).select(
        "o_orderkey",
        F.when(F.col("s").isNotNull(), F.size("s")).alias("steps"),
        F.get("s", F.lit(0))["step"].alias("first_step"),
        F.get("s", F.lit(0))["tool"].alias("first_tool"),
        F.get("s", F.lit(1))["output"].alias("second_output"),
        F.get("s", F.lit(0))["rest"].alias("first_rest"),
    )


@query(
    "h15_json_props",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events",
)
def _(src: Source):
    return src.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


# A lane from the supplier's spot to the customer's, as coordinates around one city.
_LANE = """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 36.0::DOUBLE + (l_suppkey % 50) / 1000.0::DOUBLE AS lat0,
           -115.0::DOUBLE + (l_suppkey % 30) / 1000.0::DOUBLE AS lon0, 36.0::DOUBLE + (l_partkey % 70) / 1000.0::DOUBLE AS lat1,
           -115.0::DOUBLE + (l_partkey % 90) / 1000.0::DOUBLE AS lon1, l_quantity / 40 AS progress FROM lineitem"""


def _lanes(src: Source):
    def near(base, key, n):
        return F.lit(base) + F.col(key) % n / F.lit(1000.0)

    return src.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        near(36.0, "l_suppkey", 50).alias("lat0"),
        near(-115.0, "l_suppkey", 30).alias("lon0"),
        near(36.0, "l_partkey", 70).alias("lat1"),
        near(-115.0, "l_partkey", 90).alias("lon1"),
        (F.col("l_quantity") / 40).alias("progress"),
    )


@query(
    "h16_interpolate",
    f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           round(lat0 + (lat1 - lat0) * least(1.0::DOUBLE, progress), 6) AS lat,
           round(lon0 + (lon1 - lon0) * least(1.0::DOUBLE, progress), 6) AS lon FROM ({_LANE})""",
)
def _(src: Source):
    return _lanes(src).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        S.along("lat0", "lat1", "progress").alias("lat"),
        S.along("lon0", "lon1", "progress").alias("lon"),
    )


@query(
    "h17_heading",
    f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((a + 360) % 360, 1) AS heading
    FROM (SELECT *, degrees(atan2(lon1 - lon0, lat1 - lat0)) AS a FROM ({_LANE}))""",
)
def _(src: Source):
    return _lanes(src).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.heading("lat0", "lon0", "lat1", "lon1").alias("heading")
    )


@query(
    "h18_pull_back",
    f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           round(CASE WHEN abs(lat1 - lat0) > 0.015 THEN lat1 - (lat1 - lat0) * 0.05 ELSE lat1 END, 9) AS lat FROM ({_LANE})""",
)
def _(src: Source):
    return _lanes(src).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(S.pull_back("lat1", "lat0"), 9).alias("lat")
    )


@query(
    "i13_battery_range",
    with_cte(
        "vehicles",
        "SELECT vehicle_id, round(battery_pct * 1.2::DOUBLE, 1) AS app_miles, round(battery_pct * 3.0::DOUBLE, 1) AS log_miles FROM vehicles",
    ),
)
def _(src: Source):
    return domain.vehicles(src).select(
        "vehicle_id",
        S.battery_range("battery_pct", 1.2).alias("app_miles"),
        S.battery_range("battery_pct", 3.0).alias("log_miles"),
    )


@query(
    "i14_vehicle_status",
    with_cte(
        "telemetry",
        """SELECT vehicle_id, "timestamp" AS at, CASE WHEN battery_pct < 10 THEN 'charging' WHEN passenger_count > 0 THEN 'en_route'
                  WHEN speed_mph < 2 THEN 'idle' ELSE 'active' END AS status FROM telemetry""",
    ),
)
def _(src: Source):
    return domain.telemetry(src).select(
        "vehicle_id",
        F.col("timestamp").alias("at"),
        S.motion_status(F.col("battery_pct") < 10, "passenger_count", "speed_mph").alias("status"),
    )


@query(
    "j05_replace_placeholder",
    """
    SELECT conv_id, turn, coalesce(nullif(CASE role WHEN 'user' THEN 'New conversation' WHEN 'system' THEN NULL ELSE role END, 'New conversation'),
                                   CASE WHEN length("text") > 100 THEN substr("text", 1, 100) || '...' ELSE "text" END) AS title FROM conversations""",
)
def _(src: Source):
    current = F.when(F.col("role") == "user", "New conversation").when(F.col("role") != "system", F.col("role"))
    return src.conversations.select(
        "conv_id", "turn", replace_placeholder(current, "New conversation", S.ellipsis("text", 100)).alias("title")
    )
