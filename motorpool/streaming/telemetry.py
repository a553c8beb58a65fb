"""Telemetry as a stream, with batch twins where the result can be told from the rows alone.

Every sink writes one folder per batch id, replaced when a batch is retried, so a restart
from the checkpoint leaves neither gaps nor doubles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from motorpool.functions.scalars import minute_number
from motorpool.operators.changes import flag_rows
from motorpool.operators.joins import latest_per_key
from motorpool.schemas import struct
from motorpool.session import remove_folder
from motorpool.sources.tables import literal_rows


def telemetry_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet folder, or a glob of files, as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def without_replays(sdf: DataFrame, keys: Sequence[str], ts: str, delay: str = "10 minutes") -> DataFrame:
    """Drop rows already seen within the delay, such as a source sending a batch again.

    A watermark needs a TIMESTAMP; a zone-free time is cast for it in a helper column.
    """
    timed = sdf.withColumn("__event_time", F.col(ts).cast("timestamp")).withWatermark("__event_time", delay)
    return timed.dropDuplicatesWithinWatermark([*keys, ts]).drop("__event_time")


def _run(writer, checkpoint: str, trigger: Mapping[str, object] | None) -> StreamingQuery:
    trigger = dict(trigger or {"availableNow": True})
    query = writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
    if trigger.get("availableNow"):
        query.awaitTermination()
    return query


def ingest_telemetry(sdf: DataFrame, path: str, checkpoint: str, trigger: Mapping[str, object] | None = None) -> StreamingQuery:
    """Append the stream to a Parquet table. The default trigger takes what is there and ends."""
    return _run(sdf.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint, trigger)


def recent_batches(query: StreamingQuery, name: str) -> DataFrame:
    """Rows and time of the batches that the query still remembers, the last 100 unless the session
    says otherwise. Totals come from what was written: :func:`stream_status`."""
    rows = [
        (name, int(p.batchId), int(p.numInputRows), str(p.timestamp), int(p.batchDuration))
        for p in query.recentProgress
    ]
    schema = struct("stream:str batch_id:long rows:long started_at:str duration_ms:long")
    return literal_rows(SparkSession.active(), rows, schema)


# --- checked ingest ----------------------------------------------------------------


MEASURED = T.StructType(
    [
        T.StructField("rows_inserted", T.LongType()),
        T.StructField("errors", T.LongType()),
        T.StructField("last_insert", T.TimestampType()),
        T.StructField("batch_id", T.LongType()),
    ]
)


def ingest_checked(
    sdf: DataFrame,
    rules: Mapping[str, Column],
    path: str,
    checkpoint: str,
    trigger: Mapping[str, object] | None = None,
    metrics: str | None = None,
) -> StreamingQuery:
    """Append the stream with every row marked: bad rows are kept apart and counted, not fatal.

    With ``metrics``, a folder, each batch leaves one row of counts there, observed while its rows
    are written, so that no row is read again; see :func:`read_metrics`. A retried batch replaces
    its rows and its counts.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        marked = flag_rows(batch, rules).withColumn("accepted", F.size("broken_rules") == 0)
        marked = marked.withColumn("ingested_at", F.current_timestamp())
        seen = Observation()
        if metrics:
            marked = marked.observe(
                seen,
                F.count_if("accepted").alias("rows_inserted"),
                F.count_if(~F.col("accepted")).alias("errors"),
                F.max(F.when(F.col("accepted"), F.col("ingested_at"))).alias("last_insert"),
            )
        marked.write.mode("overwrite").partitionBy("accepted").parquet(f"{path}/batch_id={batch_id}")
        if metrics:
            counted = T.StructType(MEASURED.fields[:3])
            row = tuple(seen.get[f.name] for f in counted.fields)
            batch.sparkSession.createDataFrame([row], counted).coalesce(1).write.mode("overwrite").parquet(f"{metrics}/batch_id={batch_id}")

    return _run(sdf.writeStream.foreachBatch(write), checkpoint, trigger)


def read_checked(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a checked ingest with ``broken_rules``, ``ingested_at``, ``batch_id`` and ``accepted``."""
    full = T.StructType(
        [
            *schema.fields,
            T.StructField("broken_rules", T.ArrayType(T.StringType())),
            T.StructField("ingested_at", T.TimestampType()),
            T.StructField("batch_id", T.LongType()),
            T.StructField("accepted", T.BooleanType()),
        ]
    )
    return spark.read.schema(full).parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The counts of every batch of a checked ingest: one small row a batch."""
    return spark.read.schema(MEASURED).parquet(path)


def measured_status(metrics: DataFrame, name: str) -> DataFrame:
    """The row of :func:`stream_status` from the counts of the batches, whose rows stay unread."""
    return metrics.agg(
        F.lit(name).alias("stream"),
        F.count(F.lit(1)).alias("batches"),
        F.coalesce(F.sum("rows_inserted"), F.lit(0)).alias("rows_inserted"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"),
        F.max("last_insert").alias("last_insert"),
    )


def ingest_stats(checked: DataFrame, keys: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Rows taken and errors per batch, or per any other keys."""
    return checked.groupBy(*keys).agg(
        F.count_if("accepted").alias("rows_inserted"), F.count_if(~F.col("accepted")).alias("errors")
    )


def stream_status(checked: DataFrame, name: str) -> DataFrame:
    """One row: the stream's batches, rows and errors so far and its last insert, counted from
    what was written, so that no batch is forgotten and none is counted twice after a retry."""
    return checked.agg(
        F.lit(name).alias("stream"),
        F.count_distinct("batch_id").alias("batches"),
        F.count_if("accepted").alias("rows_inserted"),
        F.count_if(~F.col("accepted")).alias("errors"),
        F.max(F.when(F.col("accepted"), F.col("ingested_at"))).alias("last_insert"),
    )


# --- versions ------------------------------------------------------------------------
#
# A sink that keeps the newest row per key writes the keys of each batch to a folder of its
# own. Every ``fold`` batches the folder holds all keys instead, and folders before the last
# such one go; so reads cost the same however long the stream has run.


def _versioned(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])


def _before(spark: SparkSession, path: str, schema: T.StructType, batch_id: int, fold: int) -> DataFrame | None:
    """The rows that batches before ``batch_id`` left, from the last folder that holds all on."""
    if batch_id == 0:
        return None
    first = (batch_id - 1) // fold * fold
    folders = [f"{path}/batch_id={i}" for i in range(first, batch_id)]
    return spark.read.schema(_versioned(schema)).option("basePath", path).parquet(*folders)


def _keep(rows: DataFrame, path: str, batch_id: int, key: str, ts: str, fold: int) -> None:
    """``rows``, one per key, as the version of this batch."""
    if batch_id and batch_id % fold == 0:
        older = _before(rows.sparkSession, path, rows.schema, batch_id, fold)
        whole = older.unionByName(rows.withColumn("batch_id", F.lit(batch_id).cast("long")))
        rows = newest_version(whole, key, ts)
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    # A retry of this batch still needs the folders since the last full one.
    for old in range(max(0, batch_id - 2 * fold), batch_id - fold) if batch_id % fold == 0 else ():
        remove_folder(rows.sparkSession, f"{path}/batch_id={old}")


def newest_version(versions: DataFrame, key: str, ts: str, as_of=None, minutes: int | None = None) -> DataFrame:
    newest = latest_per_key(versions, key, ts, as_of, minutes, ties="one", tie_break=[F.col("batch_id").desc()])
    return newest.drop("batch_id")


# --- latest positions ----------------------------------------------------------------


def latest_positions_stream(
    sdf: DataFrame, path: str, checkpoint: str, key: str, ts: str, fold: int = 16, trigger: Mapping[str, object] | None = None
) -> StreamingQuery:
    """Keep the newest reading of every key under ``path``. Each batch is cut to one row per key;
    the stream itself holds no state, so silent keys cost nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = latest_per_key(batch, key, ts, ties="one", tie_break=[F.col(c).desc() for c in batch.columns])
        _keep(newest, path, batch_id, key, ts, fold)

    return _run(sdf.writeStream.foreachBatch(write), checkpoint, trigger)


def read_positions(
    spark: SparkSession, path: str, schema: T.StructType, key: str, ts: str, as_of=None, minutes: int | None = None
) -> DataFrame:
    """The kept positions, newest per key, without keys that have been silent too long."""
    return newest_version(spark.read.schema(_versioned(schema)).parquet(path), key, ts, as_of, minutes)


# --- charging state ------------------------------------------------------------------


def threshold_mark(level: str, low: float, high: float) -> Column:
    """TRUE below the low threshold, FALSE from the high one on, NULL between."""
    return F.when(F.col(level) < low, F.lit(True)).when(F.col(level) >= high, F.lit(False))


def charging_state(
    df: DataFrame,
    key: str,
    ts: str,
    level: str,
    low: float = 10,
    high: float = 90,
    chunk_minutes: int = 60,
    carried: DataFrame | None = None,
    name: str = "charging",
) -> DataFrame:
    """Two-threshold state per reading: on below ``low``, off again from ``high`` on.

    The state is the last crossing so far. A key's time line is cut into chunks: one row per
    chunk gives what the chunks before it left behind, and each chunk is then ordered on its
    own, so a key with very many readings is shared among tasks. ``carried`` (key, state)
    holds the state before the first reading. Times are unique per key.
    """
    marked = df.withColumns(
        {"__mark": threshold_mark(level, low, high), "__chunk": F.floor(minute_number(ts) / chunk_minutes)}
    )
    ends = marked.groupBy(key, "__chunk").agg(
        F.max_by("__mark", F.when(F.col("__mark").isNotNull(), F.col(ts))).alias("__end")
    )
    earlier = W.partitionBy(key).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    entry = ends.select(key, "__chunk", F.last("__end", ignorenulls=True).over(earlier).alias("__entry"))
    so_far = W.partitionBy(key, "__chunk").orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
    rows = marked.withColumn("__mark", F.last("__mark", ignorenulls=True).over(so_far)).join(
        entry, [key, "__chunk"]
    )
    state = [F.col("__mark"), F.col("__entry")]
    if carried is not None:
        rows = rows.join(carried.select(F.col(key), F.col(name).alias("__carried")), key, "left")
        state.append(F.col("__carried"))
    return rows.withColumn(name, F.coalesce(*state, F.lit(False))).select(*df.columns, name)


def charging_state_stream(
    sdf: DataFrame,
    path: str,
    checkpoint: str,
    key: str,
    ts: str,
    level: str,
    low: float = 10,
    high: float = 90,
    fold: int = 16,
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """:func:`charging_state` batch by batch, with the state per key kept beside the rows.

    The state of a key is whether it charges and the time of its last reading; a batch writes
    the state of its own keys only. A reading that is not newer than the last one of an earlier
    batch comes late: it changes nothing and is kept apart, see :func:`read_late`.
    """
    state_schema = T.StructType([sdf.schema[key], T.StructField("charging", T.BooleanType()), sdf.schema[ts]])

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, states = batch.sparkSession, f"{path}/state"
        batch = batch.persist()
        try:
            old = _before(spark, states, state_schema, batch_id, fold)
            carried, late = None, batch.limit(0)
            on_time = batch
            if old is not None:
                old = newest_version(old, key, ts).join(batch.select(key).distinct(), key, "left_semi")
                seen = old.select(F.col(key).alias("__key"), F.col(ts).alias("__seen"))
                told = batch.join(seen, F.col(key) == F.col("__key"), "left")
                behind = F.coalesce(F.col(ts) <= F.col("__seen"), F.lit(False))
                late = told.filter(behind).select(*batch.columns)
                on_time = told.filter(~behind).select(*batch.columns)
                carried = old.select(key, "charging")
            rows = charging_state(on_time, key, ts, level, low, high, carried=carried)
            rows.write.mode("overwrite").parquet(f"{path}/rows/batch_id={batch_id}")
            late.write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
            mark = threshold_mark(level, low, high)
            last = on_time.groupBy(key).agg(
                F.max_by(mark, F.when(mark.isNotNull(), F.col(ts))).alias("__new"), F.max(ts).alias(ts)
            )
            if carried is not None:
                last = last.join(carried, key, "left")
            charging = F.coalesce("__new", "charging", F.lit(False)) if carried is not None else F.coalesce("__new", F.lit(False))
            _keep(last.select(key, charging.alias("charging"), ts), states, batch_id, key, ts, fold)
        finally:
            batch.unpersist()

    return _run(sdf.writeStream.foreachBatch(write), checkpoint, trigger)


def read_charging(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField("charging", T.BooleanType())])
    return spark.read.schema(full).parquet(f"{path}/rows/*")


def read_late(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Readings that came after a newer one of their key, with the batch they came in."""
    return spark.read.schema(_versioned(schema)).parquet(f"{path}/late")
