"""Tables laid out by key, so that a change batch rewrites only the folders that hold its keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motorpool.operators.joins import insert_if_absent
from motorpool.session import materialise, remove_folder

BUCKET = "__bucket"


@dataclass(frozen=True)
class KeyedTable:
    """A Parquet folder with one sub-folder per hash bucket of ``key``.

    ``buckets`` belongs to the layout and stays as it is for the life of the table. Choose it so
    that one bucket is about one file: a small batch then rewrites about one file a key.
    """

    path: str
    schema: T.StructType
    key: str
    buckets: int

    def bucket_of(self, key: Column | str) -> Column:
        typed = (F.col(key) if isinstance(key, str) else key).cast(self.schema[self.key].dataType)
        return F.pmod(F.xxhash64(typed), F.lit(self.buckets)).cast("int")

    def _with_buckets(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]).withColumn(
            BUCKET, self.bucket_of(self.key)
        )

    def _scan(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(self.path)


def create_keyed(df: DataFrame, path: str, key: str, buckets: int) -> KeyedTable:
    """Lay a table out by key, replacing what the path holds."""
    if buckets < 1:
        raise ValueError("buckets start at 1")
    if BUCKET in df.columns:
        raise ValueError(f"{BUCKET} is the layout's own column")
    table = KeyedTable(path, df.schema, key, buckets)
    bucketed = table._with_buckets(df).repartition(BUCKET)
    bucketed.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(BUCKET).parquet(path)
    return table


def read_keyed(spark: SparkSession, table: KeyedTable) -> DataFrame:
    return table._scan(spark).select(*table.schema.names)


def lookup(spark: SparkSession, table: KeyedTable, keys: Sequence) -> DataFrame:
    """The rows of a few given keys, read from their buckets alone."""
    wanted = [F.lit(k) for k in keys]
    if not wanted:
        return read_keyed(spark, table).limit(0)
    found = table._scan(spark).filter(F.col(BUCKET).isin(_buckets_of(spark, table, wanted)))
    return found.filter(F.col(table.key).isin(*wanted)).select(*table.schema.names)


def _buckets_of(spark: SparkSession, table: KeyedTable, keys: Sequence[Column]) -> list[int]:
    row = spark.range(1).select(F.array_distinct(F.array(*[table.bucket_of(k) for k in keys]))).first()
    return list(row[0])


def rewrite_touched(spark: SparkSession, table: KeyedTable, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
    """Replace the buckets that hold ``keys`` (first column) and leave all other files alone.

    ``change`` takes the rows of those buckets and gives their new rows, which must keep to the
    same buckets: any operator of ``operators/changes.py`` fits. The buckets' numbers go to
    the driver, at most ``table.buckets`` of them, and are returned. The new rows are written to
    the shared folder first; the buckets then change at the commit of one job, and one that
    lost all its rows is removed after it. A batch that was interrupted can be run again if
    ``change`` gives the same on its own outcome. One writer at a time: there is no lock.
    """
    marks = keys.select(table.bucket_of(keys.columns[0]).alias(BUCKET)).distinct().collect()
    touched = sorted(r[0] for r in marks)
    if not touched:
        return touched
    held = table._scan(spark).filter(F.col(BUCKET).isin(touched)).select(*table.schema.names)
    fresh = table._with_buckets(change(held))
    strays = F.raise_error(F.lit("a changed row left the buckets of its batch"))
    fresh = fresh.withColumn(BUCKET, F.when(F.col(BUCKET).isin(touched), F.col(BUCKET)).otherwise(strays.cast("int")))
    # Written aside first: the table is not read any more while its folders are replaced.
    fresh = materialise(fresh.repartition(BUCKET), "touched")
    filled = {r[0] for r in fresh.select(BUCKET).distinct().collect()}
    (
        fresh.repartition(BUCKET)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(BUCKET)
        .parquet(table.path)
    )
    for bucket in touched:
        if bucket not in filled:
            remove_folder(spark, f"{table.path}/{BUCKET}={bucket}")
    return touched


def upsert(spark: SparkSession, table: KeyedTable, rows: DataFrame, order: Sequence[str]) -> list[int]:
    """Insert rows, or replace those of the same key; of several new rows with one key the last
    by ``order`` counts, and where that is equal the greatest by the other plain columns.

    A NULL key is refused. Rows are folded before they meet the table, so a key with very many
    new rows ships one. Columns the rows lack become NULL.
    """
    key = table.key
    named = [
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema.fields
    ]
    rest = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.AtomicType) and f.name not in (key, *order)]
    known = F.when(F.col(key).isNotNull(), F.col(key)).otherwise(F.raise_error(F.lit("NULL key")).cast(rows.schema[key].dataType))
    placed = rows.withColumn(key, known).select(
        F.struct(*named).alias("__row"), F.struct(*order, *sorted(rest)).alias("__place"), F.col(key).alias("__key")
    )
    last = placed.groupBy("__key").agg(F.max_by("__row", "__place").alias("__row")).select("__row.*")
    return rewrite_touched(
        spark, table, rows.select(key), lambda held: held.join(last.select(key), key, "left_anti").select(*table.schema.names).unionByName(last)
    )


def insert_missing(spark: SparkSession, table: KeyedTable, rows: DataFrame, order: Sequence[str]) -> list[int]:
    """Insert rows whose key the table lacks; the others are passed over and their files stay.

    Only keys that are new count as touched: a batch of known keys writes nothing.
    """
    key = table.key
    marks = _held_buckets(spark, table, rows)
    new = rows.select(key).distinct().join(marks, key, "left_anti")
    aligned = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema.fields])
    return rewrite_touched(
        spark, table, new, lambda held: insert_if_absent(held, aligned.join(new, key, "left_semi").select(*table.schema.names), [key], order)
    )


def _held_buckets(spark: SparkSession, table: KeyedTable, rows: DataFrame) -> DataFrame:
    """The keys of the buckets that ``rows`` may touch: no other column and no other bucket is read."""
    touched = [r[0] for r in rows.select(table.bucket_of(table.key).alias(BUCKET)).distinct().collect()]
    return table._scan(spark).filter(F.col(BUCKET).isin(touched)).select(table.key)


def delete_keys(spark: SparkSession, table: KeyedTable, keys: DataFrame) -> list[int]:
    """Delete the rows of the listed keys (first column)."""
    doomed = keys.select(F.col(keys.columns[0]).cast(table.schema[table.key].dataType).alias(table.key)).distinct()
    return rewrite_touched(spark, table, doomed, lambda held: held.join(doomed, table.key, "left_anti").select(*table.schema.names))
