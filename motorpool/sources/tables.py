"""Tables in and out: scans, generated rows, overwrite and append, inventories, previews."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from motorpool import schemas
from motorpool.functions.scalars import day, iso_text


def load_table(spark: SparkSession, directory: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """Scan ``<directory>/<name>.parquet`` with its declared schema."""
    schema = schema or schemas.ALL_TABLES[name]
    return spark.read.schema(schema).parquet(f"{directory}/{name}.parquet")


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """Rows of the program as a local relation, so the optimizer knows their size."""
    columns = list(zip(*rows)) if rows else [()] * len(schema.fields)
    return spark.createDataFrame(pa.Table.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(schema))], schema=to_arrow_schema(schema)
    ), schema)


def inline_table(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """A literal reference table: the rows sit in the program, so it is safe to broadcast."""
    return F.broadcast(literal_rows(spark, rows, schema))


def number_rows(spark: SparkSession, start: int, stop: int, step: int = 1, name: str = "n") -> DataFrame:
    """Integers from ``start`` up to, not including, ``stop``."""
    return spark.range(start, stop, step).select(F.col("id").cast("int").alias(name))


def date_series(spark: SparkSession, as_of, back: int, forward: int, name: str = "d") -> DataFrame:
    """Calendar rows from ``back`` days before to ``forward`` days after."""
    span = F.sequence(F.date_sub(day(as_of), back), F.date_add(day(as_of), forward))
    return spark.range(1).select(F.explode(span).alias(name))


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Rebuild a table from scratch and hand back the written rows.

    Large tables pass ``partition_by`` (a date), so that day filters skip folders.
    """
    return _write(df, path, "overwrite", partition_by)


def append_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Add a batch to a table and hand back the whole of it."""
    return _write(df, path, "append", partition_by)


def _write(df: DataFrame, path: str, mode: str, partition_by: Sequence[str]) -> DataFrame:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def insert_select(df: DataFrame, path: str, schema: T.StructType) -> DataFrame:
    """Append rows lined up to the target: its column order, its types, NULL where missing."""
    aligned = df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
    return append_table(aligned, path)


def register_view(df: DataFrame, name: str) -> str:
    df.createOrReplaceTempView(name)
    return name


def drop_view(spark: SparkSession, name: str) -> bool:
    return spark.catalog.dropTempView(name)


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def table_inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table with its row count."""
    return union_all(
        *[
            df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
            for name, df in tables.items()
        ]
    )


def footer_scan(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table whose ``count``, ``min`` and ``max`` are answered from the files' footers.

    Only aggregates of the whole table, or of partition columns, get there; with a filter on
    other columns, and for the bounds of texts and times, Spark reads the column as usual. A
    count over files without rows is NULL, as no footer offers any. The scan belongs to a session
    of its own, so the caller's settings stay as they are.
    """
    quick = spark.newSession()
    kept = [s for s in spark.conf.get("spark.sql.sources.useV1SourceList", "").split(",") if s not in ("", "parquet")]
    quick.conf.set("spark.sql.sources.useV1SourceList", ",".join(kept))
    quick.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    reader = quick.read if schema is None else quick.read.schema(schema)
    return reader.parquet(path)


def footer_bounds(spark: SparkSession, paths: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One row per table with its row count, the filled values of one column of whole numbers or
    days, and that column's least and greatest value: ``paths`` maps a table's name to
    (path, column). No column is read; an empty table has counts of 0 and no bounds.
    """

    def one(name: str, path: str, column: str) -> DataFrame:
        # Spark takes a pushed count for never NULL, so it is asked for only where there are rows.
        any_row = spark.read.parquet(path).select().limit(1).agg(F.count(F.lit(1))).scalar()

        def counted(c: Column) -> Column:
            return F.when(any_row > 0, c).otherwise(F.lit(0))

        least, greatest = F.min(column).alias("least"), F.max(column).alias("greatest")
        asked = footer_scan(spark, path).agg(F.count(F.lit(1)).alias("row_count"), F.count(column).alias("filled"), least, greatest)
        return asked.select(
            F.lit(name).alias("table_name"),
            F.lit(column).alias("column_name"),
            counted(F.col("row_count")).alias("row_count"),
            counted(F.col("filled")).alias("filled"),
            F.col("least").cast("string").alias("least"),
            F.col("greatest").cast("string").alias("greatest"),
        )

    return union_all(*[one(name, path, column) for name, (path, column) in paths.items()])


def describe_columns(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Schemas as rows: table, ordinal, column, type, nullable."""
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (name, i, f.name, f.dataType.simpleString(), f.nullable)
        for name, df in tables.items()
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    return literal_rows(
        spark, rows, schemas.struct("table_name:str ordinal:int column_name:str data_type:str nullable:bool")
    )


def describe_with_keys(columns: DataFrame, key_usage: DataFrame) -> DataFrame:
    """Mark the columns named in ``key_usage`` (table_name, column_name) as ``PK``."""
    marks = key_usage.select("table_name", "column_name", F.lit("PK").alias("key"))
    return columns.join(marks, ["table_name", "column_name"], "left")


def sample_table(df: DataFrame, limit: int = 20, order: Iterable[str] = ()) -> DataFrame:
    """A preview of 1 to 100 rows, each with the table's total; ``order`` makes it repeatable."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be from 1 to 100")
    order = list(order)
    head = (df.orderBy(*order) if order else df).limit(limit)
    total = df.agg(F.count(F.lit(1))).scalar()
    return head.withColumn("table_rows", total)


def normalise_types(df: DataFrame) -> DataFrame:
    """Decimals to double; dates and timestamps to ISO text."""

    def plain(field: T.StructField) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(field.dataType, T.DateType):
            c = iso_text(c, "date")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = iso_text(c, "timestamp")
        return c.alias(field.name)

    return df.select(*[plain(f) for f in df.schema.fields])


def parse_cells(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text cells to the declared types; ``true`` and ``1`` read as TRUE, all else as FALSE."""

    def typed(field: T.StructField) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, T.BooleanType):
            return F.lower(c).isin("true", "1").alias(field.name)
        return c.cast(field.dataType).alias(field.name)

    return df.select(*[typed(f) for f in schema.fields])


def read_ops_table(spark: SparkSession, name: str, snapshot: str | None = None, jdbc: Mapping[str, str] | None = None) -> DataFrame:
    """An operational table, whole, from its database or from a Parquet snapshot of it.

    A database read of any size should pass ``partitionColumn``, ``lowerBound``,
    ``upperBound`` and ``numPartitions`` among the options.
    """
    if jdbc is not None:
        return spark.read.format("jdbc").options(dbtable=name, **jdbc).load()
    return load_table(spark, snapshot, name)
