"""Kept orders: a list sorted once, from which any page reads the ranges it lies in."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE = "__range"


@dataclass(frozen=True)
class KeptOrder:
    """The rows of a list in folders by range of its order, beside a table with each range's
    first position and row count."""

    path: str
    schema: T.StructType
    order: tuple[tuple[str, bool], ...]

    def columns(self) -> list[Column]:
        return [F.col(n).desc() if descending else F.col(n).asc() for n, descending in self.order]


def keep_order(df: DataFrame, path: str, order: Sequence[tuple[str, bool]], rows_per_range: int = 100_000) -> KeptOrder:
    """Lay a list out by ``order``, pairs of (column, descending) that end in a unique column.

    The ranges are those of Spark's range partitioning, so no task sees more than its own. With
    a column of many equal values, the columns after it part them. A list whose whole order is
    equal falls into one range and is as slow as sorting it.
    """
    if RANGE in df.columns:
        raise ValueError(f"{RANGE} is the layout's own column")
    if rows_per_range < 1:
        raise ValueError("rows_per_range starts at 1")
    kept = KeptOrder(path, df.schema, tuple((n, bool(d)) for n, d in order))
    ranges = max(1, -(-df.count() // rows_per_range))
    by = kept.columns()
    (
        df.repartitionByRange(ranges, *by)
        .sortWithinPartitions(*by)
        .withColumn(RANGE, F.spark_partition_id())
        .write.mode("overwrite")
        .partitionBy(RANGE)
        .parquet(f"{path}/rows")
    )
    counted = _rows(df.sparkSession, kept).groupBy(RANGE).agg(F.count(F.lit(1)).alias("rows"))
    # One row per range, so the running total may see them all.
    earlier = W.orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    starts = counted.select(RANGE, "rows", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    starts.coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")
    return kept


def _rows(spark: SparkSession, kept: KeptOrder) -> DataFrame:
    return spark.read.schema(T.StructType([*kept.schema.fields, T.StructField(RANGE, T.IntegerType())])).parquet(f"{kept.path}/rows")


def _ranges(spark: SparkSession, kept: KeptOrder) -> DataFrame:
    return spark.read.schema(f"{RANGE} int, rows long, start long").parquet(f"{kept.path}/ranges")


def kept_page(spark: SparkSession, kept: KeptOrder, page: int, per_page: int) -> DataFrame:
    """One page with the list's ``total``, in order; nothing is written.

    The ranges a page lies in are looked up first: at most ``per_page`` of them go to the driver,
    as each holds a row of the page. Only their folders are read.
    """
    if page < 1 or per_page < 1:
        raise ValueError("page and per_page start at 1")
    if "total" in kept.schema.names:
        raise ValueError("the list has a column total; rename it before keeping the order")
    first = (page - 1) * per_page
    ranges = _ranges(spark, kept)
    met = ranges.filter((F.col("start") < first + per_page) & (F.col("start") + F.col("rows") > first))
    hit = sorted((r["start"], r[RANGE]) for r in met.collect())
    total = ranges.agg(F.coalesce(F.sum("rows"), F.lit(0))).scalar()
    rows = _rows(spark, kept).filter(F.col(RANGE).isin([r for _, r in hit])).select(*kept.schema.names)
    skipped = first - hit[0][0] if hit else 0
    return rows.orderBy(*kept.columns()).offset(skipped).limit(per_page).withColumn("total", total)
