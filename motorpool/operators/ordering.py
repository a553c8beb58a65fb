"""Numbering, sorting, top-k and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motorpool.session import materialise


def row_number_over(df: DataFrame, order: Sequence[str | Column], name: str = "rn", partitions: int | None = None) -> DataFrame:
    """Consecutive numbers from 1 over the whole table, without one task seeing all of it.

    Rows are range-partitioned and sorted by ``order``, which must be unique for the numbers
    to be repeatable, and written to the shared folder, so that the count per partition and
    the numbered rows come from the same layout. A partition's start is the running total of
    the counts before it: one row per partition, so that side is safe to broadcast.
    """
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    laid_out = materialise(
        ranged.sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered"
    )
    part = F.shiftrightunsigned(F.col("__at"), 33)
    numbered = laid_out.withColumn("__part", part)
    ends = numbered.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = ends.select(
        F.col("__part"), F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__start")
    )
    within = F.col("__at") - F.shiftleft(F.col("__part"), 33)
    return (
        numbered.join(F.broadcast(starts), "__part")
        .withColumn(name, F.col("__start") + within + 1)
        .drop("__at", "__part", "__start")
    )


def sequential_id(df: DataFrame, order: Sequence[str | Column], prefix: str, width: int, name: str, partitions: int | None = None) -> DataFrame:
    """Text ids such as ``RD-0000001``; a number wider than the pad keeps all its digits."""
    numbered = row_number_over(df, order, "__rn", partitions)
    return numbered.withColumn(name, padded_id(prefix, F.col("__rn"), width)).drop("__rn")


def padded_id(prefix: str, number: Column, width: int) -> Column:
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0")))


def top_k(df: DataFrame, order: Sequence[str | Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def paginate(df: DataFrame, order: Sequence[str | Column], page: int, per_page: int, shallow: int = 1000) -> DataFrame:
    """One page, each row with the total of the same filtered rows.

    ``order`` should end in a unique column; otherwise pages may overlap. Up to ``shallow`` rows
    deep, every task offers its first rows and one merges them. Deeper, rows are numbered by
    :func:`row_number_over`, so no task holds all that comes before the page; :func:`page_after`
    is cheaper still where the last row shown is known.
    """
    if page < 1 or per_page < 1:
        raise ValueError("page and per_page start at 1")
    total = df.agg(F.count(F.lit(1))).scalar()
    first = (page - 1) * per_page
    if first + per_page <= shallow:
        return df.orderBy(*order).offset(first).limit(per_page).withColumn("total", total)
    numbered = row_number_over(df, order, "__rn")
    return numbered.filter(F.col("__rn").between(first + 1, first + per_page)).drop("__rn").withColumn("total", total)


def page_after(df: DataFrame, keys: Sequence[tuple[str, bool]], last: Sequence | None, per_page: int) -> DataFrame:
    """The page that follows the row with the values ``last`` of the key columns, or the first.

    ``keys`` are (column, descending) and hold no NULLs. The condition reaches the scan, and only
    ``per_page`` rows leave each task.
    """
    if last is not None:
        after, same = F.lit(False), F.lit(True)
        for (name, descending), value in zip(keys, last, strict=True):
            c, edge = F.col(name), F.lit(value)
            after = after | (same & ((c < edge) if descending else (c > edge)))
            same = same & (c == edge)
        # The first key bounds the scan by itself.
        (name, descending), value = keys[0], last[0]
        df = df.filter((F.col(name) <= F.lit(value)) if descending else (F.col(name) >= F.lit(value))).filter(after)
    return df.orderBy(*[F.col(n).desc() if d else F.col(n).asc() for n, d in keys]).limit(per_page)


def whitelisted_order(sort: str, order: str, allowed: Sequence[str], default: str, tie_break: Sequence[str] = ()) -> list:
    """An order by a listed column only; anything else gives the default, descending unless ``ASC``."""
    column = F.col(sort if sort in allowed else default)
    return [column.asc() if order.upper() == "ASC" else column.desc(), *tie_break]


def sort_whitelisted(df: DataFrame, sort: str, order: str, allowed: Sequence[str], default: str, tie_break: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(*whitelisted_order(sort, order, allowed, default, tie_break))


def sort_multi(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.orderBy(*columns)


def append_pinned_rows(df: DataFrame, pinned: DataFrame) -> DataFrame:
    """Fixed rows added after a build."""
    return df.unionByName(pinned.select(*[F.col(f.name).cast(f.dataType) for f in df.schema.fields]))
