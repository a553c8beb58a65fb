"""Aggregations. All are algebraic, so Spark folds them on the map side before a shuffle.

Counts, sums and numbers fold in a hash table; the largest or first text or struct of a key
makes Spark sort a task's rows by key before it folds them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motorpool.functions.scalars import col


#: Digits after the point that sums keep; more in a value are an error.
SCALE = 6


def in_digits(c: Column | str, scale: int = SCALE) -> Column:
    """The value as DECIMAL of ``scale`` digits; a value with more of them is an error, so no digit
    is lost in silence. What a DOUBLE cannot tell from such a decimal counts as one."""
    value = col(c)
    exact = value.cast(f"decimal(28,{scale})")
    same = F.abs(exact.cast("double") - value) <= F.lit(1e-15) * F.abs(value) + F.lit(10.0 ** -(scale + 4))
    message = F.concat(F.lit(f"more than {scale} digits after the point, or too large: "), value.cast("string"))
    return F.when(value.isNull() | F.coalesce(same, F.lit(False)), exact).otherwise(F.raise_error(message))


def exact_sum(c: Column | str, scale: int = SCALE) -> Column:
    """Sum as DECIMAL, given back as DOUBLE: the same whatever the order of the tasks."""
    return F.sum(in_digits(c, scale)).cast("double")


def share_where(predicate: Column, digits: int = 1) -> Column:
    """Percent of rows for which the predicate holds; NULL for no rows."""
    hits = F.count_if(predicate)
    return F.round(F.lit(100.0) * hits / F.nullif(F.count(F.lit(1)), F.lit(0)), digits)


def weighted_share(weight: Column | str, predicate: Column, digits: int = 1, scale: int = SCALE) -> Column:
    """Percent of the weight that lies in rows for which the predicate holds."""
    part = exact_sum(F.when(predicate, col(weight)).otherwise(F.lit(0.0)), scale)
    return F.round(F.lit(100.0) * part / F.nullif(exact_sum(weight, scale), F.lit(0.0)), digits)


def conditional_share(df: DataFrame, predicate: Column, name: str, digits: int = 1) -> DataFrame:
    return df.agg(share_where(predicate, digits).alias(name))


def filtered_avg(df: DataFrame, value: str, predicate: Column, name: str, digits: int = 1, factor: float = 1.0) -> DataFrame:
    return df.filter(predicate).agg(F.round(F.avg(value) * F.lit(factor), digits).alias(name))


def ratio_to_table_count(df: DataFrame, other: DataFrame, name: str, divisor: float = 1.0, digits: int = 1) -> DataFrame:
    """Rows of ``df``, over a divisor, per row of another table."""
    rows = other.agg(F.count(F.lit(1))).scalar()
    return df.agg(F.count(F.lit(1)).alias("__n")).select(
        F.round(F.col("__n") / F.lit(divisor) / F.nullif(rows, F.lit(0)), digits).alias(name)
    )


def per_entity_per_day(df: DataFrame, entities: DataFrame, days: int, name: str, digits: int = 1) -> DataFrame:
    return ratio_to_table_count(df, entities, name, float(days), digits)


def count_by(df: DataFrame, keys: Sequence[str], name: str = "cnt") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def group_stats(df: DataFrame, keys: Sequence[str], value: str, count: str = "cnt", mean: str = "mean") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count), F.avg(value).alias(mean))


def group_max(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(value).alias(name))


def summary_row(df: DataFrame, **aggs: Column) -> DataFrame:
    return df.agg(*[c.alias(n) for n, c in aggs.items()])


def count_where(df: DataFrame, **predicates: Column) -> DataFrame:
    """Many filtered counts of one table in one pass."""
    return df.agg(*[F.count_if(p).alias(n) for n, p in predicates.items()])


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The values of each column as tidy (name, value) rows; NULL and empty text are left out."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in cols]
    )
    return (
        df.select(F.explode(pairs).alias("p"))
        .select("p.name", "p.value")
        .filter(F.col("value").isNotNull() & (F.col("value") != ""))
        .distinct()
    )


def pivot_counts(df: DataFrame, keys: Sequence[str], column: str, values: Sequence) -> DataFrame:
    """Counts of the given values as columns, 0 where there are none, in one pass."""
    counts = [F.count_if(F.col(column) == F.lit(v)).alias(str(v)) for v in values]
    return df.groupBy(*keys).agg(*counts) if keys else df.agg(*counts)


def status_map(df: DataFrame, column: str, values: Sequence[str], name: str = "counts", other: str = "other") -> DataFrame:
    """The counts of the listed values that occur, as one MAP, in one pass. Whatever is not listed,
    and NULL, counts as ``other``, so the map adds up to all rows and is as small as the list."""
    listed = sorted(values)
    if other in listed:
        raise ValueError(f"{other!r} is a listed value; give another name for the rest")
    found = F.coalesce(F.col(column).isin(listed), F.lit(False)) if listed else F.lit(False)
    counted = [F.count_if(F.col(column) == v) for v in listed] + [F.count_if(~found)]
    counts = df.agg(*[c.alias(f"__{i}") for i, c in enumerate(counted)])
    keys = [*listed, other]
    entries = F.array(*[F.struct(F.lit(v).alias("key"), F.col(f"__{i}").alias("value")) for i, v in enumerate(keys)])
    return counts.select(F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0)).alias(name))


def distinct_total(counts: DataFrame, column: str, name: str = "total") -> DataFrame:
    return counts.agg(F.coalesce(F.sum(column), F.lit(0)).alias(name))


def kpi_row(spark: SparkSession, parts: Sequence[tuple[DataFrame, Mapping[str, object]]]) -> DataFrame:
    """KPIs of several tables in one row.

    Each part is a one-row frame and its columns with the value to show when there is none.
    The parts run as scalar subqueries, one per part, side by side.
    """
    packed = [
        frame.select(F.struct(*[F.col(c) for c in defaults]).alias("kpis")).scalar().alias(f"__part{i}")
        for i, (frame, defaults) in enumerate(parts)
    ]
    return spark.range(1).select(*packed).select(
        *[
            F.coalesce(F.col(f"__part{i}")[name], F.lit(default)).alias(name)
            for i, (_, defaults) in enumerate(parts)
            for name, default in defaults.items()
        ]
    )
