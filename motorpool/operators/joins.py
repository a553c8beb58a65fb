"""Joins. Catalyst and AQE choose the strategy from sizes they have measured; only literal
tables carry a broadcast hint."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motorpool.functions.scalars import minute_number
from motorpool.operators.aggregates import SCALE, in_digits
from motorpool.operators.filters import filter_since
from motorpool.sources.tables import union_all


def _renamed(dim: DataFrame, key: str, cols, prefix: str) -> DataFrame:
    names = cols if isinstance(cols, Mapping) else {c: f"{prefix}{c}" for c in cols}
    return dim.select(F.col(key).alias(f"__{prefix}{key}"), *[F.col(c).alias(n) for c, n in names.items()])


def enrich_left(fact: DataFrame, dim: DataFrame, on: tuple[str, str], cols, prefix: str = "") -> DataFrame:
    """Add dimension columns; ``on`` is (fact column, dimension key)."""
    side = _renamed(dim, on[1], cols, prefix)
    key = f"__{prefix}{on[1]}"
    return fact.join(side, F.col(on[0]) == F.col(key), "left").drop(key)


def star_join(fact: DataFrame, roles: Sequence[tuple[DataFrame, tuple[str, str], object, str]]) -> DataFrame:
    """Inner joins to dimensions, one per role: (dim, (fact column, key), columns, prefix).

    The same dimension may take several roles, such as origin and destination.
    """
    for dim, on, cols, prefix in roles:
        side = _renamed(dim, on[1], cols, prefix)
        key = f"__{prefix}{on[1]}"
        fact = fact.join(side, F.col(on[0]) == F.col(key)).drop(key)
    return fact


def event_bounds(df: DataFrame, date: str, start_time: str, end_time: str) -> DataFrame:
    """Window bounds from a date and two ``HH:mm`` texts: columns window_start, window_end."""
    def at(clock):
        return F.concat_ws(" ", F.col(date).cast("string"), F.col(clock)).cast("timestamp_ntz")

    return df.withColumn("window_start", at(start_time)).withColumn("window_end", at(end_time))


def _within_reach(points: DataFrame, ts: str, windows: DataFrame, start: str, end: str) -> DataFrame:
    """Points between the first start and the last end, so the rest leave at the scan."""
    reach = windows.agg(F.struct(F.min(start).alias("first"), F.max(end).alias("last"))).scalar()
    return points.filter((F.col(ts) >= reach["first"]) & (F.col(ts) < reach["last"]))


def range_join(
    points: DataFrame,
    windows: DataFrame,
    ts: str,
    start: str,
    end: str,
    keys: Sequence[str] = (),
    how: str = "inner",
    bucket_minutes: int = 60,
    salts: int = 4,
) -> DataFrame:
    """Points inside ``[start, end)``.

    Windows are laid over time blocks, so the join is an equi join on the block (and ``keys``)
    with the exact bounds as a residual test. For an inner join a window takes blocks of 1, 4,
    16 ... minutes, the largest size not longer than it, so 5 at most, whatever its length; a
    point takes the block it lies in for each of the sizes that the windows use, mostly one or
    two. Neighbouring points of a block meet the windows together, :data:`CHUNK` at a time, and
    the rows come out in that order, a window's beside each other.
    Otherwise a point must not be copied, and all blocks have ``bucket_minutes``.

    Points are dealt to ``salts`` shares of their block and windows go to each, so one crowded
    block is split among tasks. ``how="semi"`` keeps each point that lies in any window, once;
    only then are equal windows folded into one first. A window column that points have too is
    refused, unless it is one of ``keys``.
    """
    clashing = [c for c in windows.columns if c in points.columns and c not in keys]
    if how != "semi" and clashing:
        raise ValueError(f"points and windows both have {', '.join(clashing)}; rename them first")
    spans = windows.filter(F.col(start) < F.col(end))
    if how == "semi":
        spans = spans.select(*keys, start, end).distinct()
    if how == "inner":
        minutes = minute_number(end) - minute_number(start) + 1
        spans = spans.withColumn("__level", F.floor(F.log2(minutes) / 2).cast("int"))
        buckets = F.sequence(_block(minute_number(start)), _block(minute_number(end)))
    else:
        spans = spans.withColumn("__level", F.lit(0))
        buckets = F.sequence(
            F.floor(minute_number(start) / bucket_minutes), F.floor(minute_number(end) / bucket_minutes)
        )
    spans = spans.withColumn("__bucket", F.explode(buckets))
    if how == "inner":
        levels = spans.agg(F.collect_set("__level").alias("levels")).scalar()
    spans = spans.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).alias("w")
    near = points if how == "left" else _within_reach(points, ts, windows, start, end)
    others = [f.name for f in points.schema.fields if f.name != ts and isinstance(f.dataType, T.AtomicType)]
    if how == "inner":
        placed = near.withColumn("__levels", levels).withColumn("__level", F.explode("__levels")).drop("__levels")
        placed = placed.withColumn("__bucket", _block(minute_number(ts)))
    else:
        placed = near.withColumn("__level", F.lit(0)).withColumn("__bucket", F.floor(minute_number(ts) / bucket_minutes))
    placed = placed.withColumn("__salt", F.pmod(F.xxhash64(ts, *others), F.lit(salts)).cast("int"))
    cell = ["__level", "__bucket", "__salt", *keys]
    if how == "inner":
        placed = _chunked(placed, cell, ts, points.columns).alias("p")
        match = (F.col("p.__last") >= F.col(f"w.{start}")) & (F.col("p.__first") < F.col(f"w.{end}"))
        # Spark does not compile a join with a lambda into one loop with the explode below, which
        # would hold a chunk's rows with all its windows at once.
        match = match & F.exists(f"p.__of_{ts}", lambda at: (at >= F.col(f"w.{start}")) & (at < F.col(f"w.{end}")))
    else:
        placed = placed.alias("p")
        match = (F.col(f"p.{ts}") >= F.col(f"w.{start}")) & (F.col(f"p.{ts}") < F.col(f"w.{end}"))
    for name in cell:
        match = match & (F.col(f"p.{name}") == F.col(f"w.{name}"))
    if how == "semi":
        return placed.join(spans, match, "left_semi").drop("__level", "__bucket", "__salt")
    added = [c for c in windows.columns if c not in keys]
    right = [F.col(f"w.{c}") for c in added]
    if how == "left":
        return placed.join(spans, match, how).select("p.*", *right).drop("__level", "__bucket", "__salt")
    bounds = [F.col(f"w.{start}").alias("__start"), F.col(f"w.{end}").alias("__end")]
    pairs = placed.join(spans, match).select(
        *[f"__of_{c}" for c in points.columns], *right, *bounds, F.posexplode(f"__of_{ts}").alias("__place", "__at")
    )
    inside = (F.col("__at") >= F.col("__start")) & (F.col("__at") < F.col("__end"))
    return pairs.filter(inside).select(*[F.col(f"__of_{c}")[F.col("__place")].alias(c) for c in points.columns], *added)


#: Points that meet a window together, and so the most that one row of a join holds.
CHUNK = 128


def _chunked(points: DataFrame, cell: Sequence[str], ts: str, columns: Sequence[str]) -> DataFrame:
    """Each cell's points by time, up to :data:`CHUNK` in a row: their first and last time and a
    list for each column, so that those nobody reads leave before the shuffle."""
    place = F.row_number().over(W.partitionBy(*cell).orderBy(ts))
    return (
        points.withColumn("__chunk", F.floor((place - 1) / CHUNK))
        .groupBy(*cell, "__chunk")
        .agg(
            F.min(ts).alias("__first"),
            F.max(ts).alias("__last"),
            *[F.collect_list(F.struct(c)).getField(c).alias(f"__of_{c}") for c in columns],  # as a struct a NULL stays
        )
    )


def _block(minute: Column) -> Column:
    """The number of the block of ``4 ** __level`` minutes that a minute lies in."""
    return F.call_function("shiftright", minute.cast("long"), (F.col("__level") * 2).cast("int"))


def range_stats(
    points: DataFrame,
    windows: DataFrame,
    ts: str,
    start: str,
    end: str,
    by: Sequence[str],
    measure: str,
    window_id: str,
    keys: Sequence[str] = (),
    scale: int = SCALE,
    levels: int = 8,
) -> DataFrame:
    """Per window and ``by``: count of points inside and their mean, without the point pairs.

    Bounds fall on whole minutes (others raise an error), so points fold into one cell per
    minute, ``by`` and ``keys``, and cells into blocks of 1, 2, 4, ... ``2**levels`` minutes.
    A window is the sum of a few aligned blocks, about two per level, so the join is a plain
    equi join on the block; equal windows are folded first. Neither a crowded minute nor many
    overlapping windows make pairs. ``measure`` is summed as DECIMAL of ``scale`` digits, so the
    mean does not depend on task order; a value with more digits is an error.
    """
    cells = (
        _within_reach(points, ts, windows, start, end)
        .withColumn("__minute", minute_number(ts))
        .groupBy(*keys, *by, "__minute")
        .agg(
            F.count(F.lit(1)).alias("__n"),
            F.count(measure).alias("__m"),
            F.sum(in_digits(measure, scale)).alias("__s"),
        )
    )
    sums = [F.sum(c).alias(c) for c in ("__n", "__m", "__s")]
    blocks = (
        cells.withColumn("__level", F.explode(F.array(*[F.lit(i) for i in range(levels + 1)])))
        .withColumn("__block", F.expr("shiftright(__minute, __level)"))
        .groupBy(*keys, *by, "__level", "__block")
        .agg(*sums)
    )

    def minute_bound(name: str) -> Column:
        aligned = F.extract(F.lit("SECOND"), F.col(name)) == 0
        return F.when(aligned | F.col(name).isNull(), minute_number(name)).otherwise(
            F.raise_error(F.lit("range_stats needs bounds on whole minutes"))
        )

    bounded = windows.select(
        window_id, *keys, minute_bound(start).alias("__from"), minute_bound(end).alias("__to")
    )
    spans = (
        bounded.select(*keys, "__from", "__to")
        .distinct()
        .filter(F.col("__from") < F.col("__to"))
        .withColumn("__piece", F.explode(_aligned_blocks(levels)))
        .select(*keys, "__from", "__to", "__piece.*")
    )
    per_span = (
        spans.join(blocks, [*keys, "__level", "__block"])
        .groupBy(*keys, "__from", "__to", *by)
        .agg(*sums)
        .withColumn("mean", F.col("__s").cast("double") / F.nullif("__m", F.lit(0)))
        .select(*keys, "__from", "__to", *by, F.col("__n").alias("n"), "mean")
    )
    return bounded.join(per_span, [*keys, "__from", "__to"]).select(window_id, *by, "n", "mean")


def _aligned_blocks(levels: int) -> Column:
    """``[__from, __to)`` as disjoint blocks (level, block) of ``2**level`` minutes.

    At each level the whole blocks inside run from ``first`` to before ``last``; those whose
    parent block is inside too are left to the next level, so at most one at each end is
    taken. The top level takes all it has.
    """

    def inside(level: int) -> tuple[str, str]:
        return f"shiftright(__from + {2**level - 1}, {level})", f"shiftright(__to, {level})"

    def block(level: int, number: str) -> str:
        return f"named_struct('__level', {level}, '__block', {number})"

    ends = []
    for level in range(levels):
        first, last = inside(level)
        ends.append(f"IF({first} < {last} AND {first} % 2 = 1, {block(level, first)}, NULL)")
        ends.append(f"IF({first} < {last} AND {last} % 2 = 1, {block(level, last + ' - 1')}, NULL)")
    first, last = inside(levels)
    top = f"IF({first} < {last}, transform(sequence({first}, {last} - 1), b -> {block(levels, 'b')}), array())"
    return F.expr(f"concat(array_compact(array({', '.join(ends)})), {top})")


def grid(dim: DataFrame, **series: Column) -> DataFrame:
    """Every dimension row with every member of each series.

    Series are array columns (``sequence`` of dates or numbers), so rows are expanded in
    place and nothing is joined.
    """
    for name, members in series.items():
        dim = dim.withColumn(name, F.explode(members))
    return dim


def left_default(df: DataFrame, lookup: DataFrame, on: Sequence[str], value: str, default) -> DataFrame:
    """Add ``value`` from a lookup unique on its keys, with a default where it has none."""
    side = lookup.select(*on, F.col(value))
    return df.join(side, list(on), "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def pick_from_list(df: DataFrame, items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Resolve (group, index) to the list's entry."""
    return df.join(items, list(keys))


def first_match(df: DataFrame, dims: Mapping[str, DataFrame], group: str, index: str, value: str) -> DataFrame:
    """The entry at ``index`` of the dimension that belongs to the row's group.

    The dimensions (index, value) become one table keyed by group, so one join serves all.
    """
    stacked = union_all(
        *[
            d.select(F.lit(name).alias(group), F.col(d.columns[0]).alias(index), F.col(d.columns[1]).alias(value))
            for name, d in dims.items()
        ]
    )
    return df.join(stacked, [group, index], "left")


def top_n_per_key(df: DataFrame, keys: Sequence[str] | str, order: Sequence[Column], n: int, rank: str = "rank_in_key") -> DataFrame:
    """The first ``n`` rows of each key with their rank.

    Spark keeps ``n`` per key on the map side already, so a hot key ships few rows.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def latest_per_key(
    df: DataFrame,
    key: str,
    ts: str,
    as_of=None,
    minutes: int | None = None,
    ties: str = "all",
    tie_break: Sequence[Column] = (),
) -> DataFrame:
    """The newest row of each key, within a lookback when one is given.

    ``all`` keeps every row at the newest time; ``one`` keeps a single row, the first by
    ``tie_break``, which it needs.
    """
    if ties == "one" and not tie_break:
        raise ValueError("ties='one' needs a tie_break")
    if minutes is not None:
        df = filter_since(df, ts, as_of, minutes=minutes)
    w = W.partitionBy(key).orderBy(F.col(ts).desc(), *(tie_break if ties == "one" else ()))
    place = F.rank() if ties == "all" else F.row_number()
    return df.withColumn("__place", place.over(w)).filter(F.col("__place") <= 1).drop("__place")


def attach_group_stats(dim: DataFrame, fact: DataFrame, on: tuple[str, str], aggs: Sequence[Column], fill=0) -> DataFrame:
    """Dimension rows with statistics of their facts, ``fill`` where there are none."""
    stats = fact.groupBy(F.col(on[1]).alias("__key")).agg(*aggs)
    names = [c for c in stats.columns if c != "__key"]
    joined = dim.join(stats, F.col(on[0]) == F.col("__key"), "left").drop("__key")
    return joined.fillna(fill, subset=names)


def attach_children(parent: DataFrame, child: DataFrame, on: tuple[str, str], order: Sequence[Column], n: int, cols: Sequence[str], name: str) -> DataFrame:
    """Each parent with an array of its first ``n`` children, in order; empty when none."""
    kept = top_n_per_key(child, on[1], order, n, "__rank")
    packed = kept.groupBy(F.col(on[1]).alias("__key")).agg(
        F.sort_array(F.collect_list(F.struct("__rank", *cols))).alias("__items")
    )
    items = F.transform("__items", lambda x: F.struct(*[x[c].alias(c) for c in cols]))
    return (
        parent.join(packed, F.col(on[0]) == F.col("__key"), "left")
        .withColumn(name, F.coalesce(items, F.filter(items, lambda _: F.lit(False)), F.array().cast(_items_type(child, cols))))
        .drop("__key", "__items")
    )


def _items_type(child: DataFrame, cols: Sequence[str]) -> str:
    fields = ",".join(f"{c}:{child.schema[c].dataType.simpleString()}" for c in cols)
    return f"array<struct<{fields}>>"


def insert_if_absent(target: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Add the rows whose key the target does not hold; of several with one key, the first by
    ``order``, or the smallest by all other columns where none is given.

    New rows are folded per key before they meet the target. A NULL in the key is an error.
    """
    key = list(key)
    for name in key:
        given = F.col(name)
        new = new.withColumn(name, F.when(given.isNotNull(), given).otherwise(F.raise_error(F.lit(f"{name} is NULL")).cast(new.schema[name].dataType)))
    others = [c for c in new.columns if c not in key]
    if others:
        row = F.struct(*others)
        first = F.min_by(row, F.struct(*order)) if order else F.min(row)
        folded = new.groupBy(*key).agg(first.alias("__row")).select(*key, "__row.*")
    else:
        folded = new.select(*key).distinct()
    return target.unionByName(folded.join(target.select(*key), key, "left_anti"))


def orphans(child: DataFrame, parent: DataFrame, on: tuple[str, str]) -> DataFrame:
    """Child rows whose parent does not exist. A NULL names no parent, so it is no orphan."""
    child = child.filter(F.col(on[0]).isNotNull())
    known = parent.select(F.col(on[1]).alias("__key")).distinct()
    return child.join(known, F.col(on[0]) == F.col("__key"), "left_anti")


def delete_cascade(parent: DataFrame, child: DataFrame, on: tuple[str, str], doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents and children left after the parents named in ``doomed`` go; ``on`` is (child column, parent key)."""
    gone = doomed.select(F.col(on[1]).alias("__gone")).distinct()
    parents = parent.join(gone, F.col(on[1]) == F.col("__gone"), "left_anti")
    children = child.join(gone, F.col(on[0]) == F.col("__gone"), "left_anti")
    return parents, children
