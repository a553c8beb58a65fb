"""Demand forecasts: the zone, date and hour grid, its predictions, and demand from history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorpool import schemas, values
from motorpool.functions.hashing import hash_uniform, pick
from motorpool.functions.scalars import col, day, whole
from motorpool.operators.aggregates import group_max
from motorpool.operators.joins import grid, left_default
from motorpool.operators.ordering import padded_id
from motorpool.plans.fleet import numbered_expand


def event_multipliers(events: DataFrame) -> DataFrame:
    """Largest multiplier per forecast_date and zone_id."""
    return group_max(
        events.select(F.col("event_date").alias("forecast_date"), F.col("zone").alias("zone_id"), "demand_multiplier"),
        ["forecast_date", "zone_id"],
        "demand_multiplier",
        "event_mult",
    )


def forecast_grid(
    zones: DataFrame,
    multipliers: DataFrame,
    as_of,
    back: int = 30,
    forward: int = 7,
    step: int = 3,
    mode: str = "modulo",
    order: str = "zone_id",
) -> DataFrame:
    """Past days every ``step`` hours and today plus ``forward`` days hourly, per zone.

    The event multiplier joins at zone and date, before the hours are laid out; ``forecast_id``
    numbers the rows by date, the ``order`` of a zone column, and hour. It is part of the seed
    in the scaled build.
    """
    today = day(as_of)
    span = F.sequence(F.date_sub(today, back), F.date_add(today, forward))
    needed = dict.fromkeys(["zone_id", "city", "base_demand_per_hour", "vehicle_capacity", order])
    days = grid(zones.select(*needed), forecast_date=span)
    days = left_default(days, multipliers, ["forecast_date", "zone_id"], "event_mult", 1.0)
    past = F.col("forecast_date") < today
    days = days.withColumns(
        {
            "period": F.when(past, "historical").otherwise("future"),
            "slots": F.when(past, F.lit((24 + step - 1) // step)).otherwise(F.lit(24)),
        }
    )
    laid_out = numbered_expand(days, "slots", "forecast_date", [order], "slot", "rn").withColumn(
        "forecast_id", padded_id("FC-", F.col("rn"), 6)
    )
    own = (["forecast_id"] if mode == "scaled" else []) + ["forecast_date", "zone_id", "hour"]
    hour = (F.col("slot") - 1) * F.when(F.col("period") == "historical", F.lit(step)).otherwise(F.lit(1))
    return laid_out.withColumn("hour", hour.cast("int")).withColumns(
        {
            "hour_weight": pick(F.col("hour"), values.HOUR_DEMAND),
            "seed": F.concat_ws("-", *[F.col(c).cast("string") for c in own]),
        }
    ).drop("slot", "slots")


def predict_demand_supply(df: DataFrame) -> DataFrame:
    """Hashed demand and supply of a grid row, at least 1 each."""
    demand = (
        F.col("base_demand_per_hour")
        * F.col("hour_weight")
        * F.greatest(F.col("event_mult"), F.lit(1.0))
        * hash_uniform(F.concat(F.lit("fc-demand-"), "seed"), 0.8, 1.2)
    )
    supply = F.col("vehicle_capacity") * hash_uniform(F.concat(F.lit("fc-supply-"), "seed"), 0.5, 1.0)
    return df.withColumns(
        {
            "predicted_demand": F.greatest(F.lit(1), whole(demand)),
            "predicted_supply": F.greatest(F.lit(1), whole(supply)),
        }
    )


def demand_score(predicted: Column | str, base: Column | str, multiplier: Column | str, round_first: bool = False) -> Column:
    """Demand against 1.5 times the base, raised by 30 % on event days, at most 1, 2 digits.

    ``round_first`` rounds the plain score before the rise as well.
    """
    plain = col(predicted).cast("double") / (col(base) * F.lit(1.5))
    if round_first:
        plain = F.round(F.least(F.lit(1.0), plain), 2)
    raised = F.when(col(multiplier) > 1.0, plain * F.lit(1.3)).otherwise(plain)
    return F.round(F.least(F.lit(1.0), raised), 2)


def confidence(seed: Column | str, date: Column | str, as_of) -> Column:
    """0.70 to 0.98 for the past; a band that sinks by 0.02 a day for today and later."""
    seed, ahead = col(seed), F.date_diff(col(date), day(as_of))
    centre = F.lit(0.95) - ahead * F.lit(0.02)
    lo = F.greatest(F.lit(0.70), centre - F.lit(0.10))
    hi = F.least(F.lit(0.98), centre + F.lit(0.03))
    return F.round(F.when(ahead < 0, hash_uniform(seed, 0.70, 0.98)).otherwise(hash_uniform(seed, lo, hi)), 2)


def build_forecasts(
    zones: DataFrame,
    events: DataFrame,
    as_of,
    back: int = 30,
    forward: int = 7,
    step: int = 3,
    mode: str = "modulo",
    order: str = "zone_id",
) -> DataFrame:
    rows = predict_demand_supply(
        forecast_grid(zones, event_multipliers(events), as_of, back, forward, step, mode, order)
    )
    twice = mode == "scaled"
    return rows.withColumns(
        {
            "demand_score": demand_score("predicted_demand", "base_demand_per_hour", "event_mult", round_first=twice),
            "confidence": confidence(F.concat(F.lit("fc-conf-"), "seed"), "forecast_date", as_of),
            "model_version": F.lit(values.MODEL_VERSION),
        }
    ).select(*schemas.FLEET_TABLES["demand_forecasts"].names)


def predict_demand(
    zones: DataFrame,
    rides: DataFrame,
    events: DataFrame,
    as_of,
    history_days: int,
    ahead_days: int,
    rides_per_vehicle_hour: float = 2.0,
) -> DataFrame:
    """Expected rides, demand score and vehicles for each zone and coming hour.

    Our own definition, as only the name and purpose are given: the mean of the zone's rides
    at that weekday and hour over the history, times the event multiplier. ``rides`` needs
    pickup_zone and request_ts.
    """
    today = day(as_of)
    first = F.date_sub(today, history_days)
    past = rides.filter(
        (F.col("request_ts") >= first.cast("timestamp_ntz")) & (F.col("request_ts") < today.cast("timestamp_ntz"))
    )
    counted = past.groupBy(
        F.col("pickup_zone").alias("zone_id"),
        F.dayofweek("request_ts").alias("dow"),
        F.hour("request_ts").alias("hour"),
    ).agg(F.count(F.lit(1)).alias("past_rides"))
    ahead = F.sequence(today, F.date_add(today, ahead_days))
    coming = grid(zones.select("zone_id", "city", "base_demand_per_hour"), forecast_date=ahead)
    coming = left_default(coming, event_multipliers(events), ["forecast_date", "zone_id"], "event_mult", 1.0)
    coming = grid(coming, hour=F.sequence(F.lit(0), F.lit(23))).withColumn("dow", F.dayofweek("forecast_date"))
    joined = left_default(coming, counted, ["zone_id", "dow", "hour"], "past_rides", 0)
    # The history has every weekday once a week, and those of its first days once more.
    begun = F.pmod(F.col("dow") - F.dayofweek(first), F.lit(7)) < history_days % 7
    same_days = F.lit(history_days // 7) + begun.cast("int")
    expected = F.col("past_rides") / F.greatest(same_days, F.lit(1)) * F.greatest(F.col("event_mult"), F.lit(1.0))
    return joined.withColumn("expected", expected).select(
        "zone_id",
        "city",
        "forecast_date",
        "hour",
        F.round("expected", 4).alias("expected_rides"),
        demand_score("expected", "base_demand_per_hour", "event_mult").alias("demand_score"),
        F.ceil(F.round(F.col("expected") / F.lit(rides_per_vehicle_hour), 6)).cast("int").alias("vehicle_count"),
    )
