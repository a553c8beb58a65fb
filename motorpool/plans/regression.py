"""Demand fitted per zone by least squares: hour of day, weekday, event and trend.

Our own definition, beside the plain means of :func:`motorpool.plans.forecasts.predict_demand`.
Spark sums the normal equations as one row per zone and pair of features; a zone's system has
at most 32 unknowns, whatever the history, and is solved by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorpool.functions.scalars import day
from motorpool.operators.aggregates import exact_sum
from motorpool.operators.joins import grid, left_default
from motorpool.plans.forecasts import demand_score, event_multipliers

#: 24 hours; Monday to Saturday against Sunday; the event multiplier above 1; days since the start.
EVENT, TREND, UNKNOWNS = 30, 31, 32
TARGET = UNKNOWNS


def features(date: Column, hour: Column, multiplier: Column, start: Column) -> Column:
    """The features of a zone's hour that are not zero, as (i, x); an hour has at most four."""
    def one(i, x):
        return F.struct(i.cast("int").alias("i"), x.cast("double").alias("x"))

    weekday = F.dayofweek(date)
    all_of_them = F.array(
        one(hour, F.lit(1.0)),
        one(weekday + 22, F.when(weekday > 1, 1.0).otherwise(0.0)),
        one(F.lit(EVENT), F.greatest(multiplier, F.lit(1.0)) - 1.0),
        one(F.lit(TREND), F.date_diff(date, start)),
    )
    return F.filter(all_of_them, lambda f: f["x"] != 0)


def zone_hours(zones: DataFrame, events: DataFrame, first: Column, last: Column, *keep: str) -> DataFrame:
    """Every hour of the days from ``first`` to ``last`` for each zone, with its event multiplier."""
    days = grid(zones.select("zone_id", *keep), forecast_date=F.sequence(first, last))
    days = left_default(days, event_multipliers(events), ["forecast_date", "zone_id"], "event_mult", 1.0)
    return grid(days, hour=F.sequence(F.lit(0), F.lit(23)))


def normal_equations(zones: DataFrame, rides: DataFrame, events: DataFrame, as_of, history_days: int) -> DataFrame:
    """Sums of products (zone_id, i, j, total) over the hours of the history, ``i <= j``; the
    column ``TARGET`` holds the rides of an hour. Hours without rides count as zero."""
    today = day(as_of)
    first = F.date_sub(today, history_days)
    counted = (
        rides.filter((F.col("request_ts") >= first.cast("timestamp_ntz")) & (F.col("request_ts") < today.cast("timestamp_ntz")))
        .groupBy(F.col("pickup_zone").alias("zone_id"), F.to_date("request_ts").alias("forecast_date"), F.hour("request_ts").alias("hour"))
        .agg(F.count(F.lit(1)).alias("rides"))
    )
    hours = left_default(
        zone_hours(zones, events, first, F.date_sub(today, 1)), counted, ["zone_id", "forecast_date", "hour"], "rides", 0
    )
    own = features(F.col("forecast_date"), F.col("hour"), F.col("event_mult"), first)
    target = F.array(F.struct(F.lit(TARGET).alias("i"), F.col("rides").cast("double").alias("x")))
    cells = hours.select("zone_id", F.concat(own, target).alias("f"))
    products = F.flatten(
        F.transform(
            "f",
            lambda a: F.transform(
                F.filter("f", lambda b: b["i"] >= a["i"]),
                lambda b: F.struct(a["i"].alias("i"), b["i"].alias("j"), (a["x"] * b["x"]).alias("v")),
            ),
        )
    )
    return (
        cells.select("zone_id", F.explode(products).alias("p"))
        .groupBy("zone_id", F.col("p.i").alias("i"), F.col("p.j").alias("j"))
        .agg(exact_sum(F.round("p.v", 6)).alias("total"))
    )


def solve(equations: DataFrame) -> DataFrame:
    """One row per zone with the weights of its features. Where the history leaves some of them
    open (a zone without events), the solution of least norm is taken, so they are zero."""
    unknowns, target = UNKNOWNS, TARGET

    def fit(cells):
        import numpy as np
        import pandas as pd

        a, b = np.zeros((unknowns, unknowns)), np.zeros(unknowns)
        for i, j, v in zip(cells["i"], cells["j"], cells["total"].astype(float)):
            if i == target:
                continue
            if j == target:
                b[i] = v
            else:
                a[i, j] = a[j, i] = v
        # To one scale first, so that what counts as zero does not hang on the trend's unit.
        scale = np.sqrt(np.where(a.diagonal() > 0, a.diagonal(), 1.0))
        weights = np.linalg.lstsq(a / np.outer(scale, scale), b / scale, rcond=1e-10)[0] / scale
        return pd.DataFrame({"zone_id": [cells["zone_id"].iloc[0]], "weights": [weights.tolist()]})

    return equations.withColumn("total", F.col("total").cast("double")).groupBy("zone_id").applyInPandas(
        fit, "zone_id string, weights array<double>"
    )


def predict_fitted(
    zones: DataFrame,
    rides: DataFrame,
    events: DataFrame,
    vehicles: DataFrame,
    as_of,
    history_days: int,
    ahead_days: int,
    rides_per_vehicle_hour: float = 2.0,
) -> DataFrame:
    """Expected rides, score and vehicles for each zone and coming hour, from the fitted weights,
    beside the vehicles now in the zone (``vehicles``: city, zone_id, vehicles) and those it lacks.

    A fit below zero counts as zero. A zone without rides or vehicles has zeros.
    """
    today = day(as_of)
    weights = solve(normal_equations(zones, rides, events, as_of, history_days))
    coming = zone_hours(zones, events, today, F.date_add(today, ahead_days), "city", "base_demand_per_hour").join(weights, "zone_id", "left")
    own = features(F.col("forecast_date"), F.col("hour"), F.col("event_mult"), F.date_sub(today, history_days))
    fitted = F.aggregate(
        own, F.lit(0.0), lambda total, f: total + f["x"] * F.coalesce(F.element_at("weights", f["i"] + 1), F.lit(0.0))
    )
    here = vehicles.groupBy("zone_id").agg(F.sum("vehicles").alias("vehicles_now"))
    needed = F.ceil(F.round(F.col("expected") / F.lit(rides_per_vehicle_hour), 6)).cast("int")
    return (
        left_default(coming.withColumn("expected", F.greatest(fitted, F.lit(0.0))), here, ["zone_id"], "vehicles_now", 0)
        .withColumn("vehicle_count", needed)
        .select(
            "zone_id",
            "city",
            "forecast_date",
            "hour",
            F.round("expected", 4).alias("expected_rides"),
            demand_score("expected", "base_demand_per_hour", "event_mult").alias("demand_score"),
            "vehicle_count",
            "vehicles_now",
            F.greatest(F.col("vehicle_count") - F.col("vehicles_now"), F.lit(0)).alias("vehicles_short"),
        )
    )
