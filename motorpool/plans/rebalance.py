"""Vehicle moves between the zones of a city.

Our own definition, as only the name and purpose are given. ``optimize_rebalancing`` is a greedy
matching, not an optimum: the largest surplus serves the largest shortage first, blind to
distance. ``cheapest_rebalancing`` moves as many vehicles over the least total distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EARTH_MILES = 3958.8


def zone_supply(vehicles: DataFrame, min_battery: int | None = None) -> DataFrame:
    """Vehicles per zone and city, only those with enough charge when a limit is given."""
    if min_battery is not None:
        vehicles = vehicles.filter(F.col("battery_pct") >= min_battery)
    return vehicles.groupBy("city", F.col("current_zone").alias("zone_id")).agg(
        F.count(F.lit(1)).alias("vehicles")
    )


def zone_balance(supply: DataFrame, demand: DataFrame) -> DataFrame:
    """Spare vehicles per city and zone, below zero where some lack; zones in balance are left out."""
    spare = F.coalesce("vehicles", F.lit(0)) - F.coalesce("needed", F.lit(0))
    return (
        supply.join(demand, ["city", "zone_id"], "full")
        .select("city", "zone_id", spare.cast("long").alias("spare"))
        .filter(F.col("spare") != 0)
    )


def optimize_rebalancing(supply: DataFrame, demand: DataFrame) -> DataFrame:
    """Moves (city, from_zone, to_zone, vehicle_count).

    ``supply``: city, zone_id, vehicles. ``demand``: city, zone_id, needed. Surpluses and
    shortages of a city are laid end to end; the ends of both cut the line into moves. The
    windows see zones, not vehicles, and no pairs of zones are made.
    """
    balance = zone_balance(supply, demand).withColumn("gives", F.col("spare") > 0)
    line = W.partitionBy("city", "gives").orderBy(F.abs("spare").desc(), "zone_id")
    reach = F.sum(F.abs("spare")).over(line.rowsBetween(W.unboundedPreceding, 0))
    ends = (
        balance.withColumn("reach", reach)
        .groupBy("city", "reach")
        .agg(
            F.max(F.when(F.col("gives"), F.col("zone_id"))).alias("giver"),
            F.max(F.when(~F.col("gives"), F.col("zone_id"))).alias("taker"),
        )
    )
    city_line = W.partitionBy("city").orderBy("reach")
    onward = city_line.rowsBetween(0, W.unboundedFollowing)
    return (
        ends.select(
            "city",
            F.first("giver", ignorenulls=True).over(onward).alias("from_zone"),
            F.first("taker", ignorenulls=True).over(onward).alias("to_zone"),
            (F.col("reach") - F.lag("reach", 1, 0).over(city_line)).alias("vehicle_count"),
        )
        .filter(F.col("from_zone").isNotNull() & F.col("to_zone").isNotNull())
    )


def miles_between(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    """Great-circle distance."""
    half = [F.pow(F.sin(F.radians(b - a) / 2), F.lit(2)) for a, b in ((lat0, lat1), (lon0, lon1))]
    return F.lit(2 * EARTH_MILES) * F.asin(F.sqrt(half[0] + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * half[1]))


def moved_miles(moves: DataFrame, zones: DataFrame) -> DataFrame:
    """Moves with the distance between their zones, ``miles`` for one vehicle."""

    def end(role):
        return zones.select(
            F.col("zone_id").alias(f"{role}_zone"), F.col("latitude").alias(f"__{role}_lat"), F.col("longitude").alias(f"__{role}_lon")
        )

    joined = moves.join(end("from"), "from_zone", "left").join(end("to"), "to_zone", "left")
    miles = miles_between(F.col("__from_lat"), F.col("__from_lon"), F.col("__to_lat"), F.col("__to_lon"))
    return joined.select(*moves.columns, miles.alias("miles"))


def cheapest_rebalancing(supply: DataFrame, demand: DataFrame, zones: DataFrame, max_zones: int = 2000) -> DataFrame:
    """Moves as :func:`optimize_rebalancing` gives them, of the least total distance.

    Each city is a transport problem of its own, solved by shortest augmenting paths; cities run
    side by side. A task holds the zones of one city, not its vehicles; a city with more than
    ``max_zones`` zones out of balance is an error, and so is one without coordinates. ``zones``
    needs zone_id, latitude and longitude. As many vehicles move as surplus and shortage allow.
    Of several plans of equal distance one is taken, the same on every run.
    """
    placed = zone_balance(supply, demand).join(zones.select("zone_id", "latitude", "longitude"), "zone_id", "left")
    earth = EARTH_MILES

    def plan(city):
        import numpy as np
        import pandas as pd

        name = city["city"].iloc[0]
        if len(city) > max_zones:
            raise ValueError(f"{name} has {len(city)} zones out of balance, more than max_zones: take optimize_rebalancing")
        if city[["latitude", "longitude"]].isna().any().any():
            raise ValueError(f"a zone of {name} has no coordinates")
        city = city.sort_values("zone_id")
        give, take = city[city["spare"] > 0], city[city["spare"] < 0]
        left, lack = give["spare"].to_numpy().copy(), -take["spare"].to_numpy()
        lat0, lon0, lat1, lon1 = (np.radians(side[c].to_numpy(float)) for side in (give, take) for c in ("latitude", "longitude"))
        half = np.sin((lat1 - lat0[:, None]) / 2) ** 2 + np.cos(lat0)[:, None] * np.cos(lat1) * np.sin((lon1 - lon0[:, None]) / 2) ** 2
        cost = 2 * earth * np.arcsin(np.sqrt(half))
        flow = np.zeros(cost.shape, dtype=np.int64)
        while left.any() and lack.any():
            # Shortest ways from any giver with vehicles left, back over moves that can be undone.
            to_giver, to_taker = np.where(left > 0, 0.0, np.inf), np.full(len(lack), np.inf)
            by_giver, by_taker = np.full(len(left), -1), np.full(len(lack), -1)
            while True:
                reach = to_giver[:, None] + cost
                best = reach.argmin(0)
                shorter = reach[best, np.arange(len(lack))] < to_taker - 1e-9
                to_taker[shorter], by_taker[shorter] = reach[best, np.arange(len(lack))][shorter], best[shorter]
                undone = np.where(flow > 0, to_taker - cost, np.inf)
                best = undone.argmin(1)
                nearer = undone[np.arange(len(left)), best] < to_giver - 1e-9
                if not nearer.any():
                    break
                to_giver[nearer], by_giver[nearer] = undone[np.arange(len(left)), best][nearer], best[nearer]
            end = int(np.where(lack > 0, to_taker, np.inf).argmin())
            way, taker = [], end
            while True:
                giver = int(by_taker[taker])
                way.append((giver, taker, 1))
                if by_giver[giver] < 0:
                    break
                taker = int(by_giver[giver])
                way.append((giver, taker, -1))
            n = min(left[giver], lack[end], *[flow[g, t] for g, t, sign in way if sign < 0])
            for g, t, sign in way:
                flow[g, t] += sign * n
            left[giver] -= n
            lack[end] -= n
        g, t = flow.nonzero()
        return pd.DataFrame(
            {
                "city": name,
                "from_zone": give["zone_id"].to_numpy()[g],
                "to_zone": take["zone_id"].to_numpy()[t],
                "vehicle_count": flow[g, t],
                "miles": cost[g, t],
            }
        )

    return placed.groupBy("city").applyInPandas(plan, "city string, from_zone string, to_zone string, vehicle_count long, miles double")
