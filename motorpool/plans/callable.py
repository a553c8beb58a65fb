"""Demand and moves as functions that SQL can call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEMAND, MOVES = "motorpool_demand", "motorpool_moves"


def register_functions(spark: SparkSession, demand: DataFrame, moves: DataFrame) -> tuple[str, ...]:
    """Make the rows of ``predict_demand`` and ``optimize_rebalancing`` callable in the session.

    Table functions ``predict_demand(zone, from_day, days)`` and ``optimize_rebalancing(in_city)``
    and the scalar ``vehicles_needed(zone, on_day, at_hour)``, NULL for an hour that is not
    predicted. Their bodies are SQL over the very plans passed here, so Catalyst sees through
    them: a call with given arguments filters those plans, and a lateral one over the rows of
    a table becomes a join on equal keys. They last as long as the session.
    """
    demand.createOrReplaceTempView(DEMAND)
    moves.createOrReplaceTempView(MOVES)
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION predict_demand(zone STRING, from_day DATE, days INT)
            RETURNS TABLE (zone_id STRING, city STRING, forecast_date DATE, hour INT, expected_rides DOUBLE, demand_score DOUBLE, vehicle_count INT)
            RETURN SELECT d.zone_id, d.city, d.forecast_date, d.hour, d.expected_rides, d.demand_score, d.vehicle_count FROM {DEMAND} d
                   WHERE d.zone_id = predict_demand.zone
                     AND d.forecast_date >= predict_demand.from_day AND d.forecast_date < date_add(predict_demand.from_day, predict_demand.days)"""
    )
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION optimize_rebalancing(in_city STRING)
            RETURNS TABLE (city STRING, from_zone STRING, to_zone STRING, vehicle_count BIGINT)
            RETURN SELECT m.city, m.from_zone, m.to_zone, m.vehicle_count FROM {MOVES} m
                   WHERE m.city = optimize_rebalancing.in_city"""
    )
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION vehicles_needed(zone STRING, on_day DATE, at_hour INT) RETURNS INT
            RETURN (SELECT max(d.vehicle_count) FROM {DEMAND} d
                    WHERE d.zone_id = vehicles_needed.zone AND d.forecast_date = vehicles_needed.on_day AND d.hour = vehicles_needed.at_hour)"""
    )
    return "predict_demand", "optimize_rebalancing", "vehicles_needed"
