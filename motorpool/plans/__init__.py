"""Composed plans: table builds, forecasts, dashboards, rebalancing."""
