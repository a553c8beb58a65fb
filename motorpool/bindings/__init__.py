"""The operators bound to the source tables, each beside the SQL that states its result."""

from motorpool.bindings import (  # noqa: F401
    activity,
    aggregates,
    builds,
    changes,
    demand,
    filters,
    joins,
    listings,
    operations,
    ordering,
    scalars,
    sources,
    streams,
    supply,
)
from motorpool.bindings.registry import ORACLES, QUERIES  # noqa: F401
