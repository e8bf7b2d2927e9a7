"""All registered queries."""

from logharbor.plans.catalog import (  # noqa: F401
    changes,
    landing,
    lookups,
    ordering,
    predicates,
    projections,
    rollups,
    scalars,
    sets,
    streams,
    trees,
)
from logharbor.plans.catalog.base import CATALOG, ORACLES

__all__ = ["CATALOG", "ORACLES"]
