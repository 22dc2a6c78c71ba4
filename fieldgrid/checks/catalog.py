"""All registered queries and their SQL texts."""

from . import q_boosting, q_features, q_grid, q_groups, q_layers, q_model, q_tables, q_upkeep, q_verbs  # noqa: F401
from .registry import QUERIES, oracles

ORACLES = oracles()

__all__ = ["ORACLES", "QUERIES"]
