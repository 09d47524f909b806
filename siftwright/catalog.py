"""All named queries and their oracle SQL."""

from __future__ import annotations

from siftwright.plans import boosts, evaluations, graphs, memories, packs, ranking, retrieval, sourcing, whole, workspaces  # noqa: F401
from siftwright.plans.registry import QUERIES, SQL  # noqa: F401
