"""Name -> query and name -> SQL of the core operators."""

from __future__ import annotations

from veridelta.plans import adapting, corpus, datasets, evaluation, facts, graphs, mining, records, star, streams  # noqa: F401
from veridelta.plans.registry import QUERIES, SQL

FLAGSHIP = "tp_at_k_by_hop"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
