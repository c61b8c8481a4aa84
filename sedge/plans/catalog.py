"""All queries of this package but those of its `llm` part."""

from __future__ import annotations

from sedge.plans import allocation, corpus, custom, gates, ranked, records, routes, statistics, vectors  # noqa: F401  each registers its queries
from sedge.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
