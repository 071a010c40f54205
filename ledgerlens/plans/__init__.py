"""Driver-facing plans: bindings of the driver tables, the query registry and its SQL oracles."""

from __future__ import annotations


def load_all() -> None:
    """Import every query module so that it registers itself."""
    from . import eval_queries, events_queries, prompt_queries, retrieval_queries, source_queries, text_queries  # noqa: F401
