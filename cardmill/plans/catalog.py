"""All registered queries and their SQL."""

from __future__ import annotations

from cardmill.plans import card_queries, search_queries, stream_queries, text_queries

_MODULES = [search_queries, text_queries, card_queries, stream_queries]


def queries() -> dict:
    return {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: text for module in _MODULES for name, text in module.ORACLES.items()}
