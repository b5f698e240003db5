"""All registered queries with their SQL."""

from __future__ import annotations

from . import asks, context, conversation, corpus, markup, moods, plugins, quality, retrieval, storage, streams, tagging

MODULES = (retrieval, conversation, corpus, streams, markup, quality, storage, asks, context, moods, plugins, tagging)


def queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.query.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.query.sql.items()}
