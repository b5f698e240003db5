"""Corpus operators for training-data pipelines; nothing else in the library imports this package."""

from __future__ import annotations

from . import registry

queries, oracle_sql = registry.queries, registry.oracle_sql
