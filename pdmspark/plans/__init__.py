"""Registered queries over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from . import joined, measured, modelled, ordered, ranked, resampled, streamed, tables
from .base import QUERIES, SQL
from .ranked import flagship

__all__ = ["flagship", "oracle_sql", "queries"]
_MODULES = (tables, joined, ordered, measured, ranked, resampled, modelled, streamed)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
