"""All named queries of the library."""

from __future__ import annotations

from . import activity, displays, messages, network, scenes, screens, shapes, sources, speech, tracks, views  # noqa: F401
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
