"""Registered queries over the given tables, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable


def _registered() -> dict[str, tuple[Callable, str | None]]:
    from yardspark.plans import boxes, dashboard, files, placement, readings, streams

    return {**dashboard.QUERIES, **placement.QUERIES, **boxes.QUERIES, **readings.QUERIES, **streams.QUERIES, **files.QUERIES}


def queries() -> dict[str, Callable]:
    return {name: f for name, (f, _) in _registered().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for name, (_, q) in _registered().items() if q}
