"""Queries of the core and their DuckDB twins, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from . import analytics, kernels, knowledge, memory, more, references, scans, semantics, streams, writing

MODULES = [references, kernels, memory, analytics, knowledge, scans, streams, more, semantics, writing]
FLAGSHIP = "w2_context_window"


def queries() -> dict[str, Callable]:
    return {k: f for m in MODULES for k, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in MODULES for k, (_, sql) in m.QUERIES.items() if sql}
