"""All queries of the core with their SQL counterparts, by name."""

from __future__ import annotations

import importlib

from .registry import QUERIES, SQL, Query

for _module in ("scans", "diagnostics", "symbols", "sequences", "vectors", "series", "graphs", "models", "streams"):
    importlib.import_module(f"pathloom.plans.{_module}")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
