"""All named queries of the library, with the SQL that DuckDB runs to check them."""

from __future__ import annotations

import importlib

#: Modules with QUERIES (name -> function of spark and the folder) and ORACLE_SQL (name -> SQL).
MODULES: tuple[str, ...] = tuple(f"quire.operators.{m}" for m in ("search", "joins", "facets", "tree", "quality", "diff", "order", "variant", "latex", "portable", "bank", "assets", "plugins", "preview", "composed", "patches", "policy"))


def queries() -> dict:
    return {k: v for m in MODULES for k, v in importlib.import_module(m).QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in importlib.import_module(m).ORACLE_SQL.items()}
