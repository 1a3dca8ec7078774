"""The query catalogue: name -> (Spark callable, DuckDB SQL or None), gathered from the modules of this folder."""

from importlib import import_module

MODULES: tuple[str, ...] = ("signal_queries", "interval_queries", "text_queries", "layout_queries")


def _all() -> dict:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"trackloom.plans.{name}").CATALOGUE
    return found


def queries() -> dict:
    return {k: v[0] for k, v in _all().items()}


def oracle_sql() -> dict:
    return {k: v[1] for k, v in _all().items() if v[1]}
