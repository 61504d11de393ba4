"""All registered queries of the core and the SQL that gives the same rows."""

from importlib import import_module

MODULES = ("metrics", "joining", "samples", "texts", "answers")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in import_module(f"{__package__}.{m}").SQL.items()}
