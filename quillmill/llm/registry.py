"""Queries and SQL of all operators of this subpackage."""

from importlib import import_module

MODULES = ("overlap", "cooccurrence", "subsequences", "terms", "defects", "truncation", "packing", "mixing", "toxicity")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in import_module(f"{__package__}.{m}").SQL.items()}
