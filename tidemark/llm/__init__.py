"""Operators for preparing training corpora: one module per operator, each with its own queries."""

from importlib import import_module

MODULES = (
    "sharding",
    "tokens",
    "jpeg",
    "secrets",
    "packing",
    "exact_dedup",
    "toxicity",
    "quality",
    "mixing",
    "simhash",
    "fim",
    "host_rules",
    "filter_audit",
)


def queries() -> dict:
    """name -> callable(spark, sf_dir) for every operator of this subpackage."""
    found = {}
    for name in MODULES:
        found.update(import_module(f"{__name__}.{name}").QUERIES)
    return found


def oracle_sql() -> dict:
    found = {}
    for name in MODULES:
        found.update(getattr(import_module(f"{__name__}.{name}"), "ORACLE_SQL", {}))
    return found
