"""Operators for preparing large text corpora.

Nothing else in the library imports this subpackage.  ``queries()`` and
``oracle_sql()`` hand its registered queries to the entry module.
"""

from __future__ import annotations

import importlib

_MODULES: tuple[str, ...] = (
    "url_filter",
    "token_store",
    "token_counts",
    "piece_sampling",
    "license_scan",
    "secret_scan",
    "lm_scoring",
    "simhash",
    "quality_rules",
    "decontamination",
)


def _loaded():
    return [importlib.import_module(f"{__name__}.{m}") for m in _MODULES]


def queries() -> dict:
    """Name -> callable(spark, sf_dir) of every registered query here."""
    out = {}
    for module in _loaded():
        out.update(module.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL, for the queries that SQL can express."""
    out = {}
    for module in _loaded():
        out.update(module.ORACLE_SQL)
    return out
