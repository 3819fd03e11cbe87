"""Named queries over the given tables."""

from __future__ import annotations

import importlib

from earshot.plans import registry

_MODULES = ["evaluation", "curation", "arrays", "reports", "live", "sound"]


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"earshot.plans.{name}")


def queries() -> dict[str, registry.Query]:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
