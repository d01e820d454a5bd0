"""All queries and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("leads", "catalogue", "attempts", "evidence", "screening", "streams", "files", "tables")


def _merged(name: str) -> dict:
    out = {}
    for module in MODULES:
        for key, value in getattr(import_module(f"{__package__}.{module}"), name).items():
            if key in out:
                raise ValueError(f"query {key} is registered twice")
            out[key] = value
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict:
    return _merged("ORACLE")
