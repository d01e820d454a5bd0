"""Queries opN_<name> of the corpus operators over their whole tables, and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("mixing_query", "archive_query", "decontamination_query", "toxicity_query", "secrets_query",
           "search_query", "token_query", "url_query", "repeats_query",
           "simhash_query", "cluster_query", "fim_query", "language_query")


def queries() -> dict:
    return {name: run for m in MODULES for name, run in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracles() -> dict:
    return {name: sql for m in MODULES for name, sql in import_module(f"{__package__}.{m}").ORACLE.items()}
