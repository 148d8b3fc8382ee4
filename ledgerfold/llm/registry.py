"""All queries of this subpackage and their SQL oracles."""

from __future__ import annotations

import importlib

MODULES = ("secrets", "decontaminate", "token_shards", "media", "chat", "toxicity", "licenses", "fixity", "mixing", "near_dedup")


def _modules():
    return [importlib.import_module(f"ledgerfold.llm.{m}") for m in MODULES]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in _modules() for k, sql in m.ORACLE.items()}
