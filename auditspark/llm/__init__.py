"""Operators of a training-data pipeline: the numbered components, each with the query that applies it.

queries() and oracle_sql() are what __spark_entry__.py adds to the library's own registry.
"""

from __future__ import annotations

from importlib import import_module

#: Operator modules by number.
MODULES = {
    1: "decontaminate",
    2: "sorted_table",
    3: "shard_lookup",
    4: "best_fit",
    5: "near_dedup",
    6: "line_dedup",
    7: "fingerprints",
    8: "toxicity",
    9: "chat_format",
    10: "language_id",
    11: "simhash",
    12: "ranked_search",
    13: "conversation_repair",
}


def queries() -> dict:
    return {f"op{n}_{name}": import_module(f"auditspark.llm.{name}").query for n, name in MODULES.items()}


def oracle_sql() -> dict:
    found = {f"op{n}_{name}": getattr(import_module(f"auditspark.llm.{name}"), "ORACLE_SQL", None) for n, name in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
