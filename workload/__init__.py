"""Registered queries and the SQL they are checked against."""

from __future__ import annotations

from importlib import import_module

MODULES = ("chains", "nested", "texts", "generated", "corpus_jobs", "checked", "lossless", "flat", "large_tables")


def all_queries() -> dict:
    """``{name: (callable(spark, sf_dir), SQL text or None)}``"""
    merged: dict = {}
    for name in MODULES:
        for key, value in import_module(f"workload.{name}").QUERIES.items():
            if key in merged:
                raise ValueError(f"query {key!r} is registered twice")
            merged[key] = value
    return merged
