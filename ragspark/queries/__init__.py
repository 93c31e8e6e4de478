"""Runnable queries over the standard tables, with their SQL oracles."""

import importlib

from ragspark.queries.registry import ORACLES, QUERIES

MODULES = ("text_queries", "vector_queries", "chat_queries", "transfer_queries", "catalog_queries", "stream_queries")
for _module in MODULES:
    importlib.import_module(f"ragspark.queries.{_module}")

__all__ = ["ORACLES", "QUERIES"]
