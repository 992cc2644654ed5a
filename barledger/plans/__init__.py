"""Registered queries. ``load()`` imports every query module once."""

from importlib import import_module

MODULES = ("bar_queries", "metric_queries", "book_queries", "value_queries", "scenario_queries", "rebalance_queries", "source_queries", "anchor_queries")


def load() -> None:
    for name in MODULES:
        import_module(f"barledger.plans.{name}")
