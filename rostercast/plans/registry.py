"""Collects every registered query module."""

from __future__ import annotations

import importlib

from rostercast.plans.catalog import ORACLE, QUERIES

QUERY_MODULES = ["rostercast.plans.queries_core", "rostercast.plans.queries_explore",
                 "rostercast.plans.queries_learn", "rostercast.plans.queries_given",
                 "rostercast.plans.queries_forecast", "rostercast.plans.queries_boost"]


def load_all():
    for mod in QUERY_MODULES:
        importlib.import_module(mod)
    return QUERIES, ORACLE
