"""Named queries over the driver tables and their DuckDB oracle twins.

Each plan module exposes ``QUERIES`` (name -> callable(spark, sf_dir)) and
``ORACLE`` (name -> DuckDB SQL).  Queries without a SQL twin are checked by
row count plus tests against a sequential model.
"""
from __future__ import annotations

import importlib

MODULES = ["naming", "blocks", "extraction", "export", "text", "library", "jobs", "streams", "options", "edges", "storage"]


def _load():
    qs, sql = {}, {}
    for m in MODULES:
        mod = importlib.import_module(f"quire.plans.{m}")
        qs.update(mod.QUERIES)
        sql.update(mod.ORACLE)
    return qs, sql


def all_queries():
    return _load()[0]


def all_oracles():
    return _load()[1]
