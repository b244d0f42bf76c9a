"""Registered queries: every operator applied to whole driver tables."""

from __future__ import annotations

from functools import wraps
from importlib import import_module

from quillsift.session import ship_package

MODULES = ("corpus", "retrieval", "answers", "quality", "records")


def queries() -> dict:
    out = {}
    for name in MODULES:
        for key, build in import_module(f"quillsift.catalog.{name}").QUERIES.items():
            out[key] = _shipped(build)
    return out


def _shipped(build):
    @wraps(build)
    def run(spark, folder):
        ship_package(spark)
        return build(spark, folder)

    return run
