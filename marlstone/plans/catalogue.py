"""All queries of the core, by name, with the SQL they are checked against."""

from __future__ import annotations

from importlib import import_module

from marlstone.plans.registry import Query

#: Modules with queries, in the order in which they are listed.
MODULES = ("retrieval", "texts", "curation", "metrics", "state", "relational")


def _merged(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        more = getattr(import_module(f"marlstone.plans.{name}").REGISTRY, what)
        if both := out.keys() & more.keys():
            raise ValueError(f"queries defined twice: {sorted(both)}")
        out |= more
    return out


def queries() -> dict[str, Query]:
    return _merged("queries")


def oracles() -> dict[str, str]:
    return _merged("oracles")
