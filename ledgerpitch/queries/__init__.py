"""The operators bound to the driver tables, each next to its SQL check."""

from __future__ import annotations

from ledgerpitch.queries import features, links, money, publication, responses, states, storage, values

MODULES = (features, states, money, values, links, storage, responses, publication)


def all_queries() -> dict:
    found: dict = {}
    for module in MODULES:
        found.update(module.QUERIES)
    return found


def all_oracles() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES:
        found.update(module.ORACLES)
    return found
