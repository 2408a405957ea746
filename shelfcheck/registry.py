"""Named checks.  A user adds one by registering a Column builder or a DataFrame function."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from shelfcheck.operators.checks import Check, Scope


@dataclass(frozen=True)
class Registered:
    flag: str
    severity: str
    build: Callable[[Scope], list[Check]] | None = None
    run: Callable[[DataFrame, object, str | None], DataFrame] | None = None


_REGISTRY: dict[str, Registered] = {}


def register_check(flag: str, severity: str = "medium", *, build=None, run=None) -> None:
    """Add a check after the built-in ones in priority.

    ``build(scope)`` returns column checks that join the shared projection;
    ``run(df, rules, country)`` returns rows of ``sid, flag, detail, reason, cv``.
    """
    if (build is None) == (run is None):
        raise ValueError("give either build or run")
    _REGISTRY[flag] = Registered(flag, severity, build, run)


def unregister_check(flag: str) -> None:
    _REGISTRY.pop(flag, None)


def registered() -> list[Registered]:
    return list(_REGISTRY.values())
