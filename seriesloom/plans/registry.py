"""The registry of functions: names, signatures and the builders of their plans."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Function:
    name: str
    signature: str
    group: str
    description: str
    build: Callable


FUNCTIONS: dict[str, Function] = {}


def function(*names: str, args: str, group: str) -> Callable:
    """Registers a builder ``(context, expression) -> SeriesList`` under its names."""

    def register(build: Callable) -> Callable:
        for name in names:
            if name in FUNCTIONS:
                raise ValueError(f"{name} is registered twice")
            FUNCTIONS[name] = Function(name, f"{name}({args})", group, (build.__doc__ or "").strip(), build)
        return build

    return register
