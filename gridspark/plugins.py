"""Stages by name: what `decompose` and the command line run, and what may stand in its place.

    @registry.implements("graph", "no-externals")
    def graph(cells): ...

    decompose(spark, paths, use={"graph": "no-externals"})
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

BUILT_IN = "built-in"
#: The arguments that each stage is called with, in order.
SHAPES = {
    "read": ("spark", "paths"),
    "inventory": ("files",),
    "graph": ("cells",),
    "classify": ("workbooks", "cells", "ranges", "unsupported"),
    "questions": ("items",),
    "store": ("done", "out"),
}


class StageRegistry:
    """Functions by stage and name. Unknown stages and names are KeyErrors."""

    def __init__(self) -> None:
        self.found: dict[str, dict[str, Callable]] = {stage: {} for stage in SHAPES}

    def implements(self, stage: str, name: str, replace: bool = False) -> Callable[[Callable], Callable]:
        """A decorator that registers a function; one that can't be called as the stage is, or whose name is taken, is refused."""
        known = self.found[stage]

        def add(function: Callable) -> Callable:
            if name in known and not replace:
                raise ValueError(f"stage {stage} has an implementation named {name!r}")
            try:
                inspect.signature(function).bind(*SHAPES[stage])
            except TypeError as e:
                raise ValueError(f"stage {stage} is called with {', '.join(SHAPES[stage])}: {e}") from None
            known[name] = function
            return function

        return add

    def get(self, stage: str, name: str = BUILT_IN) -> Callable:
        return self.found[stage][name]

    def names(self, stage: str) -> list[str]:
        return sorted(self.found[stage])


registry = StageRegistry()
