"""What the embedding program grants and adds: capabilities, presets, assertion types, reports.

A scenario document can ask for live sources and actions; only the runtime that the
program passes in can allow them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from importlib.metadata import entry_points
from typing import Any

from pyspark.sql import DataFrame

from logstrata.operators.filters import presets as merged

#: (rule, events) -> number that the rule's bounds are held against.
Assertion = Callable[[dict[str, Any], DataFrame], int]
#: (scenario name, result data) -> text of a report.
Outputter = Callable[[str, dict[str, Any]], str]
#: (scenario name, arguments) -> pattern.
Resolver = Callable[[str], str]


@dataclass(frozen=True)
class Runtime:
    allow_live: bool = False
    allow_actions: bool = False
    presets: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    assertions: Mapping[str, Assertion] = field(default_factory=dict)
    outputters: Mapping[str, Outputter] = field(default_factory=dict)
    resolver: Resolver | None = None

    def preset(self, name: str) -> str:
        known = merged(dict(self.presets))
        if name not in known:
            raise ValueError(f"no preset {name!r}")
        return known[name][0]


def plugged(group: str = "logstrata.plugins") -> Runtime:
    """A runtime with what installed packages add: each entry point is a function from a runtime to one with more."""
    runtime = Runtime()
    for point in sorted(entry_points(group=group), key=lambda p: p.name):
        runtime = point.load()(runtime)
    return runtime
