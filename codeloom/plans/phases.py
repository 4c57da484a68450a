"""Phases of an index build: declared dependencies, topological order, cycle report, timings; extension points."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame


class ContractExtractor(Protocol):
    """Finds contracts of one kind in files (repo, path, content)."""

    kind: str

    def extract(self, files: DataFrame) -> DataFrame: ...


class LanguageProvider(Protocol):
    """Facts of one language's files, its MRO strategy and its import semantics."""

    name: str
    mro_strategy: str
    import_semantics: str

    def facts(self, files: DataFrame) -> DataFrame: ...


Embedder = Callable[[Column], Column]
#: Names communities; gets (comm, label, members) and returns (comm, name, keywords).
Enricher = Callable[[DataFrame], DataFrame]

# Import semantics and MRO strategy by language; others use named imports and first-wins.
LANGUAGE_RULES = {
    "python": ("namespace", "c3"),
    "java": ("named", "implements-split"),
    "kotlin": ("named", "implements-split"),
    "csharp": ("named", "implements-split"),
    "c": ("wildcard-transitive", "first-wins"),
    "cpp": ("wildcard-transitive", "leftmost-base"),
    "go": ("wildcard-leaf", "first-wins"),
    "ruby": ("wildcard-leaf", "ruby-mixin"),
    "rust": ("named", "qualified-syntax"),
    "swift": ("wildcard-leaf", "first-wins"),
    "dart": ("wildcard-leaf", "first-wins"),
}


def language_rules(language: str) -> tuple[str, str]:
    """(import semantics, MRO strategy)"""
    return LANGUAGE_RULES.get(language, ("named", "first-wins"))


@dataclass(frozen=True)
class Phase:
    """A named step; ``run`` gets the results of its dependencies by name."""

    name: str
    run: Callable[[dict], object]
    needs: tuple[str, ...] = ()


class CycleError(ValueError):
    pass


def ordered(phases: list[Phase]) -> list[Phase]:
    """Dependencies first, otherwise as given. Names the phases of a cycle and unknown dependencies."""
    by_name = {p.name: p for p in phases}
    if len(by_name) != len(phases):
        raise ValueError("two phases have the same name")
    unknown = sorted({n for p in phases for n in p.needs} - set(by_name))
    if unknown:
        raise ValueError(f"unknown phases: {', '.join(unknown)}")
    done: list[Phase] = []
    left = list(phases)
    while left:
        names = {p.name for p in done}
        ready = [p for p in left if names.issuperset(p.needs)]
        if not ready:
            raise CycleError(" -> ".join(sorted(p.name for p in left)))
        done.append(ready[0])
        left.remove(ready[0])
    return done


@dataclass
class Run:
    results: dict = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)


def run_phases(phases: list[Phase]) -> Run:
    """Run all; every phase sees only the results that it declared."""
    out = Run()
    for phase in ordered(phases):
        began = time.perf_counter()
        out.results[phase.name] = phase.run({n: out.results[n] for n in phase.needs})
        out.seconds[phase.name] = time.perf_counter() - began
    return out
