"""Feature specifications, the registry, and the catalogue."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass
from typing import Protocol

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class FeatureSpec:
    """What a column measures, why it may matter and how it misleads."""

    name: str
    family: str
    description: str
    rationale: str
    limitation: str
    unit: str = "ratio"
    minimum: float | None = 0.0
    maximum: float | None = None
    higher_means: str = "depends"
    level: str = "account"

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[a-z][a-z0-9_]*", self.name):
            raise ValueError(f"{self.name!r} is not a lower-case snake name")
        for what in ("rationale", "limitation"):
            if len(getattr(self, what)) < 40:
                raise ValueError(f"{self.name}: {what} needs 40 characters at least")


class Extractor(Protocol):
    """A family of features: its specifications and a table keyed by account_id."""

    name: str

    def specs(self) -> tuple[FeatureSpec, ...]: ...

    def extract(self, corpus) -> DataFrame: ...


class FeatureRegistry:
    """All specifications by name; a name may be given once."""

    def __init__(self, specs: Iterable[FeatureSpec] = ()) -> None:
        self._specs: dict[str, FeatureSpec] = {}
        for spec in specs:
            if spec.name in self._specs:
                raise ValueError(f"feature {spec.name} is there already")
            self._specs[spec.name] = spec

    @classmethod
    def from_extractors(cls, extractors: Iterable[Extractor]) -> FeatureRegistry:
        return cls(spec for e in extractors for spec in e.specs())

    def __iter__(self) -> Iterator[FeatureSpec]:
        return iter(self._specs.values())

    def __len__(self) -> int:
        return len(self._specs)

    def __getitem__(self, name: str) -> FeatureSpec:
        return self._specs[name]

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(self._specs)

    def to_records(self) -> list[dict]:
        return [asdict(s) for s in self]


def catalogue(registry: FeatureRegistry) -> str:
    """The features as Markdown, by family."""
    out = ["# Features", ""]
    for family in dict.fromkeys(s.family for s in registry):
        out += [f"## {family}", ""]
        for s in (s for s in registry if s.family == family):
            reach = f"{'' if s.minimum is None else f'{s.minimum:g}'} to {'' if s.maximum is None else f'{s.maximum:g}'}".strip()
            out += [f"### `{s.name}`", "", s.description, "", f"- Unit: {s.unit}; range: {reach}; higher: {s.higher_means}", f"- Why: {s.rationale}", f"- Limits: {s.limitation}", ""]
    return "\n".join(out)
