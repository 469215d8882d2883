"""A pipeline as data."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Asset:
    """kind: input, output or an operator's name. depends: the assets it reads."""

    name: str
    kind: str
    parameters: dict[str, Any]
    depends: tuple[str, ...] = ()
    metadata: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Pipeline:
    assets: dict[str, Asset]
    hooks: dict[str, list[str]] = field(default_factory=dict)
    quality: list[dict[str, Any]] = field(default_factory=list)
    name: str = ""
    version: str = ""
