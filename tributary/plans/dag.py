"""The order in which assets are planned."""

from __future__ import annotations

from ..errors import CYCLE, PipelineError
from .model import Pipeline


def waves(pipeline: Pipeline) -> list[list[str]]:
    """Groups of assets, each after those it reads; an asset is in the wave after its last dependency's."""
    left = {n: set(a.depends) for n, a in pipeline.assets.items()}
    out: list[list[str]] = []
    while left:
        ready = [n for n, d in left.items() if not d]
        if not ready:
            raise PipelineError(CYCLE, f"assets depend on each other: {', '.join(sorted(left))}")
        out.append(ready)
        for n in ready:
            del left[n]
        for d in left.values():
            d.difference_update(ready)
    return out


def order(pipeline: Pipeline) -> list[str]:
    return [n for w in waves(pipeline) for n in w]
