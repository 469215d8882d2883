"""A pipeline's plan as text, without running it."""

from __future__ import annotations

import re

from .dag import order, waves
from .model import Asset, Pipeline

TITLES = {"group": "GROUP BY", "asOfJoin": "AS OF JOIN", "fillNa": "FILL NA", "dropNa": "DROP NA", "scd2": "SCD2", "sql": "SQL"}


def title(kind: str) -> str:
    return TITLES.get(kind) or re.sub(r"(?<=[a-z])(?=[A-Z])", " ", kind).upper()


def line(a: Asset) -> str:
    p = a.parameters
    if a.kind == "input":
        return f"  {a.name} [{p['format']}] {p['path']}"
    if a.kind == "output":
        return f"  {p['from']} -> [{p['format']}] {p['path']} (mode: {p.get('mode') or 'error'})"
    n = len(a.depends)
    return f"  {a.name} = {title(a.kind)} <- {', '.join(a.depends) or '-'} ({n} input{'s' * (n != 1)})"


def explain(pipeline: Pipeline) -> str:
    assets = [pipeline.assets[n] for n in order(pipeline)]
    groups = {
        "Inputs": [a for a in assets if a.kind == "input"],
        "Transformations": [a for a in assets if a.kind not in ("input", "output")],
        "Outputs": [a for a in assets if a.kind == "output"],
    }
    out = ["=== Pipeline plan ===", ""]
    for name, members in groups.items():
        if members or name == "Inputs":
            out += [f"--- {name} ---", *map(line, members), ""]
    steps = waves(pipeline)
    counts = [len(g) for g in groups.values()]
    out += [
        f"Total: {len(assets)} assets ({counts[0]} inputs, {counts[1]} transformations, {counts[2]} outputs)",
        f"Execution waves: {len(steps)}",
    ]
    return "\n".join([*out, *[f"  Wave {k}: {', '.join(w)}" for k, w in enumerate(steps, 1)]]) + "\n"
