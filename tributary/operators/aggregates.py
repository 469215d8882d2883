"""Grouping: plain, rollup, cube, grouping sets."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.expressions import expr, identifier
from .registry import known, only, operator


def aggregates(p) -> list:
    return [expr(a) for a in p["agg"]]


@operator("group", "from agg", "by", title="GROUP BY")
def group(ctx, p, inputs) -> DataFrame:
    df, by = only(inputs), p.get("by") or []
    return df.groupBy(
        *[expr(b) if b not in df.columns else identifier(b) for b in by]
    ).agg(*aggregates(p)) if by else df.agg(*aggregates(p))


@operator("rollup", "from by agg")
def rollup(ctx, p, inputs) -> DataFrame:
    df = only(inputs)
    return df.rollup(*[identifier(c) for c in known(df, p["by"], "rollup")]).agg(*aggregates(p))


@operator("cube", "from by agg")
def cube(ctx, p, inputs) -> DataFrame:
    df = only(inputs)
    return df.cube(*[identifier(c) for c in known(df, p["by"], "cube")]).agg(*aggregates(p))


@operator("groupingSets", "from sets agg")
def grouping_sets(ctx, p, inputs) -> DataFrame:
    """The sorted union of all sets' columns, then the aggregates."""
    df = only(inputs)
    columns = known(df, sorted({c for s in p["sets"] for c in s}), "groupingSets")
    out = df.groupingSets([[identifier(c) for c in s] for s in p["sets"]], *[identifier(c) for c in columns]).agg(*aggregates(p))
    return out.select(*[identifier(c) for c in columns], *[identifier(c) for c in out.columns if c not in columns])
