"""Window functions: one specification for all functions of the operator."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BAD_PARAMETER, PipelineError
from ..functions.expressions import identifier, normalised
from .registry import known, only, operator

#: These functions have frames of their own; Spark rejects another.
RANKING = re.compile(r"\s*(row_number|rank|dense_rank|percent_rank|cume_dist|ntile|lag|lead)\s*\(", re.I)
BOUND = re.compile(r"(unbounded (preceding|following)|current row|.+ (preceding|following))", re.I)


def order_text(columns: list) -> str:
    keys = []
    for c in columns:
        c = {"column": c} if isinstance(c, str) else c
        keys.append(f"{normalised(c['column'])} {str(c.get('direction', 'asc')).upper()} NULLS {str(c.get('nulls', 'last')).upper()}")
    return ", ".join(keys)


@operator("window", "from functions", "partition_by order_by frame")
def window(ctx, p, inputs) -> DataFrame:
    """All columns and each function's value over the partition.

    Simple order names sort ascending, nulls last. Without a frame Spark's defaults hold (with an order: from the first row
    to the current row's peers). Ranking functions never take the frame.
    """
    df = only(inputs)
    parts = []
    if p.get("partition_by"):
        parts.append("PARTITION BY " + ", ".join(c if c not in df.columns else identifier(c) for c in p["partition_by"]))
    if p.get("order_by"):
        parts.append("ORDER BY " + order_text(p["order_by"]))
    frame = ""
    if f := p.get("frame"):
        kind, start, end = str(
            f.get("frame_type", f.get("type", "rows"))
        ).upper(), f.get("start", "UNBOUNDED PRECEDING"), f.get("end", "CURRENT ROW")
        if kind not in ("ROWS", "RANGE") or not all(BOUND.fullmatch(str(b).strip()) for b in (start, end)):
            raise PipelineError(BAD_PARAMETER, f"window: frame {kind} {start} .. {end}")
        frame = f"{kind} BETWEEN {start} AND {end}"
    out = [F.col(identifier(c)) for c in known(df, [c for c in df.columns if c not in {f["alias"] for f in p["functions"]}], "window")]
    for f in p["functions"]:
        spec = " ".join([*parts, *([frame] if frame and not RANKING.match(f["expression"]) else [])])
        out.append(F.expr(f"{normalised(f['expression'])} OVER ({spec})").alias(f["alias"]))
    return df.select(*out)
