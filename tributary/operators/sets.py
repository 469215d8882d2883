"""Set operators, distinct rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import ordering
from .registry import known, only, operator


@operator("union", "sources", "all by_name allow_missing_columns", sources=lambda p: list(p["sources"]))
def union(ctx, p, inputs) -> DataFrame:
    """By position, or by name; without ``all`` equal rows come once."""
    frames = [inputs[s] for s in p["sources"]]
    if p.get("by_name"):
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=bool(p.get("allow_missing_columns"))), frames)
    else:
        df = reduce(DataFrame.union, frames)
    return df if p.get("all", True) else df.distinct()


@operator("intersect", "sources", "all", sources=lambda p: list(p["sources"]))
def intersect(ctx, p, inputs) -> DataFrame:
    return reduce(DataFrame.intersectAll if p.get("all") else DataFrame.intersect, [inputs[s] for s in p["sources"]])


@operator("except", "left right", "all", sources=lambda p: [p["left"], p["right"]])
def except_(ctx, p, inputs) -> DataFrame:
    left, right = inputs[p["left"]], inputs[p["right"]]
    return left.exceptAll(right) if p.get("all") else left.subtract(right)


@operator("distinct", "from", "columns order_by")
def distinct(ctx, p, inputs) -> DataFrame:
    """Distinct rows; with ``columns`` one row for each of their values, the first by ``order_by`` if that is given."""
    df = only(inputs)
    if not p.get("columns"):
        return df.distinct()
    columns = known(df, p["columns"], "distinct")
    if not p.get("order_by"):
        return df.dropDuplicates(columns)
    first = Window.partitionBy(*columns).orderBy(*ordering(p["order_by"]))
    return df.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth")
