"""Pivot, unpivot, transpose, crosstab, describe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BAD_PARAMETER, PipelineError
from ..functions.expressions import identifier, normalised, without_alias
from .registry import known, only, operator


#: Columns that a pivot or crosstab makes at most, unless told otherwise.
MAX_VALUES = 10_000


def values_of(df: DataFrame, column: str, most: int | None) -> list:
    """The column's values in order, without null. One small job, as the columns of the result depend on them; more values
    than ``most`` are an error, so that the driver never holds more."""
    c, most = F.col(identifier(column)), MAX_VALUES if most is None else int(most)
    found = [r[0] for r in df.select(c).where(c.isNotNull()).distinct().orderBy(c).limit(most + 1).collect()]
    if len(found) > most:
        raise PipelineError(BAD_PARAMETER, f"{column} has more than {most} values: give them, or raise max_values")
    return found


def value_name(v) -> str:
    return str(v).lower() if isinstance(v, bool) else str(v)


@operator("pivot", "from group_by pivot_column agg", "values max_values")
def pivot(ctx, p, inputs) -> DataFrame:
    """A column for each value (several aggregates: ``value_alias``); filtered aggregates, so that counts of none are 0."""
    df = only(inputs)
    known(df, [*p["group_by"], p["pivot_column"]], "pivot")
    values = p["values"] if p.get("values") else values_of(df, p["pivot_column"], p.get("max_values"))
    kind = df.schema[p["pivot_column"]].dataType
    aggregates = [without_alias(a) for a in p["agg"]]
    out = []
    keyed = df.withColumn("__pivot", F.col(identifier(p["pivot_column"])))
    for n, v in enumerate(values):
        keyed = keyed.withColumn(f"__is{n}", F.col("__pivot") == F.lit(v).cast(kind))
        for a, alias in aggregates:
            name = value_name(v) if len(aggregates) == 1 else f"{value_name(v)}_{alias or a}"
            out.append(F.expr(f"{normalised(a)} FILTER (WHERE __is{n})").alias(name))
    if not out:
        return df.select(*[identifier(c) for c in p["group_by"]]).distinct()
    return keyed.groupBy(*[identifier(c) for c in p["group_by"]]).agg(*out)


@operator("unpivot", "from ids values", "variable_column value_column")
def unpivot(ctx, p, inputs) -> DataFrame:
    df = only(inputs)
    known(df, [*p["ids"], *p["values"]], "unpivot")
    columns = [[F.col(identifier(c)) for c in p[k]] for k in ("ids", "values")]
    return df.unpivot(*columns, p.get("variable_column") or "variable", p.get("value_column") or "value")


@operator("transpose", "from", "index_columns")
def transpose(ctx, p, inputs) -> DataFrame:
    """Long form: a row (index columns, column_name, value as text) for each other column."""
    df = only(inputs)
    index = known(df, p.get("index_columns") or [], "transpose")
    rest = [c for c in df.columns if c not in index]
    if not rest:
        return df
    text = df.select(*[F.col(identifier(c)) for c in index], *[F.col(identifier(c)).cast("string").alias(c) for c in rest])
    return text.unpivot([F.col(identifier(c)) for c in index], [F.col(identifier(c)) for c in rest], "column_name", "value")


@operator("crosstab", "from col1 col2", "max_values")
def crosstab(ctx, p, inputs) -> DataFrame:
    """Counts of each pair of values; rows of col1, a column for each value of col2, 0 where there are none."""
    df = only(inputs)
    known(df, [p["col1"], p["col2"]], "crosstab")
    c2 = F.col(identifier(p["col2"]))
    columns = [F.count_if(c2 == F.lit(v)).alias(value_name(v)) for v in values_of(df, p["col2"], p.get("max_values"))]
    grouped = df.groupBy(identifier(p["col1"]))
    return grouped.agg(*columns) if columns else df.select(identifier(p["col1"])).distinct()


STATISTICS = {"count": F.count, "mean": F.avg, "avg": F.avg, "stddev": F.stddev, "std": F.stddev, "min": F.min, "max": F.max}


@operator("describe", "from", "columns statistics")
def describe(ctx, p, inputs) -> DataFrame:
    """A row for each statistic, a text column for each described column, from one aggregation.

    Means of columns that hold no numbers are null; an unknown statistic is an error.
    """
    df = only(inputs)
    columns = known(
        df,
        p.get("columns") or [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.StringType))],
        "describe",
    )
    names = [str(s).lower() for s in p.get("statistics") or ["count", "mean", "stddev", "min", "max"]]
    if unknown := [s for s in names if s not in STATISTICS]:
        raise PipelineError(BAD_PARAMETER, f"describe: unknown statistic {', '.join(unknown)}")
    cells = []
    for s in names:
        for c in columns:
            col = F.col(identifier(c))
            if s in ("mean", "avg", "stddev", "std") and not isinstance(df.schema[c].dataType, T.NumericType):
                col = col.try_cast("double")
            cells.append(STATISTICS[s](col).cast("string").alias(f"{s}|{c}"))
    one = df.agg(*cells)
    rows = [F.struct(F.lit(s).alias("statistic"), *[F.col(identifier(f"{s}|{c}")).alias(c) for c in columns]) for s in names]
    return one.select(F.inline(F.array(*rows)))


