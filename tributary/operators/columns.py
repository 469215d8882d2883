"""Projection, filtering and column operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BAD_PARAMETER, PipelineError
from ..functions.expressions import expr, identifier, normalised
from ..functions.types import spark_type
from .registry import known, only, operator


@operator("select", "from columns")
def select(ctx, p, inputs) -> DataFrame:
    return only(inputs).selectExpr(*[normalised(c) for c in p["columns"]])


@operator("where", "from filter")
def where(ctx, p, inputs) -> DataFrame:
    return only(inputs).where(expr(p["filter"]))


@operator("addColumns", "from columns")
def add_columns(ctx, p, inputs) -> DataFrame:
    """One after the other: an expression may use the columns added before it."""
    df = only(inputs)
    for c in p["columns"]:
        df = df.withColumn(c["name"], expr(c["expression"]))
    return df


@operator("dropColumns", "from columns")
def drop_columns(ctx, p, inputs) -> DataFrame:
    df = only(inputs)
    return df.drop(*known(df, p["columns"], "dropColumns"))


@operator("renameColumns", "from mappings")
def rename_columns(ctx, p, inputs) -> DataFrame:
    """All at once, so that two names can be swapped."""
    df = only(inputs)
    known(df, list(p["mappings"]), "renameColumns")
    return df.toDF(*[p["mappings"].get(c, c) for c in df.columns])


def converted(c: Column, kind: str, on_error: str) -> Column:
    return c.try_cast(spark_type(kind)) if on_error == "null" else c.cast(spark_type(kind))


@operator("castColumns", "from columns", "on_error")
def cast_columns(ctx, p, inputs) -> DataFrame:
    """Types change in place. A value that can't be cast fails the run, or becomes null with ``on_error: null``."""
    df = only(inputs)
    to = {c["name"]: c["target_type"] for c in p["columns"]}
    known(df, list(to), "castColumns")
    return df.select(
        *[
            converted(
                F.col(identifier(c)),
                to[c],
                p.get("on_error"),
            ).alias(c) if c in to else F.col(identifier(c)) for c in df.columns
        ]
    )


@operator("schemaEnforce", "from columns", "on_error")
def schema_enforce(ctx, p, inputs) -> DataFrame:
    """The listed columns alone, in their order and types."""
    df = only(inputs)
    known(df, [c["name"] for c in p["columns"]], "schemaEnforce")
    return df.select(*[converted(F.col(identifier(c["name"])), c["data_type"], p.get("on_error")).alias(c["name"]) for c in p["columns"]])


@operator("conditional", "from output_column branches", "otherwise")
def conditional(ctx, p, inputs) -> DataFrame:
    if not p["branches"]:
        raise PipelineError(BAD_PARAMETER, "conditional: no branches")
    case = F
    for b in p["branches"]:
        case = case.when(expr(b["condition"]), expr(b["value"]))
    if p.get("otherwise") is not None:
        case = case.otherwise(expr(p["otherwise"]))
    return only(inputs).withColumn(p["output_column"], case)


def split_filters(condition: str) -> tuple[str, str]:
    """Filters of the rows that pass and of the others; rows whose condition is null are among the others."""
    return f"coalesce({condition}, false)", f"NOT coalesce({condition}, false)"


@operator("split", "from condition", "pass fail")
def split(ctx, p, inputs) -> DataFrame:
    """The passing side. The parser rewrites a split of a document into two filters, one for each side."""
    return only(inputs).where(expr(split_filters(p["condition"])[0]))


def leaves(schema: T.StructType, separator: str, at: str = "", name: str = "") -> list[Column]:
    out = []
    for f in schema.fields:
        path, flat = at + identifier(f.name), name + f.name
        if isinstance(f.dataType, T.StructType):
            out += leaves(f.dataType, separator, f"{path}.", flat + separator)
        else:
            out.append(F.col(path).alias(flat))
    return out


@operator("flatten", "from", "separator explode_arrays keep_empty")
def flatten(ctx, p, inputs) -> DataFrame:
    """Fields of structs become columns ``a_b``; with ``explode_arrays`` each array column gives a row for each element.

    An exploded column moves to the end. Rows with a null or empty array go, unless ``keep_empty`` is set. Structs within
    arrays are flattened in turn.
    """
    separator = p.get("separator") or "_"
    explode = F.explode_outer if p.get("keep_empty") else F.explode
    df = only(inputs)
    while True:
        if any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
            df = df.select(*leaves(df.schema, separator))
        arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
        if not p.get("explode_arrays") or not arrays:
            return df
        a = arrays[0]
        df = df.select(*[F.col(identifier(c)) for c in df.columns if c != a], explode(F.col(identifier(a))).alias(a))


@operator("parse", "from column format", "schema options")
def parse(ctx, p, inputs) -> DataFrame:
    """One typed column for each entry of the schema, beside the columns there are; no schema: no change."""
    df = only(inputs)
    known(df, [p["column"]], "parse")
    fields = p.get("schema") or []
    if not fields:
        return df
    ddl = ", ".join(f"{identifier(f['name'])} {spark_type(f['data_type']).simpleString()}" for f in fields)
    source = F.col(identifier(p["column"]))
    if p["format"] == "json":
        parsed = F.from_json(source, ddl, p.get("options") or {})
    elif p["format"] == "csv":
        parsed = F.from_csv(source, ddl, p.get("options") or {})
    else:
        raise PipelineError(BAD_PARAMETER, f'parse: unknown format "{p["format"]}"')
    clash = {f["name"] for f in fields}
    rest = [F.col(identifier(c)) for c in df.columns if c not in clash]
    return df.select(*rest, parsed.alias("__parsed")).select(*rest, "__parsed.*")
