"""Operators on missing and replaced values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BAD_PARAMETER, PipelineError
from ..functions.expressions import identifier
from .registry import known, only, operator


def fits(value, kind: T.DataType) -> bool:
    """If a literal can stand in a column of this type."""
    if isinstance(kind, T.StringType):
        return True
    if isinstance(kind, T.BooleanType):
        return isinstance(value, bool) or str(value).lower() in ("true", "false")
    if isinstance(kind, T.NumericType):
        try:
            float(value)
        except (TypeError, ValueError):
            return False
        return not isinstance(value, bool) and (not isinstance(kind, T.IntegralType) or float(value) == int(float(value)))
    return isinstance(value, str) and isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType))


def as_type(value, kind: T.DataType):
    if isinstance(kind, T.StringType) and isinstance(value, bool):
        value = str(value).lower()
    return F.lit(value).cast(kind)


@operator("fillNa", "from", "columns value values")
def fill_na(ctx, p, inputs) -> DataFrame:
    """Nulls take the column's own value, else the general one. ``columns`` restricts both.

    A value that doesn't fit a listed column's type is an error; unlisted columns that it doesn't fit stay as they are.
    """
    df = only(inputs)
    listed, own, general = p.get("columns"), p.get("values") or {}, p.get("value")
    known(df, [*(listed or []), *own], "fillNa")
    out = []
    for f in df.schema.fields:
        value = own.get(f.name, general)
        c = F.col(identifier(f.name))
        if value is None or (listed is not None and f.name not in listed):
            out.append(c)
        elif fits(value, f.dataType):
            out.append(F.coalesce(c, as_type(value, f.dataType)).alias(f.name))
        elif listed is not None or f.name in own:
            raise PipelineError(BAD_PARAMETER, f'fillNa: {value!r} is no {f.dataType.simpleString()} for "{f.name}"')
        else:
            out.append(c)
    return df.select(*out)


@operator("dropNa", "from", "columns how min_non_nulls")
def drop_na(ctx, p, inputs) -> DataFrame:
    """``min_non_nulls`` before ``how``; any: no column may be null; all: one at least isn't."""
    df = only(inputs)
    columns = known(df, p.get("columns") or df.columns, "dropNa")
    least = p.get("min_non_nulls")
    if least is None:
        least = 1 if str(p.get("how", "any")).lower() == "all" else len(columns)
    there = sum((F.col(identifier(c)).isNotNull().cast("int") for c in columns), F.lit(0))
    return df.where(there >= int(least))


@operator("replace", "from mappings", "columns")
def replace(ctx, p, inputs) -> DataFrame:
    """Values whose text form equals ``old`` become ``new``, of the column's type; the first mapping that fits counts."""
    df = only(inputs)
    columns = set(known(df, p.get("columns") or df.columns, "replace"))
    out = []
    for f in df.schema.fields:
        c, case = F.col(identifier(f.name)), F
        for m in p["mappings"]:
            old = str(m["old"]).lower() if isinstance(m["old"], bool) else str(m["old"])
            if f.name in columns and fits(m["new"], f.dataType):
                case = case.when(c.cast("string") == F.lit(old), as_type(m["new"], f.dataType))
        out.append(c if case is F else case.otherwise(c).alias(f.name))
    return df.select(*out)
