"""Assertions within a pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import BAD_PARAMETER, QUALITY, PipelineError
from ..functions.expressions import expr, identifier
from .registry import known, only, operator


def failing(check: dict, df: DataFrame) -> Column:
    """If a row fails the check; a rule that is null passes."""
    rule = str(check["rule"]).strip()
    if rule in ("not_null", "unique") and not check.get("column"):
        raise PipelineError(BAD_PARAMETER, f"assertion: {rule} needs a column")
    if rule == "not_null":
        return F.col(identifier(known(df, [check["column"]], "assertion")[0])).isNull()
    return F.coalesce(~expr(rule), F.lit(False))


def described(check: dict) -> str:
    return check.get("description") or " ".join(str(check[k]) for k in ("column", "rule") if check.get(k))


@operator("assertion", "from checks", "on_failure")
def assertion(ctx, p, inputs) -> DataFrame:
    """All checks are counted in one aggregation, when planned, for fail and warn; drop filters without counting.

    ``unique`` counts values above the first of each; drop keeps the first row of each value (by all columns' order).
    """
    df, mode = only(inputs), str(p.get("on_failure") or "fail").lower()
    if mode not in ("fail", "warn", "drop"):
        raise PipelineError(BAD_PARAMETER, f"assertion: {mode}")
    plain = [c for c in p["checks"] if c["rule"] != "unique"]
    unique = [c for c in p["checks"] if c["rule"] == "unique"]
    for c in unique:
        known(df, [c["column"]], "assertion")
    if mode == "drop":
        for c in plain:
            df = df.where(~failing(c, df))
        for c in unique:
            order = [F.col(identifier(n)) for n, t in df.dtypes if not t.startswith("map")]
            df = df.withColumn(
                "__nth",
                F.row_number().over(Window.partitionBy(identifier(c["column"])).orderBy(*order)),
            ).where(f"__nth = 1 OR {identifier(c['column'])} IS NULL").drop("__nth")
        return df
    counts = [F.count_if(failing(c, df)) for c in plain]
    counts += [F.count(identifier(c["column"])) - F.count_distinct(F.col(identifier(c["column"]))) for c in unique]
    if not counts:
        return df
    found = df.agg(*[c.alias(f"n{k}") for k, c in enumerate(counts)]).first()
    said = [f"{described(c)}: {n} rows" for c, n in zip([*plain, *unique], found, strict=True) if n]
    if said and mode == "fail":
        raise PipelineError(QUALITY, "; ".join(said))
    for s in said:
        ctx.log(f"assertion failed: {s}")
    return df
