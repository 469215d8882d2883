"""Order, limits, samples, partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import from_place
from ..errors import BAD_PARAMETER, PipelineError
from ..functions.expressions import identifier, ordering
from .registry import known, only, operator


def whole(n, what: str) -> int:
    if int(n) < 0:
        raise PipelineError(BAD_PARAMETER, f"{what}: {n} rows")
    return int(n)


@operator("orderBy", "from columns")
def order_by(ctx, p, inputs) -> DataFrame:
    return only(inputs).orderBy(*ordering(p["columns"]))


@operator("limit", "from count")
def limit(ctx, p, inputs) -> DataFrame:
    """After orderBy, Spark plans both as one top-k."""
    return only(inputs).limit(int(p["count"]))


@operator("offset", "from count")
def offset(ctx, p, inputs) -> DataFrame:
    """The rows behind the first ``count``. A limited frame is one top-k with an offset; any other is checkpointed when it is
    planned and keeps its partitions."""
    df, n = only(inputs), whole(p["count"], "offset")
    if df._jdf.queryExecution().optimizedPlan().nodeName() == "GlobalLimit":
        return df.offset(n)
    return from_place(df, n) if n else df


@operator("tail", "from count")
def tail(ctx, p, inputs) -> DataFrame:
    """The last rows in the present order. The frame is checkpointed when it is planned and keeps its partitions."""
    df, n = only(inputs), whole(p["count"], "tail")
    return from_place(df, -n) if n else df.where(F.lit(False))


@operator("sample", "from fraction", "with_replacement seed")
def sample(ctx, p, inputs) -> DataFrame:
    return only(inputs).sample(bool(p.get("with_replacement")), float(p["fraction"]), p.get("seed"))


@operator("repartition", "from num_partitions", "columns")
def repartition(ctx, p, inputs) -> DataFrame:
    df = only(inputs)
    return df.repartition(int(p["num_partitions"]), *[identifier(c) for c in known(df, p.get("columns") or [], "repartition")])


@operator("coalesce", "from num_partitions")
def coalesce(ctx, p, inputs) -> DataFrame:
    return only(inputs).coalesce(int(p["num_partitions"]))


@operator("hint", "from hints")
def hint(ctx, p, inputs) -> DataFrame:
    df = only(inputs)
    for h in p["hints"]:
        df = df.hint(h["name"], *(h.get("parameters") or []))
    return df
