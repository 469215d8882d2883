"""Slowly changing dimensions and merges, as frames of the resulting table."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..checkpoints import numbered
from ..errors import BAD_PARAMETER, PipelineError
from ..functions.expressions import expr, identifier
from .registry import known, operator


@operator(
    "scd2",
    "current incoming key_columns track_columns",
    "start_date_column end_date_column current_flag_column effective_ts",
    sources=lambda p: [p["current"], p["incoming"]],
)
def scd2(ctx, p, inputs) -> DataFrame:
    """The versioned table after taking in ``incoming``.

    Only rows whose flag is true take part; closed history passes through. A current row whose tracked columns differ
    (null-safe) from the incoming row's is closed; changed and new incoming rows start a version. One full join, from which
    each pair gives the rows it needs, so either side is shuffled once. Columns of current that neither the incoming rows
    nor the operator fill are null in new versions.

    Keys compare null-safely: a null key is a key. Two incoming rows of one key fail the run when rows are read.
    """
    cur, inc = inputs[p["current"]], inputs[p["incoming"]]
    start, end, flag = (p.get(k) or d for k, d in (("start_date_column", "start_date"), ("end_date_column", "end_date"), ("current_flag_column", "is_current")))
    keys, track = p["key_columns"], p["track_columns"]
    if not keys or not track:
        raise PipelineError(BAD_PARAMETER, "scd2: key_columns and track_columns can't be empty")
    known(cur, [*keys, *track, start, end, flag], "scd2")
    known(inc, [*keys, *track], "scd2")
    kind = cur.schema[start].dataType
    stamp = p.get("effective_ts") or ctx.now
    now = (F.lit(stamp) if stamp is not None else F.current_timestamp()).cast(kind)
    live = F.coalesce(F.col(identifier(flag)), F.lit(False))
    history = cur.where(~live)
    pack = lambda df, name: df.select(F.struct(*[F.col(identifier(c)) for c in df.columns]).alias(name))
    # one row a key, by a partial aggregation: a key that comes twice is an error, not two versions
    once = pack(inc, "i").groupBy(
        *[F.col(f"i.{identifier(k)}").alias(f"__k{n}") for n, k in enumerate(keys)]
    ).agg(F.first("i").alias("i"), F.count("*").alias("n"))
    twice = F.raise_error(F.lit(f"scd2: several incoming rows for one key ({', '.join(keys)})"))
    a, b = pack(cur.where(live), "c"), once.select(F.when(F.col("n") > 1, twice.cast(inc_type(inc))).otherwise(F.col("i")).alias("i"))
    c, i = (lambda n: F.col(f"c.{identifier(n)}")), (lambda n: F.col(f"i.{identifier(n)}"))
    pairs = a.join(b, reduce(and_, [c(k).eqNullSafe(i(k)) for k in keys]), "full")
    changed = reduce(or_, [~c(t).eqNullSafe(i(t)) for t in track])
    old, new = F.col("c").isNotNull(), F.col("i").isNotNull()

    def version(of: str) -> Column:
        def value(n: str) -> Column:
            if of == "i":
                return {start: now, end: F.lit(None).cast(cur.schema[end].dataType), flag: F.lit(True)}.get(
                    n,
                    i(n).cast(cur.schema[n].dataType) if n in inc.columns else F.lit(None).cast(cur.schema[n].dataType),
                )
            shut = {end: now.cast(cur.schema[end].dataType), flag: F.lit(False)}.get(n)
            return c(n) if shut is None else F.when(new & changed, shut).otherwise(c(n))

        return F.struct(*[value(n).alias(n) for n in cur.columns])

    rows = F.filter(F.array(F.when(old, version("c")), F.when(new & (~old | changed), version("i"))), lambda r: r.isNotNull())
    return pairs.select(F.explode(rows).alias("r")).select("r.*").unionByName(history)


def inc_type(df: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])


def action_of(clauses: list[dict], default: int) -> Column:
    """The number of the first clause whose condition holds."""
    case = F
    for n, cl in enumerate(clauses):
        case = case.when(expr(cl["condition"]) if cl.get("condition") else F.lit(True), F.lit(n))
    return F.lit(default) if case is F else case.otherwise(F.lit(default))


@operator("merge", "target source on", "when_matched when_not_matched check_duplicates", sources=lambda p: [p["target"], p["source"]])
def merge(ctx, p, inputs) -> DataFrame:
    """The target after MERGE: clauses in order, the first that holds counts; unmatched target rows stay.

    Clauses: {action: update|delete|insert, condition?, star?, set?{column: expression}}; expressions name columns by asset.
    Two source rows for one updated or deleted target row fail the run when rows are read (``check_duplicates: false`` skips).
    """
    target, source = inputs[p["target"]], inputs[p["source"]]
    t, s = p["target"], p["source"]
    matched, added = p.get("when_matched") or [], p.get("when_not_matched") or []
    for cl, ok in [(m, ("update", "delete")) for m in matched] + [(m, ("insert",)) for m in added]:
        if cl["action"] not in ok:
            raise PipelineError(BAD_PARAMETER, f"merge: {cl['action']} is out of place")
        known(target, list(cl.get("set") or {}), "merge")
    checked = p.get("check_duplicates", True) and matched
    if checked:
        target, source = numbered(target, "__tid"), numbered(source, "__sid")
    left, right = target.withColumn("__t", F.lit(1)).alias(t), source.withColumn("__s", F.lit(1)).alias(s)
    df = left.join(right, expr(" AND ".join(f"({c})" for c in p["on"])), "full")
    both, only_s = F.col("__t").isNotNull() & F.col("__s").isNotNull(), F.col("__t").isNull()
    df = df.withColumn(
        "__m",
        F.when(both, action_of(matched, -1)).otherwise(-1),
    ).withColumn("__a", F.when(only_s, action_of(added, -1)).otherwise(-1))
    if checked:
        # a row of the source alone is a partition of its own: all of them together would be one task
        hits = F.count(F.when(F.col("__m") >= 0, 1)).over(Window.partitionBy(F.coalesce(F.col("__tid"), -1 - F.col("__sid"))))
        df = df.withColumn("__hits", F.when(F.col("__t").isNotNull(), hits).otherwise(0))
        df = df.withColumn(
            "__m",
            F.when(
                F.col("__hits") > 1,
                F.raise_error(F.lit("merge: several source rows match one target row")).cast("int"),
            ).otherwise(F.col("__m")),
        )
    gone = [n for n, cl in enumerate(matched) if cl["action"] == "delete"]
    df = df.where(~F.col("__m").isin(gone) & ~(only_s & (F.col("__a") < 0)) if gone else ~(only_s & (F.col("__a") < 0)))
    out = []
    for c in inputs[t].columns:
        kind, own = target.schema[c].dataType, F.col(f"{identifier(t)}.{identifier(c)}")
        case = F
        for mark, clauses in (("__m", matched), ("__a", added)):
            for n, cl in enumerate(clauses):
                sets = cl.get("set") or {}
                if c in sets:
                    value = expr(sets[c])
                elif (cl.get("star") or not sets) and c in source.columns and cl["action"] != "delete":
                    value = F.col(f"{identifier(s)}.{identifier(c)}")
                else:
                    value = F.lit(None) if mark == "__a" else own
                case = case.when(F.col(mark) == n, value.cast(kind))
        out.append((own if case is F else case.otherwise(own)).alias(c))
    return df.select(*out)
