"""Joins: n-ary, as-of, lateral."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..checkpoints import numbered
from ..errors import BAD_PARAMETER, PipelineError
from ..functions.expressions import expr, identifier, normalised, ordering
from .registry import known, operator

KINDS = {
    "inner": "inner", "left": "left", "left_outer": "left", "right": "right", "right_outer": "right", "outer": "full", "full": "full", "full_outer": "full",
    "cross": "cross", "left_semi": "left_semi", "semi": "left_semi", "left_anti": "left_anti", "anti": "left_anti",
}


def kind_of(name: str | None) -> str:
    if (name or "inner").lower() not in KINDS:
        raise PipelineError(BAD_PARAMETER, f'join: unknown type "{name}"')
    return KINDS[(name or "inner").lower()]


def all_of(conditions: list[str] | None) -> Column | None:
    return expr(" AND ".join(f"({c})" for c in conditions)) if conditions else None


@operator("join", "left right", sources=lambda p: [p["left"], *[r["name"] for r in p["right"]]])
def join(ctx, p, inputs) -> DataFrame:
    """Left-deep over ``right``. Conditions name columns by their asset; equalities among them become join keys.

    Both sides' columns stay, in order; a name that occurs twice must be qualified afterwards, or renamed before a sink.
    """
    df = inputs[p["left"]].alias(p["left"])
    for r in p["right"]:
        side, kind = inputs[r["name"]].alias(r.get("alias") or r["name"]), kind_of(r.get("type"))
        on = all_of(r.get("on"))
        if extra := set(r) - {"name", "alias", "type", "on"}:
            raise PipelineError(BAD_PARAMETER, f"join: unknown parameter {', '.join(map(str, extra))}")
        if kind == "cross":
            df = df.crossJoin(side) if on is None else df.join(side, on)
        elif on is None:
            raise PipelineError(BAD_PARAMETER, f"join: {kind} join with {r['name']} has no condition")
        else:
            df = df.join(side, on, kind)
    return df


def equal_keys(on: list, left: str, right: str, lcols: list[str], rcols: list[str]) -> list[tuple[str, str]] | None:
    """(left column, right column) of each condition, if all of them are column names or plain equalities."""
    keys = []
    for c in on or []:
        sides = [s.strip().replace("`", "").replace('"', "") for s in str(c).split("=")]
        if len(sides) == 1 and sides[0] in lcols and sides[0] in rcols:
            keys.append((sides[0], sides[0]))
            continue
        if len(sides) != 2:
            return None
        found = {}
        for s in sides:
            asset, _, name = s.rpartition(".")
            if (asset == left or not asset and s not in rcols) and name in lcols:
                found["l"] = name
            elif (asset == right or not asset and s not in lcols) and name in rcols:
                found["r"] = name
        if len(found) != 2:
            return None
        keys.append((found["l"], found["r"]))
    return keys


def distance(a: Column, b: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.NumericType):
        return F.abs(a - b)
    return F.abs(F.timestamp_diff("MICROSECOND", a.cast("timestamp_ntz"), b.cast("timestamp_ntz")))


#: Stretches of as-of values that a join without keys is cut into.
STRETCHES = 200


def stretch_of(both: DataFrame, kind: T.DataType) -> tuple[Column, int]:
    """The number of the quantiles at or below ``__at``, and of the quantiles: equal values share a stretch, and stretches
    ascend with values."""
    if not isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise PipelineError(BAD_PARAMETER, f"asOfJoin: without on, values must be numbers, dates or timestamps, not {kind.simpleString()}")
    shares = F.array(*[F.lit((k + 1) / STRETCHES) for k in range(STRETCHES - 1)])
    bounds = sorted(set(both.agg(F.percentile_approx("__at", shares, 10 * STRETCHES)).first()[0] or []))
    return (
        F.size(F.filter(F.array(*[F.lit(b).cast(kind) for b in bounds]), lambda b: b <= F.col("__at"))) if bounds else F.lit(0)
    ), len(bounds)


def carried(df: DataFrame, both: DataFrame, wanted: list[str], stretches: int) -> DataFrame:
    """df with the nearest right row of the stretches before (__back) or behind (__ahead) where its own has none."""
    part = F.col("__part")
    at = both.where("__side = 1").groupBy("__part", "__at").agg(F.max_by("__r", "__r.t").alias("r"))
    edges = at.groupBy("__part").agg(F.max_by("r", "__at")["row"].alias("last"), F.min_by("r", "__at")["row"].alias("next"))
    edges = edges.agg(
        F.array_sort(
            F.collect_list(F.struct("__part", "last", "next")),
            lambda a, b: a["__part"] - b["__part"],
        ).alias("__edges")
    )
    edges = edges.select("__edges", F.explode(F.sequence(F.lit(-1), F.lit(stretches))).alias("__part"))  # -1: a null value's
    for name in wanted:
        beyond = F.filter("__edges", lambda e: (e["__part"] < part) if name == "__back" else (e["__part"] > part))
        near = F.element_at(beyond, -1)["last"] if name == "__back" else F.get(beyond, F.lit(0))["next"]
        edges = edges.withColumn(f"{name}_edge", F.when(F.size(beyond) > 0, near))
    df = df.join(F.broadcast(edges.drop("__edges")), "__part", "left")
    for name in wanted:
        df = df.withColumn(name, F.coalesce(F.col(name), F.col(f"{name}_edge")))
    return df


@operator(
    "asOfJoin",
    "left right left_as_of right_as_of",
    "on direction how tie_break tolerance",
    sources=lambda p: [p["left"], p["right"]],
)
def as_of_join(ctx, p, inputs) -> DataFrame:
    """Every left row with the nearest right row at or before it (backward), at or after it (forward), or either way.

    One row for each left row; ``how: inner`` drops those without a partner. Equal as-of values count in each direction; of
    right rows with equal values the last by ``tie_break`` (or by all their columns) is taken, and of equally near ones
    the earlier. ``tolerance``: the largest distance, in the as-of type's unit (microseconds for timestamps).

    With equality keys the sides are stacked and each left row picks its partner from a window over the key, so nothing is
    joined many-to-many. Without any condition the as-of values are cut into stretches at quantiles (found when planning),
    each a window of its own, and the nearest right row beyond a stretch's edge is carried into it. Other conditions join
    first and rank then.
    """
    l, r = inputs[p["left"]], inputs[p["right"]]
    la, ra, direction, how = p["left_as_of"], p["right_as_of"], p.get("direction") or "backward", p.get("how") or "left"
    known(l, [la], "asOfJoin")
    known(r, [ra], "asOfJoin")
    if direction not in ("backward", "forward", "nearest") or how not in ("left", "inner"):
        raise PipelineError(BAD_PARAMETER, f"asOfJoin: {direction}, {how}")
    kind = l.schema[la].dataType
    value = lambda name: F.col(f"__{name}.{identifier(ra)}")
    keys = equal_keys(p.get("on"), p["left"], p["right"], l.columns, r.columns)
    ties = known(r, [p["tie_break"]] if isinstance(p.get("tie_break"), str) else p.get("tie_break") or [c for c, t in r.dtypes if not t.startswith("map")], "asOfJoin")
    row_l, row_r = F.struct(*[F.col(identifier(c)) for c in l.columns]), F.struct(*[F.col(identifier(c)) for c in r.columns])
    if keys is None:
        l2, r2 = numbered(l, "__id").alias(p["left"]), r.alias(p["right"])
        order = {
            "backward": f"{identifier(p['right'])}.{identifier(ra)} <= {identifier(p['left'])}.{identifier(la)}",
            "forward": f"{identifier(p['right'])}.{identifier(ra)} >= {identifier(p['left'])}.{identifier(la)}",
            "nearest": "true",
        }[direction]
        pairs = l2.join(r2, all_of([*map(normalised, p["on"]), order]), "left")
        rcol = lambda c: F.col(f"{identifier(p['right'])}.{identifier(c)}")
        lcol = lambda c: F.col(f"{identifier(p['left'])}.{identifier(c)}")
        near = distance(rcol(ra), lcol(la), kind)
        first = Window.partitionBy("__id").orderBy(near.asc_nulls_last(), rcol(ra).asc(), *[rcol(c).desc() for c in ties])
        pairs = pairs.withColumn("__nth", F.row_number().over(first)).where("__nth = 1")
        df = pairs.select(
            F.struct(*[lcol(c) for c in l.columns]).alias("__l"),
            F.when(rcol(ra).isNotNull(), F.struct(*[rcol(c) for c in r.columns])).alias("__best"),
        )
    else:
        tie = F.struct(*[F.col(identifier(c)) for c in ties])
        stack = lambda df, side, row, at: df.select(
            *[F.col(identifier(k[side])).alias(f"__k{n}") for n, k in enumerate(keys)],
            F.lit(side).alias("__side"),
            F.col(identifier(at)).alias("__at"),
            (row if side == 0 else F.lit(None)).alias("__l"),
            (F.struct(tie.alias("t"), row.alias("row")) if side else F.lit(None)).alias("__r"),
        )
        usable = r.where(F.col(identifier(ra)).isNotNull())
        by = [F.col(f"__k{n}") for n in range(len(keys))]
        has_key = reduce(and_, [k.isNotNull() for k in by], F.lit(True))
        lefts = stack(l, 0, row_l, la)
        both = lefts.where(has_key).unionByName(stack(usable, 1, row_r, ra).where(has_key))
        stretch, stretches = (F.lit(-1), 0) if keys else stretch_of(both, kind)
        both = both.withColumn("__part", stretch)
        by.append(F.col("__part"))
        upto = (Window.unboundedPreceding, Window.currentRow)
        back = Window.partitionBy(*by).orderBy(F.col("__at").asc(), F.col("__side").desc(), F.col("__r.t").asc()).rowsBetween(*upto)
        ahead = Window.partitionBy(*by).orderBy(F.col("__at").desc(), F.col("__side").desc(), F.col("__r.t").asc()).rowsBetween(*upto)
        seen = {}
        if direction != "forward":
            seen["__back"] = F.last("__r", ignorenulls=True).over(back)["row"]
        if direction != "backward":
            seen["__ahead"] = F.last("__r", ignorenulls=True).over(ahead)["row"]
        found = both
        for name, column in seen.items():
            found = found.withColumn(name, column)
        df = found.where("__side = 0")
        if not keys:
            df = carried(df, both, list(seen), stretches)
        if direction == "nearest":
            a, b = distance(value("back"), F.col("__at"), kind), distance(value("ahead"), F.col("__at"), kind)
            best = F.when(F.col("__ahead").isNull() | (a <= b), F.col("__back")).otherwise(F.col("__ahead"))
        else:
            best = F.col("__back" if direction == "backward" else "__ahead")
        df = df.select("__l", F.when(F.col("__at").isNotNull(), best).alias("__best"))
        if keys:
            # rows whose key is null have no partner; they skip the window, where all of them would be one task
            df = df.unionByName(lefts.where(~has_key).select("__l", F.lit(None).cast(df.schema["__best"].dataType).alias("__best")))
    if p.get("tolerance") is not None:
        df = df.withColumn(
            "__best",
            F.when(distance(value("best"), F.col(f"__l.{identifier(la)}"), kind) <= p["tolerance"], F.col("__best")),
        )
    if how == "inner":
        df = df.where("__best IS NOT NULL")
    own = [F.col(f"__l.{identifier(c)}").alias(c) for c in l.columns]
    return df.select(
        *own,
        *[F.col(f"__best.{identifier(c)}").alias(c) for c in r.columns if not any(c == b and a == b for a, b in keys or [])],
    )


@operator("lateralJoin", "left right", "join_type on filter order_by limit columns", sources=lambda p: [p["left"], p["right"]])
def lateral_join(ctx, p, inputs) -> DataFrame:
    """For each left row the right rows that meet ``on``; with ``order_by`` and ``limit``, the first of them.

    ``on`` may use both sides by asset name; without it the type must be cross or left, or a limit given. A limit is planned
    as a rank, never as a loop: under equalities, and an order of right columns, right rows are ranked by key before they are
    joined; without a condition the first rows are the same for every left row; otherwise ranks are within each left row.
    Rows that tie are taken in the order of the right side's columns.
    """
    kind, on = kind_of(p.get("join_type")), [*(p.get("on") or []), *([p["filter"]] if p.get("filter") else [])]
    left, right = inputs[p["left"]], inputs[p["right"]]
    if p.get("columns"):
        right = right.selectExpr(*[normalised(c) for c in p["columns"]])
    if p.get("limit") is None:
        a, b = left.alias(p["left"]), right.alias(p["right"])
        if on:
            return a.join(b, all_of(on), kind if kind != "cross" else "inner")
        if kind not in ("cross", "left"):
            raise PipelineError(BAD_PARAMETER, f"lateralJoin: {kind} join without a condition; ask for cross")
        return a.crossJoin(b) if kind == "cross" else a.join(b, F.lit(True), "left")
    if kind not in ("inner", "left"):
        raise PipelineError(BAD_PARAMETER, "lateralJoin: a limit needs an inner or left join")
    names = [c["column"] if isinstance(c, dict) else c for c in p.get("order_by") or []]
    equal = equal_keys(on, p["left"], p["right"], left.columns, right.columns)
    ties = [F.col(identifier(c)) for c, t in right.dtypes if "map<" not in t and "variant" not in t]
    if not on:
        if unknown := [c for c in names if c not in right.columns]:
            raise PipelineError(BAD_PARAMETER, f"lateralJoin: an order by {', '.join(unknown)} needs a condition")
        best = right.orderBy(*ordering(p.get("order_by") or []), *ties).limit(int(p["limit"]))
        row = F.struct(*[F.col(identifier(c)) for c in right.columns])
        attached = left.select(
            F.struct(*[F.col(identifier(c)) for c in left.columns]).alias("__l"),
            best.agg(F.collect_list(row)).scalar().alias("__r"),
        )
        attached = attached.select("__l", (F.explode if kind == "inner" else F.explode_outer)("__r").alias("__r"))
        sides = [F.col(f"{side}.{identifier(c)}").alias(c) for side, df in (("__l", left), ("__r", right)) for c in df.columns]
        return attached.select(*sides)
    if equal and names and all(c in right.columns for c in names):
        by = Window.partitionBy(*[F.col(identifier(k)) for _, k in equal]).orderBy(*ordering(p["order_by"]), *ties)
        best = right.withColumn("__nth", F.row_number().over(by)).where(F.col("__nth") <= int(p["limit"])).drop("__nth")
        return left.alias(p["left"]).join(best.alias(p["right"]), all_of(on), kind)
    a = numbered(left, "__lateral").alias(p["left"])
    df = a.join(right.withColumn("__hit", F.lit(1)).alias(p["right"]), all_of(on), kind)
    keys = [*ordering(p.get("order_by") or []), *[F.col(f"{identifier(p['right'])}.{identifier(c)}") for c, t in right.dtypes if "map<" not in t and "variant" not in t]]
    rank = F.row_number().over(Window.partitionBy("__lateral").orderBy(*keys))
    return df.withColumn("__nth", rank).where(F.col("__nth") <= int(p["limit"])).drop("__nth", "__lateral", "__hit")
