"""The operators by name: what they take, which assets they read, and the function that plans them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import BAD_PARAMETER, UNKNOWN_OPERATOR, PipelineError


@dataclass(frozen=True)
class Context:
    """What a run gives its operators besides their inputs."""

    spark: SparkSession
    now: datetime | None = None
    log: Callable[[str], None] = lambda message: None


@dataclass(frozen=True)
class Operator:
    name: str
    plan: Callable[..., DataFrame]
    required: tuple[str, ...]
    optional: tuple[str, ...]
    sources: Callable[[dict], list[str]]
    title: str = field(default="")


OPERATORS: dict[str, Operator] = {}


def operator(
    name: str,
    required: str = "",
    optional: str = "",
    sources: Callable[[dict], list[str]] = lambda p: [p["from"]],
    title: str = "",
):
    """Registers ``plan(context, parameters, inputs)``; inputs: a mapping of asset names to frames, in source order."""

    def wrap(plan: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        OPERATORS[name] = Operator(name, plan, tuple(required.split()), tuple(optional.split()), sources, title or name)
        return plan

    return wrap


def checked(name: str, parameters: dict[str, Any]) -> Operator:
    """The operator, if it is known and its parameters' names are right."""
    if name not in OPERATORS:
        raise PipelineError(UNKNOWN_OPERATOR, f'unknown operator "{name}"')
    op = OPERATORS[name]
    for p in op.required:
        if p not in parameters or parameters[p] is None:
            raise PipelineError(BAD_PARAMETER, f'{name}: "{p}" is missing')
    if extra := set(parameters) - set(op.required) - set(op.optional):
        raise PipelineError(BAD_PARAMETER, f"{name}: unknown parameter {', '.join(sorted(extra))}")
    return op


def plan(name: str, parameters: dict[str, Any], inputs: dict[str, DataFrame], context: Context) -> DataFrame:
    """The frame that an operator makes of its inputs; nothing runs, but for the few operators that say so."""
    return checked(name, parameters).plan(context, parameters, inputs)


def only(inputs: dict[str, DataFrame]) -> DataFrame:
    return next(iter(inputs.values()))


def known(df: DataFrame, columns: list[str], what: str) -> list[str]:
    if missing := [c for c in columns if c not in df.columns]:
        raise PipelineError(BAD_PARAMETER, f"{what}: no column {', '.join(missing)}")
    return columns
