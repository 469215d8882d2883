"""Operators: pure functions from input frames to a frame, found by name in the registry."""

from . import aggregates, changes, checks, columns, extend, joins, nulls, partitions, reshape, sets, windows
from .extend import register_component
from .registry import OPERATORS, Context, checked, plan

__all__ = [
    "OPERATORS",
    "Context",
    "aggregates",
    "changes",
    "checked",
    "checks",
    "columns",
    "extend",
    "joins",
    "nulls",
    "partitions",
    "plan",
    "register_component",
    "reshape",
    "sets",
    "windows",
]
