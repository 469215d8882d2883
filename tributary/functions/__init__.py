"""Type names, expressions and user functions."""

from .expressions import expr, identifier, literal, ordering
from .types import spark_type
from .udf import register_function, register_table_function

__all__ = ["expr", "identifier", "literal", "ordering", "register_function", "register_table_function", "spark_type"]
