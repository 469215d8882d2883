"""Row expressions: SQL text in Spark's grammar, with identifiers in double quotes allowed."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Alternatives in order: string literals and back-quoted names stay; a name in double quotes is back-quoted.
TOKEN = re.compile(r"""'(?:[^'\\]|\\.|'')*'|`(?:[^`]|``)*`|"((?:[^"]|"")*)\"""")


def normalised(sql: str) -> str:
    """Double quotes hold names in the documents' SQL, but strings in Spark's."""
    return TOKEN.sub(lambda m: m[0] if m[1] is None else identifier(m[1].replace('""', '"')), sql)


def expr(sql: str) -> Column:
    return F.expr(normalised(str(sql)))


def identifier(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(value) -> Column:
    return F.lit(value)


def without_alias(sql: str) -> tuple[str, str | None]:
    """The expression and the name that a trailing ``AS name`` gives it."""
    m = re.fullmatch(r"(?is)(.*\S)\s+as\s+(`(?:[^`]|``)+`|\"[^\"]+\"|\w+)\s*", sql)
    return (m[1], m[2].strip('`"')) if m else (sql, None)


def ordering(columns: list) -> list[Column]:
    """Sort keys: a name sorts ascending with nulls last; a mapping gives column, direction and nulls."""
    keys = []
    for c in columns:
        c = {"column": c} if isinstance(c, str) else c
        down = str(c.get("direction", "asc")).lower() == "desc"
        first = str(c.get("nulls", "last")).lower() == "first"
        key = expr(c["column"])
        keys.append(
            (
                key.desc_nulls_first() if first else key.desc_nulls_last()
            ) if down else (key.asc_nulls_first() if first else key.asc_nulls_last())
        )
    return keys
