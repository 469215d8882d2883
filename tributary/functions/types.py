"""Type names of pipeline documents as Spark types; an unknown name is an error."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from ..errors import BAD_PARAMETER, PipelineError

SIMPLE = {
    T.StringType(): "string varchar text char utf8 variant",
    T.ByteType(): "byte tinyint int8",
    T.ShortType(): "short smallint int16",
    T.IntegerType(): "integer int int32",
    T.LongType(): "long bigint int64",
    T.FloatType(): "float real float32",
    T.DoubleType(): "double float64",
    T.BooleanType(): "boolean bool",
    T.DateType(): "date date32",
    T.TimestampType(): "timestamp_ltz",
    T.TimestampNTZType(): "timestamp timestamp_ntz timestampntz datetime",
    T.BinaryType(): "binary bytes",
    T.YearMonthIntervalType(): "year_month_interval yearmonthinterval",
    T.DayTimeIntervalType(): "day_time_interval daytimeinterval",
}
NAMES = {name: kind for kind, names in SIMPLE.items() for name in names.split()}


def split_top(s: str) -> list[str]:
    """Parts between the commas that no bracket encloses."""
    parts, depth, last = [], 0, 0
    for k, c in enumerate(s):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            parts.append(s[last:k])
            last = k + 1
    return [p.strip() for p in [*parts, s[last:]] if p.strip()]


def spark_type(name: str) -> T.DataType:
    """``decimal(10,2)``, ``array<int>``, ``map<string, long>``, ``struct<a: int, b: array<string>>`` and the simple names.

    Lengths of char and varchar are accepted and not enforced; variant is JSON text; timestamp has no zone.
    """
    s = name.strip()
    low = s.lower()
    if low in NAMES:
        return NAMES[low]
    if m := re.fullmatch(r"(?:decimal|numeric)(?:\(\s*(\d+)\s*(?:,\s*(-?\d+)\s*)?\))?", low):
        return T.DecimalType(int(m[1] or 10), int(m[2] or 0))
    if re.fullmatch(r"(?:var)?char\(\s*\d+\s*\)", low):
        return T.StringType()
    if m := re.fullmatch(r"time(?:\(\s*(\d)\s*\))?", low):
        return T.TimeType(int(m[1] or 6))
    if m := re.fullmatch(r"(array|map|struct)\s*<(.*)>", s, re.I | re.S):
        kind, parts = m[1].lower(), split_top(m[2])
        if kind == "array" and len(parts) == 1:
            return T.ArrayType(spark_type(parts[0]), True)
        if kind == "map" and len(parts) == 2:
            return T.MapType(spark_type(parts[0]), spark_type(parts[1]), True)
        if kind == "struct" and parts:
            fields = [re.split(r"\s*:\s*|\s+", p, maxsplit=1) for p in parts]
            if all(len(f) == 2 for f in fields):
                return T.StructType([T.StructField(n.strip("`"), spark_type(t), True) for n, t in fields])
    raise PipelineError(BAD_PARAMETER, f'unknown type "{name}"')
