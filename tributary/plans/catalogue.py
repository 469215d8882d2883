"""The registered queries: each applies operators to the whole tables, beside the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable
from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IO, PipelineError
from ..functions import register_function, register_table_function
from ..operators import Context, plan, register_component
from ..quality import run_suites
from ..sources import inspect, read_input, write_output
from ..streaming import deduplicated, plan_stream, read_stream, windowed, write_stream
from .executor import planned
from .parser import parse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
NOW = datetime(2024, 1, 1)


class Tables:
    """The tables of a folder by name, as lazy frames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return read_input(self.spark, "parquet", f"{self.sf_dir}/{name}.parquet")

    def run(self, kind: str, parameters: dict, **made: DataFrame) -> DataFrame:
        """An operator over tables, or over frames made before, given by name."""
        from ..operators import checked

        names = checked(kind, parameters).sources(parameters)
        return plan(kind, parameters, {n: made[n] if n in made else self[n] for n in names}, Context(self.spark, NOW))


def query(name: str, sql: str | None = None):
    def wrap(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return wrap


def simple(name: str, kind: str, parameters: dict, sql: str | None = None, then: list[tuple[str, dict]] = ()) -> None:
    """A query of one operator, or of a chain."""

    def f(t: Tables) -> DataFrame:
        df = t.run(kind, parameters)
        for k, p in then:
            df = t.run(k, {"from": "it", **p}, it=df)
        return df

    query(name, sql)(f)


REVENUE = """
version: "2.0"
input:
  - {name: customer, format: parquet, path: "${DIR}/customer.parquet"}
  - {name: orders, format: parquet, path: "${DIR}/orders.parquet"}
  - {name: nation, format: parquet, path: "${DIR}/nation.parquet"}
transformation:
  - name: large
    where: {from: orders, filter: "o_totalprice > 1000"}
  - name: sold
    join:
      left: large
      right:
        - {name: customer, type: inner, on: ["large.o_custkey = customer.c_custkey"]}
        - {name: nation, type: inner, on: ["customer.c_nationkey = nation.n_nationkey"]}
  - name: revenue
    group:
      from: sold
      by: [n_name]
      agg: ["CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS revenue", "count(*) AS n_orders", "count(distinct c_custkey) AS n_customers"]
  - name: sorted
    orderBy:
      from: revenue
      columns: [{column: revenue, direction: desc}, n_name]
"""


@query(
    "flagship_revenue_per_nation",
    """SELECT n_name, round(sum(o_totalprice), 2) AS revenue, count(*) AS n_orders, count(DISTINCT c_custkey) AS n_customers
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       WHERE o_totalprice > 1000 GROUP BY n_name""",
)
def flagship(t: Tables) -> DataFrame:
    return planned(t.spark, parse(REVENUE, {"DIR": t.sf_dir}), Context(t.spark, NOW))["sorted"]


# Columns and filters

simple(
    "select_expr",
    "select",
    {
        "from": "orders",
        "columns": ["o_orderkey", "upper(o_orderpriority) AS priority", "round(o_totalprice * 2, 2) AS doubled"],
    },
    "SELECT o_orderkey, upper(o_orderpriority) AS priority, round(o_totalprice * 2, 2) AS doubled FROM orders",
)
simple(
    "where_pred",
    "where",
    {"from": "lineitem", "filter": "l_quantity > 45 AND l_returnflag = 'R' AND l_shipdate >= timestamp_ntz '1995-01-01'"},
    "SELECT * FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1995-01-01'",
)
simple(
    "add_columns_seq",
    "addColumns",
    {
        "from": "lineitem",
        "columns": [
            {"name": "net", "expression": "l_extendedprice * (1 - l_discount)"},
            {"name": "gross", "expression": "net * (1 + l_tax)"},
        ],
    },
    "SELECT *, net * (1 + l_tax) AS gross FROM (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem)",
)
simple(
    "drop_columns",
    "dropColumns",
    {"from": "customer", "columns": ["c_acctbal", "c_mktsegment"]},
    "SELECT c_custkey, c_name, c_nationkey FROM customer",
)
simple(
    "rename_swap",
    "renameColumns",
    {"from": "nation", "mappings": {"n_nationkey": "n_regionkey", "n_regionkey": "n_nationkey", "n_name": "name"}},
    "SELECT n_nationkey AS n_regionkey, n_regionkey AS n_nationkey, n_name AS name FROM nation",
)
simple(
    "cast_columns",
    "castColumns",
    {"from": "part", "columns": [{"name": "p_size", "target_type": "long"}, {"name": "p_partkey", "target_type": "string"}]},
    "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, "
    "p_retailprice FROM part",
)
simple(
    "schema_enforce",
    "schemaEnforce",
    {
        "from": "orders",
        "columns": [
            {"name": "o_orderdate", "data_type": "timestamp"},
            {"name": "o_orderkey", "data_type": "string"},
            {"name": "o_totalprice", "data_type": "double"},
        ],
    },
    "SELECT o_orderdate, CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_totalprice FROM orders",
)
simple(
    "conditional",
    "conditional",
    {
        "from": "orders",
        "output_column": "band",
        "branches": [
            {"condition": "o_totalprice < 50000", "value": "'low'"},
            {"condition": "o_totalprice < 200000", "value": "'mid'"},
        ],
        "otherwise": "'high'",
    },
    "SELECT *, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 200000 THEN 'mid' ELSE 'high' END AS band "
    "FROM orders",
)

SPLIT = """
input: [{name: orders, format: parquet, path: "${DIR}/orders.parquet"}]
transformation:
  - name: dearth
    addColumns: {from: orders, columns: [{name: price, expression: "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END"}]}
  - name: parts
    split: {from: dearth, condition: "price > 100000", pass: dear, fail: cheap}
"""
DEARTH = "(SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders)"
query("split_pass", f"SELECT * FROM {DEARTH} WHERE coalesce(price > 100000, false)")(
    lambda t: planned(t.spark, parse(SPLIT, {"DIR": t.sf_dir}), Context(t.spark))["dear"]
)
query("split_fail", f"SELECT * FROM {DEARTH} WHERE NOT coalesce(price > 100000, false)")(
    lambda t: planned(t.spark, parse(SPLIT, {"DIR": t.sf_dir}), Context(t.spark))["cheap"]
)

# Grouping

simple(
    "group_by",
    "group",
    {
        "from": "lineitem",
        "by": ["l_returnflag", "l_linestatus"],
        "agg": [
            "count(*) AS n",
            "CAST(round(sum(l_quantity), 2) AS DOUBLE) AS quantity",
            "round(avg(l_discount), 8) AS discount",
            "max(l_shipdate) AS last",
            "count(*) FILTER (WHERE l_tax > 0.04) AS taxed",
        ],
    },
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 8) AS "
    "discount, max(l_shipdate) AS last, count(*) FILTER (WHERE l_tax > 0.04) AS taxed FROM lineitem GROUP BY 1, 2",
)
simple(
    "group_global",
    "group",
    {"from": "orders", "agg": ["count(*) AS n", "round(sum(o_totalprice), 2) AS total", "min(o_orderdate) AS first"]},
    "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderdate) AS first FROM orders",
)
simple(
    "distinct_agg",
    "group",
    {
        "from": "lineitem",
        "by": ["l_returnflag"],
        "agg": ["count(distinct l_suppkey) AS suppliers", "count(distinct l_partkey) AS parts"],
    },
    "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1",
)
simple(
    "rollup",
    "rollup",
    {
        "from": "customer",
        "by": ["c_mktsegment", "c_nationkey"],
        "agg": ["count(*) AS n", "round(sum(c_acctbal), 2) AS balance"],
    },
    "SELECT c_mktsegment, c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY ROLLUP "
    "(c_mktsegment, c_nationkey)",
)
simple(
    "cube",
    "cube",
    {"from": "customer", "by": ["c_mktsegment", "c_nationkey"], "agg": ["count(*) AS n", "max(c_acctbal) AS most"]},
    "SELECT c_mktsegment, c_nationkey, count(*) AS n, max(c_acctbal) AS most FROM customer GROUP BY CUBE (c_mktsegment, "
    "c_nationkey)",
)
simple(
    "grouping_sets",
    "groupingSets",
    {"from": "customer", "sets": [["c_nationkey"], ["c_mktsegment"], []], "agg": ["count(*) AS n"]},
    "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), ())",
)
simple(
    "distinct",
    "select",
    {"from": "lineitem", "columns": ["l_returnflag", "l_linestatus"]},
    "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    [("distinct", {})],
)
simple(
    "distinct_columns",
    "distinct",
    {"from": "orders", "columns": ["o_custkey"], "order_by": [{"column": "o_orderdate", "direction": "desc"}, "o_orderkey"]},
    "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, "
    "o_orderkey) = 1",
)

# Order, limits, partitions

simple(
    "order_by_nulls",
    "addColumns",
    {
        "from": "customer",
        "columns": [{"name": "bal", "expression": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END"}],
    },
    "SELECT * FROM (SELECT *, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS bal FROM customer) ORDER BY bal "
    "DESC NULLS FIRST, c_custkey LIMIT 300",
    [
        ("orderBy", {"columns": [{"column": "bal", "direction": "desc", "nulls": "first"}, "c_custkey"]}),
        ("limit", {"count": 300}),
    ],
)
simple(
    "order_by_nulls_all",
    "addColumns",
    {
        "from": "customer",
        "columns": [{"name": "bal", "expression": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END"}],
    },
    "SELECT *, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS bal FROM customer ORDER BY bal DESC NULLS "
    "FIRST, c_custkey",
    [("orderBy", {"columns": [{"column": "bal", "direction": "desc", "nulls": "first"}, "c_custkey"]})],
)
simple(
    "limit_ordered",
    "orderBy",
    {"from": "part", "columns": ["p_name", "p_partkey"]},
    "SELECT * FROM part ORDER BY p_name, p_partkey LIMIT 50",
    [("limit", {"count": 50})],
)
simple(
    "top_k",
    "orderBy",
    {"from": "orders", "columns": [{"column": "o_totalprice", "direction": "desc"}, "o_orderkey"]},
    "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    [("limit", {"count": 20})],
)
simple(
    "offset",
    "orderBy",
    {"from": "supplier", "columns": ["s_suppkey"]},
    "SELECT * FROM supplier ORDER BY s_suppkey OFFSET 10",
    [("offset", {"count": 10})],
)
simple(
    "tail",
    "orderBy",
    {"from": "supplier", "columns": ["s_acctbal", "s_suppkey"]},
    "SELECT * FROM supplier ORDER BY s_acctbal DESC, s_suppkey DESC LIMIT 7",
    [("tail", {"count": 7})],
)
simple("sample", "sample", {"from": "lineitem", "fraction": 0.1, "seed": 42})
simple("repartition", "repartition", {"from": "orders", "num_partitions": 8, "columns": ["o_custkey"]}, "SELECT * FROM orders")
simple("coalesce", "coalesce", {"from": "orders", "num_partitions": 2}, "SELECT * FROM orders")
simple("hint", "hint", {"from": "nation", "hints": [{"name": "broadcast"}]}, "SELECT * FROM nation")

# Joins

for kind, sql in (
    ("inner", "JOIN"),
    ("left", "LEFT JOIN"),
    ("right", "RIGHT JOIN"),
    ("outer", "FULL JOIN"),
    ("left_semi", "SEMI JOIN"),
    ("left_anti", "ANTI JOIN"),
):
    simple(
        f"join_{kind}",
        "join",
        {
            "left": "customer",
            "right": [
                {
                    "name": "orders",
                    "type": kind,
                    "on": ["customer.c_custkey = orders.o_custkey", "orders.o_totalprice > 250000"],
                }
            ],
        },
        f"SELECT * FROM customer {sql} orders ON c_custkey = o_custkey AND o_totalprice > 250000",
    )
simple("join_cross", "join", {"left": "region", "right": [{"name": "nation", "type": "cross"}]}, "SELECT * FROM region, nation")
simple(
    "join_theta",
    "join",
    {
        "left": "supplier",
        "right": [{"name": "nation", "on": ["supplier.s_nationkey < nation.n_nationkey", "nation.n_regionkey = 2"]}],
    },
    "SELECT * FROM supplier JOIN nation ON s_nationkey < n_nationkey AND n_regionkey = 2",
)
simple(
    "join_nway",
    "join",
    {
        "left": "orders",
        "right": [
            {"name": "customer", "on": ["orders.o_custkey = customer.c_custkey"]},
            {"name": "nation", "on": ["customer.c_nationkey = nation.n_nationkey"]},
            {"name": "region", "type": "left", "on": ["nation.n_regionkey = region.r_regionkey"]},
        ],
    },
    "SELECT * FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region "
    "ON n_regionkey = r_regionkey",
)
simple(
    "join_range",
    "join",
    {
        "left": "orders",
        "right": [
            {
                "name": "lineitem",
                "on": [
                    "orders.o_orderkey = lineitem.l_orderkey",
                    "lineitem.l_shipdate BETWEEN orders.o_orderdate AND orders.o_orderdate + INTERVAL '30' DAY",
                ],
            }
        ],
    },
    "SELECT * FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + "
    "INTERVAL '30' DAY",
)


def visits(t: Tables) -> tuple[DataFrame, DataFrame]:
    buys = t.run("where", {"from": "events", "filter": "event_type = 'purchase'"})
    buys = t.run("select", {"from": "b", "columns": ["event_id", "user_id", "ts"]}, b=buys)
    seen = t.run("where", {"from": "events", "filter": "event_type = 'click'"})
    return buys, t.run("select", {"from": "s", "columns": ["user_id AS click_user", "ts AS click_ts", "event_id AS click_id"]}, s=seen)


BUYS, CLICKS = "(SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')", "(SELECT user_id AS click_user, ts AS click_ts, event_id AS click_id FROM events WHERE event_type = 'click')"


def as_of(direction: str, condition: str, order: str, how: str = "left"):
    def f(t: Tables) -> DataFrame:
        buys, clicks = visits(t)
        return t.run(
            "asOfJoin",
            {
                "left": "buys",
                "right": "clicks",
                "left_as_of": "ts",
                "right_as_of": "click_ts",
                "on": ["buys.user_id = clicks.click_user"],
                "direction": direction,
                "tie_break": "click_id",
                "how": how,
            },
            buys=buys,
            clicks=clicks,
        )

    sql = (
        f"SELECT b.*, c.* FROM {BUYS} b LEFT JOIN {CLICKS} c ON b.user_id = c.click_user AND {condition} QUALIFY "
        f"row_number() OVER (PARTITION BY b.event_id ORDER BY {order}) = 1"
    )
    query(
        f"asof_{direction}" + ("" if how == "left" else f"_{how}"),
        sql if how == "left" else f"SELECT * FROM ({sql}) WHERE click_id IS NOT NULL",
    )(f)


as_of("backward", "c.click_ts <= b.ts", "click_ts DESC NULLS LAST, click_id DESC")
as_of("backward", "c.click_ts <= b.ts", "click_ts DESC NULLS LAST, click_id DESC", "inner")
as_of("forward", "c.click_ts >= b.ts", "click_ts ASC NULLS LAST, click_id DESC")
as_of("nearest", "true", "abs(epoch_us(click_ts) - epoch_us(b.ts)) ASC NULLS LAST, click_ts ASC, click_id DESC")

simple(
    "lateral_top",
    "lateralJoin",
    {
        "left": "customer",
        "right": "orders",
        "join_type": "left",
        "on": ["customer.c_custkey = orders.o_custkey"],
        "order_by": [{"column": "o_totalprice", "direction": "desc"}, "o_orderkey"],
        "limit": 2,
    },
    "SELECT c.*, o.* FROM customer c LEFT JOIN orders o ON c_custkey = o_custkey QUALIFY row_number() OVER (PARTITION BY "
    "c_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) <= 2",
)
simple(
    "lateral_plain",
    "lateralJoin",
    {"left": "region", "right": "nation", "join_type": "inner", "on": ["region.r_regionkey = nation.n_regionkey"]},
    "SELECT * FROM region JOIN nation ON r_regionkey = n_regionkey",
)

simple(
    "lateral_left_without_condition",
    "lateralJoin",
    {
        "left": "region",
        "right": "nation",
        "join_type": "left",
        "columns": ["n_name", "n_nationkey"],
        "order_by": ["n_name"],
        "limit": 3,
    },
    "SELECT * FROM region, (SELECT n_name, n_nationkey FROM nation ORDER BY n_name LIMIT 3)",
)


@query(
    "asof_without_keys",
    f"SELECT b.*, c.* FROM {BUYS} b ASOF LEFT JOIN (SELECT * FROM {CLICKS} QUALIFY row_number() OVER (PARTITION BY click_ts ORDER BY click_id DESC) = 1) c ON b.ts >= c.click_ts",
)
def asof_without_keys(t: Tables) -> DataFrame:
    buys, clicks = visits(t)
    return t.run(
        "asOfJoin",
        {"left": "buys", "right": "clicks", "left_as_of": "ts", "right_as_of": "click_ts", "tie_break": "click_id"},
        buys=buys,
        clicks=clicks,
    )


# Windows

simple(
    "window_rank",
    "window",
    {
        "from": "orders",
        "partition_by": ["o_custkey"],
        "order_by": [{"column": "o_totalprice", "direction": "desc"}, "o_orderkey"],
        "frame": {"frame_type": "range", "start": "UNBOUNDED PRECEDING", "end": "CURRENT ROW"},
        "functions": [
            {"expression": "row_number()", "alias": "rn"},
            {"expression": "dense_rank()", "alias": "dr"},
            {"expression": "ntile(3)", "alias": "third"},
        ],
    },
    "SELECT *, CAST(row_number() OVER w AS INT) AS rn, CAST(dense_rank() OVER w AS INT) AS dr, CAST(ntile(3) OVER w AS "
    "INT) AS third FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey)",
)
simple(
    "window_frame_rows",
    "window",
    {
        "from": "orders",
        "partition_by": ["o_custkey"],
        "order_by": ["o_orderdate", "o_orderkey"],
        "frame": {"frame_type": "rows", "start": "2 PRECEDING", "end": "CURRENT ROW"},
        "functions": [{"expression": "max(o_totalprice)", "alias": "most"}, {"expression": "count(*)", "alias": "n"}],
    },
    "SELECT *, max(o_totalprice) OVER w AS most, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey "
    "ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
)
simple(
    "window_frame_range",
    "window",
    {
        "from": "events",
        "partition_by": ["user_id"],
        "order_by": ["ts"],
        "frame": {"frame_type": "range", "start": "INTERVAL '1' DAY PRECEDING", "end": "CURRENT ROW"},
        "functions": [{"expression": "count(*)", "alias": "day_events"}],
    },
    "SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS "
    "day_events FROM events",
)
simple(
    "window_lag",
    "window",
    {
        "from": "orders",
        "partition_by": ["o_custkey"],
        "order_by": ["o_orderdate", "o_orderkey"],
        "functions": [
            {"expression": "lag(o_totalprice, 1)", "alias": "before"},
            {"expression": "lead(o_orderkey)", "alias": "next"},
        ],
    },
    "SELECT *, lag(o_totalprice, 1) OVER w AS before, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION "
    "BY o_custkey ORDER BY o_orderdate, o_orderkey)",
)
simple(
    "window_whole",
    "window",
    {"from": "nation", "functions": [{"expression": "count(*)", "alias": "n"}]},
    "SELECT *, count(*) OVER () AS n FROM nation",
)

# Reshaping

STATUS = "max(o_totalprice) FILTER (WHERE o_orderstatus = '{0}') AS \"{0}\""
simple(
    "pivot",
    "pivot",
    {
        "from": "orders",
        "group_by": ["o_orderpriority"],
        "pivot_column": "o_orderstatus",
        "values": ["O", "F", "P"],
        "agg": ["max(o_totalprice) AS most"],
    },
    f"SELECT o_orderpriority, {', '.join(STATUS.format(s) for s in 'OFP')} FROM orders GROUP BY 1",
)
simple(
    "pivot_discovered",
    "pivot",
    {
        "from": "lineitem",
        "group_by": ["l_linestatus"],
        "pivot_column": "l_returnflag",
        "agg": ["count(*) AS n", "max(l_quantity) AS most"],
    },
    "SELECT l_linestatus, " + ", ".join(
        (
            f"count(*) FILTER (WHERE l_returnflag = '{f}') AS \"{f}_n\", max(l_quantity) FILTER (WHERE l_returnflag = "
            f"'{f}') AS \"{f}_most\""
        ) for f in "ANR"
    ) + " FROM lineitem GROUP BY 1",
)
simple(
    "unpivot",
    "unpivot",
    {
        "from": "lineitem",
        "ids": ["l_orderkey", "l_linenumber"],
        "values": ["l_discount", "l_tax"],
        "variable_column": "measure",
        "value_column": "amount",
    },
    "SELECT l_orderkey, l_linenumber, 'l_discount' AS measure, l_discount AS amount FROM lineitem UNION ALL SELECT "
    "l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem",
)
simple(
    "crosstab",
    "crosstab",
    {"from": "customer", "col1": "c_nationkey", "col2": "c_mktsegment"},
    "SELECT c_nationkey, " + ", ".join(
        f"count(*) FILTER (WHERE c_mktsegment = '{s}') AS \"{s}\"" for s in (
            "AUTOMOBILE",
            "BUILDING",
            "FURNITURE",
            "HOUSEHOLD",
            "MACHINERY",
        )
    ) + " FROM customer GROUP BY 1",
)
simple(
    "transpose",
    "transpose",
    {"from": "nation", "index_columns": ["n_nationkey"]},
    "SELECT n_nationkey, 'n_name' AS column_name, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', "
    "CAST(n_regionkey AS VARCHAR) FROM nation",
)
simple(
    "describe",
    "describe",
    {"from": "part", "columns": ["p_size", "p_brand"], "statistics": ["count", "min", "max"]},
    "SELECT 'count' AS statistic, CAST(count(p_size) AS VARCHAR) AS p_size, CAST(count(p_brand) AS VARCHAR) AS p_brand "
    "FROM part UNION ALL SELECT 'min', CAST(min(p_size) AS VARCHAR), min(p_brand) FROM part UNION ALL SELECT 'max', "
    "CAST(max(p_size) AS VARCHAR), max(p_brand) FROM part",
)

# Sets

simple("union_all", "union", {"sources": ["nation", "nation"], "all": True}, "SELECT * FROM nation UNION ALL SELECT * FROM nation")
simple("union_distinct", "union", {"sources": ["region", "region"], "all": False}, "SELECT * FROM region")
KEYS = {"s": ("supplier", "s_nationkey AS k"), "c": ("customer", "c_nationkey AS k"), "n": ("nation", "n_nationkey AS k")}


def keys(t: Tables, *names: str) -> dict[str, DataFrame]:
    return {n: t.run("select", {"from": KEYS[n][0], "columns": [KEYS[n][1]]}) for n in names}


SELECT = {n: f"SELECT {c} FROM {t}" for n, (t, c) in KEYS.items()}
query("union_by_name", "SELECT n_nationkey AS k, n_name AS name, NULL::VARCHAR AS r_name FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region")(
    lambda t: t.run("union", {"sources": ["a", "b"], "by_name": True, "allow_missing_columns": True}, a=t.run("select", {"from": "nation", "columns": ["n_nationkey AS k", "n_name AS name"]}), b=t.run("select", {"from": "region", "columns": ["r_name", "r_regionkey AS k"]}))
)
query("intersect", f"{SELECT['s']} INTERSECT {SELECT['c']} INTERSECT {SELECT['n']}")(
    lambda t: t.run("intersect", {"sources": ["s", "c", "n"]}, **keys(t, "s", "c", "n"))
)
query("intersect_all", f"{SELECT['s']} INTERSECT ALL {SELECT['c']}")(
    lambda t: t.run("intersect", {"sources": ["s", "c"], "all": True}, **keys(t, "s", "c"))
)
query("except", f"{SELECT['n']} EXCEPT {SELECT['s']}")(lambda t: t.run("except", {"left": "n", "right": "s"}, **keys(t, "n", "s")))
query("except_all", f"{SELECT['c']} EXCEPT ALL {SELECT['s']}")(
    lambda t: t.run("except", {"left": "c", "right": "s", "all": True}, **keys(t, "c", "s"))
)

# Missing values

GAPS = {
    "from": "customer",
    "columns": [
        "c_custkey",
        "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS bal",
        "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS seg",
        "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END AS nat",
    ],
}
GAPS_SQL = (
    "(SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS bal, CASE WHEN c_custkey % 5 = 0 THEN "
    "NULL ELSE c_mktsegment END AS seg, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END AS nat FROM customer)"
)
simple(
    "fill_na",
    "select",
    GAPS,
    f"SELECT c_custkey, coalesce(bal, 0) AS bal, coalesce(seg, 'none') AS seg, coalesce(nat, 0) AS nat FROM {GAPS_SQL}",
    [("fillNa", {"value": 0, "values": {"seg": "none"}})],
)
simple(
    "drop_na_any",
    "select",
    GAPS,
    f"SELECT * FROM {GAPS_SQL} WHERE bal IS NOT NULL AND seg IS NOT NULL AND nat IS NOT NULL",
    [("dropNa", {"how": "any"})],
)
simple(
    "drop_na_all",
    "select",
    GAPS,
    f"SELECT * FROM {GAPS_SQL} WHERE bal IS NOT NULL OR seg IS NOT NULL OR nat IS NOT NULL",
    [("dropNa", {"how": "all", "columns": ["bal", "seg", "nat"]})],
)
simple(
    "drop_na_thresh",
    "select",
    GAPS,
    f"SELECT * FROM {GAPS_SQL} WHERE (bal IS NOT NULL)::INT + (seg IS NOT NULL)::INT + (nat IS NOT NULL)::INT >= 2",
    [("dropNa", {"min_non_nulls": 2, "columns": ["bal", "seg", "nat"]})],
)
simple(
    "replace",
    "replace",
    {
        "from": "orders",
        "columns": ["o_orderstatus", "o_custkey"],
        "mappings": [{"old": "O", "new": "open"}, {"old": "F", "new": "filled"}, {"old": 1, "new": -1}],
    },
    "SELECT o_orderkey, CASE WHEN o_custkey = 1 THEN -1 ELSE o_custkey END AS o_custkey, CASE o_orderstatus WHEN 'O' THEN "
    "'open' WHEN 'F' THEN 'filled' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority "
    "FROM orders",
)

# Parsing and nesting

simple(
    "parse_json",
    "parse",
    {
        "from": "events",
        "column": "props",
        "format": "json",
        "schema": [{"name": "k", "data_type": "long"}, {"name": "missing", "data_type": "string"}],
    },
    "SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing "
    "FROM events",
)
simple(
    "parse_csv",
    "select",
    {"from": "nation", "columns": ["n_nationkey", "concat_ws(',', n_nationkey, n_name, n_regionkey) AS line"]},
    "SELECT n_nationkey, concat_ws(',', n_nationkey, n_name, n_regionkey) AS line, n_nationkey AS a, n_name AS b, "
    "CAST(n_regionkey AS BIGINT) AS c FROM nation",
    [
        (
            "parse",
            {
                "column": "line",
                "format": "csv",
                "schema": [
                    {"name": "a", "data_type": "int"},
                    {"name": "b", "data_type": "string"},
                    {"name": "c", "data_type": "long"},
                ],
            },
        )
    ],
)
simple(
    "flatten_struct",
    "select",
    {
        "from": "orders",
        "columns": [
            "o_orderkey",
            "struct(o_totalprice AS price, struct(o_orderstatus AS status, o_custkey AS cust) AS inner) AS o",
        ],
    },
    "SELECT o_orderkey, o_totalprice AS o_price, o_orderstatus AS o_inner_status, o_custkey AS o_inner_cust FROM orders",
    [("flatten", {"separator": "_"})],
)
simple(
    "flatten_explode",
    "select",
    {"from": "embeddings", "columns": ["vec_id", "label", "embedding AS x"]},
    "SELECT vec_id, label, unnest(embedding) AS x FROM embeddings",
    [("flatten", {"explode_arrays": True})],
)

# Changes

VERSIONS = (
    "c_custkey, c_mktsegment, c_nationkey, timestamp_ntz '2020-01-01' AS start_date, CASE WHEN c_custkey % 11 = 0 THEN "
    "timestamp_ntz '2021-01-01' END AS end_date, c_custkey % 11 != 0 AS is_current"
)
VERSIONS_SQL = (
    "(SELECT c_custkey, c_mktsegment, c_nationkey, TIMESTAMP '2020-01-01' AS start_date, CASE WHEN c_custkey % 11 = 0 THEN "
    "TIMESTAMP '2021-01-01' END AS end_date, c_custkey % 11 <> 0 AS is_current FROM customer WHERE c_custkey % 10 <> 3)"
)
NEWS = (
    "c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'MOVED' WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END AS "
    "c_mktsegment, c_nationkey"
)
NEWS_SQL = f"(SELECT {NEWS} FROM customer WHERE c_custkey % 10 <> 5)"


@query(
    "scd2",
    f"""WITH cur AS {VERSIONS_SQL}, inc AS {NEWS_SQL}, live AS (SELECT * FROM cur WHERE is_current),
    moved AS (SELECT live.c_custkey FROM live JOIN inc USING (c_custkey) WHERE live.c_mktsegment IS DISTINCT FROM inc.c_mktsegment)
    SELECT * FROM cur WHERE NOT is_current
    UNION ALL SELECT * FROM live WHERE c_custkey NOT IN (SELECT c_custkey FROM moved)
    UNION ALL SELECT c_custkey, c_mktsegment, c_nationkey, start_date, TIMESTAMP '2024-01-01', false FROM live WHERE c_custkey IN (SELECT c_custkey FROM moved)
    UNION ALL SELECT c_custkey, c_mktsegment, c_nationkey, TIMESTAMP '2024-01-01', NULL, true FROM inc WHERE c_custkey IN (SELECT c_custkey FROM moved) OR c_custkey NOT IN (SELECT c_custkey FROM live)""",
)
def scd2(t: Tables) -> DataFrame:
    cur = t.run("where", {"from": "customer", "filter": "c_custkey % 10 != 3"}).selectExpr(*columns_of(VERSIONS))
    inc = t.run("where", {"from": "customer", "filter": "c_custkey % 10 != 5"}).selectExpr(*columns_of(NEWS))
    return t.run(
        "scd2",
        {"current": "cur", "incoming": "inc", "key_columns": ["c_custkey"], "track_columns": ["c_mktsegment"]},
        cur=cur,
        inc=inc,
    )


def columns_of(text: str) -> list[str]:
    return text.split(", ")


@query(
    "merge",
    """SELECT t.c_custkey, t.c_name, CASE WHEN s.c_custkey IS NOT NULL AND s.c_acctbal > 5000 THEN s.c_acctbal + 1 WHEN s.c_custkey IS NOT NULL THEN s.c_acctbal ELSE t.c_acctbal END AS c_acctbal
       FROM (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 10 <> 3) t LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 1) s USING (c_custkey)
       WHERE NOT coalesce(s.c_acctbal < 0, false)
       UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 10 = 3""",
)
def merge(t: Tables) -> DataFrame:
    target = t["customer"].where("c_custkey % 10 != 3").select("c_custkey", "c_name", "c_acctbal")
    return t.run("merge", {
        "target": "t", "source": "s", "on": ["t.c_custkey = s.c_custkey"],
        "when_matched": [{"action": "delete", "condition": "s.c_acctbal < 0"}, {"action": "update", "condition": "s.c_acctbal > 5000", "set": {"c_acctbal": "s.c_acctbal + 1"}}, {"action": "update", "set": {"c_acctbal": "s.c_acctbal"}}],
        "when_not_matched": [{"action": "insert", "star": True}],
    }, t=target, s=t["customer"].where("c_custkey % 2 = 1"))


#: The whole table with its keys moved on: the first keys of customer have no partner, the last of these are new.
SHIFT = 100
SHIFTED_SQL = f"(SELECT * REPLACE (c_custkey + {SHIFT} AS c_custkey) FROM customer)"


def shifted(t: Tables) -> DataFrame:
    return t["customer"].withColumn("c_custkey", F.col("c_custkey") + F.lit(SHIFT))


@query(
    "scd2_all",
    ORACLES["scd2"].replace(
        VERSIONS_SQL,
        VERSIONS_SQL.replace(" WHERE c_custkey % 10 <> 3", ""),
    ).replace(NEWS_SQL, f"(SELECT {NEWS} FROM {SHIFTED_SQL})"),
)
def scd2_all(t: Tables) -> DataFrame:
    cur, inc = t["customer"].selectExpr(*columns_of(VERSIONS)), shifted(t).selectExpr(*columns_of(NEWS))
    return t.run(
        "scd2",
        {"current": "cur", "incoming": "inc", "key_columns": ["c_custkey"], "track_columns": ["c_mktsegment"]},
        cur=cur,
        inc=inc,
    )


@query(
    "merge_all",
    f"""SELECT t.c_custkey, t.c_name, CASE WHEN s.c_custkey IS NOT NULL AND s.c_acctbal > 5000 THEN s.c_acctbal + 1 WHEN s.c_custkey IS NOT NULL THEN s.c_acctbal ELSE t.c_acctbal END AS c_acctbal
       FROM customer t LEFT JOIN {SHIFTED_SQL} s ON t.c_custkey = s.c_custkey
       WHERE NOT coalesce(s.c_acctbal < 0, false)
       UNION ALL SELECT c_custkey, c_name, c_acctbal FROM {SHIFTED_SQL} WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)""",
)
def merge_all(t: Tables) -> DataFrame:
    return t.run("merge", {
        "target": "t", "source": "s", "on": ["t.c_custkey = s.c_custkey"],
        "when_matched": [{"action": "delete", "condition": "s.c_acctbal < 0"}, {"action": "update", "condition": "s.c_acctbal > 5000", "set": {"c_acctbal": "s.c_acctbal + 1"}}, {"action": "update", "set": {"c_acctbal": "s.c_acctbal"}}],
        "when_not_matched": [{"action": "insert", "star": True}],
    }, t=t["customer"].select("c_custkey", "c_name", "c_acctbal"), s=shifted(t))


@query(
    "merge_mostly_inserts",
    """SELECT c_custkey, c_name, CASE WHEN c_custkey IN (SELECT o_orderkey FROM orders) THEN -1.0 ELSE c_acctbal END AS c_acctbal FROM customer
       UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)""",
)
def merge_mostly_inserts(t: Tables) -> DataFrame:
    """Ten times as many rows in the source as in the target: nearly all are inserted."""
    source = t.run(
        "select",
        {"from": "orders", "columns": ["o_orderkey AS c_custkey", "o_orderstatus AS c_name", "o_totalprice AS c_acctbal"]},
    )
    return t.run("merge", {
        "target": "t", "source": "s", "on": ["t.c_custkey = s.c_custkey"],
        "when_matched": [{"action": "update", "set": {"c_acctbal": "-1.0"}}], "when_not_matched": [{"action": "insert", "star": True}],
    }, t=t["customer"].select("c_custkey", "c_name", "c_acctbal"), s=source)


@query(
    "scd2_null_keys",
    """SELECT k, v, start_date, end_date, is_current FROM (
         SELECT NULL::INT AS k, 'none' AS v, TIMESTAMP '2020-01-01' AS start_date, TIMESTAMP '2024-01-01' AS end_date, false AS is_current
         UNION ALL SELECT NULL, 'some', TIMESTAMP '2024-01-01', NULL, true
         UNION ALL SELECT n_nationkey, n_name, TIMESTAMP '2020-01-01', NULL, true FROM nation)""",
)
def scd2_null_keys(t: Tables) -> DataFrame:
    cur = t.spark.createDataFrame([(None, "none")], "k int, v string").unionByName(
        t["nation"].selectExpr("n_nationkey AS k", "n_name AS v")
    )
    inc = t.spark.createDataFrame([(None, "some")], "k int, v string").unionByName(
        t["nation"].selectExpr("n_nationkey AS k", "n_name AS v")
    )
    cur = cur.selectExpr(
        "k",
        "v",
        "timestamp_ntz '2020-01-01' AS start_date",
        "CAST(NULL AS TIMESTAMP_NTZ) AS end_date",
        "true AS is_current",
    )
    return t.run("scd2", {"current": "cur", "incoming": "inc", "key_columns": ["k"], "track_columns": ["v"]}, cur=cur, inc=inc)


# Checks

simple(
    "assertion_drop",
    "assertion",
    {
        "from": "lineitem",
        "on_failure": "drop",
        "checks": [
            {"rule": "l_quantity < 40"},
            {"column": "l_orderkey", "rule": "not_null"},
            {"rule": "nullif(l_returnflag, 'N') = 'A'"},
        ],
    },
    "SELECT * FROM lineitem WHERE l_quantity < 40 AND coalesce(nullif(l_returnflag, 'N') = 'A', true)",
)
simple(
    "assertion_warn",
    "assertion",
    {
        "from": "orders",
        "on_failure": "warn",
        "checks": [{"rule": "o_totalprice > 0"}, {"column": "o_orderkey", "rule": "unique"}],
    },
    "SELECT * FROM orders",
)


@query(
    "quality_report",
    """SELECT 'completeness' AS check_type, true AS passed, 1.0::DOUBLE AS metric
       UNION ALL SELECT 'uniqueness', count(DISTINCT o_custkey) / count(*) >= 0.9, count(DISTINCT o_custkey) / count(*) FROM orders
       UNION ALL SELECT 'volume', count(*) >= 10, count(*)::DOUBLE FROM orders
       UNION ALL SELECT 'validity', count(*) FILTER (WHERE o_orderstatus IN ('O', 'F')) / count(*) >= 0.5, count(*) FILTER (WHERE o_orderstatus IN ('O', 'F')) / count(*) FROM orders
       UNION ALL SELECT 'referential', true, count(c_custkey) / count(*) FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
def quality_report(t: Tables) -> DataFrame:
    checks = [
        {"type": "completeness", "column": "o_custkey"},
        {"type": "uniqueness", "column": "o_custkey", "threshold": 0.9},
        {"type": "volume", "min": 10},
        {"type": "validity", "column": "o_orderstatus", "accepted_values": ["O", "F"], "threshold": 0.5},
        {"type": "referential", "column": "o_custkey", "reference": "customer", "ref_column": "c_custkey", "threshold": 0.9},
    ]
    report = run_suites(
        [{"suite": "orders", "target": "orders", "checks": checks}],
        {"orders": t["orders"], "customer": t["customer"]},
        NOW,
    )
    kind = T.StructType(
        [
            T.StructField("check_type", T.StringType()),
            T.StructField("passed", T.BooleanType()),
            T.StructField("metric", T.DoubleType()),
        ]
    )
    return t.spark.createDataFrame([(r.check_type, r.passed, r.metric) for r in report.results], kind)


CHECKS = [
    {"type": "schema", "required": ["o_orderkey", "o_custkey"]},
    {"type": "schema", "required": ["o_orderkey", "o_nothing"]},
    {"type": "statistical", "column": "o_orderkey", "max": {"min": 1}, "min": {"max": 5}},
    {"type": "freshness", "column": "o_orderdate", "max_age": "36500d"},
    {"type": "freshness", "column": "o_orderdate", "max_age": "1h"},
    {"type": "crossColumn", "condition": "o_totalprice >= 0 OR o_custkey > 0"},
    {"type": "custom", "expression": "o_orderkey % 4 = 0", "threshold": 0.9},
]
AGE_SQL = "epoch(TIMESTAMP '2024-01-01') - epoch(max(o_orderdate))"


@query(
    "quality_report_more",
    f"""SELECT 0 AS n, 'schema' AS check_type, true AS passed, NULL::DOUBLE AS metric UNION ALL SELECT 1, 'schema', false, NULL
       UNION ALL SELECT 2, 'statistical', max(o_orderkey) >= 1 AND min(o_orderkey) <= 5, min(o_orderkey)::DOUBLE FROM orders
       UNION ALL SELECT 3, 'freshness', true, {AGE_SQL} FROM orders UNION ALL SELECT 4, 'freshness', {AGE_SQL} <= 3600, {AGE_SQL} FROM orders
       UNION ALL SELECT 5, 'crossColumn', true, 1.0 UNION ALL SELECT 6, 'custom', false, count(*) FILTER (WHERE o_orderkey % 4 = 0) / count(*) FROM orders""",
)
def quality_report_more(t: Tables) -> DataFrame:
    report = run_suites([{"suite": "orders", "target": "orders", "checks": CHECKS}], {"orders": t["orders"]}, NOW)
    return t.spark.createDataFrame(
        [(n, r.check_type, r.passed, r.metric) for n, r in enumerate(report.results)],
        "n int, check_type string, passed boolean, metric double",
    )


# Files: what is written is read back

ROUND_TRIP_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


def scratch(spark: SparkSession) -> str:
    """A new folder that all machines see, beside the checkpoints; of the machine's own only where one machine is all."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: files can't be written where all machines see them")
    return f"{shared or tempfile.gettempdir()}/round-trip-{uuid.uuid4()}"


def round_trip(format: str, writing: dict | None = None, reading: dict | None = None) -> None:
    def f(t: Tables) -> DataFrame:
        df, path = t.run(
            "select",
            {"from": "orders", "columns": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]},
        ), scratch(t.spark)
        write_output(df, format, path, "error", writing)
        return read_input(t.spark, format, path, {**(reading or {}), "schema": ", ".join(f"{n} {k}" for n, k in df.dtypes)})

    query(f"round_trip_{format}", ROUND_TRIP_SQL)(f)


round_trip("csv", {"header": True}, {"header": True})
round_trip("json")
round_trip("ndjson")
round_trip("orc")
round_trip("parquet", {"compression": "zstd"})
round_trip("xml", {"rowTag": "order"}, {"rowTag": "order"})


@query("round_trip_text", "SELECT n_name AS value FROM nation")
def round_trip_text(t: Tables) -> DataFrame:
    path = scratch(t.spark)
    write_output(t.run("select", {"from": "nation", "columns": ["n_name"]}), "text", path)
    return read_input(t.spark, "text", path)


def written(name: str, modes: list[str], sql: str) -> None:
    """Suppliers written once, then customers' keys by each mode; a refused write is a row less."""

    def f(t: Tables) -> DataFrame:
        path = scratch(t.spark)
        write_output(t.run("select", {"from": "supplier", "columns": ["s_suppkey AS k", "'s' AS side"]}), "parquet", path)
        for mode in modes:
            try:
                write_output(t.run("select", {"from": "customer", "columns": ["c_custkey AS k", "'c' AS side"]}), "parquet", path, mode)
            except PipelineError as e:
                if e.code != IO:
                    raise
        return read_input(t.spark, "parquet", path)

    query(f"write_{name}", sql)(f)


OF_S, OF_C = "SELECT s_suppkey AS k, 's' AS side FROM supplier", "SELECT c_custkey AS k, 'c' AS side FROM customer"
written("error", ["error"], OF_S)
written("ignore", ["ignore"], OF_S)
written("append", ["append"], f"{OF_S} UNION ALL {OF_C}")
written("overwrite", ["overwrite"], OF_C)
written("modes_in_turn", ["append", "ignore", "overwrite", "append"], f"{OF_C} UNION ALL {OF_C}")


@query(
    "inspect",
    "SELECT 'n_nationkey' AS name, 'int' AS type, count(*) AS n FROM nation UNION ALL SELECT 'n_name', 'string', count(*) "
    "FROM nation UNION ALL SELECT 'n_regionkey', 'int', count(*) FROM nation",
)
def inspected(t: Tables) -> DataFrame:
    found = inspect(t.spark, "parquet", f"{t.sf_dir}/nation.parquet")
    return t.spark.createDataFrame([(x["name"], x["type"], found["rows"]) for x in found["fields"]], "name string, type string, n long")


simple("sample_whole", "sample", {"from": "lineitem", "fraction": 1.0, "seed": 7}, "SELECT * FROM lineitem")


@query("sample_share", "SELECT true AS near, 0::BIGINT AS strangers, true AS repeatable")
def sample_share(t: Tables) -> DataFrame:
    """A tenth within five standard deviations, only rows of the table, the same rows again for the same seed."""
    a, b = (t.run("sample", {"from": "lineitem", "fraction": 0.1, "seed": 42}) for _ in range(2))
    parts = [a, b, t["lineitem"], t.run("except", {"left": "a", "right": "lineitem"}, a=a)]
    digests = [df.select(F.lit(k).alias("k"), F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h")) for k, df in enumerate(parts)]
    one = t.run("union", {"sources": [f"p{k}" for k in range(4)]}, **{f"p{k}": d for k, d in enumerate(digests)})
    one = one.agg(
        *[F.count_if(F.col("k") == k).alias(f"n{k}") for k in range(4)],
        *[F.sum(F.when(F.col("k") == k, F.col("h"))).alias(f"h{k}") for k in range(2)],
    )
    return one.selectExpr("abs(n0 - 0.1 * n2) <= 5 * sqrt(0.09 * n2) AS near", "n3 AS strangers", "n0 = n1 AND h0 <=> h1 AS repeatable")


# SQL and extensions

simple(
    "math_functions",
    "select",
    {
        "from": "lineitem",
        "columns": [
            "l_orderkey",
            "l_linenumber",
            "abs(l_discount - 0.05) AS a",
            "ceil(l_quantity / 7) AS c",
            "floor(l_quantity / 7) AS f",
            "round(sqrt(l_extendedprice), 6) AS s",
            "pmod(l_orderkey, 13) AS m",
            "CAST(sign(l_tax - 0.04) AS INT) AS g",
            "round(ln(l_quantity), 6) AS l",
            "round(power(l_tax + 1, 3), 6) AS p",
            "greatest(l_discount, l_tax) AS top",
            "least(l_discount, l_tax) AS low",
        ],
    },
    "SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) AS a, CAST(ceil(l_quantity / 7) AS BIGINT) AS c, "
    "CAST(floor(l_quantity / 7) AS BIGINT) AS f, round(sqrt(l_extendedprice), 6) AS s, l_orderkey % 13 AS m, "
    "CAST(sign(l_tax - 0.04) AS INT) AS g, round(ln(l_quantity), 6) AS l, round(power(l_tax + 1, 3), 6) AS p, "
    "greatest(l_discount, l_tax) AS top, least(l_discount, l_tax) AS low FROM lineitem",
)
simple(
    "approximate_aggregates",
    "group",
    {
        "from": "lineitem",
        "by": ["l_returnflag"],
        "agg": [
            "abs(approx_count_distinct(l_partkey) - count(distinct l_partkey)) <= 0.2 * count(distinct l_partkey) AS near",
            "abs(percentile_approx(l_quantity, 0.5, 10000) - percentile(l_quantity, 0.5)) <= 1 AS middle",
        ],
    },
    "SELECT DISTINCT l_returnflag, true AS near, true AS middle FROM lineitem",
)


@query("table_function", "SELECT n_nationkey, n_name, i, n_nationkey * i AS product FROM nation, (VALUES (1), (2), (3)) AS v(i)")
def table_function(t: Tables) -> DataFrame:
    class Multiples:
        def eval(self, n: int, most: int):
            for i in range(1, most + 1):
                yield i, n * i

    register_table_function(t.spark, "multiples", Multiples, "i int, product int")
    return t.run(
        "sql",
        {"views": ["nation"], "query": "SELECT n_nationkey, n_name, i, product FROM nation, LATERAL multiples(n_nationkey, 3)"},
    )


@query(
    "enrich",
    "SELECT n_nationkey, n_name, n_regionkey, CASE WHEN n_nationkey % 5 <> 0 THEN '<' || upper(n_name) || '>' END AS body "
    "FROM nation",
)
def enriched(t: Tables) -> DataFrame:
    """Bodies from a small server of this process, written while it runs; keys it doesn't know give null."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    known = {r.n_name for r in t["nation"].where("n_nationkey % 5 != 0").collect()}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            key = unquote(self.path.rsplit("/", 1)[1])
            self.send_response(200 if key in known else 404)
            self.end_headers()
            self.wfile.write(f"<{key.upper()}>".encode())

        def log_message(self, *args) -> None:
            pass

    host = t.spark.conf.get("spark.driver.host", "127.0.0.1")
    server = ThreadingHTTPServer((host, 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    path = scratch(t.spark)
    try:
        p = {
            "from": "nation",
            "url": f"http://{host}:{server.server_port}/n/${{keyColumn}}",
            "key_column": "n_name",
            "response_column": "body",
        }
        write_output(t.run("enrich", {**p, "on_error": "null", "max_retries": 1}), "parquet", path)
    finally:
        server.shutdown()
    return read_input(t.spark, "parquet", path)


def streamed(name: str, sql: str, mode: str = "append"):
    """A query over the table that a stream has written when it has read all there is."""

    def wrap(f: Callable[[DataFrame], DataFrame]):
        def run(t: Tables) -> DataFrame:
            path = scratch(t.spark)
            static = t["events"].select("event_id", "user_id", "event_type", "ts")
            write_output(static.withColumn("ts", F.col("ts").cast("timestamp")).repartition(3), "parquet", f"{path}/in")
            source = read_stream(t.spark, "parquet", "event_id long, user_id long, event_type string, ts timestamp", f"{path}/in")
            if mode == "append":
                write_stream(f(source), "parquet", f"{path}/log", f"{path}/out").awaitTermination()
                return read_input(t.spark, "parquet", f"{path}/out")
            table = f"stream_{uuid.uuid4().hex}"
            write_stream(f(source), "memory", f"{path}/log", mode=mode, options={"queryName": table}).awaitTermination()
            return t.spark.table(table)

        query(name, sql)(run)
        return f

    return wrap


@streamed("stream_stateless", "SELECT event_id, user_id, event_type = 'purchase' AS bought FROM events WHERE event_type <> 'click'")
def stream_stateless(df: DataFrame) -> DataFrame:
    return plan_stream(
        [
            ("where", {"from": "stream", "filter": "event_type != 'click'"}),
            ("addColumns", {"from": "stream", "columns": [{"name": "bought", "expression": "event_type = 'purchase'"}]}),
            ("select", {"from": "stream", "columns": ["event_id", "user_id", "bought"]}),
        ],
        df,
    )


@streamed(
    "stream_windowed",
    "SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY "
    "AS window_end, count(*) AS n FROM events GROUP BY ALL",
    "complete",
)
def stream_windowed(df: DataFrame) -> DataFrame:
    out = windowed(df, "ts", ["count(*) AS n"], "1 day", by=["event_type"], late="3650 days")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@streamed("stream_deduplicated", "SELECT DISTINCT user_id, event_type FROM events")
def stream_deduplicated(df: DataFrame) -> DataFrame:
    return deduplicated(df, ["user_id", "event_type"], "ts", "36500 days").select("user_id", "event_type")


simple(
    "sql_op",
    "sql",
    {
        "views": ["orders", "customer"],
        "query": 'SELECT "c_mktsegment", count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1',
    },
    "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
)


@query("custom_udf", "SELECT l_orderkey, l_linenumber, l_quantity * 2 + 1 AS y FROM lineitem WHERE l_discount > 0.05")
def custom_udf(t: Tables) -> DataFrame:
    register_function(t.spark, "twice_and_one", lambda s: s * 2 + 1, "double")
    register_component("discounted", lambda df, options: df.where(F.col("l_discount") > options["above"]))
    df = t.run("custom", {"from": "lineitem", "component": "discounted", "options": {"above": 0.05}})
    return t.run("select", {"from": "it", "columns": ["l_orderkey", "l_linenumber", "twice_and_one(l_quantity) AS y"]}, it=df)
