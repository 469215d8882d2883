"""Operators on small frames: nulls, empty tables, ties, wrong parameters."""

from __future__ import annotations

import random
from datetime import date, datetime
from decimal import Decimal
from http.server import BaseHTTPRequestHandler, HTTPServer
from threading import Thread

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.errors import PipelineError
from tributary.functions import register_table_function, spark_type
from tributary.functions.expressions import normalised, without_alias
from tributary.operators import OPERATORS, Context, plan, register_component


def run(spark, kind, parameters, **inputs):
    return plan(kind, parameters, inputs, Context(spark, datetime(2024, 1, 1)))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def gaps(spark):
    return spark.createDataFrame(
        [(1, 1, "x", 1.5), (2, None, None, None), (None, None, None, None), (4, 4, None, 2.0)],
        "k int, a int, b string, c double",
    )


def test_there_are_45_operators():
    assert len(OPERATORS) == 45


def test_types():
    assert spark_type("decimal(10, 2)") == T.DecimalType(10, 2)
    assert spark_type("array<struct<a: int, b: map<string, long>>>") == T.ArrayType(
        T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.MapType(T.StringType(), T.LongType()))])
    )
    assert spark_type("VARCHAR(5)") == T.StringType() and spark_type("time(3)") == T.TimeType(3)
    with pytest.raises(PipelineError, match="V-004"):
        spark_type("intt")


def test_expression_text():
    assert normalised("""concat("a b", 'it"s', `x"y`)""") == """concat(`a b`, 'it"s', `x"y`)"""
    assert without_alias("sum(x) AS total") == ("sum(x)", "total") and without_alias("cast(x as int)") == ("cast(x as int)", None)


def test_cast_fails_or_gives_null(spark):
    df = spark.createDataFrame([("1",), ("x",)], "a string")
    columns = [{"name": "a", "target_type": "int"}]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        run(spark, "castColumns", {"from": "t", "columns": columns}, t=df).collect()
    assert rows(run(spark, "castColumns", {"from": "t", "columns": columns, "on_error": "null"}, t=df)) == [(1,), (None,)]
    out = run(spark, "schemaEnforce", {"from": "t", "columns": [{"name": "a", "data_type": "decimal(5,1)"}]}, t=df.where("a = '1'"))
    assert rows(out) == [(Decimal("1.0"),)]


def test_fill_na(spark, gaps):
    assert rows(run(spark, "fillNa", {"from": "t", "value": 0}, t=gaps)) == rows(gaps.na.fill(0).na.fill("0"))
    out = run(spark, "fillNa", {"from": "t", "columns": ["a"], "value": 9, "values": {"a": 7}}, t=gaps)
    assert [r.a for r in out.orderBy("k").collect()] == [7, 1, 7, 4]
    with pytest.raises(PipelineError, match="V-004"):
        run(spark, "fillNa", {"from": "t", "columns": ["a"], "value": "many"}, t=gaps)
    assert rows(run(spark, "fillNa", {"from": "t", "value": "many"}, t=gaps))[0][1] == 1


@pytest.mark.parametrize(
    "how,n",
    [
        ({"how": "any"}, 1),
        ({"how": "all"}, 3),
        ({"min_non_nulls": 3}, 2),
        ({"how": "any", "columns": ["k"]}, 3),
        ({"how": "any", "min_non_nulls": 0}, 4),
    ],
)
def test_drop_na(spark, gaps, how, n):
    assert run(spark, "dropNa", {"from": "t", **how}, t=gaps).count() == n


def test_replace_compares_text(spark, gaps):
    out = run(spark, "replace", {"from": "t", "mappings": [{"old": 1, "new": 5}, {"old": "1", "new": 6}, {"old": "x", "new": "y"}]}, t=gaps)
    assert (5, 5, "y", 1.5) in rows(out)


def test_rename_swaps_and_missing_names(spark, gaps):
    assert run(spark, "renameColumns", {"from": "t", "mappings": {"a": "k", "k": "a"}}, t=gaps).columns == ["a", "k", "b", "c"]
    for kind, p in (("dropColumns", {"columns": ["nope"]}), ("renameColumns", {"mappings": {"nope": "x"}})):
        with pytest.raises(PipelineError, match="V-004"):
            run(spark, kind, {"from": "t", **p}, t=gaps)


def test_parameters_are_checked(spark, gaps):
    with pytest.raises(PipelineError, match="V-003"):
        run(spark, "nope", {"from": "t"}, t=gaps)
    with pytest.raises(PipelineError, match="V-004"):
        run(spark, "where", {"from": "t"}, t=gaps)
    with pytest.raises(PipelineError, match="unknown parameter"):
        run(spark, "where", {"from": "t", "filter": "true", "extra": 1}, t=gaps)


def test_joins_resolve_asset_names(spark):
    a, b = spark.createDataFrame([(1, "x"), (None, "y")], "id int, v string"), spark.createDataFrame(
        [(1, "p"), (1, "q"), (None, "r")],
        "id int, w string",
    )
    p = lambda kind: {"left": "a", "right": [{"name": "b", "type": kind, "on": ["a.id = b.id"]}]}
    counts = {k: run(spark, "join", p(k), a=a, b=b).count() for k in ("inner", "left", "right", "outer", "left_semi", "left_anti")}
    assert counts == {"inner": 2, "left": 3, "right": 3, "outer": 4, "left_semi": 1, "left_anti": 1}
    with pytest.raises(PipelineError, match="no condition"):
        run(spark, "join", {"left": "a", "right": [{"name": "b"}]}, a=a, b=b)
    with pytest.raises(PipelineError, match="unknown type"):
        run(spark, "join", p("sideways"), a=a, b=b)


LEFT = [(1, 10, "a"), (1, 10, "b"), (1, 3, "c"), (2, 5, "d"), (3, 5, "e"), (None, 5, "f"), (1, None, "g")]
RIGHT = [(1, 5, "r5"), (1, 10, "r10"), (1, 10, "r10x"), (1, 12, "r12"), (2, 9, "s9"), (4, 1, "z"), (None, 5, "n"), (1, None, "m")]


@pytest.mark.parametrize(
    "direction,expected",
    [
        ("backward", ["r10x", "r10x", None, None, None, None, None]),
        ("forward", ["r10x", "r10x", "r5", "s9", None, None, None]),
        ("nearest", ["r10x", "r10x", "r5", "s9", None, None, None]),
    ],
)
@pytest.mark.parametrize("on", ["l.k = r.rk", "l.k <= r.rk AND l.k >= r.rk"])
def test_as_of(spark, direction, expected, on):
    l, r = spark.createDataFrame(LEFT, "k int, at int, id string"), spark.createDataFrame(RIGHT, "rk int, rat int, v string")
    p = {"left": "l", "right": "r", "left_as_of": "at", "right_as_of": "rat", "on": [on], "direction": direction}
    out = run(spark, "asOfJoin", p, l=l, r=r)
    assert out.columns == ["k", "at", "id", "rk", "rat", "v"]
    assert [x.v for x in out.orderBy("id").collect()] == expected
    assert run(spark, "asOfJoin", {**p, "how": "inner"}, l=l, r=r).count() == sum(e is not None for e in expected)
    near = run(spark, "asOfJoin", {**p, "tolerance": 1}, l=l, r=r)
    assert [x.v for x in near.orderBy("id").collect()] == ["r10x", "r10x", None, None, None, None, None]


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("n,values", [(400, 3000), (60, 10), (0, 5), (40, 1)])
def test_as_of_without_keys(spark, direction, n, values):
    """Every left row against all right rows: stretches of any size, ties, edges, nulls, an empty right side."""
    r = random.Random(n)
    left = [(k, r.choice([None, *[r.randrange(values) for _ in range(9)]])) for k in range(150)]
    right = [(r.choice([None, *[r.randrange(values) for _ in range(9)]]), f"v{k:03}") for k in range(n)]
    a, b = spark.createDataFrame(left, "id int, at int"), spark.createDataFrame(right, "rat int, v string")
    out = run(
        spark,
        "asOfJoin",
        {"left": "l", "right": "r", "left_as_of": "at", "right_as_of": "rat", "direction": direction, "tie_break": "v"},
        l=a,
        r=b,
    )

    def best(at):
        some = [(x, v) for x, v in right if at is not None and x is not None and (direction == "nearest" or (x <= at if direction == "backward" else x >= at))]
        return max(some, key=lambda x: (-abs(x[0] - at), -x[0], x[1]), default=(None, None))

    assert sorted(map(tuple, out.collect())) == sorted(((k, at, *best(at)) for k, at in left), key=lambda x: x[0])
    plan_text = out._jdf.queryExecution().executedPlan().toString()
    assert all("__part" in line for line in plan_text.splitlines() if "Window [" in line)


def test_as_of_null_keys_are_spread(spark):
    l, r = spark.createDataFrame(
        [(None, k) for k in range(50)] + [(1, 5)],
        "k int, at int",
    ), spark.createDataFrame([(1, 3), (None, 4)], "rk int, rat int")
    out = run(spark, "asOfJoin", {"left": "l", "right": "r", "left_as_of": "at", "right_as_of": "rat", "on": ["l.k = r.rk"]}, l=l, r=r)
    assert out.where("rat IS NOT NULL").collect() == [(1, 5, 1, 3)] and out.count() == 51


def test_lateral_without_condition(spark):
    l, r = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(5, "b"), (5, "a"), (4, "c")], "v int, w string")
    p = {"left": "l", "right": "r", "join_type": "left"}
    assert rows(run(spark, "lateralJoin", p, l=l, r=r.limit(0))) == [(1, None, None), (2, None, None)]
    assert run(spark, "lateralJoin", p, l=l, r=r).count() == 6 == run(spark, "lateralJoin", {**p, "join_type": "cross"}, l=l, r=r).count()
    with pytest.raises(PipelineError, match="without a condition"):
        run(spark, "lateralJoin", {**p, "join_type": "inner"}, l=l, r=r)
    top = {**p, "order_by": [{"column": "v", "direction": "desc"}], "limit": 1}
    assert rows(run(spark, "lateralJoin", top, l=l, r=r)) == [(1, 5, "a"), (2, 5, "a")]
    assert rows(run(spark, "lateralJoin", top, l=l, r=r.limit(0))) == [(1, None, None), (2, None, None)]


def test_lateral_ties_go_by_the_right_columns(spark):
    l, r = spark.createDataFrame([(1,)], "id int"), spark.createDataFrame(
        [(1, 5, c) for c in "dbca"],
        "lid int, v int, w string",
    ).repartition(4)
    for on in (["l.id = r.lid"], ["l.id <= r.lid"]):
        p = {"left": "l", "right": "r", "on": on, "order_by": ["v"], "limit": 2}
        assert rows(run(spark, "lateralJoin", p, l=l, r=r)) == [(1, 1, 5, "a"), (1, 1, 5, "b")]


def test_lateral_limit(spark):
    l, r = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, 5), (1, 7), (1, 6)], "lid int, v int")
    p = {
        "left": "l",
        "right": "r",
        "join_type": "left",
        "on": ["l.id = r.lid"],
        "order_by": [{"column": "v", "direction": "desc"}],
        "limit": 2,
    }
    for on in (["l.id = r.lid"], ["l.id <= r.lid", "l.id >= r.lid"]):
        assert rows(run(spark, "lateralJoin", {**p, "on": on}, l=l, r=r)) == [(1, 1, 6), (1, 1, 7), (2, None, None)]


def test_pivot_refuses_too_many_values(spark):
    df = spark.range(30).selectExpr("id % 3 AS g", "id AS p")
    p = {"from": "t", "group_by": ["g"], "pivot_column": "p", "agg": ["count(*) AS n"]}
    with pytest.raises(PipelineError, match="more than 29 values"):
        run(spark, "pivot", {**p, "max_values": 29}, t=df)
    assert len(run(spark, "pivot", {**p, "max_values": 30}, t=df).columns) == 31
    with pytest.raises(PipelineError, match="more than 5 values"):
        run(spark, "crosstab", {"from": "t", "col1": "g", "col2": "p", "max_values": 5}, t=df)


def test_pivot_counts_none_as_zero_and_skips_null(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "it's", 2), ("b", "x", 3), ("b", None, 4)], "g string, p string, v int")
    out = run(spark, "pivot", {"from": "t", "group_by": ["g"], "pivot_column": "p", "agg": ["count(*) AS n"]}, t=df)
    assert out.columns == ["g", "it's", "x"] and rows(out) == [("a", 1, 1), ("b", 0, 1)]
    out = run(
        spark,
        "pivot",
        {"from": "t", "group_by": ["g"], "pivot_column": "p", "values": ["x", "q"], "agg": ["sum(v) AS s", "count(*) AS n"]},
        t=df,
    )
    assert out.columns == ["g", "x_s", "x_n", "q_s", "q_n"] and rows(out) == [("a", 1, 1, None, 0), ("b", 3, 1, None, 0)]


def test_flatten(spark):
    df = spark.sql(
        "SELECT 1 AS id, struct(2 AS a, struct(3 AS c) AS b) AS s, array(struct(1 AS x), struct(2 AS x)) AS r UNION ALL "
        "SELECT 2, struct(2, struct(3)), CAST(array() AS ARRAY<STRUCT<x: INT>>)"
    )
    out = run(spark, "flatten", {"from": "t", "separator": "."}, t=df.drop("r"))
    assert out.columns == ["id", "s.a", "s.b.c"]
    assert rows(run(spark, "flatten", {"from": "t", "explode_arrays": True}, t=df)) == [(1, 2, 3, 1), (1, 2, 3, 2)]
    assert run(spark, "flatten", {"from": "t", "explode_arrays": True, "keep_empty": True}, t=df).count() == 3


def test_window_traps(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 4)], "id int, v int")
    p = {
        "from": "t",
        "order_by": ["v"],
        "frame": {"frame_type": "range", "start": "UNBOUNDED PRECEDING", "end": "CURRENT ROW"},
        "functions": [{"expression": "row_number()", "alias": "n"}, {"expression": "sum(id)", "alias": "s"}],
    }
    assert rows(run(spark, "window", p, t=df)) == [(1, 5, 2, 4), (2, None, 3, 6), (3, 4, 1, 3)]
    with pytest.raises(PipelineError, match="V-004"):
        run(spark, "window", {**p, "frame": {"start": "now; drop"}}, t=df)


def test_scd2(spark):
    d = lambda y: date(y, 1, 1)
    cur = spark.createDataFrame(
        [
            (1, "a", d(2020), None, True),
            (2, "b", d(2020), None, True),
            (3, None, d(2020), None, True),
            (4, "d", d(2020), None, True),
            (2, "old", d(2019), d(2020), False),
        ],
        "k int, v string, start_date date, end_date date, is_current boolean",
    )
    inc = spark.createDataFrame([(1, "a"), (2, "B"), (3, "c"), (5, "e")], "k int, v string")
    got = rows(run(spark, "scd2", {"current": "c", "incoming": "i", "key_columns": ["k"], "track_columns": ["v"]}, c=cur, i=inc))
    n = d(2024)
    want = [
        (1, "a", d(2020), None, True),
        (2, "B", n, None, True),
        (2, "b", d(2020), n, False),
        (2, "old", d(2019), d(2020), False),
        (3, None, d(2020), n, False),
        (3, "c", n, None, True),
        (4, "d", d(2020), None, True),
        (5, "e", n, None, True),
    ]
    assert got == sorted(want, key=repr)


def test_scd2_keys(spark):
    """A key that comes twice is an error; a null key is a key, and isn't added again."""
    d = lambda y: date(y, 1, 1)
    kind = "k int, v string, start_date date, end_date date, is_current boolean"
    cur = spark.createDataFrame([(1, "a", d(2020), None, True), (None, "n", d(2020), None, True)], kind)
    go = lambda inc, c=cur: run(
        spark,
        "scd2",
        {"current": "c", "incoming": "i", "key_columns": ["k"], "track_columns": ["v"]},
        c=c,
        i=spark.createDataFrame(inc, "k int, v string"),
    )
    assert rows(go([(None, "n"), (1, "a")])) == rows(cur)
    twice = go([(None, "m")])
    assert rows(go([(None, "m")], twice)) == rows(twice) and twice.where("is_current").count() == 2
    for inc in ([(1, "b"), (1, "c")], [(1, "a"), (1, "a")], [(None, "x"), (None, "x")], [(7, "x"), (7, "x")]):
        with pytest.raises(Exception, match="several incoming rows"):
            go(inc).collect()


def test_merge_spreads_inserts(spark):
    """Rows of the source alone aren't one window partition."""
    t, s = spark.range(900).selectExpr("id", "id AS v"), spark.range(100, 50_900).selectExpr("id", "-id AS v")
    p = {
        "target": "t",
        "source": "s",
        "on": ["t.id = s.id"],
        "when_matched": [{"action": "update", "star": True}],
        "when_not_matched": [{"action": "insert", "star": True}],
    }
    df = run(spark, "merge", p, t=t, s=s)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 50_900 and max(sizes) < 0.6 * sum(sizes) and df.where("v < 0").count() == 50_800


def test_merge(spark):
    t, s = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id int, v int"), spark.createDataFrame(
        [(2, 20), (3, None), (9, 90)],
        "id int, v int",
    )
    p = {
        "target": "t",
        "source": "s",
        "on": ["t.id = s.id"],
        "when_matched": [{"action": "delete", "condition": "s.v IS NULL"}, {"action": "update", "set": {"v": "t.v + s.v"}}],
        "when_not_matched": [{"action": "insert", "star": True}],
    }
    assert rows(run(spark, "merge", p, t=t, s=s)) == [(1, 1), (2, 22), (9, 90)]
    with pytest.raises(Exception, match="several source rows"):
        run(spark, "merge", p, t=t, s=s.union(s)).collect()
    assert rows(run(spark, "merge", {**p, "when_not_matched": []}, t=t, s=s)) == [(1, 1), (2, 22)]


def test_assertions(spark):
    df = spark.createDataFrame([(1, 5), (1, None), (2, -1)], "id int, v int")
    checks = [{"rule": "v > 0", "description": "positive"}, {"column": "id", "rule": "unique"}]
    with pytest.raises(PipelineError, match="E-QUALITY-001: positive: 1 rows; id unique: 1 rows"):
        run(spark, "assertion", {"from": "t", "checks": checks}, t=df)
    said = []
    out = plan("assertion", {"from": "t", "checks": checks, "on_failure": "warn"}, {"t": df}, Context(spark, None, said.append))
    assert out.count() == 3 and len(said) == 2
    assert rows(run(spark, "assertion", {"from": "t", "checks": checks, "on_failure": "drop"}, t=df)) == [(1, None)]
    assert run(spark, "assertion", {"from": "t", "checks": checks}, t=df.limit(0)).count() == 0


def test_sql_and_custom(spark, gaps):
    spark.range(3).createOrReplaceTempView("t")
    out = run(spark, "sql", {"views": ["t"], "query": 'SELECT max("k") AS m FROM t'}, t=gaps)
    assert rows(out) == [(4,)] and spark.table("t").count() == 3
    spark.catalog.dropTempView("t")
    with pytest.raises(PipelineError, match="E-COMP-001"):
        run(spark, "custom", {"from": "t", "component": "nope"}, t=gaps)
    register_component("head", lambda df, options: df.limit(options["n"]))
    assert run(spark, "custom", {"from": "t", "component": "head", "options": {"n": 2}}, t=gaps).count() == 2


def test_table_function(spark):
    class Twice:
        def eval(self, x: int):
            yield (x,)
            yield (x * 2,)

    register_table_function(spark, "twice", Twice, "y int")
    assert rows(spark.sql("SELECT * FROM twice(4)")) == [(4,), (8,)]


@pytest.fixture(scope="module")
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.path)
            key = self.path.rsplit("/", 1)[1]
            code = 404 if key == "b" else 500 if key == "c" and seen.count(self.path) < 2 else 200
            self.send_response(code)
            self.end_headers()
            self.wfile.write(f"<{key}>".encode())

        def log_message(self, *a):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/x/", seen
    s.shutdown()


def test_enrich(spark, server):
    url, seen = server
    df = spark.createDataFrame([("a",), ("a",), ("c",), (None,), ("b",)], "k string")
    p = {
        "from": "t",
        "url": url + "${keyColumn}",
        "key_column": "k",
        "response_column": "r",
        "max_retries": 2,
        "on_error": "null",
        "parallel": 1,
    }
    assert rows(run(spark, "enrich", p, t=df)) == sorted([("a", "<a>"), ("a", "<a>"), ("c", "<c>"), (None, None), ("b", None)], key=repr)
    assert seen.count("/x/a") == 1 and seen.count("/x/b") == 1 and seen.count("/x/c") == 2
    assert run(spark, "enrich", {**p, "on_error": "skip"}, t=df).count() == 4
    with pytest.raises(Exception, match="E-ENRICH-001"):
        run(spark, "enrich", {**p, "on_error": "fail"}, t=df).collect()


def test_small_things(spark, gaps):
    assert run(spark, "sample", {"from": "t", "fraction": 1.0}, t=gaps).count() == 4
    assert run(spark, "repartition", {"from": "t", "num_partitions": 3, "columns": ["k"]}, t=gaps).rdd.getNumPartitions() == 3
    assert run(spark, "tail", {"from": "t", "count": 9}, t=gaps).count() == 4
    assert run(spark, "parse", {"from": "t", "column": "b", "format": "json"}, t=gaps) is gaps
    out = run(spark, "describe", {"from": "t", "columns": ["a", "b"]}, t=gaps)
    assert {r.statistic: (r.a, r.b) for r in out.collect()}["mean"] == ("2.5", None)
    assert rows(run(spark, "crosstab", {"from": "t", "col1": "k", "col2": "b"}, t=gaps)) == [(1, 1), (2, 0), (4, 0), (None, 0)]
    assert run(spark, "transpose", {"from": "t", "index_columns": ["k"]}, t=gaps).columns == ["k", "column_name", "value"]
