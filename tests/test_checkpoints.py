"""Rows by their place, and row numbers that a task run again gives alike."""

from __future__ import annotations

import pytest

from tributary.checkpoints import from_place, numbered, steady
from tributary.errors import PipelineError
from tributary.operators import Context, plan


def sorted_range(spark, n=100):
    return spark.range(n).repartition(7).orderBy("id")


@pytest.mark.parametrize("first", [0, 1, 13, 50, 99, 100, 1000, -1, -7, -100, -1000])
def test_rows_from_a_place(spark, first):
    got = [r.id for r in from_place(sorted_range(spark), first).collect()]
    assert got == list(range(100))[first if first >= -100 else 0 :]


def test_place_of_awkward_frames(spark):
    assert from_place(spark.range(0), 3).columns == ["id"]
    assert from_place(spark.range(0), -3).count() == 0
    clash = spark.range(5).selectExpr("id AS __place", "id AS __place_")
    assert [tuple(r) for r in from_place(clash.orderBy("__place"), 3).collect()] == [(3, 3), (4, 4)]


def test_offset_and_tail_keep_their_partitions(spark):
    run = lambda kind, **p: plan(kind, {"from": "t", **p}, {"t": sorted_range(spark, 1000)}, Context(spark))
    for df in (run("offset", count=10), run("tail", count=900)):
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in run("tail", count=3).collect()] == [997, 998, 999]
    assert run("tail", count=0).count() == 0
    assert run("offset", count=0).count() == 1000
    top = plan("offset", {"from": "t", "count": 2}, {"t": sorted_range(spark).limit(5)}, Context(spark))
    assert [r.id for r in top.collect()] == [2, 3, 4]
    for kind in ("offset", "tail"):
        with pytest.raises(PipelineError, match="V-004"):
            run(kind, count=-1)


def test_only_unsteady_rows_are_checkpointed(spark, sf_dir):
    scan = spark.read.parquet(f"{sf_dir}/orders.parquet")
    assert steady(scan.where("o_totalprice > 5").select("o_orderkey"))
    assert steady(spark.createDataFrame([(1,)], "a int"))
    shuffled = scan.repartition(5, "o_custkey")
    assert not steady(shuffled) and not steady(scan.groupBy("o_custkey").count()) and not steady(scan.orderBy("o_orderkey"))
    assert not steady(spark.createDataFrame(shuffled.rdd, scan.schema))
    df = numbered(shuffled, "n")
    assert steady(df) and df.select("n").distinct().count() == scan.count()
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_merge_and_as_of_over_shuffled_rows(spark):
    t = spark.range(20).selectExpr("id AS k", "id AS v").repartition(5, "v")
    s = spark.range(10, 40).selectExpr("id AS k", "-id AS v").repartition(3, "v")
    p = {
        "target": "t",
        "source": "s",
        "on": ["t.k = s.k"],
        "when_matched": [{"action": "update", "star": True}],
        "when_not_matched": [{"action": "insert", "star": True}],
    }
    got = sorted(tuple(r) for r in plan("merge", p, {"t": t, "s": s}, Context(spark)).collect())
    assert got == [(k, k if k < 10 else -k) for k in range(40)]
    left = spark.createDataFrame([(1, 5), (None, 5), (None, 5), (1, None), (2, 9)], "k int, at int").repartition(3, "at")
    right = spark.createDataFrame([(1, 4, "a"), (None, 4, "n"), (2, 10, "b")], "k2 int, at2 int, x string").repartition(2, "x")
    p = {"left": "l", "right": "r", "left_as_of": "at", "right_as_of": "at2", "on": ["l.k = r.k2"]}
    got = sorted(((r.k, r.at, r.x) for r in plan("asOfJoin", p, {"l": left, "r": right}, Context(spark)).collect()), key=repr)
    assert got == sorted([(1, 5, "a"), (None, 5, None), (None, 5, None), (1, None, None), (2, 9, None)], key=repr)
    assert plan("asOfJoin", {**p, "how": "inner"}, {"l": left, "r": right}, Context(spark)).count() == 1
