"""Reliable checkpoints in the folder that the machines share, and row numbers that survive a lost executor."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Logical nodes that give the rows of their input in its order, partition by partition, whenever they are run.
STEADY = {
    "Project",
    "Filter",
    "Sample",
    "Generate",
    "Expand",
    "Union",
    "SubqueryAlias",
    "LocalRelation",
    "LogicalRelation",
    "Range",
    "OneRowRelation",
    "DataSourceV2ScanRelation",
}
#: Bits of a row's place within its partition in a number of ``monotonically_increasing_id``.
PLACE_BITS = 33


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as the cluster names it. Only a session of one machine may do without: it gets a
    temporary one; on a cluster a folder of one machine's would break the run, so that it is an error not to name one."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return sc._jsc.sc().getCheckpointDir().get()
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all machines share")
    sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """df read back from a reliable checkpoint: its lineage ends there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def steady(df: DataFrame) -> bool:
    """Whether a task of df that is run again gives its rows in the same order, as scans do and shuffles don't."""

    def holds(node) -> bool:
        if node.nodeName() == "LogicalRDD":
            return node.rdd().outputDeterministicLevel().toString() == "DETERMINATE"
        return node.nodeName() in STEADY and all(holds(node.children().apply(k)) for k in range(node.children().size()))

    return holds(df._jdf.queryExecution().optimizedPlan())


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number of its own for each row, the same whenever a task is run again.

    Rows behind a shuffle come in another order when a lost task is run again; numbers given to them then would name other
    rows in one half of a job than in the other. Such rows are checkpointed first; scans of files needn't be.
    """
    return (df if steady(df) else cut(df)).withColumn(name, F.monotonically_increasing_id())


def from_place(df: DataFrame, first: int) -> DataFrame:
    """The rows of df from the ``first`` on, from zero, in their order; a negative number counts from the end.

    The rows stay in their partitions: the checkpointed partitions' sizes tell where the place lies, and one comparison of
    row numbers leaves out what is before it.
    """
    name = "__place"
    while name in df.columns:
        name += "_"
    rows = cut(df).withColumn(name, F.monotonically_increasing_id())
    part = F.shiftright(name, PLACE_BITS)
    sizes = sorted((p, n) for p, n in rows.groupBy(part.alias("p")).count().collect())
    left = first if first >= 0 else max(0, sum(n for _, n in sizes) + first)
    for p, n in sizes:
        if left < n:
            return rows.where(F.col(name) >= (p << PLACE_BITS) + left).drop(name)
        left -= n
    return rows.where(F.lit(False)).drop(name)
