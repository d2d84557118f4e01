"""Session helpers: checkpoint folder and size-checked broadcasts."""
from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Only a single-process session without the setting gets a folder of its own,
    removed when the process ends.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="peakgrid-ckpt-")
        atexit.register(shutil.rmtree, shared, True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _is_marked(df: DataFrame) -> bool:
    """Whether a broadcast mark sits on the table, below projections and filters at most."""
    plan = df._jdf.queryExecution().analyzed()
    while True:
        if plan.nodeName() == "ResolvedHint":
            return True
        if plan.children().size() != 1:
            return False
        plan = plan.children().apply(0)


def lookup(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a lookup table for broadcast when it is counted and found small.

    Tables with more than ``limit`` rows come back unmarked, so the join is
    planned as a shuffle join with the adaptive skew handling. A table that was
    marked before is not counted again.
    """
    if _is_marked(df):
        return df
    if df.limit(limit + 1).count() <= limit:
        return F.broadcast(df)
    return df


def derived_lookup(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """As :func:`lookup` for a table that is itself the result of a heavy job;
    it is written once, so the size check does not run the job again."""
    return lookup(cut(df), limit)
