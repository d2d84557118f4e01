"""Shared helpers: stored intermediate tables, text cleaning, connected components."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakgrid.session import checkpoint_dir

#: Words of the text contracts: anything between space, tab, \n, \v, \f and \r.
BLANKS = " \t\n\x0b\x0c\r"
#: Setting by which the shuffle files of an execution are removed at its end; else they stay until the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/peakgrid-{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Cuts the lineage, so a lost executor costs a re-read only, and gives the
    planner the true size of the table. The shuffle files of the write go when it ends.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*stored: DataFrame) -> None:
    """Delete the files of tables that :func:`store` wrote and nothing reads any more."""
    for df in stored:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.sparkSession._jvm.java.net.URI(folder))
            if path.getName().startswith("peakgrid-"):
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """``mapInArrow`` with a per-task setup: ``make`` runs once in each task."""
    def run(batches):
        step = make()
        for batch in batches:
            yield from step(batch)
    return df.mapInArrow(run, schema)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of ``edges(a, b)``, as ``(node, root)``.

    Alternates large-star and small-star steps until the edges are stable, each
    round stored. Every step is one aggregate (combined before the shuffle) and
    one join on the node; no component is ever gathered. Both directions of an edge come from
    one read of it, so the plan of a round, which the driver holds, has four reads. Nulls and loops are
    ignored; an empty table gives an empty one.
    """
    def pair(a: str, b: str) -> Column:
        return F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    e = store(edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "edges")
    last = None
    for _ in range(rounds):
        both = e.select(F.explode(F.array(pair("a", "b"), pair("b", "a"))).alias("e")).select("e.a", "e.b")
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        root = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = F.when(F.col("b") == F.col("m"), F.array(pair("a", "m"))).otherwise(F.array(pair("a", "m"), pair("b", "m")))
        e = store(down.join(root, "a").select(F.explode(moved).alias("e")).select("e.a", "e.b").distinct(), "edges")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct().join(e.select(F.col("a").alias("node")), "node", "left_anti"))


def with_component(df: DataFrame, key: str, edges: DataFrame, name: str = "component_id") -> DataFrame:
    """Add the root of ``key`` (itself where it has no edge)."""
    roots = components(edges)
    return (df.join(roots.withColumnRenamed("node", key), key, "left")
            .withColumn(name, F.coalesce("root", key)).drop("root"))


def frequency_cut(counts: DataFrame, size: int, n: str = "n") -> int:
    """Smallest count that at most ``size`` rows reach; rows with equal counts stay or go together.

    From a histogram of the counts in steps of a 64th, at most a few thousand rows, so nothing
    that grows with the table or its partitions comes to the driver. Counts below 128 are exact; null counts are left out.
    """
    step = f"cast(greatest(length(bin({n})) - 7, 0) AS int)"
    bins = counts.filter(F.col(n) > 0).groupBy(F.expr(f"shiftleft(shiftright({n}, {step}), {step})").alias("edge")).agg(F.count("*").alias("rows")).collect()
    left, edge = size, max((b.edge for b in bins), default=0) * 2 + 1
    for b in sorted(bins, key=lambda b: -b.edge):
        if b.rows > left:
            break
        left, edge = left - b.rows, b.edge
    return edge


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))
