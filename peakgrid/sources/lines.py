"""Text files as lines in file order, and state that runs along a file.

A file is read in splits. Order inside a split is kept by a line number; what
must be carried from split to split (the open block, a running length) goes
through a table with one row per split, so no task sees a whole file.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT = ["file", "block"]


def text_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, value) without order; for formats whose rows stand alone."""
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value")


def ordered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, block, line, value): ``block`` is the byte offset of the split, ``line`` rises inside it."""
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value")


def carry_block(lines: DataFrame, mark: Column, name: str) -> DataFrame:
    """Add ``name``: the last non-null ``mark`` at or before each line of its file."""
    w = Window.partitionBy(*SPLIT).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    inside = lines.withColumn("_mark", mark).withColumn("_in", F.last("_mark", ignorenulls=True).over(w))
    ends = inside.groupBy(*SPLIT).agg(F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col("line"))).alias("_end"))
    v = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*SPLIT, F.last("_end", ignorenulls=True).over(v).alias("_before"))
    return (inside.join(before, SPLIT).withColumn(name, F.coalesce("_in", "_before"))
            .drop("_mark", "_in", "_before"))


def running_offset(lines: DataFrame, size: Column, by: list[str], name: str) -> DataFrame:
    """Add ``name``: the sum of ``size`` over the earlier lines of the same ``by`` block."""
    keys = [*by, *SPLIT]
    lines = lines.withColumn("_size", size.cast("long"))
    w = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    inside = lines.withColumn("_in", F.coalesce(F.sum("_size").over(w), F.lit(0)))
    per = lines.groupBy(*keys).agg(F.sum("_size").alias("_total"))
    group = list(dict.fromkeys([*by, "file"]))
    v = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(*keys, F.coalesce(F.sum("_total").over(v), F.lit(0)).alias("_before"))
    return inside.join(before, list(dict.fromkeys(keys))).withColumn(name, F.col("_in") + F.col("_before")).drop("_size", "_in", "_before")


def fields(line: Column, sep: str = "\t") -> Column:
    return F.split(line, sep, -1)


def at(cols: str, i: int, kind: str = "string") -> Column:
    """Field ``i`` (from 0) of an array column, null when missing or not of the type."""
    c = F.try_element_at(F.col(cols), F.lit(i + 1))
    if kind == "string":
        return c
    return F.trim(F.when(F.trim(c) != "", c)).try_cast(kind)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
