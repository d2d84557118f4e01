"""Binned signals from wig, bedGraph and Parquet."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import strip_chr, to_fixed
from ..operators.bins import rebin
from .lines import at, carry_block, ordered_lines, text_lines

Paths = str | list[str] | dict[str, str]


def format_of(path: str) -> str:
    """WIG, BEDGRAPH or BINS (Parquet) by suffix; a folder of part files is named by its parents."""
    low = path.lower().removesuffix(".gz")
    if low.endswith((".wig", ".wiggle")):
        return "WIG"
    return "BEDGRAPH" if low.endswith(".bedgraph") else "BINS"


def _plain(path: str) -> str:
    return re.sub(r"^[A-Za-z0-9]+:/*", "/", path).rstrip("/")


def _sample(paths: Paths, sample: str | None) -> tuple[list[str], Column]:
    """Files to read and the sample column: one name, or by file from {path: sample}.

    A path may be a folder of part files.
    """
    if not isinstance(paths, dict):
        return ([paths] if isinstance(paths, str) else list(paths)), F.lit(sample)
    names = F.create_map(*[F.lit(x) for p, s in paths.items() for x in (_plain(p), s)])
    file = F.regexp_replace("file", r"^[A-Za-z0-9]+:/*", "/")
    return list(paths), F.coalesce(F.try_element_at(names, file),
                                   F.try_element_at(names, F.regexp_replace(file, "/[^/]*$", "")))


def read_wig(spark: SparkSession, paths: Paths, sample: str | None, binsize: int, strip: bool = False) -> DataFrame:
    """variableStep wig, plain or gz: value at bin (pos-1)/b, the last line of a bin wins.

    Blocks may come in any order; the chromosome is the exact token of the header.
    """
    paths, name = _sample(paths, sample)
    lines = ordered_lines(spark, paths).filter((F.col("value") != "") & ~F.col("value").startswith("track"))
    header = F.col("value").contains("chrom=")
    rows = carry_block(lines, F.when(header, F.regexp_extract("value", r"chrom=(\S+)", 1)), "chrom")
    rows = rows.filter(~header & F.col("chrom").isNotNull()).withColumn("f", F.split("value", "[ \t]"))
    bins = rows.select(name.alias("sample"), "chrom", F.floor((at("f", 0, "int") - 1) / binsize).cast("int").alias("bin"),
                       to_fixed(at("f", 1, "double")).alias("v"), F.struct("file", "block", "line").alias("o"))
    chrom = strip_chr(F.col("chrom")) if strip else F.col("chrom")
    return (bins.groupBy("sample", chrom.alias("chrom"), "bin").agg(F.max_by("v", "o").alias("v"))
            .filter(F.col("v") != 0))


def read_bedgraph_rows(spark: SparkSession, paths: Paths, sample: str | None, strip: bool = False) -> DataFrame:
    """Value rows (sample, chrom, start, end, value); an empty value is 0."""
    paths, name = _sample(paths, sample)
    lines = text_lines(spark, paths).filter((F.col("value") != "") & ~F.col("value").rlike("^(track|browser|#)"))
    rows = lines.withColumn("f", F.split("value", "[ \t]"))
    value = F.when(F.size("f") >= 4, F.coalesce(at("f", 3, "double"), F.lit(0.0))).otherwise(
        F.raise_error(F.concat(F.lit("bedGraph row without four fields: "), F.col("value"))).cast("double"))
    chrom = strip_chr(F.col("f")[0]) if strip else F.col("f")[0]
    return rows.select(name.alias("sample"), chrom.alias("chrom"), at("f", 1, "int").alias("start"),
                       at("f", 2, "int").alias("end"), value.alias("value"))


def read_bedgraph(spark: SparkSession, paths: Paths, sample: str | None, binsize: int, strip: bool = False) -> DataFrame:
    """bedGraph on the bin grid; a bin hit more than once takes the unweighted mean."""
    return rebin(read_bedgraph_rows(spark, paths, sample, strip), binsize).filter(F.col("v") != 0)


def read_bins(spark: SparkSession, path: str) -> DataFrame:
    """Parquet bins, partitioned by sample and chromosome."""
    return spark.read.schema("bin int, v long, sample string, chrom string").parquet(path).select(
        "sample", "chrom", "bin", "v")
