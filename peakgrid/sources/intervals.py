"""Intervals: BED, BED12, MACS tables, interactions and barcoded reads."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import strip_chr
from .lines import at, base_name, fields, text_lines


def _bed_rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    v = F.col("value")
    rows = text_lines(spark, paths).filter((v != "") & ~v.startswith("#") & ~v.contains("chromosome")
                                           & ~v.contains("description")).withColumn("f", fields(v))
    rows = rows.withColumn("f", F.when(F.size("f") >= 3, F.col("f")).otherwise(
        F.raise_error(F.concat(F.lit("BED row without three fields: "), v)).cast("array<string>")))
    return rows.filter(F.col("f")[1] != "start")


def _span() -> list:
    s, e = at("f", 1, "int"), at("f", 2, "int")
    return [strip_chr(F.col("f")[0]).alias("chrom"), s.alias("start"), e.alias("end"),
            F.floor((s + e) / 2).cast("int").alias("summit")]


def read_bed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """First three columns and the name; also peak tables and narrowPeak."""
    return _bed_rows(spark, paths).select(*_span(), at("f", 3).alias("name"))


def read_bed12(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """BED with score, strand, thick range, colour and block fields as far as there are columns."""
    rgb = F.split(at("f", 8), ",")
    rows = _bed_rows(spark, paths).withColumn("_rgb", F.when(F.size(rgb) >= 3, rgb))

    def colour(i: int):
        return F.coalesce(F.try_element_at("_rgb", F.lit(i)).cast("int"), F.lit(-1))

    return rows.select(*_span(), at("f", 3).alias("name"), at("f", 4, "int").alias("score"), at("f", 5).alias("strand"),
                       at("f", 6, "int").alias("thick_start"), at("f", 7, "int").alias("thick_end"),
                       F.struct(colour(1).alias("r"), colour(2).alias("g"), colour(3).alias("b")).alias("rgb"),
                       at("f", 9, "int").alias("block_count"), at("f", 10).alias("block_sizes"),
                       at("f", 11).alias("block_starts"))


def read_macs_xls(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Peak table of MACS with the absolute summit."""
    rows = _bed_rows(spark, paths).filter(F.col("f")[0] != "chr")
    return rows.select(strip_chr(F.col("f")[0]).alias("chrom"), at("f", 1, "int").alias("start"),
                       at("f", 2, "int").alias("end"), at("f", 3, "int").alias("length"), at("f", 4, "int").alias("summit"),
                       at("f", 5, "double").alias("pileup"), at("f", 6, "double").alias("p"),
                       at("f", 7, "double").alias("enrichment"), at("f", 8, "double").alias("q"), at("f", 9).alias("name"))


NEED = {"mango": 8, "hiccups": 19, "bedpe": 6}  # fixed values: fewest columns per tool


def _interaction_lines(spark: SparkSession, paths: str | list[str], tool: str) -> DataFrame:
    v = F.col("value")
    rows = text_lines(spark, paths).filter((v != "") & ~v.startswith("#"))
    if tool != "bedpe":
        rows = rows.filter(~v.contains("color"))
    if tool == "mango":
        rows = rows.filter(~v.contains("chrom1"))
    return rows.withColumn("f", fields(v))


def read_interactions(spark: SparkSession, paths: str | list[str], tool: str = "mango", label: str | None = None) -> DataFrame:
    """Loops (set_label, first, second, val); rows with too few columns are left out.

    mango: p from column 16 if there, else 8, 0 taken as 1e-12; hiccups: the value
    of column 18; bedpe: 1.
    """
    rows = _interaction_lines(spark, paths, tool).filter(F.size("f") >= NEED[tool])
    if tool == "mango":
        p = F.coalesce(at("f", 15, "double"), at("f", 7, "double"))
        val = -F.log10(F.when(p == 0, F.lit(1e-12)).otherwise(p))
    elif tool == "hiccups":
        q = at("f", 17, "double")
        val = F.when(q == 0, F.lit(float("inf"))).otherwise(-F.log10(F.when(q == 0, F.lit(1.0)).otherwise(q)))
    else:
        val = F.lit(1.0)

    def anchor(i: int):
        return F.struct(strip_chr(F.col("f")[i]).alias("chrom"), at("f", i + 1, "int").alias("start"),
                        at("f", i + 2, "int").alias("end"))

    set_label = F.lit(label) if label is not None else base_name(F.col("file"))
    return rows.select(set_label.alias("set_label"), anchor(0).alias("first"), anchor(3).alias("second"), val.alias("val"))


def count_short_interactions(spark: SparkSession, paths: str | list[str], tool: str = "mango") -> int:
    """Rows that :func:`read_interactions` left out."""
    return _interaction_lines(spark, paths, tool).filter(F.size("f") < NEED[tool]).count()


def read_chiadrop(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(barcode, chrom, pos) from comma separated rows."""
    rows = text_lines(spark, paths).filter((F.col("value") != "") & ~F.col("value").startswith("#"))
    rows = rows.withColumn("f", fields(F.col("value"), ","))
    return rows.select(at("f", 0).alias("barcode"), strip_chr(F.col("f")[1]).alias("chrom"), at("f", 2, "int").alias("pos"))
