"""Genome, statistics and other small tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import strip_chr
from ..operators.reads import GENOME_ROW
from ..session import lookup
from .lines import at, base_name, carry_block, fields, ordered_lines, text_lines


def read_genome_table(spark: SparkSession, path: str, strip: bool = False) -> DataFrame:
    """(chrom, length, mappable null, ord) in file order; # lines and blank lines are skipped.

    A genome table is one small file; its order is that of its line numbers. It
    comes back counted and marked for broadcast when it is small enough.
    """
    rows = (ordered_lines(spark, path).filter((F.trim("value") != "") & ~F.col("value").startswith("#"))
            .withColumn("f", fields(F.col("value"))))
    name = strip_chr(at("f", 0)) if strip else at("f", 0)
    rank = F.row_number().over(Window.orderBy("block", "line")) - 1
    return lookup(rows.select(name.alias("chrom"), at("f", 1, "int").alias("length"),
                              F.lit(None).cast("long").alias("mappable"), rank.cast("int").alias("ord")))


def read_mappable_table(spark: SparkSession, path: str, strip: bool = False) -> DataFrame:
    """(chrom, mappable)."""
    rows = text_lines(spark, path).filter((F.trim("value") != "") & ~F.col("value").startswith("#"))
    rows = rows.withColumn("f", fields(F.col("value")))
    name = strip_chr(at("f", 0)) if strip else at("f", 0)
    return rows.select(name.alias("chrom"), at("f", 1, "long").alias("mappable"))


def with_mappable(genome: DataFrame, mappable: DataFrame) -> DataFrame:
    """Genome table with the mappable bases as effective size; the length where none are given."""
    return lookup(genome.drop("mappable").join(mappable, "chrom", "left").select(
        "chrom", "length", F.coalesce("mappable", F.col("length").cast("long")).alias("mappable"), "ord"))


def read_cytoband(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, name, stain)."""
    rows = text_lines(spark, path).filter((F.col("value") != "") & ~F.col("value").startswith("#"))
    rows = rows.withColumn("f", fields(F.col("value")))
    return rows.select(strip_chr(at("f", 0)).alias("chrom"), at("f", 1, "int").alias("start"),
                       at("f", 2, "int").alias("end"), at("f", 3).alias("name"), at("f", 4).alias("stain"))


def read_gene_list(spark: SparkSession, path: str, first_field: bool = False) -> DataFrame:
    """One name per line; for gene loci the first tab field."""
    rows = text_lines(spark, path).filter(F.col("value") != "")
    name = F.split("value", "\t")[0] if first_field else F.col("value")
    return rows.select(name.alias("name"))


def read_stats(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, chrom, total) from statistics files: the genome row, then the chromosomes.

    The column is the one whose heading holds "normalized read number"; the light
    form written for signals of other tools has it second.
    """
    lines = ordered_lines(spark, paths).filter(F.trim("value") != "").withColumn("f", fields(F.col("value")))
    heading = F.array_position(F.transform("f", lambda x: x.contains("normalized read number")), True)
    mark = F.when(F.col("value").contains("normalized read number"), heading.cast("int")).when(
        F.col("value").contains("total reads"), F.lit(2))
    rows = carry_block(lines, mark, "col")
    rows = carry_block(rows, F.when(F.split("value", "\t")[0] == GENOME_ROW, F.lit(1)), "seen")
    total = F.try_element_at("f", F.col("col"))
    return (rows.filter(F.col("seen").isNotNull() & F.col("col").isNotNull() & ~F.col("value").contains("% genome"))
            .select("file", strip_chr(F.col("f")[0]).alias("chrom"), F.floor(total.try_cast("double")).cast("long").alias("total"))
            .filter(F.col("total").isNotNull()))


def read_bin_mappability(spark: SparkSession, path: str, binsize: int) -> DataFrame:
    """(chrom, bin, fraction) from files map_<chrom>.<binsize>.wig[.gz] with start and value."""
    rows = text_lines(spark, path).filter(F.col("value") != "").withColumn("f", fields(F.col("value")))
    chrom = F.regexp_extract(base_name(F.col("file")), r"^map_(.+?)\.\d+\.wig", 1)
    return rows.select(chrom.alias("chrom"), F.floor(at("f", 0, "int") / binsize).cast("int").alias("bin"),
                       at("f", 1, "double").alias("fraction"))


def read_window_track(spark: SparkSession, path: str, window: int, strip: bool = False) -> DataFrame:
    """(chrom, start, value) from files <chrom>-bs<window>; starts must be multiples of the window."""
    rows = text_lines(spark, path).filter(F.trim("value") != "")
    rows = rows.withColumn("f", F.split(F.trim("value"), r"[ \t]+"))
    chrom = F.regexp_extract(base_name(F.col("file")), r"^(.+)-bs\d+", 1)
    start = at("f", 0, "int")
    start = F.when(start % window == 0, start).otherwise(F.raise_error(F.lit("start is not a multiple of the window")).cast("int"))
    return rows.select((strip_chr(chrom) if strip else chrom).alias("chrom"), start.alias("start"), at("f", 1, "double").alias("value"))
