"""Sequences and base mappability, cut into chunks or segments."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tiles import div
from ..operators.gc import CHUNK
from ..operators.intervals import merge_intervals
from .lines import base_name, carry_block, ordered_lines, running_offset


def read_fasta(spark: SparkSession, paths: str | list[str], size: int = CHUNK, all_records: bool = False) -> DataFrame:
    """Sequence chunks (chrom, chunk, seq).

    One file per chromosome, named after it, first record only; with
    ``all_records`` every record, named by the first word of its header.
    """
    lines = ordered_lines(spark, paths).filter(F.col("value") != "")
    header = F.col("value").startswith(">")
    rows = carry_block(lines, F.when(header, F.struct(F.col("block").alias("b"), F.col("line").alias("l"),
                                                      F.regexp_extract("value", r"^>(\S+)", 1).alias("name"))), "rec")
    rows = rows.filter(F.col("rec").isNotNull())
    if not all_records:
        first = (rows.filter(header).groupBy("file").agg(F.min(F.struct("rec.b", "rec.l")).alias("first")))
        rows = rows.join(first, "file").filter(F.struct("rec.b", "rec.l") == F.col("first")).drop("first")
    rows = rows.filter(~header).withColumn("seq", F.regexp_replace("value", "[^A-Za-z]", ""))
    rows = running_offset(rows, F.length("seq"), ["file", "rec"], "offset").filter(F.length("seq") > 0)
    name = F.col("rec.name") if all_records else F.regexp_replace(base_name(F.col("file")), r"\.(fa|fasta)(\.gz)?$", "")
    rows = rows.select(name.alias("chrom"), "offset", "seq")
    last = F.col("offset") + F.length("seq") - 1
    cut = rows.withColumn("chunk", F.explode(F.sequence(div("offset", size), div(last, size))))
    begin = F.greatest(F.col("chunk") * size - F.col("offset"), F.lit(0)).cast("int")
    end = F.least((F.col("chunk") + 1) * size - F.col("offset"), F.length("seq")).cast("int")
    cut = cut.select("chrom", "chunk", (F.col("offset") + begin).alias("o"), F.substring("seq", begin + 1, end - begin).alias("s"))
    # at most ``size`` letters meet in one group
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "s"))), lambda x: x["s"]), "")
    return cut.groupBy("chrom", "chunk").agg(joined.alias("seq"))


def read_bp_mappability(spark: SparkSession, paths: str | list[str], size: int = CHUNK) -> DataFrame:
    """Mappable segments (chrom, start, end) from files map_<chrom>_binary.txt[.gz] of 0 and 1 per base."""
    lines = ordered_lines(spark, paths).withColumn("bits", F.regexp_replace("value", "[^01]", ""))
    chrom = F.regexp_extract(base_name(F.col("file")), r"^map_(.+)_binary\.txt", 1)
    lines = running_offset(lines.withColumn("chrom", chrom), F.length("bits"), ["file"], "offset")
    parts = lines.select("chrom", "offset", F.posexplode(
        F.regexp_extract_all("bits", F.lit("(.{1,%d})" % size), F.lit(1))).alias("k", "part"))
    runs = parts.select("chrom", (F.col("offset") + F.col("k") * size).alias("o"), F.posexplode(
        F.regexp_extract_all("part", F.lit("(0+|1+)"), F.lit(1))).alias("i", "run"))
    w = Window.partitionBy("chrom", "o").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    at = (F.col("o") + F.coalesce(F.sum(F.length("run")).over(w), F.lit(0))).cast("int")
    seg = runs.withColumn("start", at).filter(F.col("run").startswith("1"))
    return merge_intervals(seg.select("chrom", "start", (F.col("start") + F.length("run") - 1).alias("end")))
