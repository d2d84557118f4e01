"""Gene annotation files."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import roman_chrom, strip_chr
from ..operators.genes import assemble_transcripts, tag_rank
from .lines import at, fields, ordered_lines, text_lines


def _rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    rows = text_lines(spark, paths).filter((F.col("value") != "") & ~F.col("value").startswith("#"))
    return rows.withColumn("f", fields(F.col("value")))


def read_refflat(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """refFlat genes, one row per (chrom, transcript name); the last row of a name wins.

    The biotype is column 13, else 12; else by accession once any NM/NR name is in the file.
    """
    rows = (ordered_lines(spark, paths).filter((F.col("value") != "") & ~F.col("value").startswith("#"))
            .withColumn("f", fields(F.col("value"))))
    tname = F.col("f")[1]
    has_nm = rows.agg(F.coalesce(F.bool_or(tname.contains("NM") | tname.contains("NR")), F.lit(False))).first()[0]
    by_name = F.when(tname.contains("NM"), "protein_coding").otherwise("noncoding RNA") if has_nm else F.lit("")
    gtype = F.coalesce(at("f", 12), at("f", 11), by_name)
    n = at("f", 8, "int")

    def numbers(i: int) -> Column:
        return F.transform(F.slice(F.split(F.col("f")[i], ","), F.lit(1), n), lambda x: x.cast("int"))

    exon = F.transform(F.arrays_zip(numbers(9).alias("start"), numbers(10).alias("end")),
                       lambda z: F.struct(z["start"].alias("start"), z["end"].alias("end")))
    out = rows.select(
        strip_chr(F.col("f")[2]).alias("chrom"), tname.alias("tname"), F.struct(
            F.col("f")[0].alias("gname"), F.col("f")[3].alias("strand"), at("f", 4, "int").alias("tx_start"),
            at("f", 5, "int").alias("tx_end"), at("f", 6, "int").alias("cds_start"), at("f", 7, "int").alias("cds_end"),
            exon.alias("exon"), gtype.alias("gtype")).alias("g"), F.struct("file", "block", "line").alias("o"))
    return (out.groupBy("chrom", "tname").agg(F.max_by("g", "o").alias("g"))
            .select("chrom", F.col("tname").alias("tid"), F.col("g.gname").alias("gid"), "tname", F.col("g.gname").alias("gname"),
                    "g.strand", "g.tx_start", "g.tx_end", "g.cds_start", "g.cds_end", "g.exon", "g.gtype",
                    F.lit("").alias("ttype"), F.lit("").alias("tag")))


def gtf_rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows of a GTF or GFF3 file with their attributes."""
    rows = _rows(spark, paths).filter(F.size("f") >= 9).withColumn("a", F.col("f")[8])

    def attribute(*keys: str) -> Column:
        name = "|".join(keys)
        gtf = F.regexp_extract("a", rf'(?:^|;)\s*(?:{name})\s+"([^"]*)"', 1)
        bare = F.regexp_extract("a", rf"(?:^|;)\s*(?:{name})\s+([^\";\s]+)", 1)
        gff = F.regexp_extract("a", rf"(?:^|;)\s*(?:{name})=([^;]*)", 1)
        return F.when(gff != "", gff).when(gtf != "", gtf).otherwise(bare)

    tags = F.concat(F.regexp_extract_all("a", F.lit(r'(?:^|;)\s*tag\s+"([^"]*)"'), F.lit(1)),
                    F.flatten(F.transform(F.regexp_extract_all("a", F.lit(r"(?:^|;)\s*tag=([^;]*)"), F.lit(1)),
                                          lambda x: F.split(x, ","))))
    ranked = F.sort_array(F.transform(tags, lambda x: F.struct(tag_rank(x).alias("r"), x.alias("t"))), asc=False)
    tag = F.coalesce(F.try_element_at(ranked, F.lit(1))["t"], F.lit(""))
    return rows.select(strip_chr(F.col("f")[0]).alias("chrom"), F.col("f")[2].alias("feature"), at("f", 3, "int").alias("start"),
                       at("f", 4, "int").alias("end"), F.col("f")[6].alias("strand"), attribute("gene_id").alias("gid"),
                       attribute("transcript_id").alias("tid"), attribute("gene_name").alias("gname"),
                       attribute("transcript_name").alias("tname"), attribute("gene_biotype", "gene_type").alias("gtype"),
                       attribute("transcript_biotype", "transcript_type").alias("ttype"), tag.alias("tag"))


def read_gtf(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Transcripts of a GTF or GFF3 file; rows without a transcript id are left out."""
    return assemble_transcripts(gtf_rows(spark, paths))


def _feature(chrom: Column, name: Column, start: Column, end: Column, strand: Column, gtype: Column, tid: Column) -> list:
    return [chrom.alias("chrom"), tid.alias("tid"), name.alias("gname"), strand.alias("strand"),
            start.alias("tx_start"), end.alias("tx_end"), gtype.alias("gtype")]


def read_sgd(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Yeast features; types without a naming rule are left out, strand C swaps the ends."""
    rows = _rows(spark, paths)
    kind, name, gene = F.col("f")[1], at("f", 3), at("f", 4)
    chrom = roman_chrom(strip_chr(F.col("f")[8]))
    minus = F.col("f")[11] == "C"
    label = (F.when(kind == "centromere", F.concat(F.lit("CEN_chr"), chrom)).when(kind == "teromere", name)
             .when(kind.isin("ORF", "tRNA"), F.when(gene != "", gene).otherwise(name))
             .when(kind == "rRNA", "rRNA").when(kind == "snoRNA", "snoRNA").when(kind == "long_terminal_repeat", "LTR")
             .when(kind == "repeat_region", at("f", 6)).when(kind == "retrotransposon", name))
    start, end = at("f", 9, "int"), at("f", 10, "int")
    strand = F.when(kind.isin("centromere", "teromere"), "").when(minus, "-").otherwise("+")
    return rows.select(*_feature(chrom, label, F.when(minus, end).otherwise(start), F.when(minus, start).otherwise(end),
                                 strand, kind, F.col("f")[0])).filter(F.col("gname").isNotNull())


def read_ars(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Replication origins; names get the prefix ARS_ unless they hold ARS."""
    rows = _rows(spark, paths).filter(~F.col("value").contains("Status"))
    name = F.when(F.col("f")[2].contains("ARS"), F.col("f")[2]).otherwise(F.concat(F.lit("ARS_"), F.col("f")[2]))
    return rows.select(*_feature(roman_chrom(strip_chr(F.col("f")[4])), name, at("f", 5, "int"), at("f", 6, "int"),
                                 F.lit(""), F.lit("ARS"), name))


def read_ter(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Termination sites: name, chrom, start, end."""
    rows = _rows(spark, paths).filter(~F.col("value").contains("#") & ~F.col("value").contains("Name"))
    return rows.select(*_feature(roman_chrom(strip_chr(F.col("f")[1])), F.col("f")[0], at("f", 2, "int"), at("f", 3, "int"),
                                 F.lit(""), F.lit("TER"), F.col("f")[0]))
