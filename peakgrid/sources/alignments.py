"""Aligned reads from text SAM, TagAlign and Bowtie files."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import READS
from .lines import at, fields

SUFFIXES = {".sam": "SAM", ".sam.gz": "SAM", ".tagAlign": "TAGALIGN", ".tagAlign.gz": "TAGALIGN",
            ".bowtie": "BOWTIE", ".bowtie.gz": "BOWTIE"}


def format_of(path: str) -> str:
    """Format by file suffix."""
    for suffix, name in SUFFIXES.items():
        if path.endswith(suffix):
            return name
    raise ValueError(f"cannot tell the format of {path}; name it")


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _sam(rows: DataFrame, paired: bool) -> DataFrame:
    """One row per aligned primary read; in paired mode the first read of a pair carries the fragment."""
    r = rows.filter(~F.col("value").startswith("@")).withColumn("f", fields(F.col("value")))
    r = r.withColumn("flag", at("f", 1, "int")).withColumn("pos", at("f", 3, "int") - 1)
    r = r.filter((F.col("flag").bitwiseAND(0x4) == 0) & (F.col("flag").bitwiseAND(0x900) == 0))
    spans = F.regexp_extract_all(at("f", 5), F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    r = r.withColumn("span", F.aggregate(spans, F.lit(0), lambda a, x: a + x.cast("int")))
    if paired:
        r = r.filter((F.col("flag").bitwiseAND(0x1) != 0) & (F.col("flag").bitwiseAND(0x40) != 0))
    minus = F.col("flag").bitwiseAND(0x10) != 0
    f3 = F.when(minus, F.col("pos") + F.col("span") - 1).otherwise(F.col("pos"))
    nh = F.regexp_extract("value", r"\tNH:i:(\d+)", 1)
    is_pair = F.col("flag").bitwiseAND(0x1) != 0
    mate = F.when(is_pair, F.when(at("f", 6) == "=", at("f", 2)).otherwise(at("f", 6)))
    tlen = F.when(is_pair, F.abs(at("f", 8, "int")))
    f5 = F.when(is_pair & F.lit(paired) & (tlen > 0), F.when(minus, f3 - tlen + 1).otherwise(f3 + tlen - 1))
    return r.select("sample", "read_id", at("f", 2).alias("chrom"), F.when(minus, "-").otherwise("+").alias("strand"),
                    f3.alias("f3"), f5.alias("f5"), F.length(at("f", 9)).alias("len_f3"), _null("int").alias("len_f5"),
                    F.when(nh != "", nh).cast("int").alias("nh"), mate.alias("mate_chrom"), tlen.alias("tlen"))


def _tagalign(rows: DataFrame) -> DataFrame:
    r = rows.filter((F.col("value") != "") & ~F.col("value").startswith("#")).withColumn("f", fields(F.col("value")))
    s, e, minus = at("f", 1, "int"), at("f", 2, "int"), at("f", 5) == "-"
    return r.select("sample", "read_id", at("f", 0).alias("chrom"), F.when(minus, "-").otherwise("+").alias("strand"),
                    F.when(minus, e - 1).otherwise(s).alias("f3"), _null("int").alias("f5"), (e - s).alias("len_f3"),
                    _null("int").alias("len_f5"), _null("int").alias("nh"), _null("string").alias("mate_chrom"),
                    _null("int").alias("tlen"))


def _bowtie(rows: DataFrame) -> DataFrame:
    r = rows.filter(F.col("value") != "").withColumn("f", fields(F.col("value")))
    s, n, minus = at("f", 3, "int"), F.length(at("f", 4)), at("f", 1) == "-"
    return r.select("sample", "read_id", at("f", 2).alias("chrom"), F.when(minus, "-").otherwise("+").alias("strand"),
                    F.when(minus, s + n - 1).otherwise(s).alias("f3"), _null("int").alias("f5"), n.alias("len_f3"),
                    _null("int").alias("len_f5"), _null("int").alias("nh"), _null("string").alias("mate_chrom"),
                    _null("int").alias("tlen"))


def read_alignments(spark: SparkSession, paths: str | list[str], sample: str, fmt: str | None = None,
                    paired: bool = False) -> DataFrame:
    """Reads of one sample; several files (or a comma list) are pooled. A named format wins over the suffix.

    The parser is specified by its file formats only. Positions are 0-based; f3 is the 5' end.
    """
    names = paths.split(",") if isinstance(paths, str) else list(paths)
    by_format: dict[str, list[str]] = {}
    for p in names:
        by_format.setdefault(fmt or format_of(p), []).append(p)
    out = None
    for i, (kind, files) in enumerate(sorted(by_format.items())):
        rows = spark.read.text(files).select(
            F.lit(sample).alias("sample"), (F.monotonically_increasing_id() + F.lit(i << 58)).alias("read_id"), "value")
        one = _sam(rows, paired) if kind == "SAM" else _tagalign(rows) if kind == "TAGALIGN" else _bowtie(rows)
        out = one if out is None else out.unionByName(one)
    out = out.withColumn("weight", F.lit(1.0))
    return out.select(*[F.col(f.name).cast(f.dataType) for f in READS.fields])


def union_alignments(parts: list[DataFrame]) -> DataFrame:
    """Pool read tables. Ids are made distinct by the number of the part."""
    out = parts[0]
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("read_id", F.col("read_id") + F.lit(i << 55)))
    return out
