"""Column helpers: fixed-point values, ratios, names and classes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIX = 10000  # fixed value: signals are stored as integers of 1/10000


def to_fixed(value: Column) -> Column:
    """Double to fixed point; the cast truncates toward zero."""
    return (value * F.lit(float(FIX))).cast("long")


def from_fixed(v: Column) -> Column:
    return v / F.lit(float(FIX))


def fixed_multiply(v: Column, w: Column) -> Column:
    return (v * w).cast("long")


def fixed_divide(v: Column, w: Column) -> Column:
    return F.coalesce(F.try_divide(v.cast("double"), w).cast("long"), F.lit(0).cast("long"))


def safe_ratio(a: Column, b: Column) -> Column:
    """a/b, and 0 when b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def strip_chr(c: Column) -> Column:
    return F.regexp_replace(c, "^chr", "")


def roman_chrom(c: Column) -> Column:
    """1..16 become I..XVI, every other name stays."""
    # fixed values: yeast chromosome numerals
    numerals = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII",
                "IX", "X", "XI", "XII", "XIII", "XIV", "XV", "XVI"]
    out = c
    cond = None
    for i, r in enumerate(numerals, 1):
        cond = F.when(c == str(i), r) if cond is None else cond.when(c == str(i), r)
    return cond.otherwise(out)


def biotype_class(c: Column) -> Column:
    """Display class of a gene biotype; the first matching substring wins."""
    return (F.when(c.contains("protein_coding"), "protein_coding")
            .when(c.contains("noncoding RNA"), "noncoding RNA")
            .when(c.contains("lincRNA"), "lincRNA")
            .when(c.contains("antisense"), "antisense")
            .when(c.contains("RNA"), "RNA")
            .when(c.contains("pseudo"), "pseudo")
            .otherwise("other"))


def stain_class(c: Column) -> Column:
    """Display class of a cytoband stain."""
    return (F.when(c == "acen", "acen")
            .when(c == "gneg", "gneg")
            .when(c.isin("gpos25", "gpos33", "stalk"), "gpos25")
            .when(c == "gpos50", "gpos50")
            .when(c.isin("gpos66", "gpos75"), "gpos75")
            .when(c.isin("gpos100", "gvar"), "gpos100")
            .otherwise("unknown"))


def clip_to_scale(value: Column, scale: float, bars: int = 2, show_negative: bool = False,
                  bars_minus: int = 0) -> Column:
    """Value as drawn: at most ``scale*bars``; negatives become 0 unless shown,
    and then stop at ``scale*bars_minus`` below the axis."""
    top = F.least(value, F.lit(float(scale * bars)))
    low = F.lit(-float(scale * bars_minus)) if show_negative else F.lit(0.0)
    return F.greatest(top, low)


def drop_sex_mito(df: DataFrame, include: bool = False) -> DataFrame:
    """Leave out Y, M and Mt unless asked for; names may carry a chr prefix."""
    if include:
        return df
    return df.filter(~strip_chr(F.col("chrom")).isin("Y", "M", "Mt"))


def only_chrom(df: DataFrame, genome: DataFrame, name: str) -> DataFrame:
    """One chromosome; it must be in the genome table."""
    if genome.filter(F.col("chrom") == name).limit(1).count() == 0:
        raise ValueError(f"chromosome {name} is not in the genome table")
    return df.filter(F.col("chrom") == name)


def autosomes(genome: DataFrame, include_all: bool = False) -> DataFrame:
    """Numerically named chromosomes."""
    if include_all:
        return genome
    out = genome.filter(strip_chr(F.col("chrom")).rlike("^[0-9]+$"))
    if out.limit(1).count() == 0:
        raise ValueError("no numerically named chromosome; use include_all")
    return out
