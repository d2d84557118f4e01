"""Enrichment scores as column expressions.

Both scores are -log10 of the probability mass at the observed count (not of a
tail); thresholds are meant for that scale.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LN10 = math.log(10.0)
UNDERFLOW = -745.13  # ln of the smallest positive double
FLOOR_SCORE = 300.0


def ln_factorial(k: Column) -> Column:
    """ln k! by the Stirling series at k+8, taken down with the rising product."""
    x = k.cast("double") + 1.0
    z = x + 7.0
    r = F.pow(z, F.lit(-1.0))
    r2 = F.pow(z, F.lit(-2.0))
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2.0 * math.pi) + r * (
        F.lit(1.0 / 12.0) - r2 * (F.lit(1.0 / 360.0) - r2 * (F.lit(1.0 / 1260.0) - r2 * (1.0 / 1680.0))))
    product = x
    for i in range(1, 7):
        product = product * (x + float(i))
    return series - F.log(product)


def evaluate_once(df: DataFrame, *cols: str) -> DataFrame:
    """Fix the named columns behind a generator of one row.

    A later filter on them is then not pushed below their projection, where the
    long formulas would be written out and computed a second time.
    """
    rest = [c for c in df.columns if c not in cols]
    return df.select(*rest, F.inline(F.array(F.struct(*cols))))


def _score(ln_p: Column) -> Column:
    return F.when(ln_p < UNDERFLOW, FLOOR_SCORE).otherwise(-ln_p / LN10)


def with_poisson_score(df: DataFrame, value: Column, mean: Column, name: str) -> DataFrame:
    """Add -log10 of the Poisson(mean) mass at int(value); 0 unless value > mean > 0.

    The operands are columns of their own first: the series names them many
    times, and one projection with everything inlined outgrows generated code.
    """
    df = df.withColumn("_v", value).withColumn("_m", mean)
    df = df.withColumn("_k", F.floor("_v").cast("double"))
    k, m = F.col("_k"), F.col("_m")
    safe = F.when(m > 0, m).otherwise(1.0)
    ln_p = k * F.log(safe) - safe - ln_factorial(k)
    df = df.withColumn("_lp", ln_p)
    return (df.withColumn(name, F.when((m > 0) & (F.col("_v") > m), _score(F.col("_lp"))).otherwise(0.0))
            .drop("_v", "_m", "_k", "_lp"))


def with_binomial_score(df: DataFrame, chip: Column, control: Column, ratio: Column, name: str) -> DataFrame:
    """Add -log10 of the Binomial(1/2) mass of the ChIP count.

    The larger sample is scaled down and both are rounded up; 0 when ChIP is behind.
    An underflow needs n1 > n2, which holds for every count that can underflow.
    """
    big = ratio > 1
    n1 = F.when(big, F.ceil(chip / F.when(big, ratio).otherwise(1.0))).otherwise(F.ceil(chip))
    n2 = F.when(big, F.ceil(control)).otherwise(F.ceil(control * ratio))
    df = df.withColumn("_n1", n1.cast("double")).withColumn("_n2", n2.cast("double"))
    a, b = F.col("_n1"), F.col("_n2")
    df = df.withColumn("_n", a + b)
    for c in ("_n", "_n1", "_n2"):
        df = df.withColumn("_f" + c, ln_factorial(F.col(c)))
    df = df.withColumn("_lp", F.col("_f_n") - F.col("_f_n1") - F.col("_f_n2") - F.col("_n") * math.log(2.0))
    df = df.withColumn(name, F.when((a < b) | (F.col("_n") == 0), 0.0).otherwise(_score(F.col("_lp"))))
    return df.drop("_n", "_n1", "_n2", "_f_n", "_f_n1", "_f_n2", "_lp")


def scaled_ratio(chip: Column, control: Column, ratio: Column) -> Column:
    """ChIP / control x total ratio, 0 where the control is 0."""
    return F.when(control != 0, F.try_divide(chip, control) * ratio).otherwise(0.0)


def log_ratio(value: Column, base: float) -> Column:
    """log of the value to ``base``; 0 stays 0."""
    return F.when(value > 0, F.log(value) / math.log(base)).otherwise(0.0)
