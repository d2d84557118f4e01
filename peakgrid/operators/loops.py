"""Chromatin loops: two anchors (structs first, second) and a value."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_ratio
from ..functions.tiles import div
from ..session import cut, derived_lookup
from .intervals import overlaps_any

MIN_MAXIMUM = 1e-10


def intra_loops(loops: DataFrame, chrom: str | None = None) -> DataFrame:
    """Loops with both anchors on one (the given) chromosome."""
    out = loops.filter(F.col("first.chrom") == F.col("second.chrom"))
    return out if chrom is None else out.filter(F.col("first.chrom") == chrom)


def _mid(anchor: str) -> Column:
    return div(F.col(f"{anchor}.start") + F.col(f"{anchor}.end"), 2)


def loops_in_window(loops: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Loops with an anchor midpoint in the view: both, head or tail."""
    head, tail = _mid("first").between(start, end), _mid("second").between(start, end)
    side = F.when(head & tail, "both").when(head, "head").when(tail, "tail")
    return intra_loops(loops, chrom).withColumn("side", side).filter(F.col("side").isNotNull())


def loop_intensity(loops: DataFrame, by: str | None = None) -> DataFrame:
    """val / max(val) x 3 over the finite values of a set; the maximum is at least 1e-10."""
    finite = F.when(F.abs("val") < float("inf"), F.col("val"))
    top = F.greatest(F.coalesce(F.max(finite), F.lit(MIN_MAXIMUM)), F.lit(MIN_MAXIMUM)).alias("_top")
    if by is None:
        maximum = loops.agg(top).first()[0]
        return loops.withColumn("intensity", F.col("val") / F.lit(maximum) * 3)
    tops = derived_lookup(loops.groupBy(by).agg(top))
    return loops.join(tops, by).withColumn("intensity", F.col("val") / F.col("_top") * 3).drop("_top")


def _span_flag(spans: DataFrame, bed: DataFrame, name: str) -> DataFrame:
    hit = overlaps_any(spans.select("chrom", "start", "end"), bed).withColumn(name, F.lit(True))
    return spans.join(hit, ["chrom", "start", "end"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def loop_anchor_flags(loops: DataFrame, bed1: DataFrame, bed2: DataFrame) -> DataFrame:
    """Loops with four flags: which anchor overlaps which set.

    Equal anchors are matched once; the sets are merged before. The flags are
    joined to both sides, so they are written once.
    """
    spans = loops.select(F.explode(F.array("first", "second")).alias("a")).select("a.*").distinct()
    flags = cut(_span_flag(_span_flag(spans, bed1, "b1"), bed2, "b2"))
    for side in ("first", "second"):
        f = flags.select(F.struct("chrom", "start", "end").alias(side), F.col("b1").alias(f"{side}_1"),
                         F.col("b2").alias(f"{side}_2"))
        loops = loops.join(f, side)
    return loops


def _between(f: DataFrame) -> tuple[Column, Column, Column]:
    a1, a2, b1, b2 = (F.col(c) for c in ("first_1", "first_2", "second_1", "second_2"))
    return (a1 & b2) | (a2 & b1), a1 & b1, a2 & b2


def compare_loops_with_beds(loops: DataFrame, bed1: DataFrame, bed2: DataFrame) -> DataFrame:
    """Counts and percentages: bed1-bed2, bed1-bed1, bed2-bed2 may overlap; the rest is exclusive."""
    flags = loop_anchor_flags(loops, bed1, bed2)
    ab, aa, bb = _between(flags)
    rest = ~(ab | aa | bb)
    any1, any2 = F.col("first_1") | F.col("second_1"), F.col("first_2") | F.col("second_2")
    kinds = {"bed1-bed2": ab, "bed1-bed1": aa, "bed2-bed2": bb, "bed1-none": rest & any1,
             "bed2-none": rest & ~any1 & any2, "none": rest & ~any1 & ~any2}
    one = flags.agg(F.count("*").alias("total"),
                    *[F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long")).alias(k) for k, c in kinds.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"`{k}`").alias("n")) for k in kinds])).alias("k")
    return one.select("total", rows).select(
        "k.kind", "k.n", (100.0 * safe_ratio(F.col("k.n"), F.col("total"))).alias("pct"))


def loops_between_beds(loops: DataFrame, bed1: DataFrame, bed2: DataFrame) -> DataFrame:
    """Loops that join an interval of each set."""
    flags = loop_anchor_flags(loops, bed1, bed2)
    return flags.filter(_between(flags)[0]).drop("first_1", "first_2", "second_1", "second_2")


def beds_hit_by_loops(bed: DataFrame, loops: DataFrame) -> DataFrame:
    """Intervals that overlap any anchor."""
    anchors = loops.select(F.explode(F.array("first", "second")).alias("a")).select("a.*")
    return overlaps_any(bed, anchors)
