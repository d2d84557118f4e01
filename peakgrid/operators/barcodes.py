"""Barcoded reads (barcode, chrom, pos): fragments by gap, views, identical fragments.

Positions stay rows with a count; no barcode is ever gathered into one list, so
a barcode with a large share of the reads is spread over its tiles.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tiles import div

GAP = 100_000
TILE = 1 << 20


def multi_hit_barcodes(reads: DataFrame) -> DataFrame:
    """Reads of barcodes seen more than once in the whole file."""
    many = reads.groupBy("barcode").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).select("barcode")
    return reads.join(many, "barcode", "left_semi")


def barcode_positions(reads: DataFrame) -> DataFrame:
    """Positions of every (chrom, barcode) with their count ``n``."""
    return reads.groupBy("chrom", "barcode", "pos").agg(F.count("*").alias("n"))


def split_by_gap(positions: DataFrame, threshold: int = GAP, tile: int = TILE) -> DataFrame:
    """Cut barcodes where neighbour positions differ by more than ``threshold``.

    Adds ``frag``, the first position of the fragment. A position opens a
    fragment when nothing lies within the threshold before it, which the tile
    and its left halo decide; the open fragment of earlier tiles comes from a
    table with one row per barcode and tile.
    """
    keys = ["chrom", "barcode"]
    home = div("pos", tile)
    spread = positions.withColumn("tile", F.explode(F.sequence(home, div(F.col("pos") + threshold, tile))))
    w = Window.partitionBy(*keys, "tile").orderBy("pos")
    prev = F.lag("pos").over(w)
    opened = (spread.withColumn("_open", F.when(prev.isNull() | (F.col("pos") - prev > threshold), F.col("pos")))
              .filter(home == F.col("tile")))
    inside = opened.withColumn("_in", F.max("_open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = opened.groupBy(*keys, "tile").agg(F.max("_open").alias("_last"))
    v = Window.partitionBy(*keys).orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(*keys, "tile", F.max("_last").over(v).alias("_carry"))
    return (inside.join(carry, [*keys, "tile"])
            .withColumn("frag", F.coalesce("_in", "_carry")).drop("tile", "_open", "_in", "_carry"))


def _spans(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.sum("n").alias("size"))


def _in_view(start: int, end: int):
    touches = (F.col("last") >= start) & (F.col("first") <= end)
    spans = (F.col("first") < start) & (F.col("last") > end)
    return (F.col("size") > 1) & touches & ~spans


def barcodes_in_window(positions: DataFrame, chrom: str, start: int, end: int, threshold: int = GAP) -> DataFrame:
    """Fragments of a view with their positions.

    The whole barcode, then each fragment, must have two positions or more,
    touch the view and not reach over both of its ends.
    """
    on_chrom = positions.filter(F.col("chrom") == chrom)
    whole = _spans(on_chrom, ["chrom", "barcode"]).filter(_in_view(start, end)).select("chrom", "barcode")
    frags = split_by_gap(on_chrom.join(whole, ["chrom", "barcode"], "left_semi"), threshold)
    keys = ["chrom", "barcode", "frag"]
    keep = _spans(frags, keys).filter(_in_view(start, end))
    return frags.join(keep, keys)


def collapse_identical(fragments: DataFrame, start: int) -> DataFrame:
    """Fragments with equal position lists as one row with their number, in drawing order.

    Lists are compared by span, size and two hashes of their positions; then every
    position of a group must occur in all of its fragments, or the query stops.
    Order: fragments that begin before the
    view by last position, then the others by first and last.
    """
    keys = ["chrom", "barcode", "frag"]
    item = F.struct("pos", "n")
    prints = fragments.groupBy(*keys).agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.sum("n").alias("size"),
        F.bit_xor(F.xxhash64(item)).alias("h1"), F.bit_xor(F.xxhash64(F.lit(7), item)).alias("h2"))
    group = ["chrom", "first", "last", "size", "h1", "h2"]
    counted = prints.groupBy(*group).agg(F.count("*").alias("n_same"))
    rows = fragments.select(*keys, "pos", "n").join(prints, keys)
    check = (rows.groupBy(*group, "pos", "n").agg(F.count("*").alias("c"))
             .join(counted, group)
             .groupBy(*group).agg(F.max("n_same").alias("n_same"), F.min(F.col("c") == F.col("n_same")).alias("same")))
    ok = F.when(F.col("same"), F.col("n_same")).otherwise(
        F.raise_error(F.lit("different position lists share their hashes")).cast("long"))
    early = F.col("first") < start
    out = check.select("chrom", "first", "last", "size", ok.alias("n_same"), early.alias("before_view"))
    return out.orderBy(F.col("before_view").desc(), F.when(F.col("before_view"), F.col("last")).otherwise(F.col("first")),
                       "last", "size")


def largest_group(collapsed: DataFrame) -> DataFrame:
    """The maximum number of identical fragments, per chromosome."""
    return collapsed.groupBy("chrom").agg(F.max("n_same").alias("max_count"), F.count("*").alias("n_lines"))
