"""Tiling: the genome is cut into equal tiles so that no window, sort or merge
ever holds a whole chromosome.

Rows are shuffled on (keys, tile). A tile gets copies of the neighbour rows
within ``halo``; the operator works inside the tile and keeps its own rows.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE_BINS = 8192
TILE_BP = 65536


def div(a: Column | str, d: int) -> Column:
    """Non-negative integer division to int."""
    a = F.col(a) if isinstance(a, str) else a
    return F.floor(a / F.lit(d)).cast("int")


def spread(df: DataFrame, pos: str, halo: int, tile: int) -> DataFrame:
    """Add ``tile``; rows within ``halo`` of another tile are copied to it."""
    first = div(F.greatest(F.col(pos) - halo, F.lit(0)), tile)
    last = div(F.col(pos) + halo, tile)
    if halo == 0:
        return df.withColumn("tile", div(pos, tile))
    return df.withColumn("tile", F.explode(F.sequence(first, last)))


def by_tile(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shuffle on (keys, tile) into the configured number of partitions.

    Rows multiply behind this shuffle (zeros, neighbours), so the number is
    fixed and not lowered by the size of what is shuffled.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys, "tile")


def own_rows(df: DataFrame, pos: str, tile: int) -> DataFrame:
    return df.filter(div(pos, tile) == F.col("tile"))


def cut_to_tiles(df: DataFrame, tile: int = TILE_BP) -> DataFrame:
    """Cut closed intervals at tile borders; adds ``tile``."""
    out = df.withColumn("tile", F.explode(F.sequence(div("start", tile), div("end", tile))))
    return (out.withColumn("start", F.greatest(F.col("start"), F.col("tile") * tile))
            .withColumn("end", F.least(F.col("end"), F.col("tile") * tile + (tile - 1))))


def stitch(runs: DataFrame, keys: Sequence[str], tile: int, aggs: Sequence[Column],
           first: str = "start", last: str = "end") -> DataFrame:
    """Join runs that were cut at tile borders.

    Runs inside a tile are final. Runs that touch a border meet in one group
    per key, which holds at most two rows per tile of one chromosome.
    ``aggs`` must merge the payload; ``first``/``last`` are merged here.
    """
    keys = list(keys)
    edge = (F.col(first) % tile == 0) | (F.col(last) % tile == tile - 1)
    df = runs.withColumn("_grp", F.when(edge, -1).otherwise(div(first, tile)))
    w = Window.partitionBy(*keys, "_grp").orderBy(first)
    breaks = F.coalesce((F.lag(last).over(w) + 1 < F.col(first)).cast("int"), F.lit(1))
    df = df.withColumn("_break", breaks)
    df = df.withColumn("_run", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (df.groupBy(*keys, "_grp", "_run")
            .agg(F.min(first).alias(first), F.max(last).alias(last), *aggs)
            .drop("_grp", "_run"))
